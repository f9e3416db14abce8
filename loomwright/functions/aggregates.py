"""Aggregate functions. All reduce on the map side first, except those that gather values by nature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rec import col


def filtered(agg, x, mask) -> Column:
    """An aggregate over the rows where the mask is true."""
    return agg(F.when(col(mask), col(x)))


def arbitrary(x) -> Column:
    return F.any_value(col(x), ignoreNulls=True)


def array_agg(x) -> Column:
    """All values, nulls kept, in no order."""
    return F.transform(F.collect_list(F.struct(col(x).alias("v"))), lambda s: s["v"])


def map_agg(k, v) -> Column:
    """A map of keys and values; of a key that repeats, one of its values."""
    pairs = F.collect_list(F.when(col(k).isNotNull(), F.struct(col(k).alias("k"), col(v).alias("v"))))
    one = F.aggregate(
        pairs,
        F.slice(pairs, 1, 0),
        lambda s, e: F.when(F.exists(s, lambda x: x["k"] == e["k"]), s).otherwise(F.concat(s, F.array(e))),
    )
    return F.map_from_entries(one)


def map_agg_unique(k, v) -> Column:
    """map_agg for keys known not to repeat."""
    return F.map_from_entries(F.collect_list(F.when(col(k).isNotNull(), F.struct(col(k).alias("k"), col(v).alias("v")))))


def map_union(df: DataFrame, keys: list[str], m: str, out: str) -> DataFrame:
    """One map of all maps of a group; of a key that repeats, its least value. Entries are reduced before they are gathered."""
    entries = df.select(*keys, F.explode(m).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.min("_v").alias("_v"))
    return entries.groupBy(*keys).agg(map_agg_unique("_k", "_v").alias(out))


def histogram(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """Values and how often each occurs, as a map per group. Counted first, then gathered."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(map_agg_unique(x, "_n").alias(out))


def approx_most_frequent(df: DataFrame, keys: list[str], x: str, buckets: int, out: str) -> DataFrame:
    """The most frequent values and their counts, as a map; exact here, ties by value."""
    from pyspark.sql import Window as W

    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n"), x)) if keys else F.row_number().over(W.orderBy(F.desc("_n"), x))
    return counts.withColumn("_r", rank).where(F.col("_r") <= buckets).groupBy(*keys).agg(map_agg_unique(x, "_n").alias(out))


def approx_distinct(x, error: float = 0.023) -> Column:
    return F.approx_count_distinct(col(x), error)


def approx_percentile(x, p, weight=None, accuracy: int = 10000) -> Column:
    """Approximate percentiles; with weights exact ones, by frequency."""
    if weight is not None:
        return F.percentile(col(x), p, col(weight))
    return F.percentile_approx(col(x), p, accuracy)


def checksum(*xs) -> Column:
    """A digest of a bag of rows that doesn't depend on their order. Sums wrap by going through decimals."""
    return F.pmod(F.sum(F.xxhash64(*[col(x) for x in xs]).cast("decimal(38,0)")), F.lit(str(1 << 64)).cast("decimal(20,0)"))


def count_if(x) -> Column:
    return F.count_if(col(x))


def max_data_size_for_stats(x) -> Column:
    """Bytes of the longest text or binary value."""
    return F.max(F.octet_length(col(x)))


def approx_set(x) -> Column:
    """A sketch of the distinct values."""
    return F.hll_sketch_agg(col(x))


def merge_sets(x) -> Column:
    return F.hll_union_agg(col(x))


def set_cardinality(x) -> Column:
    return F.hll_sketch_estimate(col(x))


def empty_approx_set(spark) -> DataFrame:
    """One row with the sketch of nothing."""
    return spark.range(0).agg(F.hll_sketch_agg("id").alias("sketch"))
