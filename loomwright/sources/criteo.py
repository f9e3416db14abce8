"""Click-log sources: tab-separated files, their columnar forms, and dense re-numbering of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbering import numbered
from .tables import materialize

DENSE = [f"int_{i}" for i in range(13)]
SPARSE = [f"cat_{i}" for i in range(26)]
COLUMNS = ["label", *DENSE, *SPARSE]


def safe_cast(x, to: str, default) -> Column:
    """x as another type, or the default where that fails or x is null."""
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(c.try_cast(to), F.lit(default).cast(to))


def hex32(x) -> Column:
    """A 32-bit number written in hex as a signed int; missing or bad text is 0."""
    c = F.col(x) if isinstance(x, str) else x
    ok = F.rlike(c, F.lit("^[0-9a-fA-F]{1,8}$"))
    n = F.conv(F.when(ok, c), 16, 10).cast("bigint")
    return F.coalesce(F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n), F.lit(0)).cast("int")


def read_tsv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """label, 13 dense and 26 sparse columns; missing or bad fields are 0."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
    raw = spark.read.csv(list(paths) if not isinstance(paths, str) else paths, sep="\t", schema=schema)
    return typed(raw)


def typed(raw: DataFrame) -> DataFrame:
    return raw.select(*[safe_cast(c, "int", 0).alias(c) for c in ["label", *DENSE]], *[hex32(c).alias(c) for c in SPARSE])


def dense_log(df: DataFrame) -> DataFrame:
    """Dense columns as float ln(x + 3)."""
    return df.withColumns({c: F.log(F.coalesce(F.col(c), F.lit(0)).cast("double") + 3).cast("float") for c in DENSE})


def contiguous_ids(df: DataFrame, columns: Sequence[str], threshold: int = 0) -> DataFrame:
    """(column, id, new) for the ids of each column that occur `threshold` times or more: new runs from 2 by descending frequency, then by id.

    All columns are counted in one pass, reduced on the map side, and numbered over ranges of one sort.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("id")) for c in columns])
    counts = df.select(F.explode(pairs).alias("x")).select("x.column", "x.id").where("id IS NOT NULL").groupBy("column", "id").agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(counts.where(F.col("n") >= threshold), ["column", F.desc("n"), "id"], "place")
    first = placed.groupBy(F.col("column").alias("_c")).agg(F.min("place").alias("_first"))  # a row per column
    return placed.join(F.broadcast(first), F.col("column") == F.col("_c")).select("column", "id", (F.col("place") - F.col("_first") + 2).alias("new"))


def sparse_to_contiguous(df: DataFrame, columns: Sequence[str], threshold: int = 0) -> DataFrame:
    """Each column's ids numbered from 2 by descending frequency; ids rarer than the threshold become 1, nulls stay.

    The way back is a join per column with its numbers, which Spark broadcasts only if they are small.
    """
    ids = materialize(contiguous_ids(df, columns, threshold), "contiguous-ids")
    out = df
    for c in columns:
        mine = ids.where(F.col("column") == c).select(F.col("id").alias("_id"), F.col("new").alias("_new"))
        out = out.join(mine, out[c].cast("bigint") == mine["_id"], "left").withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce("_new", F.lit(1).cast("bigint")))).drop("_id", "_new")
    return out


def categorify(df: DataFrame, columns: Sequence[str], buckets: int) -> DataFrame:
    """Ids hashed into so many buckets."""
    return df.withColumns({c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(buckets)) for c in columns})


def etl(df: DataFrame, buckets: int) -> DataFrame:
    """Missing values filled, ids into buckets, dense columns log1p(x + 2)."""
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in DENSE + SPARSE})
    dense = filled.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(-2)) + F.lit(2.0)).cast("float") for c in DENSE})
    return categorify(dense, SPARSE, buckets)


def shuffle_rows(df: DataFrame, seed: int) -> DataFrame:
    """Rows in random order, the same at each run for equal partitions."""
    return df.orderBy(F.rand(seed))


def rank_shard(df: DataFrame, key: str, rank: int, world: int) -> DataFrame:
    """A reader's share of the rows, by hash of the key."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(world)) == rank)


def split_by_index(df: DataFrame, index: str, train: int) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(index) < train), df.where(F.col(index) >= train)


def split_at_random(df: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    a, b = df.randomSplit([share, 1 - share], seed)
    return a, b


def random_dataset(spark: SparkSession, rows: int, hash_sizes: dict[str, int], ids_per_feature: int, n_dense: int, seed: int = 0) -> DataFrame:
    """Random labels, dense values and id lists, made on the executors."""
    base = spark.range(rows)
    dense = {f"int_{i}": F.rand(seed + i).cast("float") for i in range(n_dense)}

    def ids(k: str, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(ids_per_feature)), lambda j: F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed), j), F.lit(n)))

    sparse = {k: ids(k, n) for k, n in hash_sizes.items()}
    return base.withColumns({**dense, **sparse, "label": (F.rand(seed + 1000) < 0.5).cast("int")})


def movielens(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Ratings with their movies' columns; unknown movies give nulls."""
    return ratings.join(movies, "movieId", "left")
