"""Relational operators that need more than one DataFrame call to get their semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def join(probe: DataFrame, build: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", where: Column | None = None, hint: str | None = None) -> DataFrame:
    """Equi-join with an extra filter. how: inner, left, right, full, left_semi, right_semi, left_anti, null_aware_anti.

    No side is broadcast by force: Spark decides by size, at run time too. hint: merge or shuffle_hash.
    """
    if how == "right_semi":
        return join(build, probe, [(b, a) for a, b in on], "left_semi", where, hint)
    if how == "null_aware_anti":
        return null_aware_anti(probe, build, on)
    cond = None
    for a, b in on:
        here = probe[a] == build[b]
        cond = here if cond is None else cond & here
    if where is not None:
        cond = cond & where
    return probe.join(build.hint(hint) if hint else build, cond, how)


def merge_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", where: Column | None = None) -> DataFrame:
    """A join of sorted inputs; inner and left only."""
    if how not in ("inner", "left"):
        raise ValueError("a merge join is inner or left")
    return join(left, right, on, how, where, "merge")


def null_aware_anti(probe: DataFrame, build: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """NOT IN: nothing if the build side has a null key, else rows without a match; probe nulls stay only if it is empty.

    One row, with the build side's count and whether it has nulls, decides the special cases; the rest
    is an ordinary anti-join, so that no side has to fit a broadcast.
    """
    if len(on) != 1:
        raise ValueError("a null-aware anti-join has one key")
    a, b = on[0]
    facts = build.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(b).isNull()).alias("_nulls"))
    rows = probe.join(build.select(F.col(b).alias("_key")).where("_key IS NOT NULL"), probe[a] == F.col("_key"), "left_anti")
    rows = rows.crossJoin(F.broadcast(facts))  # one row
    return rows.where((F.col("_rows") == 0) | ((F.col("_nulls") == 0) & F.col(a).isNotNull())).select(*probe.columns)


def aggregate(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], ignore_null_keys: bool = False) -> DataFrame:
    """Grouped aggregation; with ignore_null_keys, rows with a null key are left out first."""
    if ignore_null_keys:
        for k in keys:
            df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def group_id(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], aggs: dict[str, Column], out: str = "group_id") -> DataFrame:
    """Grouping sets with the number of the set in each row."""
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys])
    ids = {tuple(s): i for i, s in enumerate(sets)}
    number = F.lit(None).cast("int")
    for s, i in ids.items():
        bits = sum(1 << (len(keys) - 1 - j) for j, k in enumerate(keys) if k not in s)
        number = F.when(F.grouping_id(*keys) == bits, F.lit(i)).otherwise(number)
    return grouped.agg(*[c.alias(n) for n, c in aggs.items()], number.alias(out))


def unnest(df: DataFrame, replicate: Sequence[str], arrays: Sequence[str], ordinality: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Arrays side by side as rows, shorter ones padded with null; ordinality counts from 1. A map gives key and value columns."""
    names = list(names or arrays)
    if len(arrays) == 1 and df.schema[arrays[0]].dataType.typeName() == "map":
        k, v = (names if len(names) == 2 else (f"{arrays[0]}_key", f"{arrays[0]}_value"))
        out = df.select(*replicate, F.posexplode(arrays[0]).alias("_at", k, v))
        return out.select(*replicate, k, v, *([(F.col("_at") + 1).cast("bigint").alias(ordinality)] if ordinality else []))
    safe = F.arrays_zip(*[F.when(F.col(a).isNotNull(), F.col(a)).otherwise(F.array().cast(df.schema[a].dataType)).alias(f"_{i}") for i, a in enumerate(arrays)])
    rows = df.select(*replicate, F.posexplode(safe).alias("_at", "_z"))
    cols = [F.col("_z").getField(f"_{i}").alias(n) for i, n in enumerate(names)]
    return rows.select(*replicate, *cols, *([(F.col("_at") + 1).cast("bigint").alias(ordinality)] if ordinality else []))


def enforce_single_row(df: DataFrame) -> DataFrame:
    """The only row; a row of nulls if there is none, an error if there are more. At most two rows are looked at."""
    two = df.limit(2).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
    one = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
    joined = one.join(two, F.lit(True), "left")
    checked = joined.withColumn("_ok", F.when(F.coalesce(F.col("_n"), F.lit(1)) > 1, F.raise_error(F.lit("expected a single row"))).otherwise(F.lit(True)))
    return checked.where("_ok").select(*df.columns)


def order_by(df: DataFrame, keys: Sequence[tuple[str, bool, bool]], partial: bool = False) -> DataFrame:
    """keys: (column, ascending, nulls first). partial sorts within partitions only."""
    names = {(True, True): "asc_nulls_first", (True, False): "asc_nulls_last", (False, True): "desc_nulls_first", (False, False): "desc_nulls_last"}
    cols = [getattr(F, names[asc, first])(c) for c, asc, first in keys]
    return df.sortWithinPartitions(*cols) if partial else df.orderBy(*cols)


def top_n(df: DataFrame, keys: Sequence[tuple[str, bool, bool]], n: int) -> DataFrame:
    return order_by(df, keys).limit(n)


def limit(df: DataFrame, offset: int, count: int) -> DataFrame:
    return df.offset(offset).limit(count)


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def assign_unique_id(df: DataFrame, name: str, task: int = 0) -> DataFrame:
    """A unique number per row, under a task's 24-bit prefix; nothing is shuffled."""
    if not 0 <= task < 1 << 24:
        raise ValueError("task must fit 24 bits")
    return df.withColumn(name, F.monotonically_increasing_id().bitwiseOR(F.lit(task << 40 if task < 1 << 23 else (task << 40) - (1 << 64)).cast("bigint")))


def partition(df: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows dealt to n partitions, by hash of keys or in turn."""
    return df.repartition(n, *keys) if keys else df.repartition(n)


def values(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def window(df: DataFrame, by: Sequence[str], order: Sequence[Column], functions: dict[str, Column], frame: tuple | None = None, mode: str = "range") -> DataFrame:
    """Window functions over partitions; the default frame is RANGE from the partition's start to the current row."""
    w = W.partitionBy(*by).orderBy(*order)
    if frame:
        w = w.rowsBetween(*frame) if mode == "rows" else w.rangeBetween(*frame)
    return df.select("*", *[c.over(w).alias(n) for n, c in functions.items()])
