"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load, materialize

#: Characters that part words: space and U+0009 to U+000D. Fixed values.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Most tasks of a step, as a multiple of the session's shuffle partitions.
TASKS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)


def small(df: DataFrame, name: str, rows: int = 100_000) -> DataFrame:
    """df written down; marked for broadcast only if it has at most so many rows, else joined by shuffle."""
    df = materialize(df, name)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def measured_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a column's texts, counted in one pass that reads nothing else."""
    return df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")).cast("long"))).first()[0] or 0


def parts_for(size: int, spark: SparkSession, bytes_each: int = 8 << 20) -> int:
    """Parts so that each gets about bytes_each of a measured size; never fewer than the session's partitions."""
    return max(shuffle_partitions(spark), min(1 << 20, -(-size // bytes_each)))


def tasks_for(parts: int, spark: SparkSession) -> int:
    """Tasks for so many parts: one each, up to TASKS times the session's partitions; a task takes its parts one by one."""
    return min(parts, TASKS * shuffle_partitions(spark))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of the text as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words, without building the array: places where a word starts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def carried(docs: DataFrame, **columns: Column) -> DataFrame:
    """The given columns and, in a struct _row, all of docs', so that names can't clash."""
    return docs.select(*[c.alias(n) for n, c in columns.items()], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """docs' columns out of _row."""
    return df.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
