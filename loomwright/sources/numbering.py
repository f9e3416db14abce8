"""Positions of rows in an order, without a task that has them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import materialize


def numbered(df: DataFrame, order: Sequence, out: str) -> DataFrame:
    """df with out: rows' positions from 0 in an order of columns.

    Rows are sorted over ranges of the order; a range's rows are numbered behind the totals of the ranges
    before it, of which there are as many as partitions. No task has all rows. The sorted rows are
    written down, so that ranges hold while they are counted and read.
    """
    sorted_ = materialize(df.orderBy(*order).withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    totals = sorted_.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = totals.select(F.col("_range").alias("_r"), "_first", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    joined = sorted_.join(F.broadcast(before), F.col("_range") == F.col("_r"))  # a row per partition
    return joined.withColumn(out, F.col("_before") + F.col("_place") - F.col("_first")).drop("_range", "_place", "_r", "_first", "_before")
