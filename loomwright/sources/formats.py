"""Readers and writers of file formats and of in-memory data."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats that Spark reads and writes itself.
FORMATS = ("parquet", "orc", "csv", "json", "text", "avro")


def scan(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, columns=None, where=None, path_column: str | None = None, **options) -> DataFrame:
    """A scan with columns and filter given at once, which Spark pushes into the reader; partition columns prune."""
    if fmt not in FORMATS:
        raise ValueError(f"no reader for {fmt}")
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    if path_column:
        df = df.withColumn(path_column, F.col("_metadata.file_path"))
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by=(), mode: str = "error", **options) -> int:
    """Writes and returns the number of rows written, counted by the writer's own metrics."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(fmt).mode(mode).options(**options).partitionBy(*partition_by).save(path)
    return seen.get["rows"]


def write_bucketed(df: DataFrame, table: str, buckets: int, *columns: str, path: str | None = None) -> None:
    """A table whose joins on the columns need no shuffle; in the warehouse, or at a path."""
    writer = df.write.bucketBy(buckets, *columns).sortBy(*columns).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def from_pandas(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(pdf)


def from_pysequence(spark: SparkSession, rows: list, schema=None) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def from_numpy(spark: SparkSession, array, name: str = "value") -> DataFrame:
    """A vector as a column, a matrix as a column of arrays."""
    return spark.createDataFrame(pd.DataFrame({name: list(array.tolist())}))


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def to_pandas(df: DataFrame) -> pd.DataFrame:
    return df.toPandas()


def to_pylist(df: DataFrame) -> list:
    return [tuple(r) if len(r) > 1 else r[0] for r in df.collect()]
