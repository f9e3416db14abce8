"""Named queries over the driver tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rec
from ..sources.tables import load
from . import features, relational, scalars

BORDERS = [5.0, 10.0, 20.0, 30.0, 40.0]

FLAGSHIP_SQL = """
WITH f AS (
  SELECT CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 20 THEN 2
              WHEN l_quantity <= 30 THEN 3 WHEN l_quantity <= 40 THEN 4 ELSE 5 END AS bucket,
         least(greatest(l_discount, 0.001), 0.999) AS d,
         least(greatest(l_extendedprice, 1000.0), 50000.0) AS price
  FROM lineitem)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n,
       round(avg(CAST(ln(d / (1 - d)) AS FLOAT)), 4) AS avg_logit, round(avg(price), 4) AS avg_price
FROM f GROUP BY 1 ORDER BY 1"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucketize, logit and clamp over lineitem, then counts and means by bucket."""
    li = load(spark, sf_dir, "lineitem")
    f = li.select(
        rec.bucketize("l_quantity", BORDERS).alias("bucket"),
        rec.logit("l_discount", 0.001).alias("logit"),
        rec.clamp("l_extendedprice", 1000.0, 50000.0).alias("price"),
    )
    return (
        f.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.round(F.avg("logit"), 4).alias("avg_logit"), F.round(F.avg("price"), 4).alias("avg_price"))
        .orderBy("bucket")
    )


def queries():
    return {"flagship": flagship, **scalars.queries(), **relational.queries(), **features.queries()}


def oracle_sql():
    return {"flagship": FLAGSHIP_SQL, **scalars.oracle_sql(), **relational.oracle_sql(), **features.oracle_sql()}
