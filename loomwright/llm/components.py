"""Connected components over the cluster, by alternating large and small stars.

Each round reads the edges of the last from a table in the shared folder, so lineage stays short and
a lost executor costs one round at most. Rounds grow with the logarithm of the longest path. Only two
sums per round come to the driver, to see that nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are tied to the least of them; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("_b"), "m")
    joined = edges.join(least, F.col("b") == F.col("_b"))
    ties = joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return ties.union(least.select(F.col("m").alias("a"), F.col("_b").alias("b"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """edges (a, b) of longs, or of structs that can be ordered, a <> b, to (node, root): root is the least of its component and no row says so of itself."""
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    sums = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = sums(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = materialize(_small_star(_large_star(now)), "edges")
        after = sums(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
