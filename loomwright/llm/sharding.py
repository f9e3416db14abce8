"""Sharding by rendezvous hashing over weighted shards (native).

A record goes to the shard with the least -ln(u) / weight, where u in (0, 1) is drawn from a hash of
the stable key and the shard's number. Adding a shard or raising its weight moves rows only into it.

Defined results: a null key is replaced by the hash of its text, so that such rows spread; equal
keys go together; null text has size 1 and the CRC of no bytes; rows that repeat are placed one by
one; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Hash buckets of a shard, in whose order slots run. Part of the contract: slots never depend on sizes or settings.
BUCKETS = 4096


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the key's shard; shards of weight 0 get nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("some shard needs a positive weight")

    def draw(j: int) -> Column:  # 53 bits of the hash, in (0, 1)
        bits = F.shiftrightunsigned(F.xxhash64(F.xxhash64(key, F.lit(j)), F.lit(j)), 11)
        return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))

    costs = [F.struct((-F.ln(draw(j)) / F.lit(float(w))).alias("cost"), F.lit(j).alias("shard")) for j, w in enumerate(weights) if w > 0]
    best = costs[0] if len(costs) == 1 else F.least(*costs)
    return best["shard"].cast("int")


def shard_documents(
    docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, *, key: str = "doc_id", text: str = "text",
    grown: Sequence[float] | None = None,
) -> DataFrame:
    """key, size (bytes + 1), text_crc32, shard, slot and grown_shard for each row.

    slot numbers a shard's rows from 0 without gaps. To keep that parallel, each shard is split by
    hash into buckets; a bucket is numbered alone, behind the total of the buckets before it. The
    bucket totals come from a scan of the key alone, and only keys and digests are shuffled.
    """
    grown = list(grown) if grown is not None else [*weights, max(weights)]
    raw = F.coalesce(F.col(text), F.lit(""))
    stable = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))).otherwise(F.xxhash64(raw, F.lit("no key")))
    rows = docs.select(
        F.col(key).alias("_k"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).cast("long").alias("text_crc32"),
        rendezvous(stable, weights).alias("shard"),
        rendezvous(stable, grown).alias("grown_shard"),
        F.pmod(stable, F.lit(BUCKETS)).cast("int").alias("_b"),
    )
    totals = rows.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("n"))
    before = totals.select(  # at most shards x 4096 rows
        "shard", "_b", (F.sum("n").over(W.partitionBy("shard").orderBy("_b")) - F.col("n")).alias("before")
    )
    place = F.row_number().over(W.partitionBy("shard", "_b").orderBy("_k", "text_crc32", "size"))
    return (
        rows.withColumn("place", place)
        .join(F.broadcast(before), ["shard", "_b"])
        .select(F.col("_k").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"), "grown_shard")
    )
