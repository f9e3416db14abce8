"""Mixing sources to target weights by Sainte-Lague apportionment (native).

Sources share a number of words by weight; no source gives more than `most` times its size, and
what that leaves over is shared again by weight until nobody is above (the level is found in one
pass over the sources, ordered by the ratio at which they fill up). Targets are cut into equal
blocks of words; blocks go to sources by the highest quotients target / (2 seats + 1). Within a
source, groups of hash shards get integer quotas of its blocks by the same rule, and so do a group's
shards, of bounded size and number, of the group's; each shard takes blocks of its documents in a
seeded order, whole passes first.

Defined results: null text has size 0; the null source is a source of its own, last in order;
documents without words take nothing; rows that repeat are rows of their own, told apart only by
their order, so totals agree between reruns; texts of any length are counted whole; ties between
quotients go by source and shard; empty tables give empty results; other columns, whatever their names,
are carried along by `mix_documents` and never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._util import carried, count_words, materialize, restored, small

#: Rows of a source that make one shard, on average, and shards that make a group.
SHARD_ROWS, GROUP_SHARDS = 4_000, 1_024
#: Shares in which rows that repeat are numbered.
SALTS = 256


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sources (source, source_size, n_rows) with weight and target.

    A source fills up when the level reaches most * size / weight. In that order, the level of the
    others once the ones before have filled up is (words left) / (weights left); the first level at
    or under the source's own ratio holds for all that follow.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    rise = W.orderBy("ratio", F.col("source").isNull(), "source")
    upto, all_ = rise.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(all_)
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_)["level"])
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).drop("ratio", "level")


def sainte_lague(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: str) -> DataFrame:
    """votes with quota: the group's seats, handed out by the highest quotients vote / (2 quota + 1).

    Rounding vote / divisor gives quotas that differ from the right ones by a bounded number of
    seats. Only seats within that bound are listed as quotients, a number in proportion to the
    parties, and the highest of them fill the seats that are surely free. Ties go by key.
    """
    g = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    v = votes.withColumn("_v", F.col(vote).cast("double"))
    v = v.withColumn("_t", F.sum("_v").over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    v = v.withColumn("_q", F.when(F.col("_t") > 0, F.round(F.col("_v") * F.col(seats) / F.col("_t"))).otherwise(F.lit(0.0)).cast("long"))
    off = F.abs(F.col(seats) - F.sum("_q").over(g))
    reach = F.when(F.col("_t") > 0, F.ceil((off + F.col("_n")) * F.col("_v") / F.col("_t")) + 2).otherwise(F.lit(0)).cast("long")
    v = v.withColumn("_reach", reach).withColumn("_low", F.greatest(F.lit(0).cast("long"), F.col("_q") - F.col("_reach")))
    v = v.withColumn("_left", (F.col(seats) - F.sum("_low").over(g)).cast("long"))
    listed = v.where("_v > 0").select(
        *group, *key, "_v", "_left", F.explode(F.sequence(F.col("_low") + 1, F.col("_q") + F.col("_reach") + 1)).alias("_seat")
    )
    by = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    rank = F.row_number().over(by.orderBy((F.col("_v") / (2 * F.col("_seat") - 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], "_seat"))
    won = listed.withColumn("_r", rank).where("_r <= _left").groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_won"))
    won = won.select(*[F.col(c).alias(f"_{c}") for c in group + key], "_won")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group + key]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    out = v.join(won, cond, "left").withColumn("quota", F.col("_low") + F.coalesce(F.col("_won"), F.lit(0).cast("long")))
    return out.select(*votes.columns, "quota")


def _seeded(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key), F.col("_h"))


def mix(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 1024, seed: int = 8,
) -> DataFrame:
    """key, size, source_size, target and taken for each row of docs.

    Texts are read once, for their sizes, which are written down; only those rows are shuffled. A
    hot source is spread over as many shards as it has times SHARD_ROWS rows.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("source"), count_words(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("_h")
    )
    rows = materialize(rows, "mix-sizes")
    return _taken(rows, weights, share, most, block, seed).select(
        F.col("_key").alias(key), "size", "source_size", "target", "taken"
    )


def _taken(rows: DataFrame, weights, share, most, block, seed) -> DataFrame:
    """rows (_key, source, size, _h) with source_size, target and taken."""
    per = targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), weights, share, most
    )
    # blocks small enough that the smallest target still has a hundred of them
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    per = per.withColumn("block", F.greatest(F.lit(1.0), F.least(F.lit(float(block)), F.floor(least / 100))))
    per = per.withColumn("seats", F.round(F.sum("target").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) / F.col("block")).cast("long"))
    per = sainte_lague(per, [], ["source"], "target", "seats").withColumnRenamed("quota", "source_quota")
    per = per.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(SHARD_ROWS))).cast("long"))
    per = small(per.select(F.col("source").alias("_s"), "source_size", "target", "block", "source_quota", "shards"), "mix-sources")
    r = rows.join(per, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    r = r.withColumn("_shard", F.pmod(F.xxhash64("_key", "_h", F.lit(seed)), F.col("shards")))
    shards = materialize(r.groupBy("source", "_shard", "source_quota", "block").agg(F.sum("size").alias("shard_size")), "mix-shards")
    # first over groups of shards, then over each group's: no task ranks all shards of a source
    group = F.floor(F.col("_shard") / GROUP_SHARDS)
    groups = shards.groupBy("source", group.alias("_group"), "source_quota").agg(F.sum("shard_size").alias("group_size"))
    groups = sainte_lague(groups, ["source"], ["_group"], "group_size", "source_quota")
    groups = groups.select(F.col("source").alias("_gs"), F.col("_group").alias("_gg"), F.col("quota").alias("group_quota"))
    shards = shards.withColumn("_group", group).join(groups, F.col("source").eqNullSafe(F.col("_gs")) & (F.col("_group") == F.col("_gg"))).drop("_gs", "_gg")
    quota = sainte_lague(shards, ["source", "_group"], ["_shard"], "shard_size", "group_quota")
    quota = quota.select(
        F.col("source").alias("_s"), F.col("_shard").alias("_sh"), "shard_size",
        F.least(F.lit(float(most)) * F.col("shard_size"), F.col("quota") * F.col("block")).cast("long").alias("words"),
    )
    r = r.join(small(quota, "mix-quotas"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_sh")), "left")
    run = W.partitionBy("source", "_shard").orderBy(_seeded("_key", seed), "_key", "_h", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    passes = F.floor(F.col("words") / F.col("shard_size"))
    rest = F.col("words") - passes * F.col("shard_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - (F.col("end") - F.col("size"))))
    taken = F.when(F.col("size") > 0, passes * F.col("size") + part).otherwise(F.lit(0)).cast("long")
    return r.withColumn("end", F.sum("size").over(run)).withColumn("taken", taken)


def mix_documents(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 1024, seed: int = 8,
) -> DataFrame:
    """docs' rows as often as the mix takes them, whole: taken / size, to the nearest number.

    Only the document at the edge of a shard's last block is rounded. The rows' sizes are joined
    back by key, source and text hash; rows that repeat share what they take together.
    """
    raw = carried(docs, _key=F.col(key), _source=F.col(source), _h=F.xxhash64(F.col(text)))
    rows = materialize(
        raw.select("_key", F.col("_source").alias("source"), count_words(F.col("_row").getField(text)).alias("size"), "_h"), "mix-sizes"
    )
    taken = _taken(rows, weights, share, most, block, seed)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    # rows that repeat share what they take
    got = taken.groupBy(F.col("_key").alias("_k2"), F.col("source").alias("_s2"), F.col("_h").alias("_h2")).agg(
        F.sum(times).cast("long").alias("_times"), F.count(F.lit(1)).alias("_rows")
    )
    got = materialize(got.where("_times > 0"), "mix-times")
    same = F.col("_key").eqNullSafe(F.col("_k2")) & F.col("_source").eqNullSafe(F.col("_s2")) & F.col("_h").eqNullSafe(F.col("_h2"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))
    once = raw.join(got.where("_rows = 1"), same).select("_row", F.col("_times").alias("_n")).select("_row", copies)
    repeated = got.where("_rows > 1")
    if repeated.limit(1).count():
        once = once.unionAll(_repeated(raw, repeated, same).select("_row", copies))
    return restored(once, docs)


def _repeated(raw: DataFrame, got: DataFrame, same: Column) -> DataFrame:
    """Rows that repeat, each with its number of copies: what they take together, shared evenly, the remainder in some order.

    A group's rows are numbered in SALTS shares, each behind the totals of those before it, so that no
    task holds a group whole.
    """
    rows = materialize(raw.join(got, same).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "mix-repeated")
    group = ["_k2", "_s2", "_h2"]
    totals = rows.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_c"))
    before = totals.select(*[F.col(c).alias(f"_b{c}") for c in [*group, "_salt"]], (F.sum("_c").over(W.partitionBy(*group).orderBy("_salt")) - F.col("_c")).alias("_before"))
    on = F.lit(True)
    for c in [*group, "_salt"]:
        on = on & F.col(c).eqNullSafe(F.col(f"_b{c}"))
    number = F.row_number().over(W.partitionBy(*group, "_salt").orderBy(F.lit(0))) - 1
    numbered = rows.withColumn("_i", number).join(before, on).withColumn("_i", F.col("_i") + F.col("_before"))
    each = F.floor(F.col("_times") / F.col("_rows"))
    return numbered.select("_row", (each + F.when(F.col("_i") < F.col("_times") - each * F.col("_rows"), 1).otherwise(0)).alias("_n"))
