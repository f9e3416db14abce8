"""URL filter: prefix rules and listed canonical URLs behind a blocked Bloom filter (native).

Listed keys are hashed into a split-block Bloom filter: a block of eight 64-bit words, one bit of
each word per key. The list is written down and counted once, and the filter sized by it, at
KEY_BITS bits a key, in parts of a fixed size. Up to BROADCAST_MB the filter is broadcast; beyond that
its parts meet the rows by a shuffle on the part's number, keys alone. Keys that it passes are possible
hits; an exact hash join with the list removes the false ones, and rows that it rules out take part in
that join under no key, spread by a salt. Pages are read once for the list, where it comes from them,
and once to be judged.

Rules are host and path prefix; a rule fits its host and all subdomains. A URL's possible rule keys
are its host suffixes joined with the prefixes of its path that are as long as some rule's path. They
go through a filter of their own and the same exact join; the longest rule that fits wins.

Defined results: URLs of any length are judged whole; a null URL, or one without ://, has empty host and path and fits no rule; such rows
and URLs off the list are allowed; rows that repeat are judged alike; a null in a list counts for
nothing; empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import materialize

#: Bits of the filter for each key, the most of it that is broadcast, and blocks of a part (64 KB).
KEY_BITS, BROADCAST_MB, PART_BLOCKS = 16, 64, 1 << 10
BLOCKS, PARTS = 1 << 16, 64
#: Numbers over which rows without a key are spread.
SALTS = 1 << 12
#: A to Z and a to z, for lower-casing ASCII alone. Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without m., www. or a port, and the path without default page, page suffix or trailing slash.

    Scheme, query and fragment don't count. Null where there is no host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":\d*$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), r"/+$", "")
    return F.when(host != "", F.concat(host, path))


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key and its bit in each of the block's eight words."""
    h, bits = F.xxhash64(key), F.xxhash64(key, F.lit("bits"))
    return F.pmod(h, F.lit(blocks)), [F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(8)]


def bloom(keys: DataFrame, column: str, blocks: int = BLOCKS, parts: int = PARTS) -> DataFrame:
    """The filter as rows (part, words): array<long> of 8 * blocks / parts words each.

    Bits are or-ed before and after the shuffle, so frequent blocks cost nothing; a part never has
    more than its share of blocks.
    """
    block, bits = _places(F.col(column), blocks)
    one = F.lit(1).cast("long")
    words = [F.call_function("shiftleft", one, bit).alias(f"w{i}") for i, bit in enumerate(bits)]
    set_ = keys.where(F.col(column).isNotNull()).select(block.alias("b"), *words)
    rows = set_.groupBy("b").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
    per = blocks // parts
    packed = rows.select(
        F.pmod("b", F.lit(parts)).alias("part"), F.floor(F.col("b") / parts).cast("int").alias("at"), F.array(*[f"w{i}" for i in range(8)]).alias("w")
    ).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"))
    zeros = F.array_repeat(F.lit(0).cast("long"), 8)
    words = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("int")), zeros)))
    return packed.select("part", words.alias("words"))


def sized(keys: int) -> tuple[int, int, bool]:
    """Blocks and parts of a filter for so many keys, and whether it is small enough to be broadcast."""
    blocks = PARTS * PART_BLOCKS
    while blocks * 512 < keys * KEY_BITS:
        blocks *= 2
    return blocks, blocks // PART_BLOCKS, blocks * 64 <= BROADCAST_MB << 20


def maybe(rows: DataFrame, key: str, filter_: DataFrame, out: str, blocks: int = BLOCKS, parts: int = PARTS, small: bool = True) -> DataFrame:
    """rows with out: false where the filter rules the key out. small: whether the filter is broadcast."""
    block, bits = _places(F.col(key), blocks)
    part = F.when(F.col(key).isNotNull(), F.pmod(block, F.lit(parts)))
    if not small:  # rows without a key have no part: spread them
        part = F.coalesce(part, -1 - F.floor(F.rand(7) * SALTS))
    probe = rows.withColumn("_part", part).withColumn("_at", (F.floor(block / parts) * 8).cast("int"))
    f = filter_.select(F.col("part").alias("_p"), "words")
    f = F.broadcast(f) if small else f  # of a size that `sized` has bounded
    hit = F.col(key).isNotNull() & F.col("_p").isNotNull()
    for i, bit in enumerate(bits):
        word = F.get("words", F.col("_at") + i)
        hit = hit & (F.call_function("shiftrightunsigned", word, bit).bitwiseAND(F.lit(1)) == 1)
    joined = probe.join(f, F.col("_part") == F.col("_p"), "left")
    return joined.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_part", "_at", "_p", "words")


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]], *, key: str = "page_id", url: str = "url",
) -> DataFrame:
    """key, host, path, rule, verdict and listed for each row of pages.

    listed: one column, canonical URLs. rules: (verdict, host, path), a rule list that fits in a
    program. Without a rule that fits, a listed URL is blocked and any other allowed.
    """
    spark = pages.sparkSession
    url_ = F.col(f"`{url}`")
    list_ = materialize(listed.toDF("canon").where("canon IS NOT NULL").distinct(), "url-list")
    blocks, parts, small = sized(list_.count())
    rows = pages.select(F.col(f"`{key}`").alias("_key"), host_of(url_).alias("host"), path_of(url_).alias("path"), canonical(url_).alias("canon"))
    probed = maybe(rows, "canon", bloom(list_, "canon", blocks, parts), "_maybe", blocks, parts, small)
    probed = probed.withColumn("_c", F.when(F.col("_maybe"), F.col("canon"))).withColumn(
        "_salt", F.when(F.col("_maybe"), F.lit(0)).otherwise(F.pmod(F.xxhash64("canon", "_key"), F.lit(SALTS)) + 1).cast("int")
    )
    exact = list_.select(F.col("canon").alias("_l"), F.lit(0).alias("_s"))
    judged = probed.join(exact, (F.col("_c") == F.col("_l")) & (F.col("_salt") == F.col("_s")), "left").withColumn("listed", F.col("_l").isNotNull())
    if not rules:
        return judged.select(
            F.col("_key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"),
            F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"), "listed",
        )
    return _ruled(spark, judged, rules).select(
        F.col("_key").alias(key), "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )


def _ruled(spark, rows: DataFrame, rules) -> DataFrame:
    """rows with rule and rule_verdict of the longest rule that fits; ties, which only repeated rules make, go to allow."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = sorted({len(p) for _, _, p in rules})
    fronts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(fronts, lambda f: f.isNotNull()), lambda f: F.concat(s, f))))
    # the rules' own filter is a constant of the plan: their blocks as literal words
    words = _constant_bloom(spark, [h + p for _, h, p in rules])
    n = len(words) // 8
    block = lambda k: F.pmod(F.xxhash64(k), F.lit(n))

    def passes(k: Column) -> Column:
        _, bits = _places(k, n)
        ok = F.lit(True)
        for i, bit in enumerate(bits):
            word = F.get(F.array(*[F.lit(w).cast("long") for w in words[i::8]]), block(k).cast("int"))
            ok = ok & (F.call_function("shiftrightunsigned", word, bit).bitwiseAND(F.lit(1)) == 1)
        return ok

    with_keys = rows.withColumn("_keys", F.when(F.col("host") != "", F.filter(keys, passes)).otherwise(F.array().cast("array<string>")))
    # longest first: the exact join, one lookup per possible hit, against a map of the rules
    exact = F.create_map(*[x for r, v in _unique(rules) for x in (F.lit(r), F.lit(v))])
    fit = F.filter("_keys", lambda k: F.try_element_at(exact, k).isNotNull())
    ordered = F.transform(fit, lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))
    best = F.array_max(ordered)["k"]
    return with_keys.withColumn("rule", best).withColumn("rule_verdict", F.try_element_at(exact, F.col("rule"))).drop("_keys")


def _unique(rules):
    out: dict[str, str] = {}
    for v, h, p in rules:
        out[h + p] = min(v, out.get(h + p, v))
    return sorted(out.items())


def _constant_bloom(spark, keys: list[str]) -> list[int]:
    n = 8
    block, bits = _places(F.col("k"), n)
    words = [0] * (8 * n)
    for row in spark.createDataFrame([(k,) for k in keys], "k string").select(block, F.array(*bits)).collect():  # as many rows as rules
        for i, bit in enumerate(row[1]):
            words[8 * row[0] + i] |= 1 << bit
    return [w - (1 << 64) if w >= 1 << 63 else w for w in words]
