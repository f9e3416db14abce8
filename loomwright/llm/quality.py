"""Quality rules with risk-controlled thresholds (native).

Each rule compares one non-negative measure of a text with a cutoff and rejects above it. Cutoffs
are chosen per stratum from labelled holdouts so that at most `risk` of the stratum's good documents
are rejected, by all rules together, with probability 1 - delta over all strata, rules and cutoffs:

- Rules come in a fixed order, each with its share of the error probability. A rule is tested together
  with the cutoffs of the rules before it: what counts is the share of good documents that any of them
  rejects, so the risk isn't divided.
- A rule's cutoffs are tested from the loosest down, each with the exact binomial tail, and testing
  stops at the first that can't be certified (fixed-sequence testing): the grid needs no correction.
- Corrected for are the strata, and for later rules the grids that the cutoffs before them were chosen
  from (Bonferroni).
- Strata with fewer than `pool_below` good labels, or with none, are one stratum together: the bound
  then holds for them together. Where even that is too small to certify a cutoff, all is kept that the
  base rule keeps.

Defined results: null or empty text has no words and fails the base rule; texts of any length are
measured whole; null strata form a stratum of their own; a measure that ties with its cutoff is kept;
labels that are null, or of documents that don't exist, count for nothing; a document that is labelled
twice counts once, good if any label says so; rows that repeat are judged row by row; empty tables give
empty results; other columns, whatever their names, pass through `filter_documents` and are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import SPACE_CLASS, let, materialize, small
from .urls import bloom, maybe, sized

#: Measures that have a cutoff, and the grid that cutoffs come from: powers of 1.25 up to 1 or 100.
RULES = ("symbol_share", "dup_line_share", "repeat_share", "word_length")
GRID = 64
#: The rules' shares of the error probability, in order; and the good labels from which a stratum stands alone.
SHARES = (0.85, 0.05, 0.05, 0.05)
POOL_BELOW = 1000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside 5-word windows that occur at least twice.

    Windows whose hashes are all distinct end there. Else the windows themselves are sorted with their
    places, neighbours that are equal are marked, and the union of the marked windows is measured.
    """

    def heavy(win: Column) -> Column:
        ranked = F.array_sort(F.transform(win, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
            hits = F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))
            places = F.array_sort(F.transform(hits, lambda x: x["i"]))
            return let(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))).cast("long")),
                    F.lit(0).cast("long"),
                    lambda a, v: a + v,
                ),
            )

        return let(ranked, marked)

    places = F.sequence(F.lit(0), n - WINDOW)
    hashes = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)])),
    )
    windows = let(words, lambda ws: F.transform(places, lambda i: F.array_join(F.slice(ws, i + 1, WINDOW), " ")))
    none = F.lit(0).cast("long")
    exact = let(windows, lambda win: F.when(F.size(F.array_distinct(win)) < F.size(win), heavy(win)).otherwise(none))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n > WINDOW, F.when(some, exact).otherwise(none)).otherwise(none)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base measures of its text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    a = df.withColumn("_w", F.filter(F.split(t, SPACE_CLASS), lambda w: w != ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    return (
        a.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", _repeat_words(F.col("_w"), F.size("_w")))
        .drop("_w")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def _values() -> dict[str, Column]:
    """Measures of RULES as doubles of at least 0."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words / F.lit(100.0),
    }


def _bin(value: Column) -> Column:
    """Grid bin of a measure: 0 up to 1.25 ** -GRID, GRID + 1 above 1, else the bin that ends at 1.25 ** (bin - GRID)."""
    up = F.ceil(F.log(F.greatest(value, F.lit(1e-300))) / F.lit(math.log(1.25))) + F.lit(GRID)
    return F.least(F.lit(GRID + 1), F.greatest(F.lit(0), up)).cast("int")


def _log_choose_term(n: Column, k: Column, r: float) -> Column:
    """ln of the probability that a binomial (n, r) is k, by Stirling's series of the factorials."""

    def lf(x: Column) -> Column:
        y = x.cast("double") + F.lit(10.0)
        series = (y + 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
        fall = F.log(y)
        for i in range(1, 10):
            fall = fall + F.log(y - F.lit(float(i)))
        return series - fall  # ln x! = ln (x + 10)! less the ten factors above x

    return lf(n) - lf(k) - lf(n - k) + k * math.log(r) + (n - k) * math.log1p(-r)


def binomial_tail(n: Column, k: Column, r: float) -> Column:
    """P(binomial(n, r) <= k), exact up to rounding; 1 where k >= n r, which certifies nothing.

    It is the regularised incomplete beta function I(1 - r; n - k, k + 1), by its continued fraction, which
    ends after k + 1 steps and has settled after some multiple of the root of k.
    """
    a, b, x = (n - k).cast("double"), (k + 1).cast("double"), 1 - r

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")

        def half(s: Column, aa: Column) -> Column:
            d = F.lit(1.0) / (aa * s["d"] + 1)
            c = aa / s["c"] + 1
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

        even = m * (b - m) * F.lit(x) / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * F.lit(x) / ((a + 2 * m) * (a + 2 * m + 1))
        return let(half(s, even), lambda t: half(t, odd))

    d0 = F.lit(1.0) / (F.lit(1.0) - (a + b) * F.lit(x) / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
    steps = F.least(k + 1, F.ceil(F.sqrt(b) * 12) + 60).cast("int")
    cf = F.aggregate(F.sequence(F.lit(1), steps), start, step)["h"]
    p = F.least(F.lit(1.0), F.exp(_log_choose_term(n, k, r)) * F.lit(r) * cf)
    return F.when((n <= 0) | (k >= n * F.lit(r)), F.lit(1.0)).otherwise(p)


def thresholds(labelled: DataFrame, stratum: str = "stratum", risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Certified cutoffs per stratum and rule from good documents' measures.

    labelled: the holdout's good documents, with the base measures and the stratum; their grid bins are
    written down once. For each rule, documents are counted by bin (map-side sums; a bounded number of
    groups per stratum) beside those that rules before it reject. Result: stratum, then cutoff_<rule>,
    null where nothing is certified.
    """
    bins = [F.col(f"b{i}") for i in range(len(RULES))]
    hold = labelled.select(F.col(stratum).alias("stratum"), *[_bin(v).alias(f"b{i}") for i, v in enumerate(_values().values())])
    hold = materialize(hold, "quality-holdout")
    strata = hold.select("stratum").distinct().count()
    cut = hold.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    level, done = delta / max(strata, 1), []
    for i, share in enumerate(SHARES):
        c = cut.withColumnRenamed("stratum", "_s")
        c = F.broadcast(c) if strata <= 100_000 else c  # counted above
        before = F.lit(False)
        for j in done:
            before = before | F.coalesce(F.col(f"b{j}") > F.col(f"c{j}"), F.lit(False))
        rows = hold.join(c, F.col("stratum").eqNullSafe(F.col("_s")))
        counts = rows.groupBy("stratum", "n", F.when(before, GRID + 2).otherwise(bins[i]).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
        per = counts.groupBy("stratum", "n").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("by_bin"))
        grid = per.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
        # documents in bins above this one are those that the cutoff, or a rule before, rejects
        above = F.aggregate(
            F.map_entries("by_bin"),
            F.lit(0).cast("long"),
            lambda a, e: a + F.when(e["key"] > F.col("bin"), e["value"]).otherwise(F.lit(0).cast("long")),
        )
        tested = grid.withColumn("fails", binomial_tail(F.col("n"), above, risk) > F.lit(level * share / (GRID + 1) ** i))
        stop = F.coalesce(F.max(F.when(F.col("fails"), F.col("bin"))) + 1, F.lit(0))  # the last before the first failure
        best = tested.groupBy(F.col("stratum").alias("_t")).agg(F.when(stop <= GRID, stop).alias(f"c{i}"))
        done.append(i)
        cut = cut.join(best, F.col("stratum").eqNullSafe(F.col("_t")), "left").drop("_t")
        cut = materialize(cut, "quality-cutoffs")
    return cut.select("stratum", *[F.pow(F.lit(1.25), F.col(f"c{i}") - F.lit(GRID)).alias(f"cutoff_{k}") for i, k in enumerate(RULES)])


#: The name of the stratum that small strata form together; others' names begin with '=' or are 'null'.
POOL = "pool"


def _judging(m: DataFrame, labels: DataFrame, key: str, label: str, risk: float, delta: float, pool_below: int):
    """A function that adds rejected_by to rows with _stratum and measures; its cutoffs come from m, which also has _key and is written down."""
    good = labels.where(F.col(f"`{label}`") == 1).select(F.col(f"`{key}`").alias("_key")).where("_key IS NOT NULL").distinct()
    holdout = m.where(~base_failed()).select("_key", _named("_stratum").alias("_s"), *MEASURES).join(good, "_key", "left_semi")
    holdout = materialize(holdout, "quality-labelled")
    alone = holdout.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= pool_below)
    alone = small(alone.select("_s", F.col("_s").alias("_pool")), "quality-strata")
    pooled = lambda df: df.join(alone, "_s", "left").withColumn("_pool", F.coalesce("_pool", F.lit(POOL)))
    cut = small(thresholds(pooled(holdout), "_pool", risk=risk, delta=delta).withColumnRenamed("stratum", "_pool"), "quality-cutoffs")
    why = F.coalesce(*[F.when(v > F.col(f"cutoff_{k}"), F.lit(k)) for k, v in _values().items()])

    def judged(rows: DataFrame) -> DataFrame:
        return (
            pooled(rows.withColumn("_s", _named("_stratum")))
            .join(cut, "_pool", "left")
            .withColumn("rejected_by", F.when(base_failed(), F.lit("base")).otherwise(why))
        )

    return judged


def _named(stratum: str) -> Column:
    """The stratum as text that isn't null, so that null strata join as well."""
    return F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null"))


def judge(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang",
    label: str = "quality", risk: float = 0.01, delta: float = 0.05, pool_below: int = POOL_BELOW,
) -> DataFrame:
    """One row per row of docs: key, base measures, base_failed, rejected_by (first rule) and kept.

    The measures are computed once and written to the shared folder; only they, never texts, are
    shuffled, to meet the labels.
    """
    m = measures(docs.select(F.col(key).alias("_key"), F.col(stratum).alias("_stratum"), F.col(text).alias("_text")), "_text")
    m = materialize(m.drop("_text"), "quality-measures")
    out = _judging(m, labels, key, label, risk, delta, pool_below)(m)
    return out.select(F.col("_key").alias(key), *MEASURES, base_failed().alias("base_failed"), "rejected_by").withColumn(
        "kept", F.col("rejected_by").isNull()
    )


def filter_documents(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang",
    label: str = "quality", risk: float = 0.01, delta: float = 0.05, pool_below: int = POOL_BELOW,
) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    Only measures are written down, beside a hash of the row. A Bloom filter of the rejected rows' hashes
    then rules out most of the others on reading; what it lets pass is measured again and judged for
    itself, all rows where the filter would be too large to be broadcast. Texts are neither shuffled nor copied.
    """
    rows = docs.select(
        F.col(key).alias("_key"), F.col(stratum).alias("_stratum"), F.col(text).alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_row"),
    ).withColumn("_mark", F.xxhash64("_key", "_stratum", "_text"))
    measured = materialize(measures(rows, "_text").drop("_text", "_row"), "quality-measures")
    judged = _judging(measured, labels, key, label, risk, delta, pool_below)
    gone = materialize(judged(measured).where("rejected_by IS NOT NULL").select("_mark"), "quality-rejected")
    blocks, parts, fits = sized(gone.count())
    kept = lambda df: df.select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    again = lambda df: kept(judged(measures(df, "_text")).where("rejected_by IS NULL"))
    if not fits:
        return again(rows)
    probed = maybe(rows, "_mark", materialize(bloom(gone, "_mark", blocks, parts), "quality-filter"), "_maybe", blocks, parts)
    return kept(probed.where("NOT _maybe")).unionAll(again(probed.where("_maybe")))
