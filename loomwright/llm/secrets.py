"""Secret scans: patterns, and a battery of randomness tests with false-discovery control.

Patterns find assignments, access keys and long hex runs. The battery looks at every other token of
the characters keys are written in. '=' stands only at a token's end, so the value of NAME=value is a
token of its own. A run is judged whole, where one alphabet holds it, and in the parts between its
separators ('+' and '/', '-' and '_', or all four), so that a key behind a path or a prefix is judged
without them; of discoveries that overlap, the one least like language stands.

A token's encoding is inferred, as the smallest of decimal, hex, base32, base62 and base64 that holds
its characters. Three tests ask whether it is drawn uniformly from that alphabet: chi-squared over the
alphabet, a Wald-Wolfowitz runs test about the median symbol, and lag-one serial correlation of symbol
values. Fisher's method combines their p-values; a token that they reject as random at 0.1 % isn't
discovered, such as encoded text, counters and padded numbers.

That a short token passes says little: of language in the same alphabet, much passes too, so that the
battery's own p-value against language falls under 1 % from some 60 characters on only. The evidence
against language is a likelihood ratio therefore: the chance of the token under the language null over
that of uniform draws is, by Markov's inequality, a bound of the probability that language looks this
random, a valid p-value at any length. The null is fitted to the table, a Markov chain of symbols from
the counts of all symbol pairs of all texts over a weak prior; capitals and counting are models beside
it, and the one that explains a token best counts. Numbers alone aren't keys.

False discoveries are controlled over all tokens of the table by the step-up rule of Benjamini and
Hochberg, with weights proportional to token length that average 1. Tokens shorter than SHORTEST can't
reach any threshold and count as untested. p-values are summed up in a histogram of a fixed number of
bins, from which one threshold comes back, at a bin's lower edge, so that the rate holds.

Defined results: null and empty texts have no spans; texts of any length are scanned whole; rows
that repeat give equal results; ties between overlapping tokens go to the first; empty tables give empty
results; `redact` keeps all columns, whatever their names, and all rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import carried, materialize
from .shingles import buffers, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A run is matched whole or not at all, so a lower bound in the pattern drops the short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{12,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: What lies between a run's separators, by the separators that cut; padding stays with the last part.
PARTS = (re.compile(r"[^+/]+"), re.compile(r"[^_-]+"), re.compile(r"[^+/_-]+"))
#: Alphabets by name, in order of size. Fixed values.
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Letters' shares in percent in running text, averaged over four languages, and the space that other characters share.
LETTERS = {
    "e": 14.6, "a": 8.6, "n": 8.0, "i": 7.6, "s": 7.4, "r": 6.8, "t": 7.1, "o": 5.8, "l": 4.8, "d": 4.7, "u": 4.6, "c": 3.4, "h": 3.2,
    "m": 2.9, "p": 2.3, "g": 2.0, "b": 1.6, "f": 1.5, "v": 1.2, "q": 0.7, "y": 0.8, "w": 1.0, "k": 0.6, "z": 0.5, "j": 0.4, "x": 0.3,
}
REJECT, FALSE_SHARE = 0.001, 0.01
#: Least length of a token that is tested; bins of ln p, and how many make a factor of e.
SHORTEST, BINS, PER_E = 12, 4096, 16
#: How many symbol pairs the prior is worth, for each symbol.
PRIOR = 2000.0


_SETS = tuple((name, frozenset(chars)) for name, chars in ALPHABETS)


@functools.lru_cache(maxsize=8)
def _index(name: str) -> dict[str, int]:
    return {c: i for i, c in enumerate(dict(ALPHABETS)[name])}


def encoding_of(token: str) -> tuple[str, str] | None:
    """Name of the smallest alphabet that holds the token, and the token without base64 padding."""
    core = token.rstrip("=")
    if len(token) - len(core) > 2:
        return None
    have = set(core)
    return next(((name, core) for name, chars in _SETS if have <= chars), None)


def chi2_sf(x: float, df: float) -> float:
    """P(chi-squared with df degrees > x), by the series or continued fraction of the incomplete gamma function."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    lead = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-13:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - lead * total)
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / (c if abs(c) > 1e-300 else 1e-300)
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return min(1.0, lead * h)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@functools.lru_cache(maxsize=1024)
def _widths(size: int, cells: int) -> list[float]:
    """Shares of an alphabet's symbols that fall into each cell."""
    return [sum(1 for s in range(size) if s * cells // size == c) / size for c in range(cells)]


def uniformity(values: list[int], size: int) -> float:
    """Chi-squared p-value; symbols are pooled into cells of at least about five expected draws."""
    cells = max(2, min(size, len(values) // 5))
    counts = Counter(v * cells // size for v in values)
    x = sum((counts[c] - len(values) * w) ** 2 / (len(values) * w) for c, w in enumerate(_widths(size, cells)))
    return chi2_sf(x, cells - 1)


def runs(values: list[int], size: int) -> float:
    """Runs test p-value about the middle of the alphabet."""
    high = [2 * v >= size for v in values]
    a = sum(high)
    b, n = len(high) - a, len(high)
    if not a or not b:
        return 2.0 ** (1 - n)
    r = 1 + sum(x != y for x, y in zip(high, high[1:]))
    mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    return normal_two_sided((r - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial(values: list[int], size: int) -> float:
    """p-value of lag-one serial correlation about the alphabet's mean."""
    mean, var, n = (size - 1) / 2, (size * size - 1) / 12, len(values)
    z = sum((x - mean) * (y - mean) for x, y in zip(values, values[1:])) / (var * math.sqrt(n - 1))
    return normal_two_sided(z)


#: Chances that a character of one kind follows another in names and words; kinds: lower, upper, digit, sign. The prior.
FOLLOWS = ((0.85, 0.06, 0.03, 0.06), (0.80, 0.12, 0.04, 0.04), (0.10, 0.05, 0.75, 0.10), (0.60, 0.25, 0.10, 0.05))
_SYMBOLS = sorted(set("".join(chars for _, chars in ALPHABETS)))
_AT = {c: i for i, c in enumerate(_SYMBOLS)}


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _share(c: str) -> float:
    """Share of a character among those of its kind."""
    return LETTERS[c.lower()] / sum(LETTERS.values()) if c.isalpha() else 0.1 if c.isdigit() else 0.25


_PRIOR = np.array([[FOLLOWS[_kind(b)][_kind(c)] * _share(c) for c in _SYMBOLS] for b in _SYMBOLS])
_START = np.array([FOLLOWS[0][_kind(c)] * _share(c) for c in _SYMBOLS])
#: Symbol of each byte; others, which part tokens, are the last row and column of pair counts.
_OTHER = len(_SYMBOLS)
_BYTES = np.full(256, _OTHER, np.int64)
_BYTES[[ord(c) for c in _SYMBOLS]] = np.arange(_OTHER)


def count_pairs(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of all pairs of symbols that follow each other in texts end to end; ends: where a text begins behind another."""
    symbol, n = _BYTES[raw], _OTHER + 1
    if len(raw) < 2:
        return np.zeros(n * n, np.int64)
    pairs = symbol[:-1] * n + symbol[1:]
    apart = ends[(ends > 0) & (ends < len(raw))] - 1
    return np.bincount(pairs, minlength=n * n) - np.bincount(pairs[np.unique(apart)], minlength=n * n)


class Language:
    """A Markov chain of symbols, from pair counts over the prior."""

    def __init__(self, pairs: np.ndarray | None = None):
        n = _OTHER + 1
        pairs = np.zeros((n, n)) if pairs is None else np.asarray(pairs, float).reshape(n, n)
        counts, first = pairs[:_OTHER, :_OTHER] + PRIOR * _PRIOR, pairs[_OTHER, :_OTHER] + PRIOR * _START
        chain = 0.9 * counts / counts.sum(1, keepdims=True) + 0.1 * _PRIOR  # what was never seen keeps some chance
        log, start = np.log(chain), np.log(first / first.sum())
        self.start = {c: float(start[i]) for i, c in enumerate(_SYMBOLS)}
        self.next = {b + c: float(log[i, j]) for i, b in enumerate(_SYMBOLS) for j, c in enumerate(_SYMBOLS)}
        self._seen: dict[str, tuple[float, float]] = {}

    def chance(self, token: str) -> float:
        """ln of the chain's chance of a token."""
        return self.start[token[0]] + sum(map(self.next.__getitem__, map(operator.add, token, token[1:])))


def battery(token: str) -> float:
    """Fisher's combination of the three tests; 0 where no encoding fits."""
    found = encoding_of(token)
    if not found or len(found[1]) < 2:
        return 0.0
    index = _index(found[0])
    values = [index[c] for c in found[1]]
    x = -sum(math.log(max(test(values, len(index)), 1e-300)) for test in (uniformity, runs, serial))
    return min(1.0, math.exp(-x) * (1 + x + x * x / 2))  # the chi-squared tail with six degrees, at 2 x


@functools.lru_cache(maxsize=1)
def plain() -> Language:
    """The prior alone, for texts that stand by themselves."""
    return Language()


def likeness(token: str, language: Language) -> tuple[float, float] | None:
    """ln of the ratio of a token's chance as language or capitals, and as counting, to that of uniform draws; None for numbers and where no encoding fits."""
    found = encoding_of(token)
    if not found or not found[1] or found[1].isdigit():
        return None
    name, core = found
    uniform = -len(core) * math.log(len(_index(name)))
    words = language.chance(core)
    if not any(map(str.islower, core)):
        words = max(words, language.chance(core.lower()))
    steps = sum(1 for b, c in zip(core, core[1:]) if abs(ord(c) - ord(b)) <= 1)  # symbols that repeat or step by one
    order = -math.log(64) + steps * math.log(0.25) - (len(core) - 1 - steps) * math.log(128)
    return words - uniform, order - uniform


def judged(token: str, language: Language) -> tuple[float, float]:
    """A token's p-value, a bound of the chance that language looks as random (1 where it is no candidate), and its likeness to words."""
    like = likeness(token, language) if len(token) >= SHORTEST else None
    if like is None or max(like) > -2:
        return 1.0, 0.0
    return (math.exp(max(*like, -700.0)) if battery(token) >= REJECT else 1.0), like[0]


def _remembered(token: str, language: Language) -> tuple[float, float]:
    """Words come again and again; long tokens don't, and aren't kept."""
    if len(token) > 64:
        return judged(token, language)
    if token not in language._seen:
        if len(language._seen) >= 1 << 16:
            language._seen.clear()
        language._seen[token] = judged(token, language)
    return language._seen[token]


def _parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of the whole run, where an alphabet holds it, and of its maximal parts; of SHORTEST characters or more."""
    if run.isalnum():
        return [(0, len(run))]
    spans = {(m.start(), m.end()) for cut in PARTS for m in cut.finditer(run) if m.end() - m.start() >= SHORTEST}
    if encoding_of(run):
        spans.add((0, len(run)))
    return sorted(spans)


class Tokens:
    """Tested tokens and their total length, and the candidates among them as (bin, start, end, likeness)."""

    def __init__(self):
        self.n = self.total = 0
        self.found: list[tuple[int, int, int, float]] = []


def tokens_of(text: str, base: list[tuple[int, int, int]], language: Language) -> Tokens:
    """The text's tokens that no pattern's span overlaps."""
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in sorted(base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = Tokens()
    for m in RUN.finditer(text):
        run, at = m.group(), m.start()
        for s, e in _parts(run):
            if starts:
                i = bisect.bisect_left(starts, at + e)
                if i and ends[i - 1] > at + s:
                    continue
            out.n += 1
            out.total += e - s
            p, like = _remembered(run[s:e], language)
            if p < 1:
                out.found.append((bin_of(p, e - s), at + s, at + e, like))
    return out


def bin_of(p: float, length: int) -> int:
    """Histogram bin of p / length: bin i holds what is above exp(-i / PER_E), and the last bin the rest."""
    return min(BINS - 1, max(0, math.floor(-PER_E * (math.log(max(p, 1e-300)) - math.log(length)))))


def step_up(bins: dict[int, int], n: int, total: int, share: float = FALSE_SHARE) -> int:
    """The least bin whose tokens are discovered (BINS for none), of n tokens of a total length.

    In bin i and above a token's weighted p-value, p total / (n length), is at most exp(-i / PER_E) total / n.
    """
    found = 0
    least = BINS
    for i in sorted(bins, reverse=True):
        found += bins[i]
        if math.exp(-i / PER_E) * total / n <= share * found / n:
            least = i
    return least


def chosen(found: list[tuple[int, int, int, float]], least: int) -> list[tuple[int, int]]:
    """Spans of the discovered candidates; of those that overlap, the one least like language."""
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e, _ in sorted((x for x in found if x[0] >= least), key=lambda x: (x[3], x[1], x[2])):
        i = bisect.bisect_left(starts, e)
        if i == 0 or ends[i - 1] <= s:
            starts.insert(i, s)
            ends.insert(i, e)
    return list(zip(starts, ends))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if _may_assign(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def scan(text: str | None, language: Language | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span of a text that stands by itself, ordered by start and then kind as listed in KINDS.

    In code points. A random span is added where no pattern's span overlaps it; the false-discovery rate
    is that of this text's tokens.
    """
    if not text:
        return []
    base = base_spans(text)
    t = tokens_of(text, base, language or plain())
    least = step_up(Counter(x[0] for x in t.found), t.n, t.total) if t.found else BINS
    return named(base, chosen(t.found, least))


def named(base: list[tuple[int, int, int]], random: list[tuple[int, int]]) -> list[tuple[int, str, int]]:
    return [(s, KINDS[k], e) for s, k, e in sorted([*base, *((s, 3, e) for s, e in random)])]


def _may_assign(text: str) -> bool:
    """Whether any keyword occurs, which is quicker than the pattern; lower() may only add matches."""
    low = text.lower()
    return any(w in low for w in ("passw", "secret", "token", "api_key", "apikey"))


def digest(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def fit(docs: DataFrame, text: str = "text") -> Language:
    """The language null of a table: its symbol pairs, counted over all texts; some 4000 numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_OTHER + 1) ** 2, np.int64)
        for b in batches:
            for lo, hi in slices(b.column(0), 4 << 20):
                total += count_pairs(*buffers(b.column(0).slice(lo, hi - lo)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["pair", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros((_OTHER + 1) ** 2)
    for r in rows:
        pairs[r.pair] = r.n
    return Language(pairs)


#: A text's findings: pattern spans, tested tokens with their total length, and candidates.
FOUND_DDL = (
    "struct<base: array<struct<s: int, k: int, e: int>>, n: bigint, total: bigint,"
    " found: array<struct<bin: int, s: int, e: int, like: double>>>"
)
FOUND = pa.struct([
    ("base", pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))), ("n", pa.int64()), ("total", pa.int64()),
    ("found", pa.list_(pa.struct([("bin", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("like", pa.float64())]))),
])


def findings(text: Column, language: Language) -> Column:
    """A column's findings as a struct (FOUND_DDL), row by row in Arrow batches."""

    @F.arrow_udf(FOUND_DDL)
    def found(column: pa.Array) -> pa.Array:
        out = []
        for x in column:
            t = x.as_py() or ""
            base = base_spans(t)
            tokens = tokens_of(t, base, language)
            out.append({
                "base": [dict(zip("ske", x)) for x in base], "n": tokens.n, "total": tokens.total,
                "found": [dict(zip(("bin", "s", "e", "like"), x)) for x in tokens.found],
            })
        return pa.array(out, FOUND)

    return found(text.cast("string"))


def threshold(rows: DataFrame, found: str = "_found", share: float = FALSE_SHARE) -> int:
    """The table's step-up threshold, from a histogram of at most BINS rows and two sums."""
    n, total = rows.agg(F.sum(f"{found}.n"), F.sum(f"{found}.total")).first()
    if not n:
        return BINS
    bins = rows.select(F.explode(f"{found}.found").alias("x")).groupBy(F.col("x.bin").alias("bin")).agg(F.count(F.lit(1)).alias("c")).collect()
    return step_up({r.bin: r.c for r in bins}, n, total, share)


def _spans(row: dict, least: int) -> list[tuple[int, str, int]]:
    return named([(x["s"], x["k"], x["e"]) for x in row["base"]], chosen([(x["bin"], x["s"], x["e"], x["like"]) for x in row["found"]], least))


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_random for each row.

    Texts are read to fit the language and again to find spans and candidates, which are written down;
    the threshold comes from those rows. No text is shuffled.
    """
    ddl = f"`{key}` long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    schema = pa.schema([(key, pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), findings(F.col(f"`{text}`"), fit(docs, text)).alias("_found"))
    rows = materialize(rows, "secret-findings")
    least = threshold(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = _spans(row, least)
                n = Counter(x[1] for x in spans)
                own = digest([x for x in spans if x[1] != "random"])
                out.append((k, n["assign"], n["access"], n["hex"], hashlib.sha256(own.encode()).hexdigest(), digest(spans), n["random"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return rows.mapInArrow(run, ddl)


def mask(text: str | None, spans: list[tuple[int, str, int]] | None = None) -> str | None:
    """The text with every span, overlapping ones merged, replaced by a mark of its first kind."""
    spans = scan(text) if spans is None else spans
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end, i = max(end, spans[i][2]), i + 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with secrets masked in the text and, where there is such a column, its length in code points renewed.

    The rows are written once beside their findings and masked on reading.
    """
    rows = carried(docs, _text=F.col(f"`{text}`").cast("string"))
    rows = materialize(rows.withColumn("_found", findings(F.col("_text"), fit(docs, text))).drop("_text"), "secret-findings")
    least = threshold(rows)

    @F.arrow_udf("string")
    def mask_all(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([mask(t, _spans(f, least)) for t, f in zip(texts.to_pylist(), found.to_pylist())], pa.string())

    old = F.col("_row").getField(text).cast("string")
    may = (F.size("_found.base") > 0) | (F.size("_found.found") > 0)
    # texts without findings stay on the JVM's side: what goes to Python is null for them
    masked = mask_all(F.when(may, old), F.col("_found"))
    out = rows.withColumn("_masked", F.when(may, masked).otherwise(old))
    cols = []
    for c in docs.columns:
        own = F.col("_row").getField(c)
        if c == text:
            own = F.col("_masked").cast(docs.schema[c].dataType)
        elif c == n_chars:
            own = F.when(F.col("_masked") != old, F.length("_masked")).otherwise(own).cast(docs.schema[c].dataType)
        cols.append(own.alias(c))
    return out.select(*cols)
