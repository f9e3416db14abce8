"""Feature-preprocessing functions over columns.

Null rule, unless a docstring says otherwise: a null argument, or a null element inside an array
argument, gives a null result. Everything is built from Spark's own functions except `sigrid_hash`,
whose wrapping 64-bit products run as one Arrow-batched function per plan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _null_free(result: Column, *arrays: Column, nulls: bool = True) -> Column:
    """result where no array is null or holds a null; nulls: whether arrays may hold nulls, as far as the caller knows."""
    ok = None
    for a in arrays:
        here = a.isNotNull() & ~F.exists(a, lambda e: e.isNull()) if nulls else a.isNotNull()
        ok = here if ok is None else ok & here
    return F.when(ok, result)


# --- scalars -------------------------------------------------------------------------------------


def fill_null(x, value, to: str | None = None) -> Column:
    """value in place of null; then cast, to float for dense and bigint for sparse features."""
    out = F.coalesce(col(x), F.lit(value))
    return out.cast(to) if to else out


def _check_borders(borders) -> list[float]:
    if not borders:
        raise ValueError("bucketize needs at least one border")
    if any(a > b for a, b in zip(borders, borders[1:])):
        raise ValueError("borders must not decrease")
    if any(borders.count(b) > 2 for b in set(borders)):
        raise ValueError("a border may occur twice at most")
    return list(borders)


def bucketize(x, borders, variant: str = "cpu") -> Column:
    """Index of the first border not below x; a value equal to a doubled border goes one further. Int result.

    variant "gpu": the number of borders below x, as bigint; doubled borders count twice.
    """
    x, borders = col(x), _check_borders(borders)
    if variant == "gpu":
        below = [F.when(x > F.lit(b), F.lit(1)).otherwise(F.lit(0)) for b in borders]
        total = below[0]
        for b in below[1:]:
            total = total + b
        return F.when(x.isNotNull(), total).cast("bigint")
    out = None
    for i, b in enumerate(borders):
        doubled = i + 1 < len(borders) and borders[i + 1] == b
        here = x < F.lit(b) if doubled else x <= F.lit(b)
        out = F.when(here, i) if out is None else out.when(here, i)
    return F.when(x.isNotNull(), out.otherwise(len(borders))).cast("int")


def bucketize_list(a, borders) -> Column:
    a = col(a)
    return _null_free(F.transform(a, lambda e: bucketize(e, borders)), a)


def clamp(x, low, high) -> Column:
    """x within [low, high]; null stays null."""
    if low > high:
        raise ValueError("low must not exceed high")
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def clamp_list(a, low, high, nulls: bool = True) -> Column:
    if low > high:
        raise ValueError("low must not exceed high")
    a = col(a)
    return _null_free(F.transform(a, lambda e: F.greatest(F.lit(low), F.least(F.lit(high), e))), a, nulls=nulls)


def _logit(x: Column, eps: float) -> Column:
    c = F.greatest(F.lit(float(eps)), F.least(F.lit(1.0 - eps), x.cast("double")))
    return F.log(c / (F.lit(1.0) - c)).cast("float")


def logit(x, eps: float = 1e-6) -> Column:
    """ln(c / (1 - c)) with c = x clamped to [eps, 1 - eps]; float result."""
    x = col(x)
    return F.when(x.isNotNull(), _logit(x, eps))


def logit_list(a, eps: float = 1e-6) -> Column:
    a = col(a)
    return _null_free(F.transform(a, lambda e: _logit(e, eps)), a)


def _boxcox(x: Column, lmbda: float) -> Column:
    d = x.cast("double")
    raised = F.log(d) if lmbda == 0 else (F.pow(d, F.lit(float(lmbda))) - 1) / F.lit(float(lmbda))
    return F.when(d > 0, raised).otherwise(d).cast("float")


def boxcox(x, lmbda: float) -> Column:
    """The Box-Cox transform of positive values; others unchanged. Float result."""
    x = col(x)
    return F.when(x.isNotNull(), _boxcox(x, lmbda))


def boxcox_list(a, lmbda: float) -> Column:
    a = col(a)
    return _null_free(F.transform(a, lambda e: _boxcox(e, lmbda)), a)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def match_re(x, pattern: str) -> Column:
    """Whether the whole string matches."""
    return F.rlike(col(x), F.lit(f"^(?:{pattern})$"))


# --- hashing of ids ------------------------------------------------------------------------------

#: Multiplier of the 128-to-64-bit combination. Fixed value.
K_MUL = np.uint64(0x9DDFEA08EB382D69)


#: Basis and prime of 64-bit FNV-1a. Fixed values.
FNV_BASIS, FNV_PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers by shifts and adds, all modulo 2**64. The shifts are fixed values."""
    u = np.uint64
    x = ~x + (x << u(21))
    x = x ^ (x >> u(24))
    x = x + (x << u(3)) + (x << u(8))
    x = x ^ (x >> u(14))
    x = x + (x << u(2)) + (x << u(4))
    x = x ^ (x >> u(28))
    return x + (x << u(31))


def _fnv(x: np.ndarray) -> np.ndarray:
    """FNV-1a over the eight bytes of each integer, the lowest first."""
    h = np.full(len(x), FNV_BASIS)
    for i in range(8):
        h = (h ^ (x >> np.uint64(8 * i) & np.uint64(255))) * FNV_PRIME
    return h


def sigrid_hash_array(ids: np.ndarray, salt: int, max_value: int, variant: str = "cpu") -> np.ndarray:
    """The hash over a numpy array of int64: spread, combined with the salt, floor-mod max_value.

    variant "gpu": salt and spread id go through FNV-1a before they are combined, and max_value 1 gives
    the whole hash.
    """
    if max_value <= 0:
        raise ValueError("max_value must be positive")
    if max_value == 1 and variant == "cpu":
        return np.zeros(len(ids), np.int64)
    with np.errstate(over="ignore"):
        upper = np.array([salt & (1 << 64) - 1], np.uint64)
        shift = np.uint64(47)
        low = _spread(ids.astype(np.int64).view(np.uint64))
        if variant == "gpu":
            upper, low = _fnv(upper), _fnv(low)
        a = (low ^ upper) * K_MUL
        a ^= a >> shift
        b = (upper ^ a) * K_MUL
        b ^= b >> shift
        b *= K_MUL
    return np.mod(b.view(np.int64), max_value) if max_value > 1 else b.view(np.int64)


def sigrid_hash(x, salt: int, max_value: int, variant: str = "cpu") -> Column:
    """Salted hash of an id into [0, max_value); bigint result. variant: see sigrid_hash_array."""
    if max_value <= 0:
        raise ValueError("max_value must be positive")

    @F.arrow_udf("bigint")
    def hashed(x: pa.Array) -> pa.Array:
        made = pa.array(sigrid_hash_array(x.fill_null(0).to_numpy(zero_copy_only=False), salt, max_value, variant))
        return pc.if_else(x.is_valid(), made, pa.scalar(None, pa.int64())) if x.null_count else made

    # bare calls, so that a chain of hashes is one trip to Python
    return hashed(col(x).cast("bigint"))


def sigrid_hash_list(a, salt: int, max_value: int) -> Column:
    if max_value <= 0:
        raise ValueError("max_value must be positive")

    @F.arrow_udf("array<bigint>")
    def hashed(x: pa.Array) -> pa.Array:
        flat = x.flatten()
        ends = np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False), dtype=np.int32)
        made = pa.array(sigrid_hash_array(flat.to_numpy(zero_copy_only=False), salt, max_value))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), made)

    a = col(a).cast("array<bigint>")
    safe = F.when(a.isNotNull(), F.filter(a, lambda e: e.isNotNull())).otherwise(F.array().cast("array<bigint>"))
    return _null_free(hashed(safe), a)


# --- lists ---------------------------------------------------------------------------------------


def array_constructor(*xs) -> Column:
    """An array of the arguments; nulls are kept."""
    return F.array(*[col(x) for x in xs])


def onehot(a, low: float, high: float, k: int, nulls: bool = True) -> Column:
    """k zeros and ones by where the first element lies between low and high; outside them, class 0."""
    a = col(a)
    x = F.get(a, F.lit(0)).cast("double")
    at = ((x - F.lit(float(low))) / F.lit((high - low) / k)).cast("int")
    at = F.when((at >= 0) & (at < k) & (x >= F.lit(float(low))), at).otherwise(0)
    zero, one = F.lit(0.0).cast("float"), F.lit(1.0).cast("float")
    made = F.concat(F.array_repeat(zero, at), F.array(one), F.array_repeat(zero, F.lit(k - 1) - at))
    return _null_free(F.when(F.size(a) > 0, made), a, nulls=nulls)


def ngram(a, n: int, nulls: bool = True) -> Column:
    """All windows of n elements, one after the other in one flat array; n is cut to the length."""
    if n <= 0:
        raise ValueError("n must be positive")
    a = col(a)
    width = F.least(F.lit(n), F.size(a))
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.size(a) - width + 1), lambda i: F.slice(a, i, width)))
    return _null_free(F.when(F.size(a) == 0, a).otherwise(windows), a, nulls=nulls)


def mapid(a, mapping, variant: str = "cpu") -> Column:
    """Each element replaced by mapping[element]; at or past its end, 0.

    variant "gpu": negative elements give 0, and others are taken modulo the mapping's length.
    """
    a, m = col(a), col(mapping)
    zero = F.lit(0).cast("bigint")
    if variant == "gpu":
        at = lambda e: F.get(m, F.pmod(e, F.size(m)).cast("int")).cast("bigint")
        return _null_free(F.transform(a, lambda e: F.when(e < 0, zero).otherwise(at(e))), a, m)
    return _null_free(F.transform(a, lambda e: F.when(e >= F.size(m), zero).otherwise(F.get(m, e.cast("int")).cast("bigint"))), a, m)


def firstx(a, n: int, nulls: bool = True) -> Column:
    """The first n elements, or all."""
    a = col(a)
    return _null_free(F.slice(a, 1, n), a, nulls=nulls)


def add_tokens(a, tokens: list, begin: bool) -> Column:
    a = col(a)
    more = F.array(*[F.lit(t) for t in tokens]).cast(_array_like(tokens))
    return _null_free(F.concat(more, a) if begin else F.concat(a, more), a)


def _array_like(values: list) -> str:
    return "array<string>" if values and isinstance(values[0], str) else "array<bigint>"


# --- scores of two id lists ----------------------------------------------------------------------


def _times(a: Column, e: Column) -> Column:
    return F.size(F.filter(a, lambda x: x == e))


def _over_common(a: Column, b: Column, pick) -> Column:
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, e: s + pick(_times(a, e), _times(b, e)))


def has_id_overlap(a, b) -> Column:
    """1.0 if any id is in both lists, else 0.0."""
    a, b = col(a), col(b)
    return _null_free(F.arrays_overlap(a, b).cast("float"), a, b)


def _float(x: Column) -> Column:
    return x.cast("float")


def id_overlap_count(a, b) -> Column:
    """Size of the multiset intersection."""
    a, b = col(a), col(b)
    return _null_free(_float(_over_common(a, b, F.least)), a, b)


def get_max_count(a, b) -> Column:
    """Over common ids, the sum of the greater of both counts."""
    a, b = col(a), col(b)
    return _null_free(_float(_over_common(a, b, F.greatest)), a, b)


def get_jaccard_similarity(a, b) -> Column:
    """c / (len(a) + len(b) - c) with c the multiset overlap; two empty lists give 0."""
    a, b = col(a), col(b)
    c = _over_common(a, b, F.least)
    union = F.size(a) + F.size(b) - c
    return _null_free(_float(F.when(union == 0, F.lit(0.0)).otherwise(c / union)), a, b)


def _weight(ids: Column, weights: Column, e: Column) -> Column:
    """Sum of the weights at which e stands."""
    return F.aggregate(F.zip_with(ids, weights, lambda i, w: F.when(i == e, w.cast("double")).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def _same_length(a: Column, w: Column, result: Column) -> Column:
    return F.when(F.size(a) == F.size(w), result).otherwise(F.raise_error(F.lit("ids and weights differ in length")))


def get_cosine_similarity(a, wa, b, wb) -> Column:
    """Cosine of the weight vectors; weights of equal ids add up. A zero norm or unequal lengths are errors."""
    a, wa, b, wb = map(col, (a, wa, b, wb))
    norm = lambda ids, w: F.aggregate(F.array_distinct(ids), F.lit(0.0), lambda s, e: s + _weight(ids, w, e) * _weight(ids, w, e))
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, e: s + _weight(a, wa, e) * _weight(b, wb, e))
    length = F.sqrt(norm(a, wa)) * F.sqrt(norm(b, wb))
    out = F.when(length == 0, F.raise_error(F.lit("a vector has no length"))).otherwise(dot / length)
    return _null_free(_float(_same_length(a, wa, _same_length(b, wb, out))), a, wa, b, wb)


def get_score_sum(a, wa, b, wb) -> Column:
    """Sum of b's weights over the distinct ids of b that are in a."""
    a, wa, b, wb = map(col, (a, wa, b, wb))
    out = F.aggregate(F.array_intersect(b, a), F.lit(0.0), lambda s, e: s + _weight(b, wb, e))
    return _null_free(_float(_same_length(a, wa, _same_length(b, wb, out))), a, wa, b, wb)




def get_score_min(a, b, wb) -> Column:
    """The least of b's weights whose id is in a, or 0."""
    a, b, wb = map(col, (a, b, wb))
    return _null_free(_float(F.coalesce(F.array_min(_weights(a, b, wb)), F.lit(0.0))), a, b, wb)


def get_score_max(a, b, wb) -> Column:
    """The greatest of b's weights whose id is in a, or 0."""
    a, b, wb = map(col, (a, b, wb))
    return _null_free(_float(F.coalesce(F.array_max(_weights(a, b, wb)), F.lit(0.0))), a, b, wb)


def _weights(a: Column, b: Column, wb: Column) -> Column:
    found = F.zip_with(b, wb, lambda i, w: F.when(F.array_contains(a, i), w.cast("double")))
    return F.filter(found, lambda w: w.isNotNull())


# --- whole columns -------------------------------------------------------------------------------


def scale_to_0_1(df, column: str, out: str):
    """df with (x - min) / (max - min) over all rows; a constant column gives sigmoid(x). One aggregate row is broadcast."""
    low_high = df.agg(F.min(column).cast("double").alias("_low"), F.max(column).cast("double").alias("_high"))
    x = F.col(column).cast("double")
    flat = F.col("_low") == F.col("_high")
    scaled = F.when(flat, sigmoid(x)).otherwise((x - F.col("_low")) / F.when(~flat, F.col("_high") - F.col("_low")))
    return df.crossJoin(F.broadcast(low_high)).withColumn(out, scaled.cast("float")).drop("_low", "_high")


def scale_to_z_score(df, column: str, out: str):
    """df with (x - mean) / sample deviation over all rows; without deviation, x itself."""
    stats = df.agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_std"))
    x = F.col(column).cast("double")
    scaled = F.when(F.coalesce("_std", F.lit(0.0)) == 0, x).otherwise((x - F.col("_mean")) / F.when(F.col("_std") != 0, F.col("_std")))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, scaled.cast("float")).drop("_mean", "_std")
