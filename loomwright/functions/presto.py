"""Scalar functions of the first dialect.

Where Spark's function of the same name agrees, it is used as it is; the definitions below differ
from Spark in nulls, NaN, overflow, bounds or result type. Nothing here leaves the JVM except
`xxhash64`, which runs in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rec import col

INF, NAN = float("inf"), float("nan")


# --- arithmetic ----------------------------------------------------------------------------------


def _wide(a: Column, b: Column, op) -> Column:
    """An integer operation modulo 2**64: done in decimals, then brought back into range."""
    x = op(a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))
    two64, two63 = F.lit(str(1 << 64)).cast("decimal(38,0)"), F.lit(str(1 << 63)).cast("decimal(38,0)")
    m = F.pmod(x, two64)
    return F.when(m >= two63, m - two64).otherwise(m).cast("bigint")


def plus(a, b) -> Column:
    """Wrapping sum of bigints."""
    a, b = col(a), col(b)
    return F.coalesce(F.try_add(a.cast("bigint"), b.cast("bigint")), _wide(a, b, lambda x, y: x + y))


def minus(a, b) -> Column:
    a, b = col(a), col(b)
    return F.coalesce(F.try_subtract(a.cast("bigint"), b.cast("bigint")), _wide(a, b, lambda x, y: x - y))


def multiply(a, b) -> Column:
    a, b = col(a), col(b)
    return F.coalesce(F.try_multiply(a.cast("bigint"), b.cast("bigint")), _wide(a, b, lambda x, y: x * y))


def checked_plus(a, b) -> Column:
    """Sum; overflow is an error."""
    return col(a) + col(b)


def checked_minus(a, b) -> Column:
    return col(a) - col(b)


def checked_multiply(a, b) -> Column:
    return col(a) * col(b)


def divide_int(a, b) -> Column:
    """Integer quotient, cut towards zero; division by zero is an error."""
    a, b = col(a), col(b)
    return F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(F.call_function("div", a, F.when(b != 0, b)))


checked_divide = divide_int


def divide(a, b) -> Column:
    """Floating quotient as IEEE has it: infinities and NaN instead of errors."""
    a, b = col(a).cast("double"), col(b).cast("double")
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when((a > 0) == F.startswith(b.cast("string"), F.lit("-")), F.lit(-INF)).otherwise(F.lit(INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def mod(a, b) -> Column:
    """Remainder with the dividend's sign; of doubles by zero NaN, of integers an error."""
    return col(a) % col(b)


checked_modulus = mod


def negate(x) -> Column:
    return F.negative(col(x))


checked_negate = negate


def _same_type(f):
    def g(x, to: str) -> Column:
        return f(col(x)).cast(to)

    return g


#: Results have the argument's type, which Spark's versions of these change; it is given as text.
ceil, floor, sign = _same_type(F.ceil), _same_type(F.floor), _same_type(F.signum)


def _log(f, x) -> Column:
    x = col(x).cast("double")
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(f(x))


def ln(x) -> Column:
    """Natural logarithm; of 0 minus infinity, of negative numbers NaN."""
    return _log(F.ln, x)


def log2(x) -> Column:
    return _log(F.log2, x)


def log10(x) -> Column:
    return _log(F.log10, x)


def round_half_away(x, d: int = 0) -> Column:
    """Rounded to d digits, halves away from zero."""
    return F.round(col(x), d)


def is_finite(x) -> Column:
    x = col(x)
    return ~F.isnan(x) & (F.abs(x) != F.lit(INF))


def is_infinite(x) -> Column:
    return F.abs(col(x)) == F.lit(INF)


def width_bucket(x, low, high, n) -> Column:
    """Bucket of x among n equal ones; bad bounds, counts and NaN are errors."""
    x, low, high, n = (col(c) if not isinstance(c, (int, float)) else F.lit(c) for c in (x, low, high, n))
    bad = F.isnan(x.cast("double")) | (low == high) | (n <= 0) | (F.abs(low.cast("double")) == F.lit(INF)) | (F.abs(high.cast("double")) == F.lit(INF))
    return F.when(bad, F.raise_error(F.lit("bad argument of width_bucket"))).otherwise(F.width_bucket(x, low, high, n))


def width_bucket_array(x, bins: list[float]) -> Column:
    """Number of bins at or under x; bins must not descend."""
    if not bins or any(a > b for a, b in zip(bins, bins[1:])):
        raise ValueError("bins must ascend and not be empty")
    x = col(x)
    edges = F.array(*[F.lit(float(b)) for b in bins])
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda b: b <= x))).cast("bigint")


def from_base(s, radix: int) -> Column:
    """Number of a text in a radix; digits that aren't of it are an error."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    s = col(s)
    ok = F.rlike(F.lower(s), F.lit(f"^[+-]?[{digits}]+$"))
    negative = F.startswith(s, F.lit("-"))
    size = F.conv(F.regexp_replace(s, "^[+-]", ""), radix, 10).cast("bigint")
    return F.when(s.isNull(), F.lit(None)).when(~ok, F.raise_error(F.lit("not a number in that base"))).otherwise(F.when(negative, -size).otherwise(size))


def to_base(x, radix: int) -> Column:
    x = col(x).cast("bigint")
    return F.when(x < 0, F.concat(F.lit("-"), F.lower(F.conv((-x).cast("string"), 10, radix)))).otherwise(F.lower(F.conv(x.cast("string"), 10, radix)))


# --- bits ----------------------------------------------------------------------------------------


def _mask(bits: int) -> Column:
    return F.lit((1 << bits) - 1 if bits < 64 else -1).cast("bigint")


def bit_count(x, bits: int = 64) -> Column:
    """Ones among so many bits of two's complement; a number that needs more is an error."""
    if not 2 <= bits <= 64:
        raise ValueError("bits must be from 2 to 64")
    x = col(x).cast("bigint")
    fits = F.lit(True) if bits == 64 else (x >= -(1 << bits - 1)) & (x < 1 << bits - 1)
    return F.when(x.isNull(), F.lit(None)).when(~fits, F.raise_error(F.lit("number needs more bits"))).otherwise(F.bit_count(x.bitwiseAND(_mask(bits)))).cast("bigint")


def bitwise_left_shift(x, s) -> Column:
    """x moved left; by 64 or more, 0."""
    x, s = col(x).cast("bigint"), col(s).cast("int")
    return F.when(s >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", x, s))


def bitwise_right_shift(x, s) -> Column:
    """x moved right, zeros coming in; by 64 or more, 0."""
    x, s = col(x).cast("bigint"), col(s).cast("int")
    return F.when(s >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", x, s))


def bitwise_right_shift_arithmetic(x, s) -> Column:
    """x moved right, the sign coming in; by 64 or more, 0 or -1."""
    x, s = col(x).cast("bigint"), col(s).cast("int")
    return F.when(s >= 64, F.when(x < 0, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")).otherwise(F.call_function("shiftright", x, s))


bitwise_arithmetic_shift_right = bitwise_right_shift_arithmetic


def bitwise_logical_shift_right(x, s, bits: int) -> Column:
    """Among so many bits of x, moved right with zeros coming in."""
    return bitwise_right_shift(col(x).cast("bigint").bitwiseAND(_mask(bits)), s)


def bitwise_shift_left(x, s, bits: int) -> Column:
    """x moved left, so many bits of it kept."""
    return bitwise_left_shift(x, s).bitwiseAND(_mask(bits))


# --- comparison ----------------------------------------------------------------------------------


def _strict(f, xs) -> Column:
    xs = [col(x) for x in xs]
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, f(*xs))


def greatest(*xs) -> Column:
    """The greatest argument; null if any is null."""
    return _strict(F.greatest, xs)


def least(*xs) -> Column:
    return _strict(F.least, xs)


def distinct_from(a, b) -> Column:
    """Whether the two differ, nulls being alike."""
    return ~col(a).eqNullSafe(col(b))


# --- strings -------------------------------------------------------------------------------------

#: Characters that trim takes away: Unicode white space. Fixed values.
WHITE = r"[\t-\r \u0085   -     　]"


def trim(s) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(s), f"^{WHITE}+|{WHITE}+$", "")


def ltrim(s) -> Column:
    return F.regexp_replace(col(s), f"^{WHITE}+", "")


def rtrim(s) -> Column:
    return F.regexp_replace(col(s), f"{WHITE}+$", "")


def chr_(n) -> Column:
    """The character of a code point, by its UTF-32 bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(col(n).cast("bigint")), 8, "0")), "UTF-32")


def codepoint(s) -> Column:
    """Code point of a text of one character; longer ones are an error."""
    s = col(s)
    return F.when(s.isNull(), F.lit(None)).when(F.length(s) != 1, F.raise_error(F.lit("not one character"))).otherwise(F.ascii(s))


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|&~#" else c for c in text)


def split(s, delimiter: str, limit: int = -1) -> Column:
    """Parts between a literal delimiter; the last of `limit` parts holds the rest."""
    return F.split(col(s), _quoted(delimiter), limit)


def split_part(s, delimiter: str, i: int) -> Column:
    """The i-th part, from 1; null past the end."""
    if i <= 0:
        raise ValueError("parts are numbered from 1")
    return F.get(F.split(col(s), _quoted(delimiter), -1), i - 1)


def strpos(s, sub: str, instance: int = 1) -> Column:
    """Where the n-th occurrence of sub begins, from 1; 0 if there is none."""
    if instance <= 0:
        raise ValueError("instances are numbered from 1")
    s, at = col(s), None
    for _ in range(instance):
        at = F.instr(s, sub) if at is None else F.when(at > 0, F.call_function("locate", F.lit(sub), s, at + 1)).otherwise(F.lit(0))
    return at.cast("bigint")


def substr(s, start: int, length: int | None = None) -> Column:
    """From a place counted from 1, or from the end if negative; empty where that is 0 or outside the text."""
    s = col(s)
    n = F.length(s)
    outside = F.lit(True) if start == 0 else (F.lit(abs(start)) > n)
    begin = F.lit(start) if start > 0 else n + start + 1
    count = F.lit(1 << 30) if length is None else F.lit(max(0, length))
    return F.when(s.isNull(), F.lit(None)).when(outside, F.lit("")).otherwise(F.substring(s, begin, count))


def regexp_extract(s, pattern: str, group: int = 0) -> Column:
    """The first match's group; null without a match."""
    s = col(s)
    return F.when(F.rlike(s, F.lit(pattern)), F.regexp_extract(s, pattern, group))


def regexp_replace(s, pattern: str, to: str = "") -> Column:
    r"""All matches replaced; \1 in the replacement stands for a group."""
    out, i = "", 0
    while i < len(to):
        if to[i] == "\\" and i + 1 < len(to) and to[i + 1].isdigit():
            out, i = out + "$" + to[i + 1], i + 2
        else:
            out, i = out + ("\\$" if to[i] == "$" else to[i]), i + 1
    return F.regexp_replace(col(s), pattern, out)


def xxhash64(b) -> Column:
    """Eight bytes of xxHash64 with seed 0, most significant first."""

    @F.pandas_udf("binary")
    def digest(s: pd.Series) -> pd.Series:
        import xxhash

        return s.map(lambda x: xxhash.xxh64_digest(bytes(x), seed=0))

    b = col(b).cast("binary")
    return F.when(b.isNotNull(), digest(F.coalesce(b, F.lit(b""))))


def sha512(b) -> Column:
    """The 64 bytes of SHA-512."""
    return F.unhex(F.sha2(col(b), 512))


# --- URLs ----------------------------------------------------------------------------------------


def _url(part: str):
    def f(u) -> Column:
        return F.try_parse_url(col(u), F.lit(part))

    return f


url_extract_protocol, url_extract_host, url_extract_path = _url("PROTOCOL"), _url("HOST"), _url("PATH")
url_extract_query, url_extract_fragment = _url("QUERY"), _url("REF")


def url_extract_port(u) -> Column:
    port = F.regexp_extract(F.try_parse_url(col(u), F.lit("AUTHORITY")), r":(\d+)$", 1)
    return F.when(port != "", port.cast("bigint"))


def url_extract_parameter(u, name: str) -> Column:
    return F.try_parse_url(col(u), F.lit("QUERY"), F.lit(name))


# --- time ----------------------------------------------------------------------------------------


def _ts(x) -> Column:
    return col(x).cast("timestamp")


def to_unixtime(x) -> Column:
    return F.unix_micros(_ts(x)) / F.lit(1e6)


def from_unixtime(x) -> Column:
    return F.timestamp_micros(F.round(col(x) * F.lit(1e6)).cast("bigint"))


def from_unixtime_zone(x, zone: str) -> Column:
    """Time and zone together, as Spark has no such type."""
    return F.struct(from_unixtime(x).alias("ts"), F.lit(zone).alias("zone"))


def day_of_week(x) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(col(x)) + 1


def year_of_week(x) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(x))


def millisecond(x) -> Column:
    return F.pmod(F.unix_millis(_ts(x)), F.lit(1000))


def date_add(unit: str, n: int, x) -> Column:
    """x moved by n units; a day that a month lacks becomes its last."""
    return F.timestamp_add(unit, F.lit(n), _ts(x))


def date_diff(unit: str, a, b) -> Column:
    """Whole units from a to b. The last day of a month completes it."""
    unit = unit.upper()
    a, b = _ts(a), _ts(b)
    if unit in ("MONTH", "QUARTER", "YEAR"):
        def months(x: Column, y: Column) -> Column:  # x <= y
            whole = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)
            last = F.dayofmonth(y) == F.dayofmonth(F.last_day(y))
            time = lambda t: F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t))
            early = (F.dayofmonth(x) > F.dayofmonth(y)) & ~last | (F.dayofmonth(x) == F.dayofmonth(y)) & (time(x) > time(y))
            return whole - early.cast("int")

        m = F.when(a <= b, months(a, b)).otherwise(-months(b, a))
        per = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit]
        return F.when(m.isNotNull(), F.call_function("div", m, F.lit(per))).cast("bigint")
    return F.timestamp_diff(unit, a, b).cast("bigint")


#: MySQL's format letters and Spark's. Fixed values.
MYSQL = {
    "a": "EEE", "b": "MMM", "c": "M", "d": "dd", "e": "d", "f": "SSSSSS", "H": "HH", "h": "hh", "I": "hh", "i": "mm", "j": "DDD", "k": "H",
    "l": "h", "M": "MMMM", "m": "MM", "p": "a", "r": "hh:mm:ss a", "S": "ss", "s": "ss", "T": "HH:mm:ss", "W": "EEEE", "Y": "yyyy", "y": "yy", "%": "%",
}


def mysql_format(fmt: str) -> str:
    """A MySQL date format as Spark's."""
    out, i, text = "", 0, ""

    def quote(t: str) -> str:
        return "'" + t.replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in t) else t

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in MYSQL:
                raise ValueError(f"%{fmt[i + 1]} isn't supported")
            out, text, i = out + quote(text) + MYSQL[fmt[i + 1]], "", i + 2
        else:
            text, i = text + fmt[i], i + 1
    return out + quote(text)


def date_format(x, fmt: str) -> Column:
    return F.date_format(_ts(x), mysql_format(fmt))


def date_parse(s, fmt: str) -> Column:
    return F.to_timestamp(col(s), mysql_format(fmt))


def format_datetime(x, fmt: str) -> Column:
    """By a Joda format, whose letters in use here Spark shares."""
    return F.date_format(_ts(x), fmt)


def parse_datetime(s, fmt: str, zone: str = "UTC") -> Column:
    return F.struct(F.to_timestamp(col(s), fmt).alias("ts"), F.lit(zone).alias("zone"))


def plus_days(d, days: int) -> Column:
    """Date and day-time interval of whole days."""
    return (col(d) + F.make_dt_interval(F.lit(days))).cast("date")


# --- arrays, maps, JSON --------------------------------------------------------------------------


def array_duplicates(a) -> Column:
    """Values that occur more than once, ascending, a repeated null first."""
    a = col(a)
    return F.sort_array(F.filter(F.array_distinct(a), lambda e: F.size(F.filter(a, lambda y: y.eqNullSafe(e))) > 1))


def _if_no_null(a: Column, value: Column) -> Column:
    return F.when(~F.exists(a, lambda e: e.isNull()), value)


def array_max(a) -> Column:
    """The greatest element; null if any is null."""
    return _if_no_null(col(a), F.array_max(col(a)))


def array_min(a) -> Column:
    return _if_no_null(col(a), F.array_min(col(a)))


def array_sum(a, zero=0) -> Column:
    """Sum with nulls as 0."""
    kind = "double" if isinstance(zero, float) else "bigint"
    start = F.lit(zero).cast(kind)
    return F.aggregate(col(a), start, lambda s, e: s + F.coalesce(e.cast(kind), F.lit(zero).cast(kind)))


def array_position(a, e, instance: int = 1) -> Column:
    """Place of the n-th e, from 1, or from the end for negative n; 0 if there is none."""
    if instance == 0:
        raise ValueError("instance must not be 0")
    a, e = col(a), e if isinstance(e, Column) else F.lit(e)
    hits = F.filter(F.transform(a, lambda x, i: F.when(x == e, i + 1)), lambda i: i.isNotNull())
    return F.when(a.isNotNull() & e.isNotNull(), F.coalesce(F.try_element_at(hits, F.lit(instance)), F.lit(0))).cast("bigint")


def combinations(a, n: int, element: str = "bigint") -> Column:
    """All sub-arrays of n elements, in order."""
    if not 0 <= n <= 5:
        raise ValueError("n must be from 0 to 5")

    a = col(a).cast(f"array<{element}>")
    places = F.sequence(F.lit(0), F.size(a) - 1)
    found = F.array(F.array().cast("array<int>"))
    for _ in range(n):  # sets of places, each grown by the places behind its last
        found = F.flatten(
            F.transform(found, lambda c: F.transform(F.filter(places, lambda i: i > F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(-1))), lambda i: F.concat(c, F.array(i))))
        )
    picked = F.transform(found, lambda c: F.transform(c, lambda i: F.get(a, i)))
    none = F.array() if n else F.array(F.array())
    return F.when(a.isNotNull(), F.when(F.size(a) == 0, none.cast(f"array<array<{element}>>")).otherwise(picked))


def map_concat(*maps) -> Column:
    """All entries; of equal keys the last map's wins."""
    out = col(maps[0])
    for m in maps[1:]:
        out = F.map_zip_with(out, col(m), lambda k, x, y: F.coalesce(y, x))
    return out


def map_concat_empty_nulls(*maps, kind: str) -> Column:
    """As map_concat, with null maps as empty; kind is the map type's text."""
    empty = F.from_json(F.lit("{}"), kind)
    return map_concat(*[F.coalesce(col(m), empty) for m in maps])


def is_json_scalar(j) -> Column:
    return ~F.rlike(F.ltrim(col(j)), F.lit(r"^[\[{]"))


def json_extract_scalar(j, path: str) -> Column:
    """The scalar at a path; null where an object or array is."""
    found = F.get_json_object(col(j), path)
    return F.when(~F.rlike(found, F.lit(r"^[\[{]")), found)


def json_array_contains(j, value) -> Column:
    """Whether a JSON array holds a value of the same type among its own elements; null for what isn't an array.

    Whole numbers and numbers with a point or an exponent are two types.
    """
    items = F.try_variant_get(F.try_parse_json(col(j)), "$", "array<variant>")
    kind = lambda e: F.schema_of_variant(e)
    if isinstance(value, bool):
        same = lambda e: (kind(e) == "BOOLEAN") & (F.try_variant_get(e, "$", "boolean") == F.lit(value))
    elif isinstance(value, int):
        same = lambda e: (kind(e) == "BIGINT") & (F.try_variant_get(e, "$", "bigint") == F.lit(value))
    elif isinstance(value, float):
        same = lambda e: (kind(e).startswith("DECIMAL") | (kind(e) == "DOUBLE")) & (F.try_variant_get(e, "$", "double") == F.lit(value))
    else:
        same = lambda e: (kind(e) == "STRING") & (F.try_variant_get(e, "$", "string") == F.lit(value))
    return F.when(items.isNotNull(), F.exists(items, lambda e: F.coalesce(same(e), F.lit(False))))

