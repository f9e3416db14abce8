"""The second dialect, which is Spark's own; only what current Spark changed is defined anew."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rec import col

#: Functions whose semantics Spark still has, by name.
SAME = {
    name: getattr(F, name)
    for name in (
        "pmod", "abs", "exp", "round", "ceil", "floor", "least", "greatest", "hash", "rand", "get_json_object", "ascii", "substring", "instr",
        "length", "md5", "startswith", "endswith", "contains", "regexp_extract", "rlike", "split", "concat", "lower", "upper", "replace", "isnull",
        "isnotnull", "array", "array_contains", "array_intersect", "array_sort", "sort_array", "element_at", "create_map", "map_from_arrays",
        "map_filter", "named_struct", "transform", "aggregate", "filter",
    )
}


def divide(a, b) -> Column:
    """Null for division by zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def remainder(a, b) -> Column:
    """Null modulo zero."""
    return F.try_mod(col(a), col(b))


def unaryminus(a) -> Column:
    return F.negative(col(a))


def power(a, b) -> Column:
    return F.pow(col(a), col(b))


def size(a, legacy: bool = True) -> Column:
    """Number of elements; of null -1, or null without the legacy rule."""
    return F.coalesce(F.size(col(a)), F.lit(-1)) if legacy else F.when(col(a).isNotNull(), F.size(col(a)))


def chr_(n) -> Column:
    """The character of n modulo 256; empty for negative n."""
    return F.when(col(n) < 0, F.lit("")).otherwise(F.char(col(n)))


def last(x, ignore_nulls: bool = False) -> Column:
    """The last value in the order of rows, which the caller has to fix."""
    return F.last(col(x), ignorenulls=ignore_nulls)


def getarrayitem(a, i: int) -> Column:
    """Element from 0; null outside."""
    return F.get(col(a), i)


def getmapvalue(m, k) -> Column:
    return F.try_element_at(col(m), k if isinstance(k, Column) else F.lit(k))


def equalnullsafe(a, b) -> Column:
    return col(a).eqNullSafe(col(b))
