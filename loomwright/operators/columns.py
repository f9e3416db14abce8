"""Methods of list, map and text columns, functions by name, deferred expressions and recorded calls.

Functions given here take and return columns; Spark turns them into expressions once, and no Python runs
over rows.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import presto, rec, sparkdialect
from ..functions.rec import col

# --- lists ---------------------------------------------------------------------------------------


def list_length(a) -> Column:
    return F.when(col(a).isNotNull(), F.size(col(a)))


def list_get(a, i: int) -> Column:
    """Element from 0, from the end if negative; null outside."""
    a = col(a)
    return F.get(a, F.lit(i)) if i >= 0 else F.get(a, F.size(a) + i)


def list_slice(a, start: int = 0, stop: int | None = None) -> Column:
    """Elements start to stop, as Python cuts."""
    a = col(a)
    n = F.size(a)
    at = lambda x: F.least(n, F.lit(x)) if x >= 0 else F.greatest(F.lit(0), n + x)
    begin, end = at(start), n if stop is None else at(stop)
    return F.slice(a, begin + 1, F.greatest(F.lit(0), end - begin))


def list_join(a, sep: str) -> Column:
    return F.array_join(col(a).cast("array<string>"), sep)


def list_vmap(a, f: Callable[[Column], Column]) -> Column:
    """A column expression over the flattened elements, back in lists."""
    return F.transform(col(a), f)


list_map = list_vmap


def list_filter(a, f: Callable[[Column], Column]) -> Column:
    return F.filter(col(a), f)


def list_reduce(a, f: Callable[[Column, Column], Column], start, finish: Callable[[Column], Column] | None = None) -> Column:
    start = start if isinstance(start, Column) else F.lit(start)
    return F.aggregate(col(a), start, f, finish) if finish else F.aggregate(col(a), start, f)


def list_flatmap(a, f: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(col(a), f))


# --- maps ----------------------------------------------------------------------------------------


def map_get(m, key, default=None) -> Column:
    """The key's value; the default where it is missing, null where its value is null."""
    m, key = col(m), key if isinstance(key, Column) else F.lit(key)
    return F.when(F.map_contains_key(m, key), F.try_element_at(m, key)).when(m.isNotNull(), F.lit(default))


# --- texts ---------------------------------------------------------------------------------------


def str_slice(s, start: int = 0, stop: int | None = None) -> Column:
    """Characters start to stop, as Python cuts."""
    s = col(s)
    n = F.char_length(s)
    at = lambda x: F.least(n, F.lit(x)) if x >= 0 else F.greatest(F.lit(0), n + x)
    begin, end = at(start), n if stop is None else at(stop)
    return F.substring(s, begin + 1, F.greatest(F.lit(0), end - begin))


def str_strip(s) -> Column:
    return presto.trim(s)


def str_cat(*parts) -> Column:
    """Texts end to end; null if any is."""
    return F.concat(*[col(p) for p in parts])


def str_findall(s, pattern: str) -> Column:
    """All matches of a pattern without groups."""
    return F.regexp_extract_all(col(s), F.lit(pattern), 0)


# --- functions by name ---------------------------------------------------------------------------


def function(name: str) -> Callable[..., Column]:
    """A function of the feature functions, the first dialect, the second, or Spark's own, in this order."""
    for home in (rec, presto, sparkdialect, F):
        found = getattr(home, name, None)
        if callable(found) and not name.startswith("_"):
            return found
    if name in sparkdialect.SAME:
        return sparkdialect.SAME[name]
    raise AttributeError(f"no function {name}")


def call(name: str, *args, **kw) -> Column:
    return function(name)(*args, **kw)


def rand(spark: SparkSession, size: int, seed: int | None = None) -> DataFrame:
    """So many random numbers in [0, 1), made on the executors."""
    return spark.range(size).select(F.rand(seed).alias("rand"))


# --- deferred expressions ------------------------------------------------------------------------

_BINARY = {
    "__add__": operator.add, "__sub__": operator.sub, "__mul__": operator.mul, "__truediv__": operator.truediv, "__mod__": operator.mod,
    "__lt__": operator.lt, "__le__": operator.le, "__gt__": operator.gt, "__ge__": operator.ge, "__eq__": operator.eq, "__ne__": operator.ne,
    "__and__": operator.and_, "__or__": operator.or_,
}


class Deferred:
    """An expression over a frame that isn't there yet: me["a"] + 1, me.length("b"), ~me["c"]."""

    def __init__(self, build: Callable):
        self._build = build

    def __getitem__(self, key: str) -> Deferred:
        return Deferred(lambda frame: self._build(frame)[key])

    def __getattr__(self, name: str) -> Callable[..., Deferred]:
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda *args: Deferred(lambda frame: function(name)(*[evaluate(a, frame) for a in args]))

    def __invert__(self) -> Deferred:
        return Deferred(lambda frame: ~self._build(frame))

    __hash__ = None


for _name, _op in _BINARY.items():
    setattr(Deferred, _name, lambda self, other, op=_op: Deferred(lambda frame: op(self._build(frame), evaluate(other, frame))))

#: The frame that an expression is evaluated on later.
me = Deferred(lambda frame: frame)


def evaluate(expr, frame):
    """A deferred expression's column on a frame; other values stand for themselves."""
    return expr._build(frame) if isinstance(expr, Deferred) else expr


# --- recorded calls ------------------------------------------------------------------------------


class Trace:
    """Records calls on a frame, as statements that can be run again on another frame.

    Arguments have to be literals, as columns have no text of their own.
    """

    def __init__(self, frame):
        self.frame, self._log = frame, []

    def __getattr__(self, name: str):
        method = getattr(self.frame, name)

        def run(*args, **kw):
            self._log.append((name, args, kw))
            self.frame = method(*args, **kw)
            return self

        return run

    def statements(self) -> list[str]:
        out = []
        for name, args, kw in self._log:
            given = ", ".join([*map(repr, args), *(f"{k}={v!r}" for k, v in kw.items())])
            out.append(f"frame = frame.{name}({given})")
        return out


def replay(statements: list[str], frame):
    """Runs recorded statements on a frame; nothing but calls of its methods with literal arguments is taken."""
    for line in statements:
        node = ast.parse(line).body[0]
        made = node.value if isinstance(node, ast.Assign) else None
        if not (isinstance(made, ast.Call) and isinstance(made.func, ast.Attribute) and isinstance(made.func.value, ast.Name) and made.func.value.id == "frame") or made.func.attr.startswith("_"):
            raise ValueError(f"not a recorded call: {line}")
        frame = getattr(frame, made.func.attr)(*[ast.literal_eval(a) for a in made.args], **{k.arg: ast.literal_eval(k.value) for k in made.keywords})
    return frame
