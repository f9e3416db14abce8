"""A lazy pandas-like facade over a DataFrame with an explicit row order.

Positions, cumulative sums and "first" need an order, which Spark's rows don't have: `Frame` carries
the columns that give it. Everything returns a new Frame; nothing runs before a collecting method.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import presto
from ..sources.numbering import numbered

#: Rows of a block in which neighbours are compared.
BLOCK_ROWS = 1 << 20
INF, NAN = float("inf"), float("nan")


def true_divide(a: Column, b: Column) -> Column:
    return presto.divide(a, b)


def floor_divide(a: Column, b: Column) -> Column:
    """Integer quotient towards minus infinity."""
    m = floor_mod(a, b)
    return F.call_function("div", a - m, b)


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign."""
    return ((a % b) + b) % b


def int_pow(a: Column, b: Column) -> Column:
    """Whole power; a negative exponent is an error."""
    return F.when(b < 0, F.raise_error(F.lit("negative exponent"))).otherwise(F.pow(a, b)).cast("bigint")


def log(x: Column) -> Column:
    return presto.ln(x)


#: Unicode character tests of whole, non-empty texts. Fixed values.
PATTERNS = {
    "isalpha": r"^\p{L}+$", "isalnum": r"^[\p{L}\p{N}]+$", "isdigit": r"^[\p{Nd}\p{No}]+$", "isdecimal": r"^\p{Nd}+$", "isnumeric": r"^\p{N}+$", "isspace": r"^\s+$",
}


def text_is(x: Column, what: str) -> Column:
    if what == "islower":
        return (F.lower(x) == x) & (F.upper(x) != x)
    if what == "isupper":
        return (F.upper(x) == x) & (F.lower(x) != x)
    if what == "istitle":  # words begin upper and go on lower
        return F.rlike(x, F.lit(r"^[^\p{L}]*(?:[\p{Lu}\p{Lt}][^\p{Lu}\p{Lt}\p{L}]*|(?<=[\p{L}])\p{Ll}[^\p{L}]*)+$")) & F.rlike(x, F.lit(r"\p{L}")) & ~F.rlike(x, F.lit(r"(?<!\p{L})\p{Ll}|\p{L}[\p{Lu}\p{Lt}]"))
    return F.rlike(x, F.lit(PATTERNS[what]))


class Frame:
    def __init__(self, df: DataFrame, order: Sequence[str]):
        self.df, self.order = df, list(order)

    def _new(self, df: DataFrame, order=None) -> Frame:
        return Frame(df, self.order if order is None else order)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def __getitem__(self, key):
        if isinstance(key, str):
            return F.col(key)
        if isinstance(key, list):
            return self.select(*key)
        if isinstance(key, Column):
            return self._new(self.df.where(key))
        if isinstance(key, slice):
            return self.rows(key.start or 0, key.stop, key.step or 1)
        raise TypeError("index by name, names, mask or slice")

    # --- rows

    def _numbered(self) -> DataFrame:
        return numbered(self.df, self.order, "_row")

    def rows(self, start: int, stop: int | None, step: int = 1) -> Frame:
        """Rows by position. From the front a limit suffices; only steps number all rows."""
        df = self.df.orderBy(*self.order)
        if step == 1:
            df = df.offset(start) if start else df
            return self._new(df.limit(stop - start) if stop is not None else df)
        n = self._numbered()
        n = n.where((F.col("_row") >= start) & (F.pmod(F.col("_row") - start, F.lit(step)) == 0))
        return self._new((n.where(F.col("_row") < stop) if stop is not None else n).drop("_row"))

    def head(self, n: int = 5) -> Frame:
        return self.rows(0, n)

    def tail(self, n: int = 5) -> Frame:
        back = [F.desc(c) for c in self.order]
        return self._new(self.df.orderBy(*back).limit(n))

    def where(self, *conditions: Column) -> Frame:
        df = self.df
        for c in conditions:
            df = df.where(c)
        return self._new(df)

    filter = where

    def append(self, other: Frame) -> Frame:
        return self._new(self.df.unionByName(other.df))

    def sort(self, by: Sequence[str] | None = None, ascending: bool = True, na_position: str = "last") -> Frame:
        by = list(by or self.columns)
        f = getattr(F, f"{'asc' if ascending else 'desc'}_nulls_{na_position}")
        return self._new(self.df.orderBy(*[f(c) for c in by]))

    def drop_null(self, how: str = "any", subset=None) -> Frame:
        return self._new(self.df.dropna(how, subset=subset))

    def fill_null(self, value) -> Frame:
        return self._new(self.df.fillna(value))

    def drop_duplicates(self, subset: Sequence[str] | None = None) -> Frame:
        """The first row in order of each key."""
        w = W.partitionBy(*(subset or self.columns)).orderBy(*self.order)
        return self._new(self.df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r"))

    # --- columns

    def select(self, *names: str, **exprs: Column) -> Frame:
        """Columns by name; "*" for all, "-name" to leave one out of them; named expressions are added."""
        minus = {n[1:] for n in names if n.startswith("-")}
        if minus and "*" not in names:
            raise ValueError("-name needs *")
        cols = []
        for n in names:
            if n == "*":
                cols += [c for c in self.columns if c not in minus]
            elif not n.startswith("-"):
                cols.append(n)
        return self._new(self.df.select(*[c for c in cols if c not in exprs], *[e.alias(k) for k, e in exprs.items()]))

    def assign(self, **exprs: Column) -> Frame:
        return self._new(self.df.withColumns(exprs))

    def drop(self, *names: str) -> Frame:
        return self._new(self.df.drop(*names))

    def rename(self, mapper: dict[str, str]) -> Frame:
        return self._new(self.df.withColumnsRenamed(mapper), [mapper.get(c, c) for c in self.order])

    def reorder(self, names: Sequence[str]) -> Frame:
        if sorted(names) != sorted(self.columns):
            raise ValueError("reorder needs all columns")
        return self._new(self.df.select(*names))

    def pipe(self, f: Callable, *args, **kw):
        return f(self, *args, **kw)

    def cast(self, types: dict[str, str]) -> Frame:
        return self._new(self.df.withColumns({c: F.col(c).cast(t) for c, t in types.items()}))

    def map(self, column: str, mapping: dict | Callable, dtype: str, out: str | None = None, na_action: str | None = None) -> Frame:
        """Values through a dict, as a literal map, or through a function, in Arrow batches."""
        x = F.col(column)
        if isinstance(mapping, dict):
            table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
            made = F.try_element_at(table, x).cast(dtype)
        else:
            @F.pandas_udf(dtype)
            def apply(s: pd.Series) -> pd.Series:
                return s.map(mapping, na_action=na_action)

            made = apply(x)
        return self.assign(**{out or column: made})

    def flatmap(self, column: str, f: Callable[[Column], Column], out: str) -> Frame:
        """One row per element of what f makes of a value."""
        return self._new(self.df.withColumn(out, F.explode(f(F.col(column)))))

    def transform(self, f: Callable, schema: str) -> Frame:
        """Batches of pandas frames through f."""
        return self._new(self.df.mapInPandas(lambda it: map(f, it), schema))

    def cumulative(self, column: str, what: str, out: str, by: Sequence[str] = ()) -> Frame:
        """Running sum, min, max or prod in the frame's order."""
        w = W.partitionBy(*by).orderBy(*self.order).rowsBetween(W.unboundedPreceding, W.currentRow)
        f = {"sum": F.sum, "min": F.min, "max": F.max, "prod": F.product}[what]
        return self.assign(**{out: f(column).over(w)})

    # --- numbers of a column

    def stats(self, column: str) -> DataFrame:
        """min, max, sum, mean, std, median, mode, nunique, all, any of a column in one pass."""
        c = F.col(column)
        return self.df.agg(
            F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.median(c).alias("median"), F.mode(c, True).alias("mode"), F.count_distinct(c).alias("nunique"),
            F.bool_and(c != 0).alias("all"), F.bool_or(c != 0).alias("any"),
        )

    def quantile(self, column: str, q: float, interpolation: str = "linear") -> DataFrame:
        """Exact quantile; linear by Spark's percentile, others from the two rows around the place."""
        if interpolation == "linear":
            return self.df.agg(F.percentile(column, q).alias("q"))
        known = self.df.where(F.col(column).isNotNull())
        n = numbered(known.select(column), [column], "_i")
        place = F.lit(float(q) * (known.count() - 1))
        low, high = F.floor(place), F.ceil(place)
        ends = n.agg(
            F.max(F.when(F.col("_i") == low, F.col(column))).alias("low"), F.max(F.when(F.col("_i") == high, F.col(column))).alias("high"), F.max(place - low).alias("f")
        )
        pick = {
            "lower": F.col("low"), "higher": F.col("high"), "midpoint": (F.col("low") + F.col("high")) / 2,
            "nearest": F.when((F.col("f") < 0.5), F.col("low")).otherwise(F.col("high")),
        }[interpolation]
        return ends.select(pick.alias("q"))

    def is_unique(self, column: str) -> DataFrame:
        return self.df.agg((F.count(column) == F.count_distinct(column)).alias("is_unique"))

    def is_monotonic(self, column: str, increasing: bool = True) -> DataFrame:
        rows = numbered(self.df.select(*dict.fromkeys([*self.order, column])), self.order, "_i").select(F.col(column).alias("_x"), "_i")
        # neighbours meet in blocks of positions; a block's last row goes to the next block as well
        block = F.floor(F.col("_i") / BLOCK_ROWS)
        both = rows.withColumn("_b", F.explode(F.array_distinct(F.array(block, F.floor((F.col("_i") + 1) / BLOCK_ROWS)))))
        before = F.lag("_x").over(W.partitionBy("_b").orderBy("_i"))
        ok = F.col("_x") >= F.col("_l") if increasing else F.col("_x") <= F.col("_l")
        return both.withColumn("_l", before).agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("is_monotonic"))

    def copy(self) -> Frame:
        """Itself: a frame never changes."""
        return self

    def reduce(self, column: str, f: Callable[[Column, Column], Column], start, out: str = "reduced") -> DataFrame:
        """A column folded in the frame's order by a function of columns.

        The fold needs one row after the other, so a partition's values are folded in order as one array:
        for results that don't depend on how rows are grouped, `stats` and Spark's aggregates scale and this
        doesn't.
        """
        rows = F.array_sort(F.collect_list(F.struct(*self.order, F.col(column).alias("_x"))))
        start = start if isinstance(start, Column) else F.lit(start)
        return self.df.agg(F.aggregate(F.transform(rows, lambda r: r["_x"]), start, f).alias(out))

    def describe(self, columns: Sequence[str], percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
        """count, mean, std, min, percentiles and max of each column, one row per column."""
        parts = []
        for c in columns:
            ps = [F.percentile(c, p).alias(f"p{int(100 * p)}") for p in percentiles]
            parts.append(self.df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *ps, F.max(c).cast("double").alias("max")).withColumn("column", F.lit(c)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def groupby(self, *by: str) -> Grouped:
        return Grouped(self, list(by))

    def to_arrow(self):
        return self.df.orderBy(*self.order).toArrow()

    def to_pandas(self):
        return self.df.orderBy(*self.order).toPandas()


class Grouped:
    """Groups of a frame. Results are named field.op."""

    OPS = {
        "min": F.min, "max": F.max, "sum": F.sum, "prod": F.product, "mean": F.avg, "median": F.median, "mode": lambda c: F.mode(c, True),
        "count": F.count, "std": F.stddev_samp, "all": F.bool_and, "any": F.bool_or,
    }

    def __init__(self, frame: Frame, by: list[str]):
        self.frame, self.by = frame, by

    def size(self) -> DataFrame:
        return self.frame.df.groupBy(*self.by).agg(F.count(F.lit(1)).alias("size"))

    def agg(self, ops: str | list[str] | dict) -> DataFrame:
        fields = [c for c in self.frame.columns if c not in self.by]
        if not isinstance(ops, dict):
            ops = {f: [ops] if isinstance(ops, str) else ops for f in fields}
        made = [self.OPS[o](f).alias(f"{f}.{o}") for f, names in ops.items() for o in ([names] if isinstance(names, str) else names)]
        return self.frame.df.groupBy(*self.by).agg(*made)

    def select(self, **exprs: Column) -> DataFrame:
        return self.frame.df.groupBy(*self.by).agg(*[e.alias(k) for k, e in exprs.items()])

    def apply(self, f: Callable, schema: str) -> DataFrame:
        return self.frame.df.groupBy(*self.by).applyInPandas(f, schema)


def if_else(cond: Column, a, b) -> Column:
    return F.when(cond, a).when(cond.isNotNull(), b)


def concat(frames: Sequence[Frame]) -> Frame:
    out = frames[0]
    for f in frames[1:]:
        out = out.append(f)
    return out
