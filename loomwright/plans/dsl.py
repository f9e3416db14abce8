"""A small plan language for feature pipelines, compiled to one Spark projection per dependency level.

    # a comment
    table_size = 1000
    df["a"] = df["int_0"].fill_null(0)
    df["b"] = df["a"].logit(1e-5)
    df["c"] = bucketize(df["a"], [0.5, 1.0, 1.5])

A line names a column, an operator and its arguments: columns, literals, lists, or names of literals.
Lines form a graph over column versions, since a column may be written again. Lines that don't depend on
each other are put into one level, and a level is one select; Catalyst merges levels further, so that
chains become one stage of generated code.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rec


def _fill_null(x, value):
    return rec.fill_null(x, value)


def _cast(x, to):
    return x.cast({"float32": "float", "float64": "double", "int32": "int", "int64": "bigint"}.get(to, to))


#: Operators of the language.
OPERATORS: dict[str, Callable[..., Column]] = {
    "fill_null": _fill_null, "cast": _cast, "bucketize": rec.bucketize, "sigrid_hash": rec.sigrid_hash, "logit": rec.logit,
    "boxcox": rec.boxcox, "onehot": rec.onehot, "ngram": rec.ngram, "mapid": rec.mapid, "firstx": rec.firstx, "clamp": rec.clamp,
    "clamp_list": rec.clamp_list, "array_constructor": rec.array_constructor, "sigmoid": rec.sigmoid, "has_id_overlap": rec.has_id_overlap,
    "id_overlap_count": rec.id_overlap_count, "get_max_count": rec.get_max_count, "get_jaccard_similarity": rec.get_jaccard_similarity,
    "copy": lambda x: x,
}


#: Operators that ask whether their list may hold nulls: where the schema says it can't, they are spared the look.
LISTS = {"onehot", "ngram", "firstx", "clamp_list"}


def _ok(a: str, nulls: bool) -> str:
    return f"{a} IS NOT NULL AND NOT exists({a}, e -> e IS NULL)" if nulls else f"{a} IS NOT NULL"


def _logit_text(x, eps=1e-6):
    c = f"greatest({float(eps)!r}D, least({1.0 - eps!r}D, CAST({x} AS DOUBLE)))"
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(ln({c} / (1.0D - {c})) AS FLOAT) END"


def _boxcox_text(x, lmbda):
    d = f"CAST({x} AS DOUBLE)"
    raised = f"ln({d})" if lmbda == 0 else f"(power({d}, {float(lmbda)!r}D) - 1) / {float(lmbda)!r}D"
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(CASE WHEN {d} > 0 THEN {raised} ELSE {d} END AS FLOAT) END"


def _onehot_text(a, low, high, k, nulls=True):
    x = f"CAST(get({a}, 0) AS DOUBLE)"
    at = f"CAST(({x} - {float(low)!r}D) / {(high - low) / k!r}D AS INT)"
    at = f"CASE WHEN {at} >= 0 AND {at} < {k} AND {x} >= {float(low)!r}D THEN {at} ELSE 0 END"
    made = f"concat(array_repeat(CAST(0 AS FLOAT), {at}), array(CAST(1 AS FLOAT)), array_repeat(CAST(0 AS FLOAT), {k - 1} - {at}))"
    return f"CASE WHEN {_ok(a, nulls)} AND size({a}) > 0 THEN {made} END"


def _ngram_text(a, n, nulls=True):
    width = f"least({n}, size({a}))"
    windows = f"flatten(transform(sequence(1, size({a}) - {width} + 1), i -> slice({a}, i, {width})))"
    return f"CASE WHEN {_ok(a, nulls)} THEN CASE WHEN size({a}) = 0 THEN {a} ELSE {windows} END END"


#: The same as SQL text, for operators that wide plans use often: one expression is parsed faster than its columns are built.
TEXTS: dict[str, Callable[..., str]] = {
    "cast": lambda x, to: f"CAST({x} AS { {'float32': 'FLOAT', 'float64': 'DOUBLE', 'int32': 'INT', 'int64': 'BIGINT'}.get(to, to)})",
    "logit": _logit_text, "boxcox": _boxcox_text, "onehot": _onehot_text, "ngram": _ngram_text, "array_constructor": lambda *xs: f"array({', '.join(xs)})",
    "firstx": lambda a, n, nulls=True: f"CASE WHEN {_ok(a, nulls)} THEN slice({a}, 1, {n}) END",
}


@dataclass
class Step:
    """One line: the column it writes, the operator, and arguments, columns being ("col", name)."""

    out: str
    op: str
    args: list
    reads: list[str] = field(default_factory=list)
    level: int = 0


def _column(node: ast.AST) -> str | None:
    if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "df":
        if isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            return node.slice.value
        raise ValueError("a column is written df[\"name\"]")
    return None


def parse(text: str) -> list[Step]:
    """Steps of a plan in order, with their levels. Errors name the line."""
    names: dict[str, object] = {}
    steps: list[Step] = []
    wrote: dict[str, int] = {}  # level after which a column's present version exists
    read: dict[str, int] = {}  # last level that reads it
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        try:
            node = ast.parse(line).body[0]
            if not isinstance(node, ast.Assign) or len(node.targets) != 1:
                raise ValueError("a line is an assignment")
            out = _column(node.targets[0])
            if out is None:
                names[node.targets[0].id] = ast.literal_eval(node.value)
                continue
            call = node.value
            first: list[ast.AST] = []
            if _column(call) is not None:  # df["a"] = df["b"]
                op, args = "copy", [call]
            elif isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute):
                if not (isinstance(call.func.value, ast.Name) and call.func.value.id != "df"):
                    first = [call.func.value]
                op, args = call.func.attr, first + call.args
            elif isinstance(call, ast.Call) and isinstance(call.func, ast.Name):
                op, args = call.func.id, call.args
            else:
                raise ValueError("the right side is an operator's call")
            if op not in OPERATORS:
                raise ValueError(f"unknown operator {op}")
            step = Step(out, op, [])
            for a in args:
                c = _column(a)
                if c is not None:
                    step.args.append(("col", c))
                    step.reads.append(c)
                elif isinstance(a, ast.Name):
                    step.args.append(names[a.id])
                else:
                    step.args.append(ast.literal_eval(a))
        except (SyntaxError, ValueError, KeyError, AttributeError) as e:
            raise ValueError(f"line {number}: {e}") from e
        step.level = max([0, *(wrote.get(c, 0) for c in step.reads), wrote.get(out, 0), read.get(out, -1) + 0])
        wrote[out] = step.level + 1
        for c in step.reads:
            read[c] = max(read.get(c, 0), step.level)
        steps.append(step)
    return steps


def _values(steps: list[Step]) -> tuple[list[tuple], dict[str, int]]:
    """Distinct values that the plan's last columns need, as (operator, arguments), and the value of each column.

    A value is numbered by its operator and the numbers of its arguments, so that a line which computes
    again what is there costs nothing, and a value that no last column needs is left out.
    """
    numbers: dict[tuple, int] = {}
    now: dict[str, int] = {}

    def number(v: tuple) -> int:
        return numbers.setdefault(v, len(numbers))

    for s in steps:
        args = tuple(("col", now[a[1]] if a[1] in now else number(("input", a[1]))) if isinstance(a, tuple) and a and a[0] == "col" else ("lit", repr(a)) for a in s.args)
        if s.op == "copy":
            now[s.out] = args[0][1]
        else:
            now[s.out] = number((s.op, *args))
    made = list(numbers)
    needed, stack = set(), list(now.values())
    while stack:
        v = stack.pop()
        if v not in needed:
            needed.add(v)
            if made[v][0] != "input":
                stack += [a[1] for a in made[v][1:] if a[0] == "col"]
    return [(v, *made[v]) for v in sorted(needed)], now


def _valid(op: str, args: list) -> bool:
    """Whether columns stand only where the text form takes them, and numbers are in range; else the column form decides."""
    columns = [a[0] == "col" for a in args]
    if op == "array_constructor":
        return all(columns)
    return columns[0] and not any(columns[1:]) and (op != "ngram" or ast.literal_eval(args[1][1]) > 0)


def compile_plan(text: str) -> Callable[[DataFrame], DataFrame]:
    """A function that applies the plan to a DataFrame: one projection per level of distinct values."""
    values, last = _values(parse(text))
    depth: dict[int, int] = {}
    names: dict[int, str] = {}
    levels_: dict[int, list[tuple]] = {}
    for v, op, *args in values:
        if op == "input":
            depth[v], names[v] = 0, args[0]
            continue
        depth[v] = 1 + max([0, *(depth[a[1]] for a in args if a[0] == "col")])
        names[v] = f"_plan_{v}"
        levels_.setdefault(depth[v], []).append((v, op, args))

    # the last level that reads a value, so that each level carries only what is still needed
    used = {v: max(levels_, default=0) + 1 for v in last.values()}
    for level in levels_:
        for _, _, args in levels_[level]:
            for a in args:
                if a[0] == "col":
                    used[a[1]] = max(used.get(a[1], 0), level)

    def apply(df: DataFrame) -> DataFrame:
        columns = df.columns
        kept = {c for c in columns if c not in last}  # the plan doesn't write them again
        for level in sorted(levels_):
            schema = {f.name: f.dataType for f in df.schema}
            made = []
            for v, op, args in levels_[level]:
                sure = op in LISTS and isinstance(schema[names[args[0][1]]], T.ArrayType) and not schema[names[args[0][1]]].containsNull
                more = {"nulls": False} if sure else {}
                if op in TEXTS and _valid(op, args):
                    given = [f"`{names[a[1]]}`" if a[0] == "col" else ast.literal_eval(a[1]) for a in args]
                    made.append(F.expr(f"{TEXTS[op](*given, **more)} AS `{names[v]}`"))
                else:
                    given = [F.col(f"`{names[a[1]]}`") if a[0] == "col" else ast.literal_eval(a[1]) for a in args]
                    made.append(OPERATORS[op](*given, **more).alias(names[v]))
            needed = {names[v] for v in used if v in names and used[v] > level and depth[v] < level} | kept
            df = df.select(*[F.col(f"`{c}`") for c in df.columns if c in needed], *made)
        old = [F.col(f"`{names[last[c]]}`").alias(c) if c in last else F.col(f"`{c}`") for c in columns]
        new = [F.col(f"`{names[v]}`").alias(c) for c, v in last.items() if c not in columns]
        return df.select(*old, *new)

    return apply


def levels(text: str) -> list[list[str]]:
    """Columns written at each level of the lines as they stand."""
    out: dict[int, list[str]] = {}
    for s in parse(text):
        out.setdefault(s.level, []).append(s.out)
    return [out[k] for k in sorted(out)]


# --- the fixed plans ------------------------------------------------------------------------------

DENSE = [f"int_{i}" for i in range(13)]
SPARSE = [f"cat_{i}" for i in range(26)]
#: Table sizes of plan 0, in order of the sparse columns. Fixed values.
TABLE_SIZES = [
    1460, 583, 10131227, 2202608, 305, 24, 12517, 633, 3, 93145, 5683, 8351593, 3194,
    27, 14992, 5461306, 10, 5652, 2173, 4, 7046547, 18, 15, 286181, 105, 142572,
]

#: Table sizes of plan 1: the preprocessing baseline's default list, in order of the sparse columns. Fixed values.
TABLE_SIZES_1 = [
    33121475, 30875, 15297, 7296, 19902, 4, 6519, 1340, 63, 20388174, 945108, 253624, 11,
    2209, 10074, 75, 4, 964, 15, 39991895, 7312994, 28182799, 347447, 11111, 98, 35,
]
#: Where operators of plans 2 and 3 change, over dense and over sparse columns. Fixed values.
CUTS_2, SPARSE_CUTS_2 = (7, 16), (11, 27, 39)
CUTS_3, SPARSE_CUTS_3 = (16, 37), (25, 53, 78)


def _filled(dense: list[str], sparse: list[str]) -> list[str]:
    lines = []
    for c in dense:
        lines += [f'df["{c}"] = df["{c}"].fill_null(0)', f'df["{c}"] = df["{c}"].cast("float32")']
    for c in sparse:
        lines += [f'df["{c}"] = df["{c}"].fill_null(0)', f'df["{c}"] = df["{c}"].cast("int64")']
    return lines


def plan_0(dense=DENSE, sparse=SPARSE, sizes=TABLE_SIZES, salt: int = 0) -> str:
    """Fill, bucketize the first dense column, logit all dense, hash all sparse into one-element lists."""
    lines = _filled(dense, sparse) + [f'df["bucketize_{dense[0]}"] = bucketize(df["{dense[0]}"], [0.5, 1.0, 1.5])', f'df["bucketize_{dense[0]}"] = df["bucketize_{dense[0]}"].cast("int64")']
    lines += [f'df["{c}"] = df["{c}"].logit(1e-5)' for c in dense]
    for c, n in zip(sparse, sizes):
        lines += [f'df["{c}"] = df["{c}"].sigrid_hash({salt}, {n})', f'df["{c}"] = array_constructor(df["{c}"])', f'df["{c}"] = df["{c}"].firstx(1)']
    return "\n".join(lines)


def plan_1(dense=DENSE, sparse=SPARSE, salt: int = 0) -> str:
    """Plan 0 with the other table sizes."""
    return plan_0(dense, sparse, TABLE_SIZES_1, salt)


def _wide_plan(n_dense: int, n_sparse: int, cuts: tuple[int, int], sparse_cuts: tuple[int, int, int], rounds: int, dense, sparse) -> str:
    lines = _filled(dense, sparse)
    lines += [f'df["int_{i}"] = df["{dense[i % len(dense)]}"]' for i in range(len(dense), n_dense)]
    lines += [f'df["cat_{i}"] = df["{sparse[i % len(sparse)]}"]' for i in range(len(sparse), n_sparse)]
    for _ in range(rounds):
        for i in range(n_dense):
            c = f"int_{i}"
            if i < cuts[0]:
                lines.append(f'df["{c}"] = df["{c}"].logit(1e-5)')
            elif i < cuts[1]:
                lines.append(f'df["{c}"] = df["{c}"].boxcox(1e-5)')
            else:
                lines += [f'df["{c}_onehot"] = array_constructor(df["{c}"])', f'df["{c}_onehot"] = df["{c}_onehot"].onehot(0.0, 16.0, 5)', f'df["{c}_onehot"] = df["{c}_onehot"].firstx(1)']
        for i in range(n_sparse):
            c = f"cat_{i}"
            if i < sparse_cuts[0]:
                lines.append(f'df["{c}"] = df["{c}"].sigrid_hash(0, 65536)')
            elif i < sparse_cuts[1]:
                lines.append(f'df["{c}"] = df["{c}"].clamp(0, 16)')
            elif i < sparse_cuts[2]:
                lines += [f'df["{c}firstx"] = array_constructor(df["{c}"])', f'df["{c}firstx"] = df["{c}firstx"].firstx(1)']
            else:
                lines += [f'df["{c}ngram"] = array_constructor(df["{c}"])', f'df["{c}ngram"] = df["{c}ngram"].onehot(0.0, 16.0, 8)', f'df["{c}ngram"] = df["{c}ngram"].ngram(4)', f'df["{c}ngram"] = df["{c}ngram"].firstx(1)']
    return "\n".join(lines)


def plan_2(dense=DENSE, sparse=SPARSE, rounds: int = 4) -> str:
    """26 dense and 52 sparse columns through logit, Box-Cox, one-hot, hash, clamp, first-x and n-gram."""
    return _wide_plan(26, 52, CUTS_2, SPARSE_CUTS_2, rounds, dense, sparse)


def plan_3(dense=DENSE, sparse=SPARSE, rounds: int = 4) -> str:
    """The same over 52 dense and 104 sparse columns."""
    return _wide_plan(52, 104, CUTS_3, SPARSE_CUTS_3, rounds, dense, sparse)
