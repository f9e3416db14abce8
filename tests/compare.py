"""Side-by-side comparison of a query with its SQL in DuckDB, value by value, in no order."""

import math
import os

import duckdb

from loomwright.sources.tables import TABLES


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if v is None:
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "inf" if v == math.inf else "-inf" if v == -math.inf else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, dict):
        return str(sorted((plain(k), plain(x)) for k, x in v.items()))
    return str(int(v)) if type(v).__name__ == "Decimal" and v == int(v) else str(v)


def table_of(arrow):
    names = sorted(arrow.column_names)
    cols = [arrow.column(n).to_pylist() for n in names]
    return names, sorted(tuple(plain(v) for v in row) for row in zip(*cols))


def differences(df, con, sql):
    got, want = table_of(df.toArrow()), table_of(con.sql(sql).to_arrow_table() if hasattr(con.sql(sql), "to_arrow_table") else con.sql(sql).arrow())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} and {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} rows, first {bad[0]}" if bad else ""
