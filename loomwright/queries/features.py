"""Plans, frames, sources, collation, metrics and streams over the tables."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import rec, text
from ..operators import columns as V
from ..operators.frame import Frame, concat
from ..plans import dsl
from ..sources import collate, criteo, formats
from ..sources.numbering import numbered
from ..sources.tables import fresh_path, load
from ..streaming import metrics as M
from .scalars import sigrid_sql

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: load(spark, sf_dir, name), sf_dir)
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- plans over click-log rows made of lineitem ----------------------------------------------------


def clicks(t):
    """13 dense and 26 sparse columns derived from lineitem, with nulls, beside its key."""
    li = t("lineitem")
    dense = {f"int_{i}": F.when(c("l_linenumber") != 1 + i % 7, (c("l_quantity") * (i + 1)).cast("int") % 40) for i in range(13)}
    sparse = {f"cat_{i}": F.when(c("l_linenumber") != 1 + i % 5, (c("l_partkey") * (i + 3) + c("l_suppkey")).cast("int")) for i in range(26)}
    return li.select("l_orderkey", "l_linenumber", (c("l_returnflag") == "R").cast("int").alias("label"), *[x.alias(k) for k, x in {**dense, **sparse}.items()])


CLICKS = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN CAST(trunc(l_quantity) AS INT) % 40 END AS int_0, CASE WHEN l_linenumber <> 4 THEN CAST(trunc(l_quantity * 4) AS INT) % 40 END AS int_3 FROM lineitem)"


def _logit(x: str) -> str:
    p = f"least(greatest(CAST({x} AS DOUBLE), 0.00001), 0.99999)"
    return f"round(CAST(CAST(ln({p} / (1 - {p})) AS FLOAT) AS DOUBLE), 3)"


@query(f"SELECT l_orderkey, l_linenumber, CAST(CASE WHEN coalesce(int_0, 0) <= 0.5 THEN 0 WHEN int_0 <= 1 THEN 1 WHEN int_0 <= 1.5 THEN 2 ELSE 3 END AS BIGINT) AS bucket, {_logit('coalesce(int_3, 0)')} AS int_3, CAST(1 AS INTEGER) AS ids FROM {CLICKS}")
def plan_0(spark, t, _):
    """The flagship plan, of which one column of each kind is shown."""
    out = dsl.compile_plan(dsl.plan_0())(clicks(t))
    return out.select("l_orderkey", "l_linenumber", c("bucketize_int_0").alias("bucket"), F.round(c("int_3").cast("double"), 3).alias("int_3"), F.size("cat_5").alias("ids"))


def _cat(i: int, key: str) -> str:
    return f"SELECT {key} AS k, coalesce(CASE WHEN l_linenumber <> {1 + i % 5} THEN CAST(l_partkey * {i + 3} + l_suppkey AS INT) END, 0) AS x FROM lineitem"


def _hash_sums(columns: dict[str, int], sizes: dict[str, int], rounds: int = 1) -> str:
    """Per column the sum of its ids' hashes, as one row; columns: name to number of the id column."""
    x = " UNION ALL ".join(_cat(i, f"'{name}'") for name, i in columns.items())
    most = "(CASE k " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in sizes.items()) + " END)"
    for _ in range(rounds):
        x = f"SELECT k, r AS x FROM ({sigrid_sql(x, 0, most)})"
    return f"(SELECT k, sum(x) AS s FROM ({x}) GROUP BY 1)"


def _pivot(sums: str, names) -> str:
    return ", ".join(f"(SELECT CAST(s AS BIGINT) FROM {sums} WHERE k = '{n}') AS {n}" for n in names)


_SIZES_1 = dict(zip(dsl.SPARSE, dsl.TABLE_SIZES_1))


@query(f"WITH h AS {_hash_sums({f'cat_{i}': i for i in range(26)}, _SIZES_1)} SELECT {_pivot('h', dsl.SPARSE)}")
def plan_1(spark, t, _):
    """The same plan with the other table sizes: whole tables' hashes, summed per sparse column."""
    out = dsl.compile_plan(dsl.plan_1())(clicks(t))
    return out.agg(*[F.sum(c(s)[0]).alias(s) for s in dsl.SPARSE])


def _wide(t, plan: str):
    """Sums of every column the plan puts out, arrays by their elements."""
    out = dsl.compile_plan(plan)(clicks(t))
    sums = []
    for f in out.drop("l_orderkey", "l_linenumber").schema:
        x, kind = f"`{f.name}`", f.dataType
        real = isinstance(kind.elementType if isinstance(kind, T.ArrayType) else kind, T.FractionalType)
        to = "DOUBLE" if real else "BIGINT"
        if isinstance(kind, T.ArrayType):
            x = f"aggregate({x}, CAST(0 AS {to}), (a, e) -> a + e)"
        sums.append(F.expr(f"{'round(' if real else ''}sum(CAST({x} AS {to})){', 2)' if real else ''} AS `{f.name}`"))
    return out.agg(*sums)


def _wide_sql(n_dense: int, n_sparse: int, cuts, sparse_cuts, rounds: int = 4) -> str:
    """The same sums in SQL: each operator written out, over all rounds."""

    def logit(x: str) -> str:
        p = f"least(greatest(CAST({x} AS DOUBLE), 0.00001), 1.0 - 0.00001)"
        return f"CAST(ln({p} / (1 - {p})) AS FLOAT)"

    def boxcox(x: str) -> str:
        return f"CAST(CASE WHEN {x} > 0 THEN (pow(CAST({x} AS DOUBLE), 0.00001) - 1) / 0.00001 ELSE CAST({x} AS DOUBLE) END AS FLOAT)"

    def first_of_onehot(x: str, k: int) -> str:
        at = f"CAST(trunc(CAST({x} AS DOUBLE) / (16.0::DOUBLE / {k})) AS BIGINT)"
        return f"CASE WHEN {x} >= 0 AND {at} > 0 AND {at} < {k} THEN 0.0 ELSE 1.0 END"

    base = ["CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label"]
    base += [f"CAST(coalesce(CASE WHEN l_linenumber <> {1 + i % 7} THEN CAST(trunc(l_quantity * {i + 1}) AS INT) % 40 END, 0) AS FLOAT) AS d{i}" for i in range(13)]
    base += [f"CAST(coalesce(CASE WHEN l_linenumber <> {1 + i % 5} THEN CAST(l_partkey * {i + 3} + l_suppkey AS INT) END, 0) AS BIGINT) AS s{i}" for i in range(26)]
    layers, sums = f"SELECT {', '.join(base)} FROM lineitem", ["CAST(sum(label) AS BIGINT) AS label"]
    state = [f"d{i % 13} AS int_{i}" for i in range(n_dense)]
    layers = f"SELECT label, {', '.join(f's{i}' for i in range(26))}, {', '.join(state)} FROM ({layers})"
    for _ in range(rounds):
        step = [f"{logit(f'int_{i}') if i < cuts[0] else boxcox(f'int_{i}')} AS int_{i}" for i in range(cuts[1])]
        layers = f"SELECT * REPLACE ({', '.join(step)}) FROM ({layers})"
    for i in range(n_dense):
        sums.append(f"round(sum(CAST(int_{i} AS DOUBLE)), 2) AS int_{i}")
        if i >= cuts[1]:
            sums.append(f"round(sum(CAST({first_of_onehot(f'int_{i}', 5)} AS DOUBLE)), 2) AS int_{i}_onehot")
    hashed = {}
    for i in range(n_sparse):
        x, name = f"s{i % 26}", f"cat_{i}"
        if i < sparse_cuts[0]:
            hashed[name] = i % 26
            continue
        if i < sparse_cuts[1]:
            sums.append(f"CAST(sum(greatest(0, least(16, {x}))) AS BIGINT) AS {name}")
            continue
        sums.append(f"CAST(sum({x}) AS BIGINT) AS {name}")
        if i < sparse_cuts[2]:
            sums.append(f"CAST(sum({x}) AS BIGINT) AS {name}firstx")
        else:
            sums.append(f"round(sum(CAST({first_of_onehot(x, 8)} AS DOUBLE)), 2) AS {name}ngram")
    sums_of = _hash_sums(hashed, dict.fromkeys(hashed, 65536), rounds)
    return f"WITH h AS {sums_of}, w AS ({layers}) SELECT {', '.join(sums)}, {_pivot('h', hashed)} FROM w"


@query(_wide_sql(26, 52, dsl.CUTS_2, dsl.SPARSE_CUTS_2))
def plan_2(spark, t, _):
    return _wide(t, dsl.plan_2())


@query(_wide_sql(52, 104, dsl.CUTS_3, dsl.SPARSE_CUTS_3))
def plan_3(spark, t, _):
    return _wide(t, dsl.plan_3())


@query("""SELECT l_orderkey, l_linenumber, q2, CASE WHEN q2 <= 10 THEN 0 WHEN q2 <= 30 THEN 1 ELSE 2 END AS b FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 5.0), 45.0) AS q2 FROM lineitem)""")
def plan_language(spark, t, _):
    plan = 'low = 5.0\n# clamp, then cut\ndf["q2"] = df["l_quantity"].clamp(low, 45.0)\ndf["b"] = bucketize(df["q2"], [10.0, 30.0])'
    return dsl.compile_plan(plan)(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", "l_linenumber", "q2", "b")


@query("SELECT o_orderkey AS k, round(CAST(CAST((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) AS FLOAT) AS DOUBLE), 4) AS r FROM orders")
def rec_scale_to_0_1(spark, t, _):
    return rec.scale_to_0_1(t("orders"), "o_totalprice", "s").select(c("o_orderkey").alias("k"), F.round(c("s").cast("double"), 4).alias("r"))


@query("SELECT o_orderkey AS k, round(CAST(CAST((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS FLOAT) AS DOUBLE), 3) AS r FROM orders")
def rec_scale_to_z_score(spark, t, _):
    return rec.scale_to_z_score(t("orders"), "o_totalprice", "s").select(c("o_orderkey").alias("k"), F.round(c("s").cast("double"), 3).alias("r"))


@query("SELECT c_custkey AS k, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END::BIGINT AS r FROM customer")
def text_lookup_indices(spark, t, _):
    got = text.lookup_indices(F.array("c_mktsegment"), ["<unk>", "BUILDING", "MACHINERY"], 0)
    return t("customer").select(c("c_custkey").alias("k"), got[0].alias("r"))


@query("SELECT c_custkey, array_to_string([coalesce(CAST(n_nationkey AS BIGINT), -1), -1], ',') AS r FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 10")
def text_lookup_indices_join(spark, t, _):
    df = t("customer").select("c_custkey", F.array(c("c_nationkey").cast("string"), F.lit("nowhere")).alias("tokens"))
    vocab = t("nation").where("n_nationkey < 10").select(c("n_nationkey").cast("string").alias("token"), c("n_nationkey").alias("index"))
    return text.lookup_indices_join(df, "c_custkey", "tokens", vocab, -1).select("c_custkey", F.array_join(c("indices").cast("array<string>"), ",").alias("r"))


@query()
def text_bpe_tokenize(spark, t, _):
    import public_tokenizers

    got = text.bpe_tokenize("text", public_tokenizers.path("byte_bpe_50k.json"))
    return t("documents").select("doc_id", F.size(got).alias("n"), F.array_join(F.slice(got, 1, 5), " ").alias("first"))


# --- frames ---------------------------------------------------------------------------------------


def orders(t, *cols):
    return Frame(t("orders").select("o_orderkey", *cols), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 3")
def df_slice(spark, t, _):
    return orders(t, "o_custkey")[3:10].df


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 2 AND i < 60 AND (i - 2) % 5 = 0")
def df_slice_step(spark, t, _):
    return orders(t)[2:60:5].df


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")
def df_head(spark, t, _):
    return orders(t).head().df


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def df_tail(spark, t, _):
    return orders(t).tail().df


@query("SELECT o_orderkey, o_custkey * 2 AS twice FROM orders WHERE o_custkey > 20 AND o_totalprice < 90000")
def df_select_where_pipe(spark, t, _):
    f = orders(t, "o_custkey", "o_totalprice").where(c("o_custkey") > 20, c("o_totalprice") < 90000)
    return f.pipe(lambda g: g.select("*", "-o_custkey", "-o_totalprice", twice=c("o_custkey") * 2)).df


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END::BIGINT AS s, o_orderkey FROM orders")
def df_map_dict(spark, t, _):
    return orders(t, "o_orderstatus").map("o_orderstatus", {"O": 1, "F": 2}, "bigint", "s").select("s", "o_orderkey").df


@query("SELECT o_orderkey, o_custkey * 3 + 1 AS m FROM orders")
def df_map_function(spark, t, _):
    return orders(t, "o_custkey").map("o_custkey", lambda x: x * 3 + 1, "bigint", "m").drop("o_custkey").df


@query("SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) AS x FROM orders")
def df_flatmap(spark, t, _):
    return orders(t, "o_custkey").flatmap("o_custkey", lambda x: F.array(x, x + 1), "x").drop("o_custkey").df


@query("SELECT o_orderkey, o_custkey + 1 AS o_custkey FROM orders")
def df_transform(spark, t, _):
    return orders(t, "o_custkey").transform(lambda p: p.assign(o_custkey=p.o_custkey + 1), "o_orderkey long, o_custkey long").df


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def df_drop_duplicates(spark, t, _):
    return orders(t, "o_custkey").drop_duplicates(["o_custkey"]).df


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'x') AS s FROM orders")
def df_fill_null(spark, t, _):
    return orders(t, F.nullif("o_orderstatus", F.lit("F")).alias("s")).fill_null({"s": "x"}).df


@query("SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F'")
def df_drop_null(spark, t, _):
    return orders(t, F.nullif("o_orderstatus", F.lit("F")).alias("s")).drop_null().df


@query("SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS cust FROM orders")
def df_rename_cast_reorder(spark, t, _):
    return orders(t, "o_custkey").cast({"o_custkey": "string"}).rename({"o_orderkey": "id", "o_custkey": "cust"}).reorder(["cust", "id"]).df


@query("SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey < 10")
def df_concat(spark, t, _):
    o = orders(t, "o_custkey")
    return concat([o, o.where(c("o_custkey") < 10)]).select("o_orderkey").df


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC NULLS LAST")
def df_sort(spark, t, _):
    return orders(t, "o_custkey").sort(["o_custkey"], ascending=False).df


for _what, _f in (("sum", "sum"), ("min", "min"), ("max", "max")):
    def _cum(spark, t, _, what=_what):
        return orders(t, "o_custkey", "o_orderstatus").cumulative("o_custkey", what, "v", ["o_orderstatus"]).select("o_orderkey", "v").df

    _cum.__name__ = f"df_cum{_what}"
    query(f"SELECT o_orderkey, CAST({_f}(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM orders")(_cum)


@query("SELECT l_orderkey, l_linenumber, round(exp(sum(ln(1 + l_tax)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)), 6) AS v FROM lineitem")
def df_cumprod(spark, t, _):
    f = Frame(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (1 + c("l_tax")).alias("x")), ["l_linenumber", "l_partkey", "l_extendedprice"])
    return f.cumulative("x", "prod", "v", ["l_orderkey"]).df.select("l_orderkey", "l_linenumber", F.round("v", 6).alias("v"))


@query("""SELECT min(o_custkey) AS min, max(o_custkey) AS max, CAST(sum(o_custkey) AS BIGINT) AS sum, round(avg(o_custkey), 6) AS mean, round(stddev_samp(o_custkey), 6) AS std, median(o_custkey) AS median,
  (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, count(DISTINCT o_custkey) AS nunique, bool_and(o_custkey <> 0) AS all, bool_or(o_custkey <> 0) AS any FROM orders""")
def df_stats(spark, t, _):
    s = orders(t, "o_custkey").stats("o_custkey")
    return s.select(*[F.round(x, 6).alias(x) if x in ("mean", "std") else x for x in s.columns])


for _how, _sql in (("linear", "quantile_cont(o_totalprice, 0.3)"), ("lower", None), ("higher", None), ("midpoint", None), ("nearest", None)):
    def _q(spark, t, _, how=_how):
        return orders(t, "o_totalprice").quantile("o_totalprice", 0.3, how).select(F.round("q", 4).alias("q"))

    _q.__name__ = f"df_quantile_{_how}"
    _i = "(SELECT 0.3 * (count(*) - 1) FROM orders)"
    _at = lambda f: f"(SELECT o_totalprice FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS i FROM orders) WHERE i = {f}({_i}))"
    _pick = {"linear": _sql, "lower": _at("floor"), "higher": _at("ceil"), "midpoint": f"({_at('floor')} + {_at('ceil')}) / 2", "nearest": f"CASE WHEN {_i} - floor({_i}) < 0.5 THEN {_at('floor')} ELSE {_at('ceil')} END"}[_how]
    query(f"SELECT round({_pick}, 4) AS q" + (" FROM orders" if _how == "linear" else ""))(_q)


@query("SELECT count(DISTINCT o_orderkey) = count(o_orderkey) AS is_unique FROM orders")
def df_is_unique(spark, t, _):
    return orders(t).is_unique("o_orderkey")


@query("SELECT bool_and(x >= b) AS is_monotonic FROM (SELECT o_custkey AS x, lag(o_custkey) OVER (ORDER BY o_orderkey) AS b FROM orders)")
def df_is_monotonic(spark, t, _):
    return orders(t, "o_custkey").is_monotonic("o_custkey")


@query("SELECT coalesce(bool_and(x >= b), true) AS is_monotonic FROM (SELECT o_orderdate AS x, lag(o_orderdate) OVER (ORDER BY o_orderdate, o_orderkey) AS b FROM orders)")
def df_is_monotonic_sorted(spark, t, _):
    return Frame(t("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).is_monotonic("o_orderdate")


@query("""SELECT 'o_totalprice' AS column, count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min,
  round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, max(o_totalprice) AS max FROM orders""")
def df_describe(spark, t, _):
    d = orders(t, "o_totalprice").describe(["o_totalprice"])
    return d.select(*[F.round(x, 4).alias(x) if x in ("mean", "std", "p25", "p50", "p75") else x for x in d.columns])


GROUPED = 'SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS "o_custkey.sum", max(o_custkey) AS "o_custkey.max", min(o_custkey) AS "o_custkey.min", round(avg(o_custkey), 6) AS "o_custkey.mean", median(o_custkey) AS "o_custkey.median", count(o_custkey) AS "o_custkey.count" FROM orders GROUP BY 1'


@query(GROUPED)
def df_groupby_agg(spark, t, _):
    g = Frame(t("orders").select("o_orderstatus", "o_custkey"), ["o_custkey"]).groupby("o_orderstatus").agg(["sum", "max", "min", "mean", "median", "count"])
    return g.select(*[F.round(f"`{x}`", 6).alias(x) if x.endswith("mean") else F.col(f"`{x}`") for x in g.columns])


@query("SELECT o_orderstatus, count(*) AS size FROM orders GROUP BY 1")
def df_groupby_size(spark, t, _):
    return orders(t, "o_orderstatus").groupby("o_orderstatus").size()


@query("SELECT o_orderstatus, max(o_custkey) - min(o_custkey) AS span FROM orders GROUP BY 1")
def df_groupby_select(spark, t, _):
    return orders(t, "o_orderstatus", "o_custkey").groupby("o_orderstatus").select(span=F.max("o_custkey") - F.min("o_custkey"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def df_groupby_apply(spark, t, _):
    g = orders(t, "o_orderstatus").groupby("o_orderstatus")
    return g.apply(lambda p: p.groupby("o_orderstatus", as_index=False).size().rename(columns={"size": "n"}), "o_orderstatus string, n long")


# --- sources, sinks and collation -------------------------------------------------------------------


def _folder(spark) -> str:
    """A fresh path in the folder that all executors share."""
    return fresh_path(spark, "formats")


for _fmt in ("parquet", "orc", "json", "csv"):
    def _round(spark, t, _, fmt=_fmt):
        path = _folder(spark)
        formats.write(t("nation"), path, fmt, **({"header": True} if fmt == "csv" else {}))
        schema = "n_nationkey int, n_name string, n_regionkey int"
        return formats.scan(spark, path, fmt, schema, ["n_nationkey", "n_name"], c("n_regionkey") >= 2, **({"header": True} if fmt == "csv" else {}))

    _round.__name__ = f"io_{_fmt}"
    query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= 2")(_round)


@query("SELECT n_regionkey, n_name FROM nation WHERE n_regionkey = 3")
def io_partitioned(spark, t, _):
    """Hive-style partitions: the filter prunes folders."""
    path = _folder(spark)
    formats.write(t("nation").select("n_name", "n_regionkey"), path, partition_by=["n_regionkey"])
    return formats.scan(spark, path, columns=["n_regionkey", "n_name"], where=c("n_regionkey") == 3)


@query("SELECT count(*) AS rows FROM nation")
def io_table_write_rows(spark, t, _):
    return spark.createDataFrame([(formats.write(t("nation"), _folder(spark)),)], "rows long")


_REGION = "SELECT r_regionkey, r_name FROM region"


@query(_REGION)
def io_pandas(spark, t, _):
    return formats.from_pandas(spark, formats.to_pandas(t("region").select("r_regionkey", "r_name")))  # five rows


@query(_REGION)
def io_pysequence(spark, t, _):
    return formats.from_pysequence(spark, formats.to_pylist(t("region").select("r_regionkey", "r_name")), t("region").select("r_regionkey", "r_name").schema)


@query("SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings WHERE vec_id < 20")
def io_numpy(spark, t, _):
    """A matrix to the driver, in batches, and back as a column of arrays."""
    rows = t("embeddings").where("vec_id < 20")
    parts = list(collate.batches(rows.select("vec_id", "embedding"), 7))
    whole = collate.unbatch(spark, parts, "vec_id long, embedding array<double>")
    matrix = formats.from_numpy(spark, np.array([e for p in parts for e in p["embedding"].tolist()], np.float64), "e")  # at most 20 rows
    least = matrix.agg(F.min(F.size("e")).alias("m"))
    return whole.join(F.broadcast(least), F.size("embedding") == c("m")).select("vec_id", c("m").cast("bigint").alias("n"), c("embedding")[0].alias("x"))


@query("SELECT c_name AS value FROM customer")
def io_text(spark, t, _):
    path = _folder(spark)
    formats.write(t("customer").select("c_name"), path, "text")
    return formats.scan(spark, path, "text")


@query("SELECT n_nationkey, true AS here FROM nation")
def io_path_column(spark, t, _):
    """Each row's file, as a column."""
    path = _folder(spark)
    formats.write(t("nation").select("n_nationkey"), path)
    return formats.scan(spark, path, path_column="file").select("n_nationkey", F.contains("file", F.lit("part-")).alias("here"))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def io_bucketed(spark, t, _):
    """Two tables bucketed by their join keys: their join needs no shuffle."""
    names = [f"loomwright_{x}_{uuid.uuid4().hex[:12]}" for x in ("o", "c")]
    formats.write_bucketed(t("orders").select("o_orderkey", "o_custkey"), names[0], 4, "o_custkey", path=_folder(spark))
    formats.write_bucketed(t("customer").select("c_custkey", "c_mktsegment"), names[1], 4, "c_custkey", path=_folder(spark))
    a, b = (spark.table(n) for n in names)
    return a.join(b, a["o_custkey"] == b["c_custkey"]).select("o_orderkey", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey FROM orders")
def rel_round_robin(spark, t, _):
    """Rows dealt in turn to so many partitions, none of which gets much more than another."""
    o = t("orders").select("o_orderkey", "o_custkey").repartition(4).withColumn("_p", F.spark_partition_id())
    return o.where(c("_p") < 4).drop("_p")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS place FROM orders")
def rel_merge_exchange(spark, t, _):
    """Ranges in order, one behind the other: places in the whole order without a task that has all rows."""
    return numbered(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], "place")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_callback(spark, t, sf_dir):
    """A stream's batches handed to a function of one's own, which writes them."""
    path = _folder(spark)
    s = event_stream(spark, sf_dir).select("event_type")
    sink = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)
    s.writeStream.foreachBatch(sink).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS reduced FROM orders")
def df_reduce(spark, t, _):
    return orders(t, "o_custkey").reduce("o_custkey", lambda a, x: a + x, F.lit(0).cast("bigint"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 9")
def df_trace_replay(spark, t, _):
    """Calls recorded on one frame and run again on another."""
    traced = V.Trace(orders(t, "o_custkey")).drop("o_custkey").copy().head(9)
    return V.replay(traced.statements(), orders(t, "o_custkey")).df


@query("SELECT 500::BIGINT AS n, true AS ok")
def df_rand(spark, t, _):
    return V.rand(spark, 500, 3).agg(F.count("*").alias("n"), F.bool_and((c("rand") >= 0) & (c("rand") < 1)).alias("ok"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS m FROM orders")
def win_custom(spark, t, _):
    """A window function of one's own, in Arrow batches of whole windows."""

    @F.pandas_udf("double")
    def mean(s: pd.Series) -> float:
        return float(s.mean())

    return t("orders").select("o_orderkey", F.round(mean("o_totalprice").over(W.partitionBy("o_custkey")), 4).alias("m"))


@query(_REGION)
def io_arrow(spark, t, _):
    return formats.from_arrow(spark, formats.to_arrow(t("region")))  # five rows


@query("SELECT label, int_0, int_12, cat_0 FROM (VALUES (1, 5, 0, -1), (0, 0, 7, 10)) AS v(label, int_0, int_12, cat_0)")
def io_criteo_tsv(spark, t, _):
    row = lambda label, d0, d12, c0: "\t".join([label, d0, *[""] * 11, d12, c0, *[""] * 25])
    path = _folder(spark)
    spark.createDataFrame([(row("1", "5", "x", "ffffffff"),), (row("", "", "7", "a"),)], "value string").write.text(path)
    return criteo.read_tsv(spark, path).select("label", "int_0", "int_12", "cat_0")


@query("SELECT l_orderkey, l_linenumber, round(CAST(CAST(ln(coalesce(int_0, 0) + 3) AS FLOAT) AS DOUBLE), 4) AS d FROM " + CLICKS)
def io_criteo_dense_log(spark, t, _):
    return criteo.dense_log(clicks(t)).select("l_orderkey", "l_linenumber", F.round(c("int_0").cast("double"), 4).alias("d"))


@query("""SELECT l_orderkey, l_linenumber, p, coalesce(new, 1)::BIGINT AS x, s, (CASE WHEN s IS NOT NULL THEN coalesce(snew, 1) END)::BIGINT AS y FROM
  (SELECT l_orderkey, l_linenumber, l_partkey AS p, nullif(l_suppkey, 1) AS s FROM lineitem)
  LEFT JOIN (SELECT l_partkey AS k, row_number() OVER (ORDER BY count(*) DESC, l_partkey) + 1 AS new FROM lineitem GROUP BY 1 HAVING count(*) >= 30) ON k = p
  LEFT JOIN (SELECT l_suppkey AS k2, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) + 1 AS snew FROM lineitem WHERE l_suppkey <> 1 GROUP BY 1 HAVING count(*) >= 30) ON k2 = s""")
def io_sparse_to_contiguous(spark, t, _):
    """Frequent ids are numbered from 2 on, the most frequent first; rare ones share 1; two columns in one pass."""
    li = t("lineitem").select("l_orderkey", "l_linenumber", c("l_partkey").alias("p"), c("l_partkey").alias("x"), F.nullif("l_suppkey", F.lit(1)).alias("s"), F.nullif("l_suppkey", F.lit(1)).alias("y"))
    return criteo.sparse_to_contiguous(li, ["x", "y"], 30)


@query()
def io_etl(spark, t, _):
    return criteo.etl(clicks(t), 1000)


@query("SELECT o_orderkey, 1::BIGINT AS readers, true AS even FROM orders")
def io_rank_shards(spark, t, _):
    """Every row goes to one of the readers, and no reader gets less than half of its share."""
    parts = [criteo.rank_shard(t("orders"), "o_orderkey", r, 3).select("o_orderkey", F.lit(r).alias("rank")) for r in range(3)]
    rows = parts[0].union(parts[1]).union(parts[2])
    each = rows.groupBy("rank").agg(F.count("*").alias("n"))
    even = each.agg((F.min("n") * 6 >= F.sum("n")).alias("even"))  # one row
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("readers")).join(F.broadcast(even), F.lit(True))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders")
def io_shuffle_rows(spark, t, _):
    return criteo.shuffle_rows(t("orders").select("o_orderkey"), 3).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("SELECT count(*) FILTER (WHERE o_orderkey < 500) AS train, count(*) FILTER (WHERE o_orderkey >= 500) AS val FROM orders")
def io_split_by_index(spark, t, _):
    a, b = criteo.split_by_index(t("orders"), "o_orderkey", 500)
    return a.agg(F.count("*").alias("train")).crossJoin(b.agg(F.count("*").alias("val")))


@query("SELECT count(*) AS n FROM orders")
def io_split_at_random(spark, t, _):
    a, b = criteo.split_at_random(t("orders"), 0.7, 5)
    return a.union(b).agg(F.count("*").alias("n"))


@query("SELECT CAST(1000 AS BIGINT) AS n, true AS ok")
def io_random_dataset(spark, t, _):
    d = criteo.random_dataset(spark, 1000, {"cat_0": 10, "cat_1": 99}, 3, 2, 7)
    ok = F.bool_and((F.size("cat_0") == 3) & (F.array_max("cat_0") < 10) & (F.array_min("cat_1") >= 0) & c("int_0").between(0, 1))
    return d.agg(F.count("*").alias("n"), ok.alias("ok"))


@query("SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def io_movielens_join(spark, t, _):
    ratings = t("orders").select("o_orderkey", c("o_custkey").alias("movieId"))
    return criteo.movielens(ratings, t("customer").select(c("c_custkey").alias("movieId"), "c_mktsegment")).select("o_orderkey", "c_mktsegment")


LINES = "(SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY 1)"


def lines(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    return g.select("l_orderkey", F.transform("s", lambda x: x["l_partkey"]).alias("ids"))


def _text(a):
    return F.array_join(a.cast("array<string>"), ",")


@query(f"SELECT l_orderkey, array_to_string(list_concat(ids[1:4], list_transform(range(greatest(4 - len(ids), 0)), lambda i: 0)), ',') AS p FROM {LINES}")
def collate_pad_sequence(spark, t, _):
    return lines(t).select("l_orderkey", _text(collate.pad_sequence("ids", 4, 0)).alias("p"))


@query(f"SELECT l_orderkey, array_to_string(list_transform(range(len(ids) + 1), lambda i: i), ',') AS p FROM {LINES}")
def collate_offsets(spark, t, _):
    return lines(t).select("l_orderkey", _text(collate.offsets(F.transform("ids", lambda x: F.lit(1)))).alias("p"))


@query("SELECT c_custkey, [CAST(c_acctbal AS FLOAT), CAST(0 AS FLOAT)][1]::DOUBLE AS a, 0.0::DOUBLE AS b FROM customer")
def collate_dense(spark, t, _):
    d = t("customer").select("c_custkey", c("c_acctbal").alias("x"), F.lit(None).cast("double").alias("y")).select("c_custkey", collate.dense(["x", "y"], True).alias("d"))
    return d.select("c_custkey", c("d.values")[0].cast("double").alias("a"), c("d.presence")[1].cast("double").alias("b"))


@query(f"SELECT l_orderkey % 5 AS batch, CAST(sum(len(ids)) AS BIGINT) AS n, count(*) AS m FROM {LINES} GROUP BY 1")
def collate_jagged(spark, t, _):
    j = collate.jagged(lines(t).withColumn("batch", c("l_orderkey") % 5), ["ids"], "batch", "l_orderkey")
    return j.select("batch", F.size("ids_values").cast("bigint").alias("n"), F.size("ids_lengths").cast("bigint").alias("m"))


@query(f"SELECT l_orderkey, ids[1] AS a, ids[1] + 1 AS b FROM {LINES}")
def kjt_concat_permute(spark, t, _):
    k = collate.keyed_jagged(lines(t).withColumn("more", F.transform("ids", lambda x: x + 1)), ["ids"])
    both = k.withColumn("all", collate.kjt_concat("kjt", F.create_map(F.lit("more"), "more")))
    p = both.select("l_orderkey", collate.kjt_permute("all", ["more", "ids"]).alias("p"))
    return p.select("l_orderkey", c("p.ids")[0].alias("a"), c("p.more")[0].alias("b"))


@query("SELECT count(*)::BIGINT AS n, '0,' || count(*) AS o FROM lineitem")
def kjt_lengths(spark, t, _):
    k = collate.kjt_lengths(lines(t), ["ids"])
    return k.select(c("length_per_key")[0].cast("bigint").alias("n"), _text(c("offset_per_key")).alias("o"))


@query("SELECT vec_id, len(embedding) * 2 AS n FROM embeddings")
def kt_regroup(spark, t, _):
    e = t("embeddings").select("vec_id", "embedding", c("embedding").alias("b"))
    return e.select("vec_id", F.size(collate.regroup([["embedding", "b"]])[0]).cast("bigint").alias("n"))


@query(f"SELECT l_orderkey, array_to_string(list_transform(ids[1:2], lambda x, i: CASE WHEN i = 1 THEN '0.5' ELSE '0.25' END), ',') AS w FROM {LINES}")
def position_weighted(spark, t, _):
    return lines(t).select("l_orderkey", _text(F.slice(collate.position_weighted("ids", [0.5, 0.25]), 1, 2)).alias("w"))


@query("""SELECT l_orderkey, round(CAST(sum(embedding[1]::DOUBLE) AS DOUBLE), 3) AS x FROM (SELECT l_orderkey, l_partkey % 50 AS id FROM lineitem) JOIN embeddings ON vec_id = id GROUP BY 1""")
def pooled_embeddings(spark, t, _):
    rows = lines(t).select("l_orderkey", F.transform("ids", lambda x: x % 50).alias("ids"))
    table = t("embeddings").select(c("vec_id").alias("id"), "embedding")
    return collate.pooled_embeddings(rows, "l_orderkey", "ids", table, 2).select("l_orderkey", F.round(c("pooled")[0].cast("double"), 3).alias("x"))


# --- metrics ----------------------------------------------------------------------------------------


def predictions(t):
    li = t("lineitem")
    return li.select(
        c("l_returnflag").alias("task"), "l_orderkey", "l_linenumber", "l_partkey", (0.02 + (c("l_quantity") * 7 + c("l_linenumber") * 3) % 97 / 100).alias("prediction"),
        (c("l_partkey") % 3 == 0).cast("double").alias("label"), (1 + c("l_linenumber") % 2).cast("double").alias("weight"), (c("l_orderkey") % 8).alias("batch"),
    )


PRED = "(SELECT l_returnflag AS task, l_orderkey, l_linenumber, l_partkey, 0.02 + fmod(l_quantity * 7 + l_linenumber * 3, 97) / 100 AS p, CAST(l_partkey % 3 = 0 AS DOUBLE) AS y, CAST(1 + l_linenumber % 2 AS DOUBLE) AS w, l_orderkey % 8 AS batch FROM lineitem)"
TERMS = "sum(w) AS sw, sum(w * y) AS pos, sum(w * (1 - y)) AS neg, sum(w * p) AS pr, sum(w * (p - y) * (p - y)) AS sq, sum(w * abs(p - y)) AS ab, -sum(w * (y * log2(p) + (1 - y) * log2(1 - p))) AS ce, count(*) AS n"


@query(f"""SELECT task, round(ce / -(pos * log2(pos / sw) + neg * log2(1 - pos / sw)), 6) AS ne, round(ce / sw, 6) AS logloss, round(pos / sw, 6) AS ctr, round(pr / pos, 6) AS calibration,
  round(sq / sw, 6) AS mse, round(sqrt(sq / sw), 6) AS rmse, round(ab / sw, 6) AS mae, n AS examples FROM (SELECT task, {TERMS} FROM {PRED} GROUP BY 1)""")
def metric_all(spark, t, _):
    m = M.metrics(predictions(t), ["task"])
    return m.select(*[F.round(x, 6).alias(x) if x not in ("task", "examples") else x for x in m.columns])


@query(f"""WITH b AS (SELECT task, batch, sum(w) AS sw, sum(w * y) AS pos, count(*) AS n FROM {PRED} GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY task ORDER BY batch) AS l FROM b)
  SELECT a.task, a.batch, round(sum(z.pos) / sum(z.sw), 6) AS window_ctr, CAST(sum(z.n) AS DOUBLE) AS window_examples FROM r a JOIN r z ON a.task = z.task AND z.batch <= a.batch AND z.l - z.n >= a.l - 400 GROUP BY ALL""")
def metric_window(spark, t, _):
    m = M.window_metrics(predictions(t), "task", "batch", 400)
    return m.select("task", "batch", F.round("window_ctr", 6).alias("window_ctr"), F.round("window_examples", 0).alias("window_examples")).where("window_examples > 0")


@query(f"""WITH r AS (SELECT task, w * y AS tp, w * (1 - y) AS fp, sum(w * y) OVER (PARTITION BY task ORDER BY p DESC, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS c FROM {PRED})
  SELECT task, round(sum(fp * (c - tp / 2)) / (sum(tp) * sum(fp)), 6) AS auc FROM r GROUP BY 1""")
def metric_auc(spark, t, _):
    return M.auc(predictions(t), "task", tie=["l_orderkey", "l_linenumber", "l_partkey"]).select("task", F.round("auc", 6).alias("auc"))


@query("SELECT vec_id, CAST(CASE WHEN len(list_filter(embedding[1:5], lambda x: x > embedding[1 + vec_id % 5])) < 2 THEN 1 ELSE 0 END AS DOUBLE) AS r FROM embeddings")
def metric_multiclass_recall(spark, t, _):
    return t("embeddings").select("vec_id", M.multiclass_recall(F.slice("embedding", 1, 5), c("vec_id") % 5, 2).alias("r"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS d, count(*) AS examples, round(count(*) / 86400.0, 8) AS per_second FROM events GROUP BY 1")
def metric_throughput(spark, t, _):
    m = M.throughput(t("events").withColumn("ts", c("ts").cast("timestamp")), "ts", "1 day")
    return m.select(F.date_format("start", "yyyy-MM-dd").alias("d"), "examples", F.round("per_second", 8).alias("per_second"))


@query("SELECT user_id, CASE WHEN r <= 8 THEN r - 1 END AS slot FROM (SELECT user_id, row_number() OVER (ORDER BY min(ts), min(event_id), user_id) AS r FROM (SELECT user_id, ts, event_id FROM events) GROUP BY 1)")
def id_first_come_slots(spark, t, _):
    return M.first_come_slots(t("events"), "user_id", ["ts", "event_id"], 8).select("user_id", c("slot").cast("bigint").alias("slot"))


@query("SELECT user_id, uses, CAST(floor(log2(uses)) AS INTEGER) AS frequency FROM (SELECT user_id, count(*) AS uses FROM events GROUP BY 1)")
def id_eviction_order(spark, t, _):
    return M.eviction_order(t("events"), "user_id", "ts").select("user_id", "uses", "frequency")


def run_stream(stream, spark, mode: str = "append"):
    """A stream of files run to its end into a table in the shared folder."""
    out, check = _folder(spark), _folder(spark)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    fixed = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    # the table may be a file or a folder of files; a glob serves both
    return spark.readStream.schema(fixed).format("parquet").load(f"{sf_dir}/events.parque*")


@query()
def stream_metrics(spark, t, sf_dir):
    """Metrics of the event stream by day; the last, still open windows aren't put out."""
    s = event_stream(spark, sf_dir).withColumn("ts", c("ts").cast("timestamp"))
    s = s.withColumns({"prediction": F.pmod("event_id", F.lit(97)) / 97.0 * 0.9 + 0.05, "label": (F.pmod("user_id", F.lit(2)) == 0).cast("double"), "weight": F.lit(1.0)})
    m = M.stream_metrics(s, "ts", "1 day", "1 hour", names=["ctr", "mse", "examples"])
    return run_stream(m, spark).select(c("window.start").alias("start"), F.round("ctr", 6).alias("ctr"), F.round("mse", 6).alias("mse"), "examples")


@query()
def stream_id_slots(spark, t, sf_dir):
    """Users to cache slots, per event type, with state kept between batches."""
    s = M.stream_slots(event_stream(spark, sf_dir).select("event_type", "user_id"), "user_id", 4, "event_type")
    return run_stream(s, spark).groupBy("event_type").agg(F.count("*").alias("n"), F.max("slot").alias("top"))


@query("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS d, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL")
def extra_event_windows(spark, t, _):
    """Extra: tumbling windows by event time."""
    e = t("events").withColumn("ts", c("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return g.select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("d"), "n", "v")


@query("""SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE b IS NULL OR ts - b > INTERVAL 6 HOUR OR ts - b = INTERVAL 6 HOUR GROUP BY 1""")
def extra_sessions(spark, t, _):
    e = t("events").withColumn("ts", c("ts").cast("timestamp"))
    return e.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def extra_intersect(spark, t, _):
    return t("orders").select("o_custkey").intersect(t("customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def extra_except(spark, t, _):
    return t("customer").select("c_custkey").exceptAll(t("orders").select("o_custkey").distinct())


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
