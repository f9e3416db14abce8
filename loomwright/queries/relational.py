"""Relational operators, aggregates, windows and star-schema queries, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import sparkdialect as S
from ..operators import relational as R
from ..sources.tables import load

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, tables) under its name; tables(name) loads one."""

    def register(f):
        def run(spark, sf_dir):
            return f(spark, lambda name: load(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- plan nodes ----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.02 AND 0.05")
def rel_scan_filter_project(spark, t):
    return t("lineitem").where((c("l_quantity") > 45) & c("l_discount").between(0.02, 0.05)).select("l_orderkey", "l_extendedprice")


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) AS v(n, s)")
def rel_values(spark, t):
    return R.values(spark, [(1, "a"), (2, None), (None, "c")], "n int, s string")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS q, count(*) AS n FROM lineitem GROUP BY ALL")
def rel_hash_aggregation(spark, t):
    return R.aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], {"q": F.sum("l_quantity"), "n": F.count("*")})


@query("SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT NULL GROUP BY 1")
def rel_aggregation_ignore_null_keys(spark, t):
    return R.aggregate(t("orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("s")), ["s"], {"n": F.count("*")}, ignore_null_keys=True)


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS open FROM orders GROUP BY 1")
def rel_aggregation_masks(spark, t):
    o = t("orders").withColumns({"big_": c("o_totalprice") > 100000, "open_": c("o_orderstatus") == "O"})
    return R.aggregate(o, ["o_orderpriority"], {"big": A.filtered(F.count, "o_orderkey", "big_"), "open": F.round(A.filtered(F.sum, "o_totalprice", "open_"), 2)})


@query("SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last FROM lineitem GROUP BY 1")
def rel_streaming_aggregation(spark, t):
    """Aggregation of input that is clustered by its keys already."""
    return R.aggregate(t("lineitem").sortWithinPartitions("l_orderkey"), ["l_orderkey"], {"n": F.count("*"), "last": F.max("l_linenumber")})


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n,
  CAST(CASE grouping(l_returnflag) * 2 + grouping(l_linestatus) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS INTEGER) AS group_id
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""")
def rel_group_id(spark, t):
    return R.group_id(t("lineitem"), [["l_returnflag", "l_linestatus"], ["l_returnflag"], ["l_linestatus"], []], ["l_returnflag", "l_linestatus"], {"n": F.count("*")})


JOIN = "SELECT c_custkey, o_orderkey FROM customer {how} JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) o ON c_custkey = o_custkey"


def _sides(t):
    return t("customer").select("c_custkey", "c_acctbal"), t("orders").where("o_totalprice > 100000").select("o_custkey", "o_orderkey", "o_totalprice")


def _joins():
    for how, word in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
        def run(spark, t, how=how):
            a, b = _sides(t)
            return R.join(a, b, [("c_custkey", "o_custkey")], how, hint="shuffle_hash" if how != "full" else None).select("c_custkey", "o_orderkey")

        run.__name__ = f"rel_hash_join_{how}"
        query(JOIN.format(how=word))(run)


_joins()


@query(JOIN.format(how="INNER") + " AND o_totalprice > c_acctbal * 20")
def rel_hash_join_extra_filter(spark, t):
    a, b = _sides(t)
    return R.join(a, b, [("c_custkey", "o_custkey")], where=c("o_totalprice") > c("c_acctbal") * 20).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def rel_left_semi_join(spark, t):
    a, b = _sides(t)
    return R.join(a, b, [("c_custkey", "o_custkey")], "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def rel_right_semi_join(spark, t):
    a, b = _sides(t)
    return R.join(a.where("c_acctbal > 0"), b, [("c_custkey", "o_custkey")], "right_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE nullif(c_custkey, 5) NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def rel_null_aware_anti_join(spark, t):
    a, b = _sides(t)
    a = a.withColumn("k", F.nullif(c("c_custkey"), F.lit(5).cast("bigint")))
    return R.join(a, b, [("k", "o_custkey")], "null_aware_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 7) FROM orders WHERE o_totalprice > 100000 OR o_custkey = 7)")
def rel_null_aware_anti_join_null_build(spark, t):
    b = t("orders").where("o_totalprice > 100000 OR o_custkey = 7").select(F.nullif(c("o_custkey"), F.lit(7).cast("bigint")).alias("k"))
    return R.null_aware_anti(t("customer").select("c_custkey"), b, [("c_custkey", "k")])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000 AND o_custkey = c_custkey)")
def rel_left_anti_join(spark, t):
    a, b = _sides(t)
    return R.join(a, b, [("c_custkey", "o_custkey")], "left_anti").select("c_custkey")


@query(JOIN.format(how="LEFT") + " AND o_totalprice > 150000")
def rel_merge_join(spark, t):
    a, b = _sides(t)
    return R.merge_join(a, b, [("c_custkey", "o_custkey")], "left", c("o_totalprice") > 150000).select("c_custkey", "o_orderkey")


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey < n_regionkey")
def rel_cross_join_theta(spark, t):
    return t("region").join(t("nation"), c("r_regionkey") < c("n_regionkey")).select("r_name", "n_name")


@query("SELECT r_name, s_suppkey FROM region CROSS JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000)")
def rel_cross_join(spark, t):
    return t("region").crossJoin(t("supplier").where("s_acctbal > 5000")).select("r_name", "s_suppkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def rel_order_by(spark, t):
    return R.order_by(t("customer").select("c_custkey", "c_acctbal"), [("c_acctbal", False, False), ("c_custkey", True, True)])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def rel_top_n(spark, t):
    return R.top_n(t("orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", False, False), ("o_orderkey", True, True)], 20)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30")
def rel_limit_offset(spark, t):
    return R.limit(t("orders").select("o_orderkey").orderBy("o_orderkey"), 30, 15)


@query("""SELECT vec_id, i::BIGINT AS place, a[i] AS x, b[i] AS y FROM (SELECT vec_id, embedding[1:4] AS a, embedding[1:2] AS b FROM embeddings), range(1, 5) r(i)""")
def rel_unnest(spark, t):
    e = t("embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("a"), F.slice("embedding", 1, 2).alias("b"))
    return R.unnest(e, ["vec_id"], ["a", "b"], "place", ["x", "y"])


@query("SELECT vec_id, unnest(['p', 'q']) AS k, unnest([embedding[1], embedding[2]]) AS v FROM embeddings")
def rel_unnest_map(spark, t):
    e = t("embeddings").select("vec_id", F.create_map(F.lit("p"), c("embedding")[0], F.lit("q"), c("embedding")[1]).alias("m"))
    return R.unnest(e, ["vec_id"], ["m"], names=["k", "v"])


@query("SELECT max(c_acctbal) AS top FROM customer")
def rel_enforce_single_row(spark, t):
    return R.enforce_single_row(t("customer").agg(F.max("c_acctbal").alias("top")))


@query("SELECT CAST(NULL AS BIGINT) AS c_custkey")
def rel_enforce_single_row_empty(spark, t):
    return R.enforce_single_row(t("customer").where("c_custkey < -1").select("c_custkey"))


@query("SELECT count(*) AS n, count(*) AS ids FROM lineitem")
def rel_assign_unique_id(spark, t):
    return R.assign_unique_id(t("lineitem"), "id", 3).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def rel_union_all(spark, t):
    return R.union_all(t("nation").select(c("n_name").alias("name")), t("region").select(c("r_name").alias("name")))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def rel_distinct(spark, t):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders")
def rel_partition(spark, t):
    return R.partition(R.partition(t("orders"), 6, ["o_custkey"]), 3).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) GROUP BY 1")
def rel_sql_front_end(spark, t):
    """SQL text over the tables: parser, analyzer and optimizer are Spark's."""
    t("orders").createOrReplaceTempView("loom_orders")
    t("lineitem").createOrReplaceTempView("loom_lineitem")
    return spark.sql("SELECT o_custkey, count(*) AS n FROM loom_orders WHERE o_orderkey IN (SELECT l_orderkey FROM loom_lineitem WHERE l_quantity > 48) GROUP BY o_custkey")


# --- windows -------------------------------------------------------------------------------------

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


def _windows():
    for name, f in RANKS.items():
        tie = ", o_orderkey" if name == "row_number" else ""

        def run(spark, t, f=f, tie=tie):
            order = [F.desc("o_orderstatus"), *([c("o_orderkey")] if tie else [])]
            w = R.window(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], order, {"v": f()})
            return w.select("o_orderkey", F.round(c("v").cast("double"), 9).alias("v"))

        run.__name__ = f"win_{name}"
        query(f"SELECT o_orderkey, round(CAST({name}() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC{tie}) AS DOUBLE), 9) AS v FROM orders")(run)


_windows()


@query("SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS v FROM orders")
def win_rows_frame(spark, t):
    w = R.window(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], [c("o_orderkey")], {"v": F.count("*")}, (-2, 1), "rows")
    return w.select("o_orderkey", "v")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 2) AS v FROM orders")
def win_default_range_frame(spark, t):
    w = R.window(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), ["o_custkey"], [c("o_orderstatus")], {"v": F.sum("o_totalprice")})
    return w.select("o_orderkey", F.round("v", 2).alias("v"))


# --- aggregates ----------------------------------------------------------------------------------


def agg(name: str, expr, sql: str, table: str = "orders", by: str = "o_orderpriority"):
    def run(spark, t):
        return t(table).groupBy(by).agg(expr().alias("v"))

    run.__name__ = f"agg_{name}"
    query(f"SELECT {by}, {sql} AS v FROM {table} GROUP BY 1" if sql else None)(run)


def _text_list(a):
    return F.array_join(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit("?"))), ",")


agg("count", lambda: F.count("*"), "count(*)")
agg("count_column", lambda: F.count(F.nullif("o_orderstatus", F.lit("F"))), "count(nullif(o_orderstatus, 'F'))")
agg("count_if", lambda: A.count_if(c("o_totalprice") > 50000), "count(*) FILTER (WHERE o_totalprice > 50000)")
agg("sum", lambda: F.sum("o_custkey"), "CAST(sum(o_custkey) AS BIGINT)")
agg("avg", lambda: F.round(F.avg("o_totalprice"), 4), "round(avg(o_totalprice), 4)")
agg("min_max", lambda: F.max("o_totalprice") - F.min("o_totalprice"), "max(o_totalprice) - min(o_totalprice)")
agg("min_by", lambda: F.min_by("o_orderkey", "o_totalprice"), "arg_min(o_orderkey, o_totalprice)")
agg("max_by", lambda: F.max_by("o_orderkey", "o_totalprice"), "arg_max(o_orderkey, o_totalprice)")
agg("arbitrary", lambda: A.arbitrary("o_orderpriority"), "any_value(o_orderpriority)")
agg("array_agg", lambda: _text_list(F.array_sort(A.array_agg(F.nullif(F.pmod("o_custkey", F.lit(9)), F.lit(3))))), "array_to_string(list_transform(list_sort(list(nullif(o_custkey % 9, 3)), 'ASC', 'NULLS LAST'), lambda x: coalesce(CAST(x AS VARCHAR), '?')), ',')")
agg("bitwise_and", lambda: F.bit_and(c("o_orderkey").bitwiseOR(F.lit(6))), "bit_and(o_orderkey | 6)")
agg("bitwise_or", lambda: F.bit_or("o_orderkey"), "bit_or(o_orderkey)")
agg("bool_and", lambda: F.bool_and(c("o_totalprice") > 1000), "bool_and(o_totalprice > 1000)")
agg("bool_or", lambda: F.bool_or(c("o_totalprice") > 400000), "bool_or(o_totalprice > 400000)")
agg("every", lambda: F.every(c("o_custkey") >= 0), "bool_and(o_custkey >= 0)")
for _f, _s in (("stddev", "stddev"), ("stddev_pop", "stddev_pop"), ("stddev_samp", "stddev_samp"), ("variance", "variance"), ("var_pop", "var_pop"), ("var_samp", "var_samp")):
    agg(_f, lambda f=_f: F.round(getattr(F, f)("o_custkey"), 4), f"round({_s}(o_custkey), 4)")
agg("corr", lambda: F.round(F.corr("o_totalprice", "o_custkey"), 6), "round(corr(o_totalprice, o_custkey), 6)")
agg("covar_pop", lambda: F.round(F.covar_pop("o_totalprice", "o_custkey"), 1), "round(covar_pop(o_totalprice, o_custkey), 1)")
agg("covar_samp", lambda: F.round(F.covar_samp("o_totalprice", "o_custkey"), 1), "round(covar_samp(o_totalprice, o_custkey), 1)")
agg("max_data_size_for_stats", lambda: A.max_data_size_for_stats("text").cast("bigint"), "CAST(max(strlen(text)) AS BIGINT)", "documents", "lang")
agg("checksum", lambda: A.checksum("o_orderkey", "o_custkey").cast("string"), None)
agg("approx_distinct", lambda: (F.abs(A.approx_distinct("o_custkey") - F.count_distinct("o_custkey")) <= 0.1 * F.count_distinct("o_custkey")), "true")
agg("approx_set", lambda: (F.abs(A.set_cardinality(A.approx_set("o_custkey")) - F.count_distinct("o_custkey")) <= 0.1 * F.count_distinct("o_custkey")), "true")
agg("approx_percentile", lambda: (F.abs(A.approx_percentile("o_totalprice", 0.5) - F.median("o_totalprice")) <= F.lit(0.05) * F.max("o_totalprice")), "true")
agg("percentile_weighted", lambda: F.round(A.approx_percentile("o_custkey", 0.5, weight=F.lit(2)), 4), None)
agg("last", lambda: S.last("o_orderpriority"), "any_value(o_orderpriority)")
agg("map_agg", lambda: F.map_from_entries(F.array_sort(F.map_entries(A.map_agg(F.pmod("o_custkey", F.lit(3)), F.lit(1)))))[F.lit(2).cast("bigint")], "1")


@query("SELECT DISTINCT o_orderstatus, true AS v FROM orders")
def agg_merge_sets(spark, t):
    per = t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(A.approx_set("o_custkey").alias("s"))
    exact = t("orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n"))
    merged = per.groupBy("o_orderstatus").agg(A.set_cardinality(A.merge_sets("s")).alias("e"))
    return merged.join(exact, "o_orderstatus").select("o_orderstatus", (F.abs(c("e") - c("n")) <= 0.1 * c("n")).alias("v"))


@query("SELECT CAST(0 AS BIGINT) AS v")
def agg_empty_approx_set(spark, t):
    return A.empty_approx_set(spark).select(F.coalesce(A.set_cardinality("sketch"), F.lit(0).cast("bigint")).alias("v"))


@query("SELECT l_returnflag, l_linestatus AS k, count(*) AS v FROM lineitem GROUP BY ALL")
def agg_histogram(spark, t):
    return A.histogram(t("lineitem"), ["l_returnflag"], "l_linestatus", "h").select("l_returnflag", F.explode("h").alias("k", "v"))


@query("SELECT l_returnflag, l_linenumber AS k, n AS v FROM (SELECT l_returnflag, l_linenumber, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem GROUP BY 1, 2) WHERE r <= 3")
def agg_approx_most_frequent(spark, t):
    return A.approx_most_frequent(t("lineitem"), ["l_returnflag"], "l_linenumber", 3, "m").select("l_returnflag", F.explode("m").alias("k", "v"))


@query("SELECT o_orderstatus, o_custkey % 4 AS k, min(o_orderkey) AS v FROM orders GROUP BY ALL")
def agg_map_union(spark, t):
    o = t("orders").select("o_orderstatus", F.create_map(c("o_custkey") % 4, "o_orderkey").alias("m"))
    return A.map_union(o, ["o_orderstatus"], "m", "u").select("o_orderstatus", F.explode("u").alias("k", "v"))


# --- star-schema queries --------------------------------------------------------------------------

def revenue():
    return c("l_extendedprice") * (1 - c("l_discount"))



@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def tpch_q1(spark, t):
    li = t("lineitem").where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(revenue()), 4).alias("sum_disc"),
        F.round(F.sum(revenue() * (1 + c("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, strftime(o_orderdate, '%Y-%m-%d') AS d FROM customer, orders, lineitem
  WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def tpch_q3(spark, t):
    j = t("customer").where("c_mktsegment = 'BUILDING'").join(t("orders"), c("c_custkey") == c("o_custkey")).join(t("lineitem"), c("l_orderkey") == c("o_orderkey"))
    g = j.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(revenue()), 4).alias("revenue"))
    return g.select("o_orderkey", "revenue", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
  WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
  AND r_regionkey <= 2 GROUP BY 1""")
def tpch_q5(spark, t):
    j = t("region").where("r_regionkey <= 2").join(t("nation"), c("n_regionkey") == c("r_regionkey")).join(t("supplier"), c("s_nationkey") == c("n_nationkey"))
    j = j.join(t("lineitem"), c("l_suppkey") == c("s_suppkey")).join(t("orders"), c("l_orderkey") == c("o_orderkey"))
    j = j.join(t("customer"), (c("c_custkey") == c("o_custkey")) & (c("c_nationkey") == c("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(revenue()), 4).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q6(spark, t):
    d = lambda x: F.lit(x).cast("timestamp_ntz")
    li = t("lineitem").where((c("l_shipdate") >= d("1994-01-01")) & (c("l_shipdate") < d("1996-01-01")) & c("l_discount").between(0.05, 0.07) & (c("l_quantity") < 24))
    return li.agg(F.round(F.sum(c("l_extendedprice") * c("l_discount")), 2).alias("revenue"))


@query("""SELECT n1.n_name AS supp, n2.n_name AS cust, year(l_shipdate) AS y, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
  FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey
  AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_regionkey = 1 AND n2.n_regionkey = 2 GROUP BY ALL""")
def tpch_q7(spark, t):
    n1 = t("nation").where("n_regionkey = 1").select(c("n_nationkey").alias("k1"), c("n_name").alias("supp"))
    n2 = t("nation").where("n_regionkey = 2").select(c("n_nationkey").alias("k2"), c("n_name").alias("cust"))
    j = n1.join(t("supplier"), c("s_nationkey") == c("k1")).join(t("lineitem"), c("s_suppkey") == c("l_suppkey")).join(t("orders"), c("o_orderkey") == c("l_orderkey"))
    j = j.join(t("customer"), c("c_custkey") == c("o_custkey")).join(n2, c("c_nationkey") == c("k2"))
    return j.groupBy("supp", "cust", F.year("l_shipdate").cast("bigint").alias("y")).agg(F.round(F.sum(revenue()), 4).alias("revenue"))


@query("""SELECT year(o_orderdate) AS y, round(sum(CASE WHEN n2.n_regionkey = 1 THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey
  AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_regionkey <= 3 AND s_nationkey = n2.n_nationkey AND p_size > 10 GROUP BY 1""")
def tpch_q8(spark, t):
    n1 = t("nation").select(c("n_nationkey").alias("k1"), c("n_regionkey").alias("r1"))
    n2 = t("nation").select(c("n_nationkey").alias("k2"), c("n_regionkey").alias("r2"))
    j = t("part").where("p_size > 10").join(t("lineitem"), c("p_partkey") == c("l_partkey")).join(t("supplier"), c("s_suppkey") == c("l_suppkey"))
    j = j.join(t("orders"), c("l_orderkey") == c("o_orderkey")).join(t("customer"), c("o_custkey") == c("c_custkey"))
    j = j.join(n1, c("c_nationkey") == c("k1")).join(t("region").where("r_regionkey <= 3"), c("r1") == c("r_regionkey")).join(n2, c("s_nationkey") == c("k2"))
    share = F.sum(F.when(c("r2") == 1, revenue()).otherwise(0.0)) / F.sum(revenue())
    return j.groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(F.round(share, 6).alias("share"))


@query("""SELECT n_name, year(o_orderdate) AS y, round(sum(l_extendedprice * (1 - l_discount) - 0.5 * l_quantity), 4) AS profit FROM part, supplier, lineitem, orders, nation
  WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%a%' GROUP BY ALL""")
def tpch_q9(spark, t):
    j = t("part").where(c("p_name").like("%a%")).join(t("lineitem"), c("p_partkey") == c("l_partkey")).join(t("supplier"), c("s_suppkey") == c("l_suppkey"))
    j = j.join(t("orders"), c("o_orderkey") == c("l_orderkey")).join(t("nation"), c("s_nationkey") == c("n_nationkey"))
    return j.groupBy("n_name", F.year("o_orderdate").cast("bigint").alias("y")).agg(F.round(F.sum(revenue() - 0.5 * c("l_quantity")), 4).alias("profit"))


@query("""SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, n_name FROM customer, orders, lineitem, nation
  WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20""")
def tpch_q10(spark, t):
    j = t("customer").join(t("orders"), c("c_custkey") == c("o_custkey")).join(t("lineitem").where("l_returnflag = 'R'"), c("l_orderkey") == c("o_orderkey"))
    g = j.join(t("nation"), c("c_nationkey") == c("n_nationkey")).groupBy("c_custkey", "c_name", "n_name").agg(F.round(F.sum(revenue()), 4).alias("revenue"))
    return g.orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query("""SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high,
  CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_linenumber <= 3 GROUP BY 1""")
def tpch_q12(spark, t):
    high = c("o_orderpriority").isin("1-URGENT", "2-HIGH")
    j = t("lineitem").where("l_linenumber <= 3").join(t("orders"), c("o_orderkey") == c("l_orderkey"))
    return j.groupBy("l_linestatus").agg(F.count_if(high).alias("high"), F.count_if(~high).alias("low"))


@query("""SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY 1) GROUP BY 1""")
def tpch_q13(spark, t):
    o = t("orders").where("o_orderpriority <> '1-URGENT'")
    per = t("customer").join(o, c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return per.groupBy("n").agg(F.count("*").alias("customers"))


@query("SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem, part WHERE l_partkey = p_partkey")
def tpch_q14(spark, t):
    j = t("lineitem").join(t("part"), c("l_partkey") == c("p_partkey"))
    return j.agg(F.round(100.0 * F.sum(F.when(c("p_type").like("PROMO%"), revenue()).otherwise(0.0)) / F.sum(revenue()), 6).alias("promo"))


@query("""WITH r AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total FROM lineitem GROUP BY 1)
  SELECT s_suppkey, s_name, total FROM supplier, r WHERE s_suppkey = l_suppkey AND total = (SELECT max(total) FROM r)""")
def tpch_q15(spark, t):
    r = t("lineitem").groupBy("l_suppkey").agg(F.round(F.sum(revenue()), 4).alias("total"))
    top = R.enforce_single_row(r.agg(F.max("total").alias("top")))
    return r.join(F.broadcast(top), c("total") == c("top")).join(t("supplier"), c("s_suppkey") == c("l_suppkey")).select("s_suppkey", "s_name", "total")


@query("""SELECT p_brand, p_size, count(DISTINCT l_suppkey) AS suppliers FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45'
  AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""")
def tpch_q16(spark, t):
    li = R.null_aware_anti(t("lineitem").select("l_partkey", "l_suppkey"), t("supplier").where("s_acctbal < 0"), [("l_suppkey", "s_suppkey")])
    j = li.join(t("part").where("p_brand <> 'Brand#45'"), c("l_partkey") == c("p_partkey"))
    return j.groupBy("p_brand", "p_size").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@query("""SELECT c_name, o_orderkey, o_totalprice, sum(l_quantity) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 180)
  AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY ALL""")
def tpch_q18(spark, t):
    big = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 180")
    return t("orders").join(big, c("o_orderkey") == c("l_orderkey")).join(t("customer"), c("c_custkey") == c("o_custkey")).select("c_name", "o_orderkey", "o_totalprice", "q")


@query("""SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND (
  (p_size < 10 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 10 AND 20 AND l_quantity BETWEEN 10 AND 20) OR (p_size > 20 AND l_quantity BETWEEN 20 AND 30))""")
def tpch_q19(spark, t):
    q, s = c("l_quantity"), c("p_size")
    cond = ((s < 10) & q.between(1, 11)) | (s.between(10, 20) & q.between(10, 20)) | ((s > 20) & q.between(20, 30))
    return t("lineitem").join(t("part"), (c("p_partkey") == c("l_partkey")) & cond).agg(F.round(F.sum(revenue()), 4).alias("revenue"))


@query("""SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey < 12 AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey < 12)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY 1""")
def tpch_q22(spark, t):
    cust = t("customer").where("c_nationkey < 12")
    mean = R.enforce_single_row(cust.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean")))
    rich = cust.join(F.broadcast(mean), c("c_acctbal") > c("mean"))
    return rich.join(t("orders").where("o_totalprice > 300000"), c("o_custkey") == c("c_custkey"), "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
