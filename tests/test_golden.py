"""Golden vectors of the feature functions, and errors and edges that tables don't show."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomwright.functions import aggregates as A
from loomwright.functions import presto as P
from loomwright.functions import rec, text
from loomwright.operators import relational as R
from loomwright.operators.frame import Frame, floor_divide, floor_mod, true_divide
from loomwright.plans import dsl
from loomwright.sources import collate
from loomwright.streaming import metrics as M


def one(spark, expr, rows=None, schema=None):
    df = spark.createDataFrame(rows, schema) if rows is not None else spark.range(1)
    return [r[0] for r in df.select(expr).collect()]


def test_bucketize(spark):
    rows = [(x,) for x in (1, 2, 3, 5, 8, 10, 11, None)]
    assert one(spark, rec.bucketize("a", [2, 5, 10]), rows, "a int") == [0, 0, 1, 1, 2, 2, 3, None]
    assert one(spark, rec.bucketize_list("a", [2.0]), [([1.0, 2.0, 3.0],), ([None],), (None,)], "a array<float>") == [[0, 0, 1], None, None]
    for bad in ([], [2, 1], [1, 1, 1]):
        with pytest.raises(ValueError):
            rec.bucketize(F.lit(1), bad)


def test_sigrid_hash(spark):
    want = [6, 60, 54, 54, 9, 4, 91, 11, 67, 79, 2, 25, 92, 98, 83, 66]
    assert one(spark, rec.sigrid_hash("a", 0, 100), [(i,) for i in range(16)] + [(None,)], "a long") == want + [None]
    lists = [([0, 1, 2, 3],), ([4, 5, 6],), ([7, 8, 9],), ([],), (None,), ([1, None],)]
    assert one(spark, rec.sigrid_hash_list("a", 0, 100), lists, "a array<long>") == [want[:4], want[4:7], want[7:10], [], None, None]
    assert one(spark, rec.sigrid_hash("a", 9, 1), [(5,), (-(2**63),)], "a long") == [0, 0]
    assert all(0 <= x < 7 for x in one(spark, rec.sigrid_hash("a", 2**40, 7), [(-(2**63),), (2**63 - 1,), (-1,)], "a long"))
    with pytest.raises(ValueError):
        rec.sigrid_hash(F.lit(1), 0, 0)


A4 = [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 10, 11, 12]]


def test_overlap_scores(spark):
    rows = [
        ([1, 2, 3], [1.0, 2.0, 3.0], [1, 2, 3], [1.0, 2.0, 3.0]), ([4, 5, 6], [4.0, 5.0, 6.0], [0, 10], [0.0, 10.0]),
        ([7, 8, 9], [7.0, 8.0, 9.0], [7, 10, 10], [7.0, 10.0, 10.0]), ([10, 10, 11, 12], [10.0, 10.0, 11.0, 12.0], [10, 10, 11, 13], [10.0, 10.0, 11.0, 13.0]),
    ]
    schema = "a array<long>, wa array<float>, b array<long>, wb array<float>"
    assert one(spark, rec.has_id_overlap("a", "b"), rows, schema) == [1, 0, 1, 1]
    assert one(spark, rec.id_overlap_count("a", "b"), rows, schema) == one(spark, rec.get_max_count("a", "b"), rows, schema) == [3, 0, 1, 3]
    assert one(spark, rec.get_jaccard_similarity("a", "b"), rows, schema) == pytest.approx([1, 0, 0.2, 0.6])
    assert one(spark, rec.get_score_sum("a", "wa", "b", "wb"), rows, schema) == [6, 0, 7, 31]
    assert one(spark, rec.get_score_min("a", "b", "wb"), rows, schema) == [1, 0, 7, 10]
    assert one(spark, rec.get_score_max("a", "b", "wb"), rows, schema) == [3, 0, 7, 11]
    cos = one(spark, rec.get_cosine_similarity("a", "wa", "b", "wb"), rows, schema)
    assert cos[0] == pytest.approx(1) and cos[1] == 0 and cos[2] == pytest.approx(49 / math.sqrt(194 * 449), rel=1e-5)
    assert cos[3] == pytest.approx((400 + 121) / math.sqrt((400 + 121 + 144) * (400 + 121 + 169)), rel=1e-5)
    with pytest.raises(PySparkException):
        one(spark, rec.get_cosine_similarity("a", "wa", "b", "wb"), [([1], [0.0], [1], [1.0])], schema)
    with pytest.raises(PySparkException):
        one(spark, rec.get_score_sum("a", "wa", "b", "wb"), [([1], [0.0, 1.0], [1], [1.0])], schema)
    assert one(spark, rec.get_max_count("a", "b"), [([1, 1, 2], [0.0], [1, 2, 2], [0.0])], schema) == [4]


def test_lists(spark):
    rows = [([0, 1, 2, 3],), ([-1, 25, 10],), ([0, 0, 0, 0],), ([],), (None,), ([1, None],)]
    s = "a array<long>"
    assert one(spark, rec.clamp_list("a", 0, 20), rows, s) == [[0, 1, 2, 3], [0, 20, 10], [0] * 4, [], None, None]
    assert one(spark, rec.ngram("a", 3), rows, s) == [[0, 1, 2, 1, 2, 3], [-1, 25, 10], [0] * 6, [], None, None]
    assert one(spark, rec.firstx("a", 2), rows, s) == [[0, 1], [-1, 25], [0, 0], [], None, None]
    assert one(spark, rec.onehot("a", 0.0, 16.0, 4), [([5],), ([16],), ([-1],), ([15],), (None,)], s) == [[0, 1, 0, 0], [1, 0, 0, 0], [1, 0, 0, 0], [0, 0, 0, 1], None]
    assert one(spark, rec.mapid("a", F.array(F.lit(5), F.lit(6))), [([0, 1, 2],)], s) == [[5, 6, 0]]
    assert one(spark, rec.add_tokens(rec.add_tokens("a", [0], True), [6], False), [([1, 2],), ([3, 4, 5],)], s) == [[0, 1, 2, 6], [0, 3, 4, 5, 6]]
    assert one(spark, collate.pad_sequence("a", 3, 9), [([1],), ([1, 2, 3, 4],)], s) == [[1, 9, 9], [1, 2, 3]]
    assert one(spark, collate.offsets("a"), [([2, 0, 3],)], "a array<int>") == [[0, 2, 2, 5]]


def test_logit_boxcox_clamp(spark):
    rows = [(0.5,), (0.0,), (2.0,), (-3.0,), (None,)]
    got = one(spark, rec.logit("a", 0.1), rows, "a float")
    assert got[:4] == pytest.approx([0, math.log(1 / 9), math.log(9), math.log(1 / 9)], rel=1e-5) and got[4] is None
    got = one(spark, rec.boxcox("a", 2.0), rows, "a float")
    assert got[:4] == pytest.approx([-0.375, 0, 1.5, -3]) and got[4] is None
    assert one(spark, rec.clamp("a", -1.0, 1.0), rows, "a float") == [0.5, 0, 1, -1, None]


def test_scaling_and_vocab(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,), (4,), (5,)], "a long")
    assert [r.s for r in rec.scale_to_0_1(df, "a", "s").collect()] == [0, 0.25, 0.5, None, 0.75, 1]
    z = [r.s for r in rec.scale_to_z_score(df, "a", "s").collect()]
    assert z[2] == 0 and z[0] == pytest.approx(-2 / math.sqrt(2.5)) and z[3] is None
    same = spark.createDataFrame([(2,), (2,)], "a long")
    assert [r.s for r in rec.scale_to_0_1(same, "a", "s").collect()] == pytest.approx([1 / (1 + math.exp(-2))] * 2)
    assert [r.s for r in rec.scale_to_z_score(same, "a", "s").collect()] == [2, 2]
    vocab = ["<unk>", "Hello", "world", "How", "are", "you!"]
    rows = [(["Hello", "world"],), (["How", "are", "you!", "OOV"],)]
    assert one(spark, text.lookup_indices("a", vocab, 0), rows, "a array<string>") == [[1, 2], [3, 4, 5, 0]]


def test_bpe(spark):
    P_ = pytest.importorskip("public_tokenizers")
    rows = [("Hello World!, how are you?",), (None,), ("",)]
    got = one(spark, text.bpe_tokenize("a", P_.path("byte_bpe_50k.json")), rows, "a string")
    assert got == ["15496 2159 28265 703 389 345 30".split(), None, []]


def test_wrapping_and_checked_arithmetic(spark):
    big = 2**63 - 1
    rows, s = [(big, 2), (-(2**63), -1), (5, 3), (None, 1)], "a long, b long"
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    for f, op in ((P.plus, lambda a, b: a + b), (P.minus, lambda a, b: a - b), (P.multiply, lambda a, b: a * b)):
        assert one(spark, f("a", "b"), rows, s) == [wrap(op(a, b)) for a, b in rows[:3]] + [None]
    for f in (P.checked_plus, P.checked_multiply):
        with pytest.raises(PySparkException):
            one(spark, f("a", "b"), rows[:1], s)
    with pytest.raises(PySparkException):
        one(spark, P.checked_negate("a"), rows[1:2], s)
    with pytest.raises(PySparkException):
        one(spark, P.divide_int("a", F.lit(0)), rows, s)
    got = one(spark, P.divide(F.col("a"), F.col("b")), [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (6.0, 4.0), (None, 0.0)], "a double, b double")
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == -math.inf and got[4:] == [1.5, None]
    assert one(spark, true_divide(F.col("a"), F.col("b")), [(1, 0)], "a int, b int") == [math.inf]
    pairs = [(7, 2), (-7, 2), (7, -2), (-7, -2)]
    assert one(spark, floor_divide(F.col("a"), F.col("b")), pairs, "a long, b long") == [a // b for a, b in pairs]
    assert one(spark, floor_mod(F.col("a"), F.col("b")), pairs, "a long, b long") == [a % b for a, b in pairs]


def test_strings_and_time_edges(spark):
    assert one(spark, P.substr("a", 0), [("abc",), (None,)], "a string") == ["", None]
    assert one(spark, P.substr("a", -2), [("abc",), ("a",)], "a string") == ["bc", ""]
    assert one(spark, P.split_part("a", ".", 3), [("x.y",), ("x.y.z",)], "a string") == [None, "z"]
    assert one(spark, P.regexp_extract("a", "b+"), [("abbc",), ("x",)], "a string") == ["bb", None]
    assert one(spark, P.date_diff("MONTH", "a", "b"), [("2024-01-31 00:00:00", "2024-02-29 00:00:00"), ("2024-01-31 00:00:00", "2024-03-30 00:00:00"), ("2024-02-29 00:00:00", "2024-01-31 00:00:00")], "a string, b string") == [1, 1, -1]
    assert one(spark, P.from_base("a", 16), [("ff",), ("-1A",), (None,)], "a string") == [255, -26, None]
    with pytest.raises(PySparkException):
        one(spark, P.from_base("a", 2), [("12",)], "a string")
    assert one(spark, P.trim("a"), [("\t  x y　\n",)], "a string") == ["x y"]
    assert one(spark, F.hex(P.xxhash64(F.lit("")))) == ["EF46DB3751D8E999"]
    assert one(spark, P.bit_count(F.lit(-1), 8)) == [8]
    with pytest.raises(PySparkException):
        one(spark, P.bit_count(F.lit(200), 8))
    assert one(spark, P.array_position("a", 2, -1), [([2, 1, 2],), ([1],)], "a array<int>") == [3, 0]
    assert one(spark, P.array_duplicates("a"), [([None, 3, 1, None, 3],)], "a array<int>") == [[None, 3]]
    assert one(spark, P.combinations("a", 2), [([1, 2, 3],), (None,)], "a array<long>") == [[[1, 2], [1, 3], [2, 3]], None]
    assert one(spark, P.json_array_contains("a", 1), [("[1, 2]",), ("[1.0]",), ("{}",), ("[11]",)], "a string") == [True, False, None, False]


def test_not_in_semantics(spark):
    probe = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    build = lambda *xs: spark.createDataFrame([(x,) for x in xs], "b int")
    got = lambda b: sorted(str(r.a) for r in R.null_aware_anti(probe, b, [("a", "b")]).collect())
    assert got(build(2)) == ["1"] and got(build(2, None)) == [] and got(build()) == ["1", "2", "None"]


def test_enforce_single_row(spark):
    with pytest.raises(PySparkException):
        R.enforce_single_row(spark.range(3)).collect()
    assert R.enforce_single_row(spark.range(1)).collect()[0][0] == 0
    assert R.enforce_single_row(spark.range(0)).collect()[0][0] is None


def test_merge_join_refuses_other_types(spark):
    with pytest.raises(ValueError):
        R.merge_join(spark.range(1), spark.range(1), [("id", "id")], "full")


def test_checksum_ignores_order(spark):
    df = spark.range(100)
    assert df.agg(A.checksum("id")).first() == df.orderBy(F.rand(1)).agg(A.checksum("id")).first()


def test_frame_groupby_golden(spark):
    f = Frame(spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("b", 4)], "A string, B long"), ["B"])
    assert sorted(tuple(r) for r in f.groupby("A").agg("sum").collect()) == [("a", 4), ("b", 6)]
    assert f.groupby("A").agg({"B": ["max", "prod"]}).columns == ["A", "B.max", "B.prod"]
    with pytest.raises(ValueError):
        f.select("-A")


def test_plan_levels_and_errors(spark):
    plan = 'df["b"] = df["a"].fill_null(0)\ndf["c"] = df["x"].fill_null(1)\ndf["a"] = df["b"].clamp(0, 9)\ndf["d"] = df["a"].copy()'
    assert dsl.levels(plan) == [["b", "c"], ["a"], ["d"]]
    out = dsl.compile_plan(plan)(spark.createDataFrame([(12, None), (None, 3)], "a int, x int"))
    assert [tuple(r) for r in out.select("a", "b", "c", "d").collect()] == [(9, 12, 1, 9), (0, 0, 3, 0)]
    for bad in ('df["a"] = df["b"].nothing(1)', 'x + 1', 'df["a"] = 5'):
        with pytest.raises(ValueError, match="line 1"):
            dsl.parse(bad)
    swap = 'df["t"] = df["a"]\ndf["a"] = df["x"]\ndf["x"] = df["t"]'
    out = dsl.compile_plan(swap)(spark.createDataFrame([(1, 2)], "a int, x int")).first()
    assert (out.a, out.x) == (2, 1)


def test_plans_are_one_stage(spark):
    df = spark.createDataFrame([(1.5, 2)], "int_0 double, cat_0 int")
    plan = 'df["int_0"] = df["int_0"].fill_null(0)\ndf["int_0"] = df["int_0"].logit(1e-5)\ndf["b"] = bucketize(df["int_0"], [1.0])'
    text_ = dsl.compile_plan(plan)(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text_ and "Python" not in text_


def test_auc_and_window_metrics(spark):
    df = spark.createDataFrame([("t", 0.9, 1.0, 1.0), ("t", 0.8, 0.0, 1.0), ("t", 0.7, 1.0, 2.0), ("t", 0.1, 0.0, 1.0), ("u", 0.3, 1.0, 1.0)], "task string, prediction double, label double, weight double")
    got = {r.task: r.auc for r in M.auc(df, "task").collect()}
    assert got == {"t": pytest.approx((1 + 3) / 6), "u": 0.5}


def test_character_classes(spark):
    from loomwright.operators import frame

    digits = ["12", "²", "½", "٣", "1a", "", "x²"]
    df = spark.createDataFrame([(d,) for d in digits], "x string")
    got = {r.x: tuple(r)[1:] for r in df.select("x", *[frame.text_is(F.col("x"), k).alias(k) for k in ("isdigit", "isdecimal", "isnumeric")]).collect()}
    assert got == {"12": (True,) * 3, "²": (True, False, True), "½": (True, False, True), "٣": (True,) * 3, "1a": (False,) * 3, "": (False,) * 3, "x²": (False,) * 3}


def test_combinations_are_those_of_python(spark):
    import itertools

    rows = [[], [1], [1, 2, 3], [5, None, 5, 7], list(range(7))]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(99, None)], "i int, a array<bigint>")
    for n in range(5):
        got = {r.i: r.c for r in df.select("i", P.combinations("a", n).alias("c")).collect()}
        assert got[99] is None
        for i, r in enumerate(rows):
            assert [list(c) for c in got[i]] == [list(c) for c in itertools.combinations(r, n)], (r, n)


def test_sha512(spark):
    import hashlib

    assert bytes(spark.range(1).select(P.sha512(F.lit("abc"))).first()[0]) == hashlib.sha512(b"abc").digest()


def test_gpu_hash_by_hand(spark):
    mask = (1 << 64) - 1

    def fnv(x):
        h = 14695981039346656037
        for b in x.to_bytes(8, "little"):
            h = (h ^ b) * 1099511628211 & mask
        return h

    def spread(x):
        x = (~x + (x << 21)) & mask
        x ^= x >> 24
        x = (x + (x << 3) + (x << 8)) & mask
        x ^= x >> 14
        x = (x + (x << 2) + (x << 4)) & mask
        x ^= x >> 28
        return (x + (x << 31)) & mask

    def want(i, salt, most):
        up, k = fnv(salt & mask), 0x9DDFEA08EB382D69
        a = (fnv(spread(i & mask)) ^ up) * k & mask
        b = (up ^ a ^ a >> 47) * k & mask
        b = (b ^ b >> 47) * k & mask
        b -= (b >> 63) << 64
        return b % most if most > 1 else b

    ids = [0, 1, -1, 7, 2**62, -(2**63)]
    df = spark.createDataFrame([(i,) for i in ids], "x bigint")
    for salt, most in ((0, 100), (7, 1000003), (-3, 1)):
        got = {r.x: r.h for r in df.select("x", rec.sigrid_hash("x", salt, most, "gpu").alias("h")).collect()}
        assert got == {i: want(i, salt, most) for i in ids}


def test_positions_over_ranges(spark):
    from loomwright.sources.numbering import numbered

    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("a"), "id").repartition(7)
    got = sorted((r.i, r.a, r.id) for r in numbered(df, ["a", F.desc("id")], "i").collect())
    rows = sorted(((r.a, r.id) for r in df.collect()), key=lambda x: (x[0], -x[1]))
    assert got == [(i, *r) for i, r in enumerate(rows)]
    assert numbered(df.limit(0), ["a"], "i").count() == 0


def test_monotonic_over_blocks(spark, monkeypatch):
    from loomwright.operators import frame

    monkeypatch.setattr(frame, "BLOCK_ROWS", 10)
    up = spark.range(95).select("id", F.col("id").alias("x"))
    assert frame.Frame(up, ["id"]).is_monotonic("x").first()[0] and not frame.Frame(up, ["id"]).is_monotonic("x", increasing=False).first()[0]
    for at in (9, 10, 20, 94):  # a fall on either side of a block's end
        fall = up.withColumn("x", F.when(F.col("id") == at, -1).otherwise(F.col("id")))
        assert not frame.Frame(fall, ["id"]).is_monotonic("x").first()[0]


def test_functions_by_name_and_deferred_expressions(spark):
    from loomwright.operators import columns as C

    df = spark.createDataFrame([(3, "ab", {"k": 1})], "a int, b string, m map<string,int>")
    expr = (C.me["a"] * 2 + 1 > 6) & ~(C.me["a"] == 4)
    got = df.select(C.evaluate(expr, df), C.evaluate(C.me.length(C.me["b"]), df), C.map_get("m", "k", 9), C.map_get("m", "z", 9)).first()
    assert tuple(got) == (True, 2, 1, 9)
    with pytest.raises(AttributeError):
        C.function("no_such_function")
    with pytest.raises(ValueError):
        C.replay(["import os"], df)
    with pytest.raises(ValueError):
        C.replay(["frame = frame._private()"], df)


def test_shared_folder_on_a_cluster_has_to_be_named():
    from loomwright.sources import tables

    class Context:
        master, applicationId = "spark://host:7077", "app-1"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: None)

    with pytest.raises(ValueError):
        tables.shared_dir(Session())


def test_shared_folder_is_cleaned(spark):
    from loomwright.sources import tables

    assert tables.materialize(spark.range(3), "x").count() == 3
    other = tables.shared_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(other)
    assert path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_text_forms_of_plan_operators_agree_with_columns(spark):
    from loomwright.plans import dsl

    df = spark.createDataFrame([(1.5, [1, 2, None]), (None, [3, 40, 5]), (-2.0, []), (0.2, None)], "x double, a array<bigint>")
    for op, args in (("logit", ("x", 1e-5)), ("boxcox", ("x", 0.5)), ("boxcox", ("x", 0)), ("onehot", ("a", 0.0, 16.0, 5)), ("ngram", ("a", 2)), ("firstx", ("a", 2)), ("cast", ("x", "float32")), ("array_constructor", ("x",))):
        text = F.expr(dsl.TEXTS[op](f"`{args[0]}`", *args[1:])).alias("t")
        made = df.select(text, dsl.OPERATORS[op](F.col(args[0]), *args[1:]).alias("c")).collect()
        assert all(r.t == r.c for r in made), op


def test_bpe_of_long_texts_and_large_batches(spark):
    """Ids come back in parts of a batch, and long texts piece by piece, with the ids of whole texts."""
    P_ = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    path = P_.path("byte_bpe_50k.json")
    long = "Ein Wort,  two\n\nwords don't été_ 12 345\t\n x.  " * 40
    rows = [None, "", long, "  ", *[f"row {i} of many" for i in range(300)], "x" * 500, long + " end "]
    whole = [[str(i) for i in text._tokenizer(path).encode(x or "", add_special_tokens=False).ids] for x in rows]
    parts = list(text._encoded(pa.array(rows, pa.string()), path, 100))
    assert [x for p in parts for x in p.to_pylist()] == whole
    assert len(parts) > 10 and all(len(p) < 60 for p in parts)  # of all rows together before
    assert len(text._pieces(long, 100)) > 10 and "".join(text._pieces(long, 100)) == long
    got = one(spark, text.bpe_tokenize("a", path, 100), [(x,) for x in rows], "a string")
    assert got == [None, *whole[1:]]
