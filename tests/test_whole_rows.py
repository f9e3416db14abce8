"""Every output column of the click-log plans and ETL against plain Python on a few rows."""

import math

import numpy as np
import pytest

from loomwright.functions import rec
from loomwright.plans import dsl
from loomwright.queries import features
from loomwright.sources import criteo

M64 = (1 << 64) - 1


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i // 4, 1 + i % 7, float(i * 3 % 50 + 1) + i % 2 / 2, 100 + i * 37, i % 11, "RNA"[i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_partkey long, l_suppkey long, l_returnflag string").coalesce(1)
    return lambda name: {"lineitem": df}[name]


@pytest.fixture(scope="module")
def inputs(tables):
    return [r.asDict() for r in features.clicks(tables).collect()]


def f32(x):
    return float(np.float32(x))


def logit(x):
    p = max(1e-5, min(1 - 1e-5, x))
    return f32(math.log(p / (1 - p)))


def boxcox(x):
    return f32((x**1e-5 - 1) / 1e-5) if x > 0 else x


def hashed(x, n):
    return int(rec.sigrid_hash_array(np.array([x]), 0, n)[0])


def first_class(x, k):
    """The first of k zeros and ones over [0, 16): class 0, which also takes what lies outside."""
    at = int(x / (16 / k))
    return 1.0 if x < 0 or not 0 < at < k else 0.0


def wide(row, n_dense, n_sparse, cuts, sparse_cuts):
    out = {"label": row["label"]}
    for i in range(n_dense):
        x = float(row[f"int_{i % 13}"] or 0)
        for _ in range(4):
            x = logit(x) if i < cuts[0] else boxcox(x) if i < cuts[1] else x
        out[f"int_{i}"] = x
        if i >= cuts[1]:
            out[f"int_{i}_onehot"] = first_class(x, 5)
    for i in range(n_sparse):
        x = row[f"cat_{i % 26}"] or 0
        for _ in range(4):
            x = hashed(x, 65536) if i < sparse_cuts[0] else max(0, min(16, x)) if i < sparse_cuts[1] else x
        out[f"cat_{i}"] = x
        if sparse_cuts[1] <= i < sparse_cuts[2]:
            out[f"cat_{i}firstx"] = x
        elif i >= sparse_cuts[2]:
            out[f"cat_{i}ngram"] = first_class(x, 8)
    return out


@pytest.mark.parametrize("name, shape", [("plan_2", (26, 52, (7, 16), (11, 27, 39))), ("plan_3", (52, 104, (16, 37), (25, 53, 78)))])
def test_wide_plans_sum_every_column(spark, tables, inputs, name, shape):
    got = getattr(features, name)(spark, tables, None).first().asDict()
    rows = [wide(r, *shape) for r in inputs]
    assert set(got) == set(rows[0])
    for k in got:
        assert got[k] == pytest.approx(sum(r[k] for r in rows), rel=1e-6, abs=0.02), k


def test_every_column_of_plan_0(tables, inputs):
    got = dsl.compile_plan(dsl.plan_0())(features.clicks(tables)).collect()
    assert len(got[0]) == 3 + 13 + 26 + 1
    for r, g in zip(inputs, got):
        x = r["int_0"] or 0
        assert (g.l_orderkey, g.l_linenumber, g.label) == (r["l_orderkey"], r["l_linenumber"], r["label"])
        assert g.bucketize_int_0 == (0 if x <= 0.5 else 1 if x <= 1 else 2 if x <= 1.5 else 3)
        assert [g[k] for k in dsl.DENSE] == pytest.approx([logit(float(r[k] or 0)) for k in dsl.DENSE], rel=1e-6)
        assert [g[k] for k in dsl.SPARSE] == [[hashed(r[k] or 0, n)] for k, n in zip(dsl.SPARSE, dsl.TABLE_SIZES)]


def xxhash64(data: bytes, seed: int = 42) -> int:
    """XXH64 of fewer than 32 bytes, signed."""
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    turn = lambda x, r: (x << r | x >> 64 - r) & M64
    h, i = (seed + p5 + len(data)) & M64, 0
    while i + 8 <= len(data):
        h = (turn(h ^ turn(int.from_bytes(data[i : i + 8], "little") * p2 & M64, 31) * p1 & M64, 27) * p1 + p4) & M64
        i += 8
    if i + 4 <= len(data):
        h = (turn(h ^ int.from_bytes(data[i : i + 4], "little") * p1 & M64, 23) * p2 + p3) & M64
        i += 4
    for b in data[i:]:
        h = turn(h ^ b * p5 & M64, 11) * p1 & M64
    h = (h ^ h >> 33) * p2 & M64
    h = (h ^ h >> 29) * p3 & M64
    h ^= h >> 32
    return h - (1 << 64) if h >> 63 else h


def test_every_column_of_the_etl(spark, tables, inputs):
    got = features.io_etl(spark, tables, None).collect()
    logs = criteo.dense_log(features.clicks(tables)).collect()
    assert set(got[0].asDict()) == set(logs[0].asDict()) == set(inputs[0])
    for r, g, d in zip(inputs, got, logs):
        assert (g.l_orderkey, g.l_linenumber, g.label) == (r["l_orderkey"], r["l_linenumber"], r["label"])
        assert [g[k] for k in criteo.DENSE] == pytest.approx([math.log1p(max(r[k] or 0, -2) + 2) for k in criteo.DENSE], rel=1e-6)
        assert [g[k] for k in criteo.SPARSE] == [xxhash64(str(r[k] or 0).encode()) % 1000 for k in criteo.SPARSE]
        assert [d[k] for k in criteo.DENSE] == pytest.approx([math.log((r[k] or 0) + 3) for k in criteo.DENSE], rel=1e-6)
        assert [d[k] for k in criteo.SPARSE] == [r[k] for k in criteo.SPARSE]
