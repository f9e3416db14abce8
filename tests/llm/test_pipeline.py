"""The pipeline's stages against plain Python, each on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwright.llm import mixing, ngram_join, quality, secrets
from loomwright.llm._util import table

from .fixtures import SCHEMA, documents
from .test_native import WORD, brute_measures, brute_targets
from .test_text import brute_classes, check_packing, near_texts, tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def brute_sets(texts, k):
    out = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def test_keep_one(spark):
    texts = near_texts()
    src = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(2, texts[2], "en", "s", 1), (None, texts[2], "en", "s", 2), (7, "some other text under a known id", "en", "s", 3)]
    src += [(900, "only here twice in a row indeed", "en", "s", 3)] * 2 + [(901, None, "en", "s", 3)] * 2
    df = spark.createDataFrame(src, "doc_id long, text string, lang string, _mh string, go long")
    sets = brute_sets([r[1] for r in src], 5)
    cls = brute_classes(list(range(len(src))), sets, 80)
    best = {}
    for i, r in enumerate(src):
        rank = (r[0] is None, r[0] or 0)
        if cls[i] not in best or rank < best[cls[i]][0]:
            best[cls[i]] = (rank, i)
    want = Counter((src[i][0], src[i][1]) for _, i in best.values())
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert ngram_join.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, sf_dir).cache()
    want = {r.doc_id for r in docs.collect() if (m := brute_measures(r.text))[0] >= 10 and 100 * m[4] <= 20 * m[0]}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == columns  # too few labels here for any cutoff

    one = corpus_pipeline.near_duplicates(spark, kept, sf_dir).cache()
    src = kept.orderBy("doc_id").collect()
    cls = brute_classes([r.doc_id for r in src], brute_sets([r.text for r in src], 5), 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(cls)) and one.columns == columns

    clean = corpus_pipeline.secrets(spark, one, sf_dir).cache()
    spans = {r.doc_id: [(int(x[1]), x[0], int(x[2])) for x in (y.split(":") for y in r.spans.split(",") if y)] for r in secrets.scan_documents(one).collect()}
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((r.doc_id, secrets.mask(r.text, spans[r.doc_id])) for r in one.collect())
    assert clean.columns == columns

    mixed = corpus_pipeline.mixing(spark, clean, sf_dir).cache()
    assert mixed.columns == columns
    copies = Counter(r.doc_id for r in mixed.collect())
    size = {r.doc_id: (r.source, len(WORD.findall(r.text))) for r in clean.collect()}
    assert max(copies.values()) <= 2 and set(copies) <= set(size)
    sizes, got = Counter(), Counter()
    for s, n in size.values():
        sizes[s] += n
    for d, c in copies.items():
        got[size[d][0]] += c * size[d][1]
    longest = Counter()
    for s, n in size.values():
        longest[s] = max(longest[s], n)
    for s, t in brute_targets(sizes).items():
        assert abs(got[s] - t) <= longest[s] + 0.02 * t  # whole documents

    pieces = corpus_pipeline.packing(spark, mixed, sf_dir).collect()
    check_packing(pieces, [(r.doc_id, r.text) for r in mixed.collect()], tokenizer(), 4096)


def test_run_equals_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
    tokens = lambda df: Counter({r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()})
    assert tokens(out) == tokens(corpus_pipeline.packing(spark, docs, sf_dir))


def test_stages_take_awkward_rows(spark, sf_dir):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert corpus_pipeline.packing(spark, docs, sf_dir).count() > 0
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") and files.apply(i).getName().endswith(".data") for i in range(files.size()))


def test_shuffles_go_when_a_table_is_written(spark):
    import time

    from loomwright.sources.tables import materialize

    before, rows = shuffle_files(spark), spark.range(1000).selectExpr("id % 7 AS a").distinct().repartition(3)
    materialize(rows, "shuffled")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            return
        time.sleep(0.1)
    raise AssertionError("shuffle files are left")


def test_quality_and_near_duplicates_copy_no_texts(spark, tmp_path):
    """What both stages write beside their results is small beside the texts."""
    import os

    from loomwright.sources.tables import shared_dir

    def written():
        top = shared_dir(spark).removeprefix("file://")
        return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(top) for x in names)

    words = F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda i: F.hex(F.xxhash64("id", i)))
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(0).alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/docs")
    docs, before = spark.read.parquet(f"{tmp_path}/docs"), written()
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.filter_documents(docs, labels).count() == 100
    assert ngram_join.keep_one(docs).count() == 100
    assert written() - before < 300_000  # 100 texts of 34 kB


def test_coarse_components_are_refined(spark):
    """Sets that no link ties and that met in the first turn alone drop out, linked ones stay together."""
    import numpy as np
    import pyarrow as pa

    from loomwright.llm.shingles import shingle_sets

    texts = [" ".join(f"w{i}_{j}" for j in range(60)) for i in range(8)]
    texts.append(texts[0] + " more")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = list(shingle_sets(pa.array(texts), 3, 2))
    digests = [(ngram_join.set_digest(a), ngram_join.set_digest(b)) for a, b in sets]
    nodes = [(*digests[i], 0, len(sets[i][0]), digests[0][0], i) for i in range(9)]  # as if all had met
    nodes = spark.createDataFrame(nodes, "d1 long, d2 long, band int, n long, root long, rep long")
    left = ngram_join._refined(df, nodes, "doc_id", "text", 3, 90, np.empty(0, np.uint64)).collect()
    assert sorted(r.rep for r in left) == [0, 8] and len({r.root for r in left}) == 1


@pytest.mark.parametrize("names", [1 << 22, 20])
def test_near_copies_are_not_tied_again_in_every_bucket(spark, monkeypatch, names):
    """Ties of near copies in different tasks grow with the sets, not with the buckets that their keys go to; classes are the same where not all sets have names."""
    import random

    r, texts, ties = random.Random(3), [], []
    for i in range(60):
        texts.append([f"w{r.randrange(10**6)}" for _ in range(600)])
    for i in range(60):
        texts.append(texts[i].copy())
        for at in r.sample(range(600), 3):
            texts[-1][at] = "other"
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartitionByRange(2, "doc_id")
    plain = ngram_join.connected_components

    def counted(edges, *args):
        ties.append(edges.count())
        return plain(edges, *args)

    monkeypatch.setattr(ngram_join, "connected_components", counted)
    monkeypatch.setattr(ngram_join, "parts_for", lambda size, spark: 100)
    monkeypatch.setattr(ngram_join, "NAMES", names, raising=False)
    got = {x.doc_id: x.component_id for x in ngram_join.ngram_classes(df, shingle=5, threshold=80).collect()}
    assert got == {i: i % 60 for i in range(120)}
    if names > 60:
        assert max(ties) <= 60 * 12
