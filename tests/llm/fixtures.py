"""Small documents with every awkward case: nulls, empties, ties, repeated rows, long texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target int, shard string, _h int"


def texts(seed=5, n=40):
    r = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma,", "délta", "ε", "zeta", "eta.", "theta", "Iota", "kappa", "λx", "mu"]
    out = [" ".join(r.choices(vocab, k=r.randint(1, 120))) for _ in range(n)]
    out += [None, "", " \t\n\x0b\x0c\r", "one", "one two", "a\nb\na\n\n \nb", "x " * 30, "# * $ % & | < >", out[0], out[0], out[3] + " tail"]
    out += [" ".join(f"w{i % 700}" for i in range(6000)), "日本語 テキスト\u00a0é", "A" * 3000]
    return out


def rows():
    out = []
    for i, t in enumerate(texts()):
        out.append((i, t, [None, "en", "de"][i % 3], ["b", "a", None, "é", "b", "b"][i % 6], len(t or ""), "x", i, "y", 0))
    out.append(out[2])  # a repeated row
    out.append((None, "no key here at all", None, None, None, None, None, None, None))
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)
