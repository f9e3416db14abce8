"""Text functions that need a vocabulary: token lookup and byte-pair encoding."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rec import _null_free, col

#: A vocabulary up to this size becomes a literal map; a larger one is joined.
LITERAL_VOCAB = 1000
#: Characters of text that are encoded, and whose ids are held, at a time; and where a longer text may be cut.
PIECE, CUT = 1 << 20, re.compile(r"(?<=\w)(?=[ \n])")


def lookup_indices(tokens, vocab: dict[str, int] | list[str], default: int) -> Column:
    """Each token's index, the default for those not in the vocabulary. For small vocabularies."""
    if isinstance(vocab, list):
        vocab = {t: i for i, t in enumerate(vocab)}
    if len(vocab) > LITERAL_VOCAB:
        raise ValueError("use lookup_indices_join for a large vocabulary")
    a = col(tokens)
    other = F.lit(default).cast("bigint")
    if not vocab:
        return _null_free(F.transform(a, lambda t: other), a)
    known = F.create_map(*[F.lit(x) for t, i in vocab.items() for x in (t, i)])
    return _null_free(F.transform(a, lambda t: F.coalesce(F.try_element_at(known, t).cast("bigint"), other)), a)


def lookup_indices_join(df: DataFrame, key: str, tokens: str, vocab: DataFrame, default: int, out: str = "indices") -> DataFrame:
    """(key, out) for a vocabulary of any size, given as (token, index) rows: exploded, joined and gathered in order."""
    places = df.select(key, F.posexplode_outer(tokens).alias("_at", "token"))
    found = places.join(vocab.select("token", F.col("index").cast("bigint").alias("_i")), "token", "left")
    value = F.when(F.col("_at").isNotNull(), F.struct("_at", F.coalesce("_i", F.lit(default).cast("bigint")).alias("i")))
    gathered = F.array_sort(F.collect_list(value))
    return found.groupBy(key).agg(F.transform(gathered, lambda s: s["i"]).alias(out))


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    with open(path) as f:
        json.load(f)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _pieces(text: str, most: int) -> list[str]:
    """The text in pieces of about so many characters, cut where a blank follows a word: no token reaches across."""
    out, at = [], 0
    while len(text) - at > most and (cut := CUT.search(text, at + most)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def _encoded(texts: pa.Array, path: str, most: int) -> Iterator[pa.Array]:
    """Lists of ids as strings, for a few texts at a time: ids are held for about so many characters, tokens never."""
    tokenizer, held, first, size = _tokenizer(path), [], [0], 0

    def done() -> pa.Array:
        values = pa.array(np.concatenate(held) if held else np.empty(0, np.int32)).cast(pa.string())
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)

    for x in texts:
        n = first[-1]
        for piece in _pieces(x.as_py() or "", most):
            held.append(np.array(tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids, np.int32))
            n, size = n + len(held[-1]), size + len(piece)
        first.append(n)
        if size >= most:
            yield done()
            held, first, size = [], [0], 0
    if len(first) > 1 or not len(texts):
        yield done()


def bpe_tokenize(text, path: str, most: int = PIECE) -> Column:
    """Byte-level BPE ids of a text, as strings. The vocabulary file's path must be readable by the workers.

    A batch's ids go back in parts of about `most` characters of text, so that memory doesn't grow with a
    batch; a longer text is encoded piece by piece.
    """

    @F.arrow_udf("array<string>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield from _encoded(b, path, most)

    text = col(text)
    return F.when(text.isNotNull(), encode(text))
