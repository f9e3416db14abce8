"""Packing of documents into fixed token sequences by cutting-stock column generation.

A partition is worked through in chunks of bounded token count, so that memory is bounded and nothing
is shuffled. In a chunk, documents are cut into whole sequences first. The remainders are counted by
length class (CLASSES of equal width): a linear program over patterns, each a multiset of classes
that fits a sequence, covers the counts with the fewest sequences. It is solved by column generation:
a revised simplex keeps the basis inverse, its dual prices go to an unbounded-knapsack dynamic program,
and the best pattern enters until none pays. Patterns are rounded down and filled with the documents in
rank order (longest first, then by position); their documents stay whole. Only what no rounded pattern
takes is cut: it goes whole into the patterns' gaps by best fit, and the rest is cut to fill them and
then sequences of its own. Should gaps be left, in small chunks, the emptiest sequences are taken apart
for them, so that a chunk ends with one sequence that isn't full.

Defined results: a null or empty text is its end token alone; texts of any length are tokenized whole;
rows that repeat are packed each; documents of equal length rank by position; a null key stays null; an
empty table gives no pieces; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = 64
#: Tokens of a chunk, and distinct pieces whose ids a worker remembers.
CHUNK_TOKENS, CACHE = 4_000_000, 1_000_000

#: Texts that are certainly split the same way by the pattern below as by the tokenizer's own: ASCII and Latin letters.
_PLAIN = re.compile(r"[\t\n\r\x20-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿ]*")
#: The tokenizer's pieces over lower-cased plain text. Fixed values.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class Encoder:
    """Token ids of texts by a public tokenizer file.

    A tokenizer that lower-cases, drops white space and then encodes piece by piece gives a piece the
    same ids wherever it stands. Plain Latin texts are cut into pieces here, and each piece is encoded
    once per worker; any other text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a piece
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.ids: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        pieces: list[list[str]] = []
        plain, other = [], []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.empty(0, np.uint32)
            elif _PLAIN.fullmatch(t):
                plain.append(i)
                pieces.append(_PIECE.findall(t.lower()))
            else:
                other.append(i)
        if len(self.ids) > CACHE:
            self.ids.clear()
        known = self.ids
        new = list(set(chain.from_iterable(pieces)) - known.keys())
        for at in range(0, len(new), 20_000):
            known.update(zip(part := new[at : at + 20_000], self._encode_pieces(part)))
        for i, ps in zip(plain, pieces):
            out[i] = np.frombuffer(b"".join(map(known.__getitem__, ps)), np.uint32)
        for at in range(0, len(other), 64):
            part = other[at : at + 64]
            for i, e in zip(part, self.whole.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32)
        return out


    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as bytes: encoded in one text, parted at the tokens that end a piece."""
        ids = np.array(self.whole.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(pieces):
            return [x.tobytes() for x in np.split(ids, ends[:-1])]
        return [np.array(e.ids, np.uint32).tobytes() for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value: an unbounded knapsack over classes of size 1 to len(duals)."""
    n = len(duals)
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = min(c, n)
        gains = best[c - 1 :: -1][:k] + duals[:k]  # size s leaves c - s
        s = int(np.argmax(gains))
        best[c] = max(best[c - 1], gains[s])
        choice[c] = s if gains[s] > best[c - 1] + 1e-12 else -1
    pattern, c = np.zeros(n), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= choice[c] + 1
    return float(best[capacity]), pattern


def cutting_stock(demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, of the covering linear program's best solution.

    demand[i] pieces have size i + 1. Classes without demand are left out of the program.
    """
    live = np.flatnonzero(demand > 0)
    m = len(live)
    if not m:
        return []
    need = demand[live].astype(float)
    columns = [np.eye(m)[i] * (capacity // (live[i] + 1)) for i in range(m)]  # one class alone fills a sequence
    inverse = np.diag([1.0 / (capacity // (s + 1)) for s in live])
    x = inverse @ need
    for step in range(rounds):
        duals = inverse.sum(axis=0)  # all costs are 1
        full = np.zeros(len(demand))
        full[live] = np.maximum(duals, 0)
        value, pattern = price(full, capacity)
        if value <= 1 + 1e-9:
            break
        entering = pattern[live]
        way = inverse @ entering
        up = way > 1e-10
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, way, 1), np.inf)
        leave = int(np.argmin(ratio))
        theta = ratio[leave]
        x = np.maximum(x - theta * way, 0)
        x[leave] = theta
        row = inverse[leave] / way[leave]
        inverse = inverse - np.outer(way, row)
        inverse[leave] = row
        columns[leave] = entering
        if step % 100 == 99:  # rounding errors out of the inverse
            inverse = np.linalg.inv(np.array(columns).T)
            x = np.maximum(inverse @ need, 0)
    out = []
    for col, times in zip(columns, x):
        p = np.zeros(len(demand), int)
        p[live] = np.round(col).astype(int)
        out.append((p, float(times)))
    return out


Piece = tuple[int, int, int]


class Ranked:
    """Remainders by length, taken out one by one."""

    def __init__(self, rest: list[Piece]):
        self.pieces = sorted(rest, key=lambda p: (p[2], -p[0]))
        self.size = [p[2] for p in self.pieces]
        self.down = list(range(-1, len(self.pieces)))  # down[i + 1]: i if it is there, else a place below

    def longest(self, below: int, least: int = 0) -> int:
        """Place of the longest remainder of less than `below` tokens, and at least `least`, that is still there; -1 for none."""
        i, down = bisect.bisect_left(self.size, below), self.down
        while down[i] != i - 1:
            if i and down[down[i] + 1] != down[i]:
                down[i] = down[down[i] + 1]
            i = down[i] + 1
        return i - 1 if i and self.size[i - 1] >= least else -1

    def take(self, i: int) -> Piece:
        self.down[i + 1] = i - 1
        return self.pieces[i]


def _by_patterns(ranked: Ranked, capacity: int, classes: int) -> list[list[Piece]]:
    """Sequences of whole remainders by the program's patterns, rounded down.

    Each of a pattern's classes gives its longest remainder, or, once it is used up, the longest below;
    the last is chosen among all remainders, to fit best, and so are more while any fits.
    """
    unit = -(-capacity // classes)
    units = capacity // unit
    demand = np.bincount(np.minimum(units, -(-np.array(ranked.size) // unit)) - 1, minlength=units)
    made = []
    for pattern, times in sorted(cutting_stock(demand, units), key=lambda t: -t[1]):
        items = [int(c) + 1 for c in np.flatnonzero(pattern)[::-1] for _ in range(pattern[c])]
        for _ in range(int(times + 1e-9)):
            took, room = [], capacity
            for c in items[:-1]:
                i = ranked.longest(min(c * unit, room) + 1)
                if i >= 0:
                    took.append(ranked.take(i))
                    room -= took[-1][2]
            while (i := ranked.longest(room + 1)) >= 0:
                took.append(ranked.take(i))
                room -= took[-1][2]
            if took:
                made.append(took)
    return made


def _best_fit(ranked: Ranked, capacity: int) -> list[list[Piece]]:
    """Sequences of the remainders left over: the longest first, and then what fits best, until nothing does."""
    made = []
    while (i := ranked.longest(capacity + 1)) >= 0:
        made.append([ranked.take(i)])
        room = capacity - made[-1][0][2]
        while (i := ranked.longest(room + 1)) >= 0:
            made[-1].append(ranked.take(i))
            room -= made[-1][-1][2]
    return made


def pack(lengths: list[int], capacity: int, program: bool = True, classes: int = CLASSES) -> list[list[Piece]]:
    """Sequences of (document's position, start, length) pieces that hold all the documents' tokens once.

    program: whether patterns make sequences; without, all is placed by best fit, for comparison.
    """
    sequences: list[list[Piece]] = []
    rest: list[Piece] = []
    for d, n in enumerate(lengths):
        whole = n // capacity
        sequences += [[(d, i * capacity, capacity)] for i in range(whole)]
        if n % capacity:
            rest.append((d, whole * capacity, n % capacity))
    if not rest:
        return sequences
    ranked = Ranked(rest)
    made = (_by_patterns(ranked, capacity, classes) if program else []) + _best_fit(ranked, capacity)
    # where gaps are left, the emptiest sequences are taken apart to fill the fullest
    room = [capacity - sum(p[2] for p in s) for s in made]
    order = sorted(range(len(made)), key=lambda i: (room[i], i))
    i, j = 0, len(order) - 1
    while i < j:
        x, y = order[i], order[j]
        if not room[x]:
            i += 1
            continue
        d, start, n = made[y].pop()
        cut = min(room[x], n)
        made[x].append((d, start, cut))
        room[x] -= cut
        if n > cut:
            made[y].append((d, start + cut, n - cut))
        if made[y]:
            room[y] += cut
        else:
            j -= 1
    return sequences + [s for s in made if s]


def pack_documents(
    docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 4096,
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Packed where the rows are read; sequence_id holds the partition's number in its upper bits. The
    longest document alone may exceed a chunk.
    """
    ddl = f"`{key}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema = pa.schema([(n, pa.int64()) for n in (key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, first = encoder(tokenizer), TaskContext.get().partitionId() << 32
        keys: list = []
        held: list[np.ndarray] = []
        total = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal first
            rows = []
            for pieces in pack([len(x) for x in held], capacity):
                at = 0
                for d, start, n in pieces:
                    rows.append((keys[d], start, n, zlib.crc32(held[d][start : start + n].astype("<u4").tobytes()), len(held[d]), first, at))
                    at += n
                first += 1
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 10_000])], schema=schema)

        for b in batches:
            ks, ts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(ts), 500):
                for k, ids in zip(ks[at : at + 500], enc.encode(ts[at : at + 500])):
                    keys.append(k)
                    held.append(np.append(ids, np.uint32(end_id)))
                    total += len(ids) + 1
                    if total >= chunk_tokens:
                        yield from done()
                        keys, held, total = [], [], 0
        if held:
            yield from done()

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, ddl)
