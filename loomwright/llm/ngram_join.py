"""Exact n-gram Jaccard join: pigeonhole partitioning over the cluster, signature trees within groups.

Two texts link when their sets of 3-word shingles have 100 |A & B| >= threshold |A | B|. The
operator gives each row its class, connected over links.

1. Sets are digested in two lanes, 128 bits; equal sets are one node from then on, however many copies
   there are.
2. Sizes are put into bands so wide that linked sets are in the same band or in neighbours. In the
   group of a band and the next, linked sets differ in at most D shingles, so if D + 1 parts of the
   hash range hold something, one of them is equal: each set sends one key per part. Parts are first
   cut from its rare shingles alone, as passages that many texts share say little; which shingles are
   frequent is counted beforehand and only steers the work. A set with too many empty parts also sends
   the parts of another cut, of all its shingles, and so on, so that two linked sets always share a
   key of shingles. Keys travel in packed blocks, 12 bytes each; sets that share a key within a packed
   batch are tied there, and one of them is sent. Sets that a sketch shows to be alike are tied before
   and send their keys under one name: near copies share many keys, and would be tied to each other
   again in each bucket. Names steer the work alone; a set without one goes by its digest.
3. Sets that share keys are joined into coarse components, by union-find within a block of keys and
   then by star contraction over the cluster. The sets of these components send the keys of other cuts
   once more; what stays together must be in one component both times, so that sets which met by chance
   part again and their texts needn't travel. On a large corpus passages that many texts share still
   hold some sets together, more than a task can take and most of them without a link. Such a component's
   sets are told from each other by parities: of the shingles of each place of a bitmap, whether they are
   even or odd in number. Two sets differ in at least as many shingles as places of theirs differ, so
   pairs that differ in more places than linked sets in shingles can't link; the others are tied anew.
   Parities are a twentieth of the texts or less, and blocks of them meet those of the same and the next band.
4. A coarse component's texts are fetched past a Bloom filter of their ids and joined exactly by a
   signature tree. Its leaves are sets with their token bitmaps; a node holds the OR and the AND of
   its leaves' bitmaps and their size range. A dual traversal from the root drops pairs of nodes whose
   sizes can't match, whose greatest possible overlap is too small, or whose sets are all connected
   already; pairs of leaves that remain are intersected, and a link has to hold in both lanes.
5. A coarse component too large for one task is dealt into blocks by band and hash, each of which is
   joined alone. Representatives of the blocks' largest classes are joined next, until one task holds
   them. Then all but the sets of the component's largest class are joined with every block that
   their band allows, which is exact: whatever is left out is in one class already. Work is near to
   linear where most of a component is one class; where it isn't, it grows with the product of the
   component and what is outside of its largest class.

Defined results: null or blank texts have no shingles and are alone; one or two words are one shingle;
texts and words of any length are taken whole; rows that repeat are in one class; a null id is no
class's smallest id, unless no row has another; empty tables give empty results; other columns, whatever
their names, aren't read, and `keep_one` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import carried, materialize, parts_for, restored
from .components import connected_components
from .shingles import U, mix, set_digest, shingle_sets, slices
from .urls import bloom, maybe, sized

#: Shingles of a block of a component, keys of a packed batch.
BLOCK_SHINGLES, BATCH_KEYS = 2_000_000, 1 << 20
#: Children of a tree's node, pairs of nodes looked at together, and bits of a token bitmap: 64 times the mean size, within these.
FANOUT, PAIRS, BITS = 8, 1024, (512, 1 << 13)
#: Orders by a least hash in which neighbours are compared before the tree is built.
ORDERS = 4
#: Sets that stand for a block's largest class.
REPRESENTATIVES = 8
#: A shingle counts as shared from so many sets of a batch; so many shared ones are told to all tasks (400 kB).
SHARED, FREQUENT = 8, 50_000
#: Bits of a set's parities, twice its size to a power of two, within these, and shingles of a block of them.
PARITIES, SIFT_SHINGLES = (64, 1 << 15), 4_000_000
#: Ranges of a sketch, in how many of them alike sets agree, and most sets with another's name (16 bytes each, told to all tasks).
RANGES, ALIKE, NAMES = 8, 4, 1 << 22
_BOUNDS = np.arange(1, RANGES, dtype=U) * U(2**64 // RANGES)
RECORD = np.dtype([("key", "<u8"), ("who", "<i8"), ("sketch", "<u2", RANGES)])


class Classes:
    """Size classes for a threshold in percent, grown as needed."""

    def __init__(self, threshold: int):
        self.t, self.low, self.parts = threshold, [1], []

    def of(self, n: int) -> int:
        """Class of size n: low[c] <= n < low[c + 1]."""
        while len(self.low) < 2 or self.low[-1] <= n:
            a = self.low[-1]
            self.low.append(max(a + 1, 100 * (a - 1) // self.t + 1))
        return int(np.searchsorted(self.low, n, "right")) - 1

    def cut(self, c: int) -> tuple[int, int]:
        """For the group of classes c and c + 1: parts, and how many of them must hold something.

        Linked sets differ in less than the second number of shingles. There are a few more parts
        than that, as many as are likely to be empty.
        """
        while len(self.low) <= c + 1:
            self.of(self.low[-1])
        while len(self.parts) <= c:
            i = len(self.parts)
            a = self.low[i + 1] - 1
            need = (a + 100 * a // self.t) * (100 - self.t) // (100 + self.t) + 1
            empty = need * math.exp(-self.low[i] / need)
            self.parts.append((need + (math.ceil(1.5 * empty + math.sqrt(empty)) if empty > 0.3 else 0), need))
        return self.parts[c]


def part_keys(s: np.ndarray, classes: Classes, frequent: np.ndarray | None = None, turn: int = 0) -> np.ndarray:
    """Keys of a set for its own group and the one below; none where only equal sets link.

    If at least as many parts hold something as linked sets could differ in, plus one, then any linked
    set shares a part that isn't empty. Otherwise the set sends the parts of a further cut as well; so
    does the other, or it is itself a set for which this cut was enough. frequent, ascending, has to be
    the same for all sets. Each turn has cuts of its own, and linked sets share a key in every turn.
    """
    out, c, rare = [], classes.of(len(s)), s[~within(s, frequent)]
    if turn:
        rare = np.sort(mix(rare ^ U(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
    for group in (c, c - 1):
        k, need = classes.cut(group) if group >= 0 else (1, 1)
        if need == 1:
            continue
        x, seed = rare, 0
        while True:
            first = np.empty(0, np.int64)
            if len(x):
                part = (x >> U(32)) * U(k) >> U(32)
                first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                sums = np.add.reduceat(mix(x + U(0x9E3779B97F4A7C15)), first)
                tag = mix(np.array([group * 0x1000003 + seed], U))[0]
                out.append(mix(sums ^ mix(part[first] + tag)))
            if len(first) >= need or seed >= 16:
                break
            seed += 1
            x = np.sort(mix(s ^ U((seed + 17 * turn) * 0x2545F4914F6CDD1D & (1 << 64) - 1)))
        if len(first) < need:  # hardly ever; both sets then also send what an empty part stands for
            out.append(mix(np.array([group], U)))
    return np.concatenate(out) if out else np.empty(0, U)


def sketch(s: np.ndarray) -> np.ndarray:
    """The least shingle of a set in each range of hashes, 0 where there is none."""
    at = np.concatenate(([0], np.searchsorted(s, _BOUNDS), [len(s)]))
    out, full = np.zeros(RANGES, U), np.flatnonzero(at[1:] > at[:-1])
    out[full] = s[at[full]]
    return out


def within(s: np.ndarray, frequent: np.ndarray | None) -> np.ndarray:
    """Which of the shingles are frequent; frequent is ascending."""
    if frequent is None or not len(frequent):
        return np.zeros(s.shape, bool)
    return frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least of its component over the links a - b, by hooking roots and shortening paths."""
    up = np.arange(n)
    while len(a):
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        open_ = low != high
        a, b = a[open_], b[open_]
        np.minimum.at(up, high[open_], low[open_])
        while ((above := up[up]) != up).any():
            up = above
    return up


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= threshold * (len(a) + len(b) - common)


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Token bitmaps of sets, a row of 64-bit words each."""
    out = np.empty((len(sets), bits // 64), U)
    for at in range(0, len(sets), 512):
        part = sets[at : at + 512]
        on = np.zeros((len(part), bits), bool)
        rows = np.repeat(np.arange(len(part)), [len(s) for s in part])
        on[rows, (np.concatenate(part) & U(bits - 1)).astype(np.int64)] = True
        out[at : at + len(part)] = np.packbits(on, axis=1).view(U)
    return out


def parities(s: np.ndarray) -> np.ndarray:
    """Bits, as 64-bit words: which of the places of a bitmap an odd number of the set's shingles fall into."""
    bits = PARITIES[0]
    while bits < PARITIES[1] and bits < 2 * len(s):
        bits *= 2
    odd = np.bincount((mix(s) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def folded(words: list[np.ndarray], width: int) -> np.ndarray:
    """Parities of so many words out of as many or more, a power of two times as many: one row each."""
    out = np.empty((len(words), width), U)
    for i, w in enumerate(words):
        out[i] = np.bitwise_xor.reduce(w.reshape(-1, width), axis=0)
    return out


def near_pairs(n: np.ndarray, words: list[np.ndarray], m: np.ndarray, others: list[np.ndarray], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of sets, n[i] <= m[j], that sizes and parities don't rule out; both sides ascend by size."""
    t, wide = threshold, np.array([len(w) for w in words])
    for width in np.unique(wide).tolist():
        rows = np.flatnonzero(wide == width)
        lo, hi = np.searchsorted(m, n[rows[0]]), np.searchsorted(m, 100 * n[rows[-1]] // t, "right")
        if lo >= hi:
            continue
        mine, theirs = folded([words[i] for i in rows.tolist()], width), folded(others[lo:hi], width)
        step = max(1, (1 << 21) // (hi - lo))
        for at in range(0, len(rows), step):
            i = rows[at : at + step]
            a, b = np.searchsorted(m, n[i[0]]) - lo, np.searchsorted(m, 100 * n[i[-1]] // t, "right") - lo
            size = n[i][:, None] + m[None, lo + a : lo + b]
            most = size * (100 - t) // (100 + t)
            differ = np.zeros(size.shape, np.int32)
            half = -(-width // 2)
            for k in range(half):
                differ += np.bitwise_count(mine[at : at + step, k, None] ^ theirs[None, a:b, k])
            x, y = np.nonzero((differ <= most) & (n[i][:, None] <= m[None, lo + a : lo + b]))
            some = max(1, (1 << 22) // width)
            for c in range(0, len(x), some):
                u, v = x[c : c + some], y[c : c + some]
                rest = np.bitwise_count(mine[at + u, half:] ^ theirs[a + v, half:]).sum(1, dtype=np.int64)
                ok = differ[u, v] + rest <= most[u, v]
                yield i[u[ok]], lo + a + v[ok]


class SignatureTree:
    """Levels of nodes over sets in an order; level 0 are the sets, and a node holds FANOUT of the level below.

    A level has the OR and the AND of its nodes' bitmaps, their least and greatest sizes, and the most
    tokens of a set that share a bit with another of its tokens.
    """

    def __init__(self, maps: np.ndarray, size: np.ndarray):
        slack = size - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, maps, size, size, slack)]
        while len(self.levels[-1][2]) > 1:
            any_, all_, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(any_, at), np.bitwise_and.reduceat(all_, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at))
            )

    def may_link(self, level: int, x: np.ndarray, y: np.ndarray, t: int) -> np.ndarray:
        """Whether some sets of the nodes x and y could link, by sizes and by the most that they can have in common."""
        any_, all_, low, high, slack = self.levels[level]
        ok = (100 * high[x] >= t * low[y]) & (100 * high[y] >= t * low[x])
        i = np.flatnonzero(ok)
        x, y = x[i], y[i]
        count = lambda m: np.bitwise_count(m).sum(1).astype(np.int64)
        ax, ay = any_[x], any_[y]
        # bits of a set that the other node lacks hold a token each; so do bits that all its sets have
        most = np.minimum(np.minimum(high[x], high[y]), count(ax & ay) + np.minimum(slack[x], slack[y]))
        most = np.minimum(most, np.minimum(high[x] - count(all_[x] & ~ay), high[y] - count(all_[y] & ~ax)))
        ok[i] = (100 + t) * most >= t * (low[x] + low[y])
        return ok

    def children(self, level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the nodes' children, of a node with itself each pair once."""
        n = len(self.levels[level - 1][2])
        step = np.arange(FANOUT)
        a = np.repeat(x[:, None] * FANOUT + step, FANOUT, axis=1).ravel()
        b = np.tile(y[:, None] * FANOUT + step, (1, FANOUT)).ravel()
        same = np.repeat(x == y, FANOUT * FANOUT)
        ok = (a < n) & (b < n) & (~same | (a < b if level == 1 else a <= b))
        return a[ok], b[ok]


class Labels:
    """Components of sets, each set's label at hand as an array; the smaller component takes the other's label."""

    def __init__(self, start: list[int]):
        self.of = np.array(start, np.int64)
        self.members: dict[int, list[int]] = {}
        for i, r in enumerate(start):
            self.members.setdefault(r, []).append(i)

    def join(self, i: int, j: int) -> None:
        a, b = int(self.of[i]), int(self.of[j])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.of[moved] = a
        self.members[a] += moved

    def roots(self) -> list[int]:
        """For each set the first of its component."""
        first = {r: min(m) for r, m in self.members.items()}
        return [first[r] for r in self.of.tolist()]


def tree_join(
    sets: list[np.ndarray], threshold: int, second: list[np.ndarray] | None = None, start: list[int] | None = None, stats: dict | None = None
) -> list[int]:
    """For each set the first of its component over links, by a dual traversal of the sets' signature tree.

    second: the sets in the other lane, in which a link has to hold too. start: labels of components that
    are known already. stats gets the node pairs visited and pruned, and the pairs of sets intersected.
    """
    n = len(sets)
    labels = Labels(list(range(n)) if start is None else start)
    stats = {} if stats is None else stats
    stats["trees"] = stats.get("trees", 0) + (n > 1)
    if n < 2:
        return labels.roots()
    size = np.array([len(s) for s in sets], np.int64)
    flat, begin = np.concatenate(sets), np.cumsum(size) - size

    def test(i: int, j: int) -> None:
        if labels.of[i] == labels.of[j]:
            return
        stats["checked"] = stats.get("checked", 0) + 1
        if linked(sets[i], sets[j], threshold) and (second is None or linked(second[i], second[j], threshold)):
            labels.join(i, j)

    least = size
    for seed in range(ORDERS):  # sets that agree in a least hash are likely links
        least = np.minimum.reduceat(mix(flat ^ U((seed + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)), begin)
        order = np.lexsort((size, least))
        near = np.flatnonzero(least[order][1:] == least[order][:-1])
        for i, j in zip(order[near].tolist(), order[near + 1].tolist()):
            test(i, j)
    # components stand together, the largest first, so that whole nodes drop out
    weight = np.bincount(labels.of, minlength=n)[labels.of]
    order = np.lexsort((least, size, labels.of, -weight))
    bits = BITS[0]
    while bits < BITS[1] and bits < 64 * len(flat) // n and n * bits < 1 << 28:
        bits *= 2
    tree = SignatureTree(bitmaps([sets[i] for i in order.tolist()], bits), size[order])
    top = len(tree.levels) - 1
    zero = np.zeros(1, np.int64)
    stack = [(top, zero, zero)]
    while stack:
        level, x, y = stack.pop()
        if len(x) > PAIRS:
            stack += [(level, x[at : at + PAIRS], y[at : at + PAIRS]) for at in range(0, len(x), PAIRS)]
            continue
        stats["visited"] = stats.get("visited", 0) + len(x)
        width = FANOUT**level
        own = labels.of[order]
        low, high = (f.reduceat(own, np.arange(0, n, width)) for f in (np.minimum, np.maximum))
        open_ = (low[x] != low[y]) | (low[x] != high[x]) | (low[y] != high[y])
        stats["connected"] = stats.get("connected", 0) + int((~open_).sum())
        x, y = x[open_], y[open_]
        ok = tree.may_link(level, x, y, threshold)
        stats["pruned"] = stats.get("pruned", 0) + int((~ok).sum())
        x, y = x[ok], y[ok]
        if level == 0:
            for i, j in zip(order[x].tolist(), order[y].tolist()):
                test(i, j)
        elif len(x):
            stack.append((level - 1, *tree.children(level, x, y)))
    return labels.roots()


def _digests(docs: DataFrame, key: str, text: str, k: int, threshold: int) -> DataFrame:
    """_id, h (the text's hash), n, d1, d2, band and sketch (the last four null where the set is empty) of each row, kind 0.

    Rows of kind 1 hold shingles (h) that distinct sets of a batch share, and in how many of them (n).
    """
    schema = pa.schema([("kind", pa.int32()), ("_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("band", pa.int32()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(threshold)
        for b in batches:
            for lo, hi in slices(b.column(2), 4 << 20):
                n, digests, bands, sketches, distinct = [], [], [], [], {}
                for s, other in shingle_sets(b.column(2).slice(lo, hi - lo), k, 2):
                    n.append(len(s))
                    digests.append((set_digest(s), set_digest(other)) if len(s) else (None, None))
                    bands.append(classes.of(len(s)) if len(s) else None)
                    sketches.append(sketch(s).tobytes() if len(s) else None)
                    if len(s):
                        distinct[digests[-1]] = s
                d1, d2 = (pa.array([d[j] for d in digests], pa.int64()) for j in (0, 1))
                kind = pa.array(np.zeros(hi - lo, np.int32))
                yield pa.RecordBatch.from_arrays([kind, b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), d1, d2, pa.array(bands, pa.int32()), pa.array(sketches, pa.binary())], schema=schema)
                u, times = np.unique(np.concatenate(list(distinct.values())), return_counts=True) if distinct else (np.empty(0, U), np.empty(0, np.int64))
                u, times = u[times >= SHARED], times[times >= SHARED]
                none = pa.nulls(len(u), pa.int64())
                kind = pa.array(np.ones(len(u), np.int32))
                yield pa.RecordBatch.from_arrays([kind, none, pa.array(u.view(np.int64)), pa.array(times), none, none, pa.nulls(len(u), pa.int32()), pa.nulls(len(u), pa.binary())], schema=schema)

    string = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    ddl = "kind int, _id long, h long, n long, d1 long, d2 long, band int, sketch binary"
    return docs.select(F.col(f"`{key}`").cast("long"), F.xxhash64(string), string).mapInArrow(run, ddl)


def _frequent(found: DataFrame) -> np.ndarray:
    """Up to FREQUENT shingles that most sets share, ascending; a table of bounded size.

    It decides which parts are cut first, the same way for all sets, and nothing about links.
    """
    top = found.where("kind = 1").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT)
    return np.sort(np.array([r.h for r in top.collect()], np.int64).view(U))


def _sketched(ids: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """(bucket, block) rows: a block has records of a rare shingle of a set's sketch, its digest and 16 bits of each such shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            digest, first = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
            keys = np.frombuffer(b"".join(b.column(1).take(pa.array(first)).to_pylist()), U).reshape(-1, RANGES)
            keys = np.where((keys == 0) | within(keys, frequent), U(0), mix(keys))
            short = (keys >> U(48)).astype("<u2")
            who, which = np.nonzero(keys)
            out = np.empty(len(who), RECORD)
            out["key"], out["who"], out["sketch"] = keys[who, which], digest[who], short[who]
            bucket = ((out["key"] >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(out) else np.empty(0, np.int64)
            blocks = [out[i:j].tobytes() for i, j in zip(first.tolist(), [*first[1:].tolist(), len(out)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    return ids.where("d1 IS NOT NULL").select("d1", "sketch").mapInArrow(run, "bucket int, block binary")


def _alike(table: pa.Table) -> pa.Table:
    """Spanning stars (a, b) of a bucket's sets that agree in enough of their sketches with the first set of a shingle."""
    x = np.concatenate([np.frombuffer(b, RECORD) for b in table.column("block").to_pylist()])
    x = x[np.lexsort((x["who"], x["key"]))]
    fresh = np.concatenate(([True], x["key"][1:] != x["key"][:-1]))
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    many = ((x["sketch"] == x["sketch"][lead]) & (x["sketch"] != 0)).sum(1) >= ALIKE
    return _forest(x["who"][lead[many]], x["who"][many])


def _names(ids: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(node, root): digests of sets that go by another's, NAMES of them at most; of more, some whole groups of alike sets.

    Each set is compared with one set for each shingle of its sketch, so that there are at most RANGES ties a set.
    """
    buckets = parts_for(RECORD.itemsize * RANGES * ids.where("d1 IS NOT NULL").count(), ids.sparkSession)
    ties = _sketched(ids, buckets, frequent).groupBy("bucket").applyInArrow(_alike, "a long, b long")
    names = connected_components(ties)
    shares = -(-names.count() // NAMES)
    return names if shares <= 1 else materialize(names.where(F.pmod(F.xxhash64("root"), F.lit(shares)) == 0), "ngram-names")


def _told(names: DataFrame):
    """names as a broadcast variable: nodes, ascending, and their roots."""
    table = names.select("node", "root").toArrow()
    node, root = (table.column(c).to_numpy() for c in ("node", "root"))
    order = np.argsort(node)
    return names.sparkSession.sparkContext.broadcast((node[order], root[order]))


def _named(digest: np.ndarray, told) -> np.ndarray:
    node, root = told.value if told else (digest[:0], digest[:0])
    if not len(node):
        return digest
    at = np.minimum(np.searchsorted(node, digest), len(node) - 1)
    return np.where(node[at] == digest, root[at], digest)


def _keys(docs: DataFrame, text: str, k: int, threshold: int, buckets: int, frequent: np.ndarray, turn: int = 0, told=None) -> DataFrame:
    """(bucket, block, ties) rows: a block has as many 4-byte keys as 8-byte digests, of a batch's sets.

    Equal sets of a batch send once. Sets of a batch that share a key are tied to each other there (ties:
    pairs of digests), and the first alone sends that key, so that a frequent key costs an entry a batch.
    A set that told (a broadcast variable) has a name for goes by it instead of its digest.
    """
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.binary()), ("ties", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, held, ids, seen, total = Classes(threshold), [], [], set(), 0

        def done() -> pa.RecordBatch:
            keys = np.concatenate(held)
            who = np.repeat(np.arange(len(ids)), [len(h) for h in held])
            order = np.argsort(keys, kind="stable")
            keys, who = keys[order], who[order]
            fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
            same = np.flatnonzero(~fresh)
            digest, root = _named(np.array(ids, np.int64), told), local_components(len(ids), who[same - 1], who[same])
            tied = np.flatnonzero(digest[root] != digest)
            pairs = np.stack([digest[root[tied]], digest[tied]], 1)
            keys, who = keys[fresh], digest[who[fresh]]
            bucket = ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int32)  # keys ascend, and so do buckets
            keys = (keys & U(0xFFFFFFFF)).astype("<u4")
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            last = [*first[1:].tolist(), len(keys)]
            blocks = [keys[a:b].tobytes() + who[a:b].tobytes() for a, b in zip(first.tolist(), last)]
            share = -(-len(pairs) // len(blocks))  # ties ride along with the blocks
            ties = [pairs[i * share : (i + 1) * share].tobytes() for i in range(len(blocks))]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(blocks, pa.binary()), pa.array(ties, pa.binary())], schema=schema)

        for b in batches:
            for lo, hi in slices(b.column(0)):
                for s in shingle_sets(b.column(0).slice(lo, hi - lo), k):
                    if len(s):
                        d = set_digest(s)
                        mark = d, len(s), int(s[0]), int(s[-1])  # another set with this digest sends as well
                        if mark not in seen and len(keys := part_keys(s, classes, frequent, turn)):
                            seen.add(mark)
                            held.append(keys)
                            ids.append(d)
                            total += len(keys)
                if total >= BATCH_KEYS:
                    yield done()
                    held, ids, seen, total = [], [], set(), 0
        if held:
            yield done()

    return docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "bucket int, block binary, ties binary")


def _forest(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Spanning stars (a: root, b: node) of the links a - b."""
    differ = a != b
    nodes, flat = np.unique(np.concatenate([a[differ], b[differ]]), return_inverse=True)
    root = local_components(len(nodes), flat[: len(flat) // 2], flat[len(flat) // 2 :])
    out = root != np.arange(len(nodes))
    return pa.table({"a": nodes[root[out]] if len(nodes) else nodes, "b": nodes[out]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _stars(table: pa.Table) -> pa.Table:
    """Spanning stars (node, root) of one bucket's sets, connected where they share a key or are tied."""
    keys, who = [], []
    for x in table.column("block").to_pylist():
        n = len(x) // 12
        keys.append(np.frombuffer(x, "<u4", n))
        who.append(np.frombuffer(x, np.int64, n, 4 * n))
    keys, who = np.concatenate(keys), np.concatenate(who)
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    ties = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.column("ties").to_pylist()]
    return _forest(np.concatenate([who[same], *(t[:, 0] for t in ties)]), np.concatenate([who[same + 1], *(t[:, 1] for t in ties)]))


def _class_rows(docs: DataFrame, key: str, text: str, shingle: int, threshold: int, block_shingles: int) -> DataFrame:
    """_id, n, h (the text's hash) and class (of two digests; null for empty sets) of each row."""
    found = materialize(_digests(docs, key, text, shingle, threshold), "ngram-digests")
    ids = found.where("kind = 0").drop("kind", "sketch")
    shingles = ids.agg(F.sum("n")).first()[0] or 0
    buckets = parts_for(12 * shingles, docs.sparkSession)
    frequent = _frequent(found)
    names = _names(found.where("kind = 0").select("d1", "sketch"), frequent)
    told, same = _told(names), names.select(F.col("root").alias("a"), F.col("node").alias("b"))
    stars = _keys(docs, text, shingle, threshold, buckets, frequent, 0, told).groupBy("bucket").applyInArrow(_stars, "a long, b long")
    coarse = materialize(connected_components(stars.unionAll(same)), "ngram-coarse")
    nodes = _refined(docs, _nodes(ids, coarse), key, text, shingle, threshold, frequent, told, same)
    nodes = _sifted(docs, nodes, key, text, shingle, threshold, block_shingles)
    labels = materialize(_exact(docs, nodes, key, text, shingle, threshold, block_shingles), "ngram-labels")
    joined = ids.join(labels.select(F.col("d1").alias("_e1"), F.col("d2").alias("_e2"), "c1", "c2"), (F.col("d1") == F.col("_e1")) & (F.col("d2") == F.col("_e2")), "left")
    own = F.when(F.col("d1").isNotNull(), F.struct(F.coalesce("c1", "d1").alias("c1"), F.coalesce("c2", "d2").alias("c2")))
    return joined.select("_id", "n", "h", own.alias("class"))


def ngram_classes(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = 90, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """key, n_shingles, component_id for each row; component_id is the smallest key of the row's class."""
    rows = _class_rows(docs, key, text, shingle, threshold, block_shingles)
    least = rows.where("class IS NOT NULL").groupBy(F.col("class").alias("_c")).agg(F.min("_id").alias("least"))
    # rows alone have a null class: spread, not joined in one task
    joined = rows.where("class IS NOT NULL").join(least, F.col("class") == F.col("_c"), "left").select("_id", "n", "least")
    alone = rows.where("class IS NULL").select("_id", "n", F.col("_id").alias("least"))
    return joined.unionAll(alone).select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_one(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: int = 80, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """One row of each class, that with the smallest key (null last, then by text hash), and every row without shingles.

    The rows that go are found by key and text hash and taken out by an anti-join, which only rows meet
    that a Bloom filter of those keys and hashes lets pass; of rows that repeat the chosen one, all but
    one go.
    """
    rows = materialize(_class_rows(docs, key, text, shingle, threshold, block_shingles), "ngram-rows")
    rank = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("h").alias("h"))
    best = rows.where("class IS NOT NULL").groupBy(F.col("class").alias("_c")).agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("rows"))
    best = best.where("rows > 1").select("_c", F.col("best.i").alias("_bi"), F.col("best.h").alias("_bh"))
    inside = rows.where("class IS NOT NULL").join(best, F.col("class") == F.col("_c"))
    mine = F.col("_id").eqNullSafe(F.col("_bi")) & (F.col("h") == F.col("_bh"))
    gone = inside.where(~mine).select("_id", "h").distinct().withColumn("go", F.lit(True))
    twice = inside.where(mine).groupBy("_id", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_id", "h", F.lit(False).alias("go"))
    marks = materialize(gone.union(twice).select(F.col("_id").alias("_mi"), F.col("h").alias("_mh"), "go"), "ngram-marks")
    string = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    named = carried(docs, _key=F.col(f"`{key}`").cast("long"), _hash=F.xxhash64(string)).withColumn("_mark", F.xxhash64("_key", "_hash"))
    blocks, parts, small = sized(marks.count())
    marked = materialize(bloom(marks.select(F.xxhash64("_mi", "_mh").alias("k")), "k", blocks, parts), "ngram-marked")
    probed = maybe(named, "_mark", marked, "_maybe", blocks, parts, small)
    joined = probed.where("_maybe").join(marks, F.col("_key").eqNullSafe(F.col("_mi")) & (F.col("_hash") == F.col("_mh")), "left")
    rest = joined.where("go IS NULL").select("_row")
    first = joined.where("NOT go").dropDuplicates(["_mi", "_mh"]).select("_row")
    return restored(probed.where("NOT _maybe").select("_row").unionAll(rest).unionAll(first), docs)


def _solver(shingle: int, threshold: int):
    """Joins a task's texts; (d1, d2, c1, c2) rows name each set's class by one of its sets.

    c1, c2 of the input, where not null, name classes known before; rows of one set may repeat.
    """
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])

    def solve(table: pa.Table) -> pa.Table:
        column = table.column("_text").combine_chunks()
        column = column if isinstance(column, pa.Array) else column.chunk(0)
        names = list(zip(*(table.column(c).to_pylist() for c in ("d1", "d2", "c1", "c2"))))
        one, two, keep, start, seen, known = [], [], [], [], set(), {}
        for lo, hi in slices(column):
            for (d1, d2, c1, c2), (s, other) in zip(names[lo:hi], shingle_sets(column.slice(lo, hi - lo), shingle, 2)):
                # repeated keys may bring other texts
                if len(s) and (d1, d2) not in seen and d1 == set_digest(s) and d2 == set_digest(other):
                    seen.add((d1, d2))
                    start.append(known.setdefault((d1, d2) if c1 is None else (c1, c2), len(keep)))
                    one.append(s)
                    two.append(other)
                    keep.append((d1, d2))
        roots = tree_join(one, threshold, two, start)
        rows = [(*keep[i], *keep[r]) for i, r in enumerate(roots)]
        return pa.Table.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], schema=schema)

    return solve


SOLVED = "d1 long, d2 long, c1 long, c2 long"


def _nodes(ids: DataFrame, coarse: DataFrame) -> DataFrame:
    """(d1, d2, band, n, root, rep) of the sets of coarse components, written down."""
    members = coarse.select("node", "root").union(coarse.select("root", "root")).distinct()
    # any row of a set will do: one place stands for each digest
    reps = ids.where("d1 IS NOT NULL").groupBy("d1", "d2", "band", "n").agg(F.min("_id").alias("rep"))
    return materialize(members.join(reps, members["node"] == reps["d1"]).select("d1", "d2", "band", "n", "root", "rep"), "ngram-nodes")


def _texts(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, _text) of the rows that a Bloom filter of the nodes' ids lets pass."""
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    wanted = nodes.select(F.coalesce(F.col("rep").cast("string"), F.lit("null")).alias("k"))
    probe = texts.withColumn("_k", F.coalesce(F.col("_id").cast("string"), F.lit("null")))
    blocks, parts, small = sized(nodes.count())
    return maybe(probe, "_k", bloom(wanted, "k", blocks, parts), "_m", blocks, parts, small).where("_m").select("_id", "_text")


def _refined(docs: DataFrame, nodes: DataFrame, key: str, text: str, shingle: int, threshold: int, frequent: np.ndarray, told=None, same: DataFrame | None = None) -> DataFrame:
    """nodes by what they share in a further turn as well, without those that are then alone.

    Linked sets are in one component in both turns, so no link is lost; sets that met by chance in the
    first hardly do so among the few that are left.
    """
    shingles = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = parts_for(12 * shingles, docs.sparkSession)
    keys = _keys(_texts(docs, nodes, key, text), "_text", shingle, threshold, buckets, frequent, 1, told)
    stars = keys.groupBy("bucket").applyInArrow(_stars, "a long, b long")
    again = connected_components(stars.unionAll(same) if same else stars)
    members = again.select("node", "root").union(again.select("root", "root")).distinct().select(F.col("node").alias("_n"), F.col("root").alias("_again"))
    both = nodes.join(members, F.col("d1") == F.col("_n")).withColumn("root", F.xxhash64("root", "_again")).drop("_n", "_again")
    both = materialize(both, "ngram-both")
    more = both.groupBy(F.col("root").alias("_r")).agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    return materialize(both.join(more, F.col("root") == F.col("_r"), "left_semi"), "ngram-refined")


def _large(nodes: DataFrame, block_shingles: int) -> DataFrame:
    """_r: roots of components too large for a task, written down."""
    many = F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(block_shingles))).cast("int")
    return materialize(nodes.groupBy("root").agg(many.alias("blocks")).where("blocks > 1").select(F.col("root").alias("_r")), "ngram-large")


def _parities(texts: DataFrame, k: int) -> DataFrame:
    """(_e1, _e2, words) of the sets of texts (_id, _text): a batch's equal sets once."""
    schema = pa.schema([("_e1", pa.int64()), ("_e2", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(0)):
                found = {}
                for s, other in shingle_sets(b.column(0).slice(lo, hi - lo), k, 2):
                    if len(s):
                        found[set_digest(s), set_digest(other)] = s
                e1, e2 = (pa.array([d[j] for d in found], pa.int64()) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([e1, e2, pa.array([parities(s).tobytes() for s in found.values()], pa.binary())], schema=schema)

    return texts.select("_text").mapInArrow(run, "_e1 long, _e2 long, words binary")


def _sifter(threshold: int):
    """Spanning stars (a, b) of the sets of two blocks, side 0 and 1, or of one, side 0 alone, that sizes and parities let link."""

    def sift(table: pa.Table) -> pa.Table:
        side, n, d = (table.column(c).to_numpy() for c in ("side", "n", "d1"))
        order = np.lexsort((n, side))
        side, n, d = side[order], n[order], d[order]
        words = [np.frombuffer(w, U) for w in table.column("words").take(pa.array(order)).to_pylist()]
        cut = int(np.searchsorted(side, 1))
        spans = [(0, cut, cut, len(n)), (cut, len(n), 0, cut)] if cut < len(n) else [(0, cut, 0, cut)]
        up = np.arange(len(n))
        for a, b, lo, hi in spans:
            if a < b and lo < hi:
                for i, j in near_pairs(n[a:b], words[a:b], n[lo:hi], words[lo:hi], threshold):
                    up = local_components(len(n), up[a + i], up[lo + j])[up]
        return _forest(d[up], d)

    return sift


def _sifted(docs: DataFrame, nodes: DataFrame, key: str, text: str, shingle: int, threshold: int, block_shingles: int) -> DataFrame:
    """nodes with the components too large for a task parted by parities, without those that are then alone.

    Linked sets are in one component and in the same band or neighbours, meet in a pair of blocks and pass, so no link is lost.
    """
    large = _large(nodes, block_shingles)
    if not large.limit(1).count():
        return nodes
    inside = materialize(nodes.join(large, F.col("root") == F.col("_r"), "left_semi"), "ngram-inside")
    of = F.ceil(F.sum("n") / F.lit(SIFT_SHINGLES)).cast("int")
    shape = materialize(inside.groupBy(F.col("root").alias("_root"), F.col("band").alias("_band")).agg(of.alias("_of")), "ngram-sift")
    found = _parities(_texts(docs, inside, key, text), shingle).dropDuplicates(["_e1", "_e2"])
    sets = inside.join(found, (F.col("d1") == F.col("_e1")) & (F.col("d2") == F.col("_e2"))).drop("_e1", "_e2", "rep")
    mine = (F.col("root") == F.col("_root")) & (F.col("band") == F.col("_band"))
    block = F.pmod(F.xxhash64("d1", "d2"), F.col("_of")).cast("int")
    sets = materialize(sets.join(shape, mine).withColumn("block", block).select("root", "band", "block", "n", "d1", "words"), "ngram-parities")
    here = (F.col("root") == F.col("_root")) & (F.col("other") == F.col("_band"))

    def met(step: int, side: int) -> DataFrame:
        """The sets as one side of pairs of blocks (b, i) and (o, j), whose other block is in the band so many above or below."""
        rows = sets.withColumn("other", F.col("band") + step).join(shape, here).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
        ends = [F.col("band").alias("b"), F.col("block").alias("i"), F.col("other").alias("o"), F.col("x").alias("j")]
        if side:
            ends = [F.col("other").alias("b"), F.col("x").alias("i"), F.col("band").alias("o"), F.col("block").alias("j")]
        if not step:
            rows = rows.where("block < x" if not side else "x < block")
        return rows.select("root", *ends, F.lit(side).alias("side"), "n", "d1", "words")

    alone = sets.select("root", F.col("band").alias("b"), F.col("block").alias("i"), F.col("band").alias("o"), F.col("block").alias("j"), F.lit(0).alias("side"), "n", "d1", "words")
    pairs = alone.unionByName(met(0, 0)).unionByName(met(0, 1)).unionByName(met(1, 0)).unionByName(met(-1, 1))
    again = connected_components(pairs.groupBy("root", "b", "i", "o", "j").applyInArrow(_sifter(threshold), "a long, b long"))
    again = again.select(F.col("node").alias("_n"), F.col("root").alias("_again"))
    parted = inside.join(again, F.col("d1") == F.col("_n"), "left").withColumn("root", F.xxhash64("root", F.coalesce("_again", "d1"))).drop("_n", "_again")
    parted = materialize(parted, "ngram-parted")
    more = parted.groupBy(F.col("root").alias("_r")).agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    parted = parted.join(more, F.col("root") == F.col("_r"), "left_semi")
    return materialize(nodes.join(large, F.col("root") == F.col("_r"), "left_anti").unionByName(parted), "ngram-sifted")


def _exact(docs, nodes, key, text, shingle, threshold, block_shingles) -> DataFrame:
    """(d1, d2, c1, c2) of exact classes, for the sets of coarse components."""
    large = _large(nodes, block_shingles)
    split = large.limit(1).count() > 0
    texts = _texts(docs, nodes, key, text)
    solve, none = _solver(shingle, threshold), F.lit(None).cast("long")

    def fetched(some: DataFrame) -> DataFrame:
        return some.join(texts, F.col("rep").eqNullSafe(F.col("_id"))).drop("_id", "rep")

    if not split:
        return fetched(nodes).select("d1", "d2", "root", none.alias("c1"), none.alias("c2"), "_text").groupBy("root").applyInArrow(solve, SOLVED)

    whole = fetched(nodes.join(large, nodes["root"] == large["_r"], "left_anti"))
    whole = whole.select("d1", "d2", "root", none.alias("c1"), none.alias("c2"), "_text").groupBy("root").applyInArrow(solve, SOLVED)
    apart = materialize(fetched(nodes.join(large, nodes["root"] == large["_r"], "left_semi")), "ngram-texts")
    return whole.unionByName(_blockwise(apart, solve, block_shingles))


def _blockwise(texts: DataFrame, solve, block_shingles: int) -> DataFrame:
    """(d1, d2, c1, c2) for texts (d1, d2, band, n, root, _text) of components too large for a task; see step 5."""
    none = F.lit(None).cast("long")
    node = F.struct(F.col("d1"), F.col("d2"))
    keyed = texts.select("root", "band", "d1", "d2", "n").distinct()

    def dealt(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        """rows (with by, n, d1, d2) with a block's number in its group and the number of blocks."""
        total = F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(block_shingles))).cast("int").alias("_of")
        sizes = materialize(rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(total), name)
        on = [F.col(c) == F.col(f"_{c}") for c in by]
        joined = rows.join(sizes, on).drop(*[f"_{c}" for c in by])
        return joined.withColumn("block", F.pmod(F.xxhash64("d1", "d2"), F.col("_of")).cast("int"))

    def edges_of(solved: DataFrame) -> DataFrame:
        return solved.where("d1 <> c1 OR d2 <> c2").select(node.alias("a"), F.struct(F.col("c1").alias("d1"), F.col("c2").alias("d2")).alias("b"))

    def joined_texts(some: DataFrame) -> DataFrame:
        t = texts.select(F.col("d1").alias("_t1"), F.col("d2").alias("_t2"), "_text")
        return some.join(t, (F.col("d1") == F.col("_t1")) & (F.col("d2") == F.col("_t2"))).drop("_t1", "_t2")

    # every block alone
    blocks = materialize(dealt(keyed, ["root", "band"], "ngram-bands"), "ngram-blocks")
    task, by = blocks, ["root", "band", "block"]
    edges, rest, count = None, True, None
    while True:  # representatives, until a task holds those of a component or they don't get fewer
        rows = joined_texts(task.withColumn("c1", none).withColumn("c2", none))
        solved = materialize(rows.groupBy(*by).applyInArrow(solve, SOLVED), "ngram-solved")
        edges = edges_of(solved) if edges is None else edges.unionByName(edges_of(solved))
        if not rest:
            break
        s = solved.select(F.col("d1").alias("_s1"), F.col("d2").alias("_s2"), "c1", "c2")
        named = task.join(s, (F.col("d1") == F.col("_s1")) & (F.col("d2") == F.col("_s2"))).drop("_s1", "_s2")
        weight = named.groupBy(*by, "c1", "c2").agg(F.count(F.lit(1)).alias("w"))
        best = weight.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max(F.struct("w", "c1", "c2")).alias("best"), F.sum("w").alias("sets"))
        inside = named.join(best, [F.col(c) == F.col(f"_{c}") for c in by]).where((F.col("c1") == F.col("best.c1")) & (F.col("c2") == F.col("best.c2")))
        # some of the class by the order of their digests: a bounded number, found by partial aggregation
        some = inside.groupBy("root", *by[1:]).agg(F.min(F.struct("d1", "d2", "n")).alias("x0"), F.max(F.struct("d1", "d2", "n")).alias("x1"), *[
            F.min(F.struct(F.xxhash64("d1", F.lit(i)).alias("h"), "d1", "d2", "n")).alias(f"y{i}") for i in range(REPRESENTATIVES - 2)
        ])
        picked = F.array(*[F.struct(F.col(f"{c}.d1"), F.col(f"{c}.d2"), F.col(f"{c}.n")) for c in ["x0", "x1", *[f"y{i}" for i in range(REPRESENTATIVES - 2)]]])
        chosen = some.select("root", F.explode(picked).alias("x")).select("root", "x.*").distinct()
        task = materialize(dealt(chosen, ["root"], "ngram-levels"), "ngram-representatives")
        by = ["root", "block"]
        before, count = count, task.count()
        rest = task.where("_of > 1").limit(1).count() > 0 and (before is None or 2 * count <= before)

    # all but the largest class against every block that its band allows
    classes = materialize(connected_components(edges), "ngram-classes")
    c = classes.select(F.col("node.d1").alias("_n1"), F.col("node.d2").alias("_n2"), F.col("root.d1").alias("c1"), F.col("root.d2").alias("c2"))
    named = blocks.join(c, (F.col("d1") == F.col("_n1")) & (F.col("d2") == F.col("_n2")), "left").drop("_n1", "_n2")
    named = named.withColumn("c1", F.coalesce("c1", "d1")).withColumn("c2", F.coalesce("c2", "d2"))
    named = materialize(named, "ngram-named")
    weight = named.groupBy("root", "c1", "c2").agg(F.count(F.lit(1)).alias("w"))
    best = weight.groupBy(F.col("root").alias("_root")).agg(F.max(F.struct("w", "c1", "c2")).alias("best"))
    outside = named.join(best, F.col("root") == F.col("_root")).where((F.col("c1") != F.col("best.c1")) | (F.col("c2") != F.col("best.c2")))
    outside = materialize(dealt(outside.select("root", "band", "d1", "d2", "n", "c1", "c2"), ["root", "band"], "ngram-outside-bands"), "ngram-outside")
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    shape = lambda rows: rows.select("root", "band", F.col("_of")).distinct()
    mine = shape(blocks).select(F.col("root").alias("_root"), F.col("band").alias("_band"), F.sequence(F.lit(0), F.col("_of") - 1).alias("_all"))
    theirs = shape(outside).select(F.col("root").alias("_root"), F.col("band").alias("_band"), F.sequence(F.lit(0), F.col("_of") - 1).alias("_all"))
    here = (F.col("root") == F.col("_root")) & (F.col("other") == F.col("_band"))
    left = named.withColumn("other", near).join(theirs, here).withColumn("_j", F.explode("_all")).select(
        "root", F.col("band").alias("b"), F.col("block").alias("i"), F.col("other").alias("o"), F.col("_j").alias("j"), "d1", "d2", "c1", "c2"
    )
    right = outside.withColumn("other", near).join(mine, here).withColumn("_i", F.explode("_all")).select(
        "root", F.col("other").alias("b"), F.col("_i").alias("i"), F.col("band").alias("o"), F.col("block").alias("j"), "d1", "d2", "c1", "c2"
    )
    cross = joined_texts(left.unionByName(right)).groupBy("root", "b", "i", "o", "j").applyInArrow(solve, SOLVED)
    last = materialize(connected_components(edges_of(cross).unionByName(classes.select(F.col("node").alias("a"), F.col("root").alias("b")))), "ngram-last")
    return last.select(F.col("node.d1").alias("d1"), F.col("node.d2").alias("d2"), F.col("root.d1").alias("c1"), F.col("root.d2").alias("c2"))
