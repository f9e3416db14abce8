"""Exact repeated-substring removal by suffix sorting (deep-shallow) of candidate positions.

A position is repeated when the string of `length` bytes that starts there also starts anywhere else,
in any text; every byte that such a string covers is removed. To sort suffixes without moving the
corpus `length` times over, positions are first dealt by content:

1. Equal texts become one, with their number, on partitions by text hash. Texts travel packed and
   compressed, once; all later steps read that exchange again.
2. Every window of `length` bytes is named by its least k-gram hash (leftmost on ties). Equal windows
   have the same name at the same offset, and neighbouring windows mostly share one, so a text falls
   into runs of windows with one name. Names travel as 8-byte hashes; those that occur once in the
   corpus can't be of a repeated window, and only the others come back.
3. Runs with a name that occurs again are sent to the name's bucket with their bytes. Equal runs of a
   partition are sent once, with their number, and their places stay behind, so that a string which one
   text repeats over and over costs an entry. A name too frequent for a task is dealt further by the
   bytes around the k-gram.
4. In a bucket, equal runs (told by 160-bit digests) are repeated as a whole. Where runs of a name differ, the suffixes at their
   windows are sorted by deep-shallow sorting, separately for each offset of the k-gram: multikey
   quicksort, in which characters are 8 bytes and a ternary split about a median compares one, orders
   them to a shallow depth; groups with a longer common prefix go to blind tries, whose nodes keep only
   the depth at which suffixes branch and the byte there, up to the depth `length`. Suffixes that reach
   it together are repeated.
5. Each text gets its repeated windows back and drops the bytes that they cover.

Defined results: null text is empty; texts shorter than `length` lose nothing; texts of any length are
judged whole; rows that repeat repeat each other, and of equal strings none is kept; a null key stays
null; empty tables give empty results; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import measured_bytes, parts_for, tasks_for
from .shingles import U, mix

GRAM, SHALLOW, SEGMENT = 48, 16, 1 << 20
#: Occurrences from which a name is dealt further, and windows that then go together.
HOT, STEP = 5_000, 25
#: Windows sorted at a time, unless one name has more.
WINDOWS = 150_000


BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {BASE: np.ones(1, U), INVERSE: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2**64, kept for the next call."""
    p = _powers[base]
    while len(p) < n:
        p = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
    if len(p) <= 1 << 23:
        _powers[base] = p
    return p[:n]


# --- windows and their names ---------------------------------------------------------------------


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each position."""
    n = len(raw)
    sums = np.zeros(n + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * powers(BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * powers(INVERSE, n)[: n - k + 1])


def window_runs(raw: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text with the same least k-gram: first window, windows, gram's place, name.

    Long texts are worked through in segments of window starts, which leaves the same runs cut.
    """
    k = min(k, length)
    out = []
    for a in range(0, max(0, len(raw) - length + 1), SEGMENT):
        part = raw[a : a + SEGMENT + length - 1]
        names = gram_hashes(part, k)
        m = (names & ~U(2 * SEGMENT - 1)) | np.arange(len(names), dtype=U)  # place breaks ties
        w, have = length - k + 1, 1
        while 2 * have <= w:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if have < w:
            m = np.minimum(m[: len(m) - (w - have)], m[w - have :])
        place = (m & U(2 * SEGMENT - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.append(first, len(place)))
        out.append((first + a, count, place[first] + a, mix(names[place[first]])))  # least hashes are small: spread them over buckets
    if not out:
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, U)
    return tuple(np.concatenate(x) for x in zip(*out))


def concat_runs(texts: list[bytes], length: int, k: int):
    """Runs of all texts: text's place, first window, windows, gram's place, name. Short texts share one pass."""
    parts, at = [], 0
    while at < len(texts):
        size, b = 0, at
        while b < len(texts) and (b == at or size + len(texts[b]) <= SEGMENT // 2):
            size += len(texts[b])
            b += 1
        group = texts[at:b]
        raw = np.frombuffer(b"".join(group), np.uint8)
        first, count, place, name = window_runs(raw, length, k)
        ends = np.cumsum([len(t) for t in group])
        starts = ends - [len(t) for t in group]
        if len(group) > 1 and len(first):
            # a run may reach over texts' ends: cut it where windows leave one text and enter the next
            cuts = np.concatenate([starts, np.maximum(starts, ends - length + 1)])
            cuts = np.setdiff1d(cuts[(cuts > first[0]) & (cuts < first[-1] + count[-1])], first)
            which = np.searchsorted(first, cuts, "right") - 1
            order = np.argsort(np.concatenate([first, cuts]), kind="stable")
            last = first[-1] + count[-1]
            place, name = np.concatenate([place, place[which]])[order], np.concatenate([name, name[which]])[order]
            first = np.concatenate([first, cuts])[order]
            count = np.diff(np.append(first, last))
        doc = np.searchsorted(ends, first, "right")
        ok = first + length <= ends[np.minimum(doc, len(ends) - 1)] if len(first) else np.empty(0, bool)
        doc, first, count, place, name = doc[ok], first[ok], count[ok], place[ok], name[ok]
        parts.append((doc + at, first - starts[doc], count, place - starts[doc], name))
        at = b
    if not parts:
        e = np.empty(0, np.int64)
        return e, e, e, e, np.empty(0, U)
    return tuple(np.concatenate(x) for x in zip(*parts))


# --- deep-shallow sorting ------------------------------------------------------------------------


def characters(raw: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as one big-endian character; a view, nothing is copied."""
    return np.ndarray(shape=(len(raw) - 7,), dtype=">u8", buffer=raw, strides=(1,))


def multikey_quicksort(chars: np.ndarray, pos: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the suffixes within their groups to a shallow depth.

    group is ascending. All groups are split at once: each takes the median of three characters as
    pivot and parts into less, equal and greater; the equal part goes one character deeper. Returns
    the order, each place's group after it, and whether that group has still more than one suffix.
    """
    order = np.arange(len(pos))
    at = np.zeros(len(pos), np.int64)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
    result, final = np.empty(len(pos), np.int64), np.empty(len(pos), np.int64)
    base = start  # where a group begins in the result
    size = np.diff(np.append(start, len(pos)))
    while len(order):
        # finished: alone, or equal to the shallow depth
        whole = (size == 1) | (at[start] >= depth)
        inside = np.repeat(whole, size)
        spot = np.repeat(base, size) + np.arange(len(order)) - np.repeat(start, size)
        result[spot[inside]] = order[inside]
        final[spot[inside]] = np.repeat(base, size)[inside]
        order, at, base, size = order[~inside], at[~inside], base[~whole], size[~whole]
        if not len(order):
            break
        start = np.cumsum(size) - size
        c = chars[pos[order] + at].astype(U)
        x, y, z = c[start], c[start + size // 2], c[start + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z)), size)
        side = (c >= pivot).astype(np.int64) + (c > pivot)
        seg = np.repeat(np.arange(len(size)), size) * 3 + side
        moved = np.argsort(seg, kind="stable")
        seg = seg[moved]
        order, at = order[moved], at[moved] + 8 * (side[moved] == 1)
        cut = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        base = np.repeat(base, size)[cut] + cut - np.repeat(start, size)[cut]
        start, size = cut, np.diff(np.append(cut, len(order)))
    many = np.zeros(len(pos), bool)
    if len(final):
        same = final[1:] == final[:-1]
        many[1:] |= same
        many[:-1] |= same
    return result, final, many


def blind_tries(chars: np.ndarray, pos: np.ndarray, group: np.ndarray, depth: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of groups that agree to `depth`, and whether each equals a neighbour to `length`.

    The tries of all groups are built together, node by node from the roots. A node's branching depth
    is the least length that its first suffix has in common with any other, found without looking at
    what lies between; its children are told apart by the byte there alone.
    """
    n = len(pos)
    result, equal = np.empty(n, np.int64), np.zeros(n, bool)
    order = np.arange(n)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.empty(0, np.int64)
    size = np.diff(np.append(start, n))
    base, known = start.copy(), np.full(len(start), depth)
    while len(order):
        node = np.repeat(np.arange(len(size)), size)
        first = np.repeat(pos[order[start]], size)
        mine = pos[order]
        common = np.full(len(order), length, np.int64)
        at = np.repeat(known, size)
        open_ = np.flatnonzero(mine != first)
        while len(open_):
            a, b = chars[mine[open_] + at[open_]].astype(U), chars[first[open_] + at[open_]].astype(U)
            x = a ^ b
            differ = x != 0
            d, v = open_[differ], x[differ]
            # bytes in common before the first that differs
            lead = np.zeros(len(d), np.int64)
            for shift in (32, 16, 8):
                none = (v >> U(64 - shift)) == 0
                lead += np.where(none, shift // 8, 0)
                v = np.where(none, v << U(shift), v)
            common[d] = np.minimum(length, at[d] + lead)
            open_ = open_[~differ]
            at[open_] += 8
            open_ = open_[at[open_] < length]
        branch = np.minimum.reduceat(common, start)
        ended = (branch >= length) | (size == 1)
        inside = ended[node]
        spot = np.repeat(base - start, size) + np.arange(len(order))
        result[spot[inside]] = order[inside]
        equal[spot[inside]] = np.repeat(ended & (size > 1), size)[inside]
        keep = ~inside
        if not keep.any():
            break
        order, node = order[keep], node[keep]
        where = branch[node]
        byte = (chars[pos[order] + where].astype(U) >> U(56)).astype(np.int64)
        live = np.cumsum(~ended) - 1  # nodes that go on, numbered anew
        seg = live[node] * 256 + byte
        moved = np.argsort(seg, kind="stable")
        order, seg, node = order[moved], seg[moved], node[moved]
        cut = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        old = size[~ended]
        begin = np.repeat(np.cumsum(old) - old, old)
        base = (np.repeat(base[~ended], old) + np.arange(len(order)) - begin)[cut]
        known = branch[node[cut]] + 1
        start, size = cut, np.diff(np.append(cut, len(order)))
    return result, equal


def repeated_suffixes(raw: np.ndarray, pos: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """For each suffix whether another of its group starts with the same `length` bytes. group is ascending."""
    chars = characters(raw)
    out = np.zeros(len(pos), bool)
    depth = min(shallow, length - length % 8)
    order, cls, many = multikey_quicksort(chars, pos, group, depth)
    deep = order[many]
    if len(deep):
        sorted_, equal = blind_tries(chars, pos[deep], cls[many], depth, length)
        out[deep[sorted_]] = equal
    return out


# --- packed rows ---------------------------------------------------------------------------------


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _pack_texts(parts: int):
    """(part, keys, sizes, texts) rows: equal texts of a batch once, with their number."""
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[int, int], list] = {}
            for d1, d2, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                row = seen.get((d1, d2))
                if row is None:
                    seen[d1, d2] = [t.as_buffer().to_pybytes() if t.is_valid else b"", 1]
                else:
                    row[1] += 1
            per: dict[int, list] = {}
            for (d1, d2), (t, n) in seen.items():
                per.setdefault(d1 % parts, []).append((d1, d2, t, n))
            for part, rows in sorted(per.items()):
                keys = np.array([r[:2] for r in rows], np.int64).tobytes()
                sizes = np.array([(len(r[2]), r[3]) for r in rows], np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([keys], pa.binary()), pa.array([sizes], pa.binary()), pa.array([_squeeze(b"".join(r[2] for r in rows))], pa.binary())], schema=schema)

    return run


def _unpack_texts(table: pa.Table) -> tuple[list[tuple[int, int]], list[bytes], list[int]]:
    """Keys, texts and numbers of a part's distinct texts, in the order of keys, which every step repeats."""
    found: dict[tuple[int, int], list] = {}
    for keys, sizes, texts in zip(*(table.column(c).to_pylist() for c in ("keys", "sizes", "texts"))):
        data, at = _unsqueeze(texts), 0
        for (d1, d2), (size, n) in zip(np.frombuffer(keys, np.int64).reshape(-1, 2).tolist(), np.frombuffer(sizes, np.int64).reshape(-1, 2).tolist()):
            if (d1, d2) in found:
                found[d1, d2][1] += n
            else:
                found[d1, d2] = [data[at : at + size], n]
            at += size
    order = sorted(found)
    return order, [found[k][0] for k in order], [found[k][1] for k in order]


def _names(parts: int, length: int, k: int):
    """(bucket, part, names, counts) rows of one part's names."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("names", pa.binary()), ("counts", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        _, texts, _ = _unpack_texts(table)
        name = concat_runs(texts, length, k)[4]
        u, counts = np.unique(name, return_counts=True)
        bucket = ((u >> U(32)) * U(parts) >> U(32)).astype(np.int32)  # u ascends, and so do buckets
        counts = np.minimum(counts, 65535).astype(np.uint16)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(u) else np.empty(0, int)
        last = np.append(first[1:], len(u))
        cells = [(int(bucket[a]), part, u[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(first.tolist(), last.tolist())] if len(first) else []
        return pa.Table.from_arrays([pa.array([c[i] for c in cells], schema.field(i).type) for i in range(4)], schema=schema)

    return run


def _repeated_names(hot: int):
    """(part, names, hot) rows: the part's names that occur more than once in the corpus, and which of them are frequent."""
    schema = pa.schema([("part", pa.int32()), ("names", pa.binary()), ("hot", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_pylist()
        names = [np.frombuffer(x, U) for x in table.column("names").to_pylist()]
        counts = [np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()]
        u, back = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        at, cells = 0, []
        for p, x in zip(parts, names):
            n = total[back[at : at + len(x)]]
            at += len(x)
            if (n > 1).any():
                cells.append((p, x[n > 1].tobytes(), x[n >= hot].tobytes()))
        return pa.Table.from_arrays([pa.array([c[i] for c in cells], schema.field(i).type) for i in range(3)], schema=schema)

    return run


def _records(parts: int, length: int, k: int):
    """Rows of a part's runs whose names occur again.

    Runs with one name, content and gram's offset are one entry, with their number, so that a text which
    repeats one string over and over sends it once. Rows for a bucket have, in head, each entry's group,
    content's number, gram's offset, runs and number in the part, and in body the contents, with their
    windows in counts. A row of a bucket below 0, of its own, holds the part's places, as text's place and
    first window in the order of entries, with the runs of each entry in counts.
    """
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("head", pa.binary()), ("counts", pa.binary()), ("body", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cells = []
        if len(left) and len(right):
            part = left.column("part")[0].as_py()
            _, texts, _ = _unpack_texts(left)
            doc, first, count, place, name = concat_runs(texts, length, k)
            known = np.unique(np.concatenate([np.frombuffer(x, U) for x in right.column("names").to_pylist()]))
            hot = np.unique(np.concatenate([np.frombuffer(x, U) for x in right.column("hot").to_pylist()]))
            here = np.isin(name, known)
            doc, first, count, place, name = doc[here], first[here], count[here], place[here], name[here]
            frequent = np.isin(name, hot)
            per: dict[int, list] = {}
            for d, f, c, p, g, h in zip(doc.tolist(), first.tolist(), count.tolist(), place.tolist(), name.tolist(), frequent.tolist()):
                if not h:
                    per.setdefault((g >> 32) * parts >> 32, []).append((g, d, f, c, p - f))
                    continue
                # windows with offsets in a step of STEP share the bytes between them: a group of its own
                end = f + c
                while f < end:
                    o = p - f
                    low = o // STEP * STEP
                    n = min(end - f, o - low + 1)
                    top = min(low + STEP - 1, length - 1)
                    shared = texts[d][p - low : p - top + length]
                    sub = int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=g.to_bytes(8, "big") + bytes([low // STEP])).digest(), "big")
                    per.setdefault((sub >> 32) * parts >> 32, []).append((sub, d, f, n, o))
                    f += n
            kids, docs, firsts, done = [], [], [], 0
            for bucket, rows in sorted(per.items()):
                contents: dict[tuple[int, bytes], int] = {}
                entries: dict[tuple[int, int, int], int] = {}
                for g, d, f, c, o in rows:
                    number = contents.setdefault((c, texts[d][f : f + c + length - 1]), len(contents))
                    kids.append(done + entries.setdefault((g, number, o), len(entries)))
                    docs.append(d)
                    firsts.append(f)
                runs = np.bincount(np.array(kids[len(kids) - len(rows) :]) - done, minlength=len(entries))
                head = np.array([(g - (1 << 64) if g >> 63 else g, n, o) for g, n, o in entries], np.int64)
                rest = np.stack([head[:, 1], head[:, 2], runs, np.arange(done, done + len(entries))], 1).astype(np.int32)
                counts = np.array([c for c, _ in contents], np.int32).tobytes()
                cells.append((bucket, part, _squeeze(head[:, 0].tobytes() + rest.tobytes()), counts, _squeeze(b"".join(x for _, x in contents))))
                done += len(entries)
            order = np.argsort(np.array(kids, np.int64), kind="stable")
            places = np.stack([np.array(docs, np.int32)[order], np.array(firsts, np.int32)[order]]) if kids else np.empty((2, 0), np.int32)
            cells.append((-1 - part, part, b"", np.bincount(kids, minlength=done).astype(np.int32).tobytes() if kids else b"", _squeeze(places.tobytes())))
        return pa.Table.from_arrays([pa.array([c[i] for c in cells], schema.field(i).type) for i in range(5)], schema=schema)

    return run


def _windows(raw, kinds, begin, counts, name, offset, length: int, spans: dict[int, list]) -> None:
    """Sorts the windows of some kinds of runs and adds each kind's repeated windows to spans, as (step, windows)."""
    owner = np.repeat(np.arange(len(kinds)), counts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    pos, o = begin[owner] + step, offset[owner] - step
    rank = np.cumsum(np.concatenate(([0], name[1:] != name[:-1])))[owner]  # kinds come by name
    by = np.argsort(rank * (length + 1) + o, kind="stable")
    key = (rank * (length + 1) + o)[by]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    hit = np.zeros(len(owner), bool)
    hit[by] = repeated_suffixes(raw, pos[by], np.cumsum(fresh), length)
    new = np.concatenate(([True], owner[1:] != owner[:-1]))
    lo = np.flatnonzero(hit & (new | np.concatenate(([True], ~hit[:-1]))))
    hi = np.flatnonzero(hit & np.concatenate((new[1:] | ~hit[1:], [True])))
    for a, b in zip(lo.tolist(), hi.tolist()):
        spans.setdefault(int(kinds[owner[a]]), []).append((int(step[a]), b - a + 1))


def _solve(length: int):
    """(part, spans, counts, body) rows: of a bucket repeated windows, as (entry's number, first from its runs' begin, windows); a part's places as they are."""
    schema = pa.schema([("part", pa.int32()), ("spans", pa.binary()), ("counts", pa.binary()), ("body", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return pa.Table.from_arrays([table.column("part"), pa.nulls(len(table), pa.binary()), table.column("counts"), table.column("body")], schema=schema)
        source, group, content, offset, runs, number = [], [], [], [], [], []
        raw, begin, counts = bytearray(), [], []  # distinct contents end to end
        seen: dict[bytes, int] = {}
        for row in range(len(table)):
            head, count, body = (table.column(c)[row].as_py() for c in ("head", "counts", "body"))
            head, body = _unsqueeze(head), memoryview(_unsqueeze(body))
            n, at, mine = len(head) // 24, 0, []
            for c in np.frombuffer(count, np.int32).tolist():
                part = body[at : at + c + length - 1]
                at += len(part)
                mark = hashlib.blake2b(part, digest_size=20).digest()
                if mark not in seen:
                    seen[mark] = len(begin)
                    begin.append(len(raw))
                    counts.append(c)
                    raw += part
                mine.append(seen[mark])
            rest = np.frombuffer(head, np.int32, 4 * n, 8 * n).reshape(n, 4).astype(np.int64)
            source.append(np.full(n, row))
            group.append(np.frombuffer(head, np.int64, n))
            content.append(np.array(mine, np.int64)[rest[:, 0]])
            offset.append(rest[:, 1])
            runs.append(rest[:, 2])
            number.append(rest[:, 3])
        del seen
        source, group, content, offset, runs, number = (np.concatenate(x) for x in (source, group, content, offset, runs, number))
        raw += bytes(16)
        raw, begin, counts = np.frombuffer(raw, np.uint8), np.array(begin, np.int64), np.array(counts, np.int64)
        pair = np.lexsort((offset, content, group))
        g, c, o = group[pair], content[pair], offset[pair]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (o[1:] != o[:-1])))
        kind = np.cumsum(new) - 1  # runs of one name, offset and content
        times = np.bincount(kind, runs[pair])
        at = np.flatnonzero(new)
        kg, kc, ko = g[at], c[at], o[at]
        members = np.bincount(np.cumsum(np.concatenate(([True], kg[1:] != kg[:-1]))) - 1)
        several = np.repeat(members > 1, members)
        # windows of names with different runs, some names at a time so that memory is bounded
        several = np.flatnonzero(several)
        spans: dict[int, list] = {}
        load = np.cumsum(counts[kc[several]])
        cut = np.flatnonzero(np.concatenate(([True], kg[several][1:] != kg[several][:-1]))) if len(several) else np.empty(0, int)
        at = 0
        while at < len(cut):
            done = load[cut[at] - 1] if cut[at] else 0
            upto = max(at + 1, int(np.searchsorted(load[cut - 1] * (cut > 0), done + WINDOWS, "right")) - 1)
            some = several[cut[at] : cut[upto] if upto < len(cut) else len(several)]
            _windows(raw, some, begin[kc[some]], counts[kc[some]], kg[some], ko[some], length, spans)
            at = upto
        parts_of: dict[int, list] = {}
        parts = table.column("part").to_pylist()
        whole = times > 1
        for i, k in zip(pair.tolist(), kind.tolist()):
            found = [(0, int(counts[kc[k]]))] if whole[k] else spans.get(k, ())
            for s, w in found:
                parts_of.setdefault(parts[source[i]], []).append((number[i], s, w))
        cells = [(p, np.array(v, np.int32).tobytes(), None, None) for p, v in sorted(parts_of.items())]
        return pa.Table.from_arrays([pa.array([x[i] for x in cells], schema.field(i).type) for i in range(4)], schema=schema)

    return run


RESULT = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def _finish(length: int):
    """Per distinct text: bytes removed, maximal removed spans (flat begin, end pairs), digest of what is left."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts, numbers = _unpack_texts(left)
        found = np.empty((0, 3), np.int64)
        if len(right):
            rows = [np.frombuffer(x, np.int32).reshape(-1, 3).astype(np.int64) for x in right.column("spans").to_pylist() if x]
            kept = [(np.frombuffer(c, np.int32).astype(np.int64), np.frombuffer(_unsqueeze(x), np.int32).reshape(2, -1).astype(np.int64)) for c, x in zip(right.column("counts").to_pylist(), right.column("body").to_pylist()) if x]
            if rows and kept:  # a part has one row of places
                (runs, (doc, first)), spans = kept[0], np.concatenate(rows)
                n, begin = runs[spans[:, 0]], (np.cumsum(runs) - runs)[spans[:, 0]]
                at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                spans = np.repeat(spans, n, axis=0)
                found = np.stack([doc[at], first[at] + spans[:, 1], spans[:, 2]], 1)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        at = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
        out = []
        for i, (key, t, n) in enumerate(zip(keys, texts, numbers)):
            if n > 1 and len(t) >= length:
                cover = [(0, len(t))]
            else:
                cover = []
                for _, f, w in found[at[i] : at[i + 1]].tolist():
                    a, b = f, f + w - 1 + length
                    if cover and a <= cover[-1][1]:
                        cover[-1] = (cover[-1][0], max(b, cover[-1][1]))
                    else:
                        cover.append((a, b))
            h, end = hashlib.sha256(), 0
            for a, b in cover:
                h.update(t[end:a])
                end = b
            h.update(t[end:])
            out.append((*key, sum(b - a for a, b in cover), len(cover), h.hexdigest(), [x for s in cover for x in s]))
        return pa.Table.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(RESULT)], schema=RESULT)

    return run


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 200, hot: int = HOT) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and spans (begin and end of each removed run, flat) for each row."""
    if length < 8:
        raise ValueError("length must be at least 8 bytes")
    spark, k = docs.sparkSession, min(GRAM, length)
    parts = parts_for(measured_bytes(docs, text), spark, 4 << 20)
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    d1, d2 = F.xxhash64(raw), F.xxhash64(F.lit("second"), raw)
    packed = docs.select(d1, d2, raw).mapInArrow(_pack_texts(parts), "part int, keys binary, sizes binary, texts binary")
    by_part = packed.groupBy("part")
    names = by_part.applyInArrow(_names(parts, length, k), "bucket int, part int, names binary, counts binary")
    again = names.groupBy("bucket").applyInArrow(_repeated_names(hot), "part int, names binary, hot binary")
    records = by_part.cogroup(again.groupBy("part")).applyInArrow(_records(parts, length, k), "bucket int, part int, head binary, counts binary, body binary")
    # packed rows look small: without a number of its own, this step would get few tasks
    solved = records.repartition(tasks_for(parts, spark), "bucket").groupBy("bucket")
    found = solved.applyInArrow(_solve(length), "part int, spans binary, counts binary, body binary")
    result = by_part.cogroup(found.groupBy("part")).applyInArrow(_finish(length), "d1 long, d2 long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    rows = docs.select(F.col(f"`{key}`"), F.octet_length(raw).cast("long").alias("n_bytes"), d1.alias("_d1"), d2.alias("_d2"))
    return rows.join(result, (F.col("_d1") == F.col("d1")) & (F.col("_d2") == F.col("d2")), "left").select(key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
