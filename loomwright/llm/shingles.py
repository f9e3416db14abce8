"""Word shingles of many texts at once, over bytes in numpy.

Words are runs of bytes other than U+0020 and U+0009 to U+000D, with A to Z lower-cased. A word's
hash chains its eight-byte characters, each step a bijection of the 64-bit state that mixes every
bit; words over LONG bytes go to xxHash. A shingle's hash chains the hashes of its words. A second
lane is the same with constants of its own, so that what agrees in both agrees in 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Odd multipliers of the lanes.
LANES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes of a word from which on it is hashed by one call.
LONG = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Masks that keep the first bytes of a little-endian character.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offsets of each; null texts are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes of text together, or of one row."""
    raw, at = buffers(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, min(b, len(column))
        a = b


def word_hashes(raw: np.ndarray, at: np.ndarray, lanes: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """Hash of every word in each lane, and for each text the place of its first word (one more at the end)."""
    n = len(raw)
    if not n:
        return [np.empty(0, U)] * lanes, np.zeros(len(at), np.int64)
    word = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    low = np.zeros(n + 8, np.uint8)
    low[:n] = _LOWER[raw]
    chars = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=low, strides=(1,))
    length = e - s
    out = [mix(length.astype(U) * U(LANES[j]) + U(j + 1)) for j in range(lanes)]
    live = np.flatnonzero(length <= LONG)
    pos, left = s[live], length[live]
    while len(live):
        c = chars[pos] & _FIRST[np.minimum(left, 8)]
        for j in range(lanes):
            out[j][live] = mix((out[j][live] ^ c) * U(LANES[j]))
        on = left > 8
        live, pos, left = live[on], pos[on] + 8, left[on] - 8
    for i in np.flatnonzero(length > LONG).tolist():
        text = low[s[i] : e[i]].tobytes()
        for j in range(lanes):
            out[j][i] = xxhash.xxh3_64_intdigest(text, seed=LANES[j])
    return out, np.searchsorted(s, at)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x


def shingle_sets(column: pa.Array, k: int = 3, lanes: int = 1) -> Iterator:
    """For each text its distinct shingle hashes, sorted; a tuple of such, if more than one lane is asked for.

    Fewer words than k make one shingle of all.
    """
    raw, at = buffers(column)
    words, first = word_hashes(raw, at, lanes)
    chains = []
    for j, h in enumerate(words):
        chain = h.copy()
        for i in range(1, k):
            if len(h) > i:
                chain = mix(chain[: len(h) - i] * U(LANES[j]) + h[i:])
        chains.append(chain)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        sets = []
        for j in range(lanes):
            if b - a >= k:
                sets.append(_distinct(chains[j][a : b - k + 1]))
            elif b > a:
                x = np.array([b - a], U)
                for i in range(a, b):
                    x = mix(x * U(LANES[j]) + words[j][i : i + 1])
                sets.append(x)
            else:
                sets.append(np.empty(0, U))
        yield sets[0] if lanes == 1 else tuple(sets)


def set_digest(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set of hashes."""
    x = np.array([mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)], U) + np.array([len(s)], U) * U(LANES[0])
    return int(mix(x).view(np.int64)[0])
