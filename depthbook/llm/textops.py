"""Vectorised word hashing on Arrow string buffers, shared by the text operators.

Everything here works on one Arrow batch at a time: the batch's UTF-8 bytes are looked
at as one numpy array, so a very long text costs memory in proportion to itself and an
empty or null text is simply a text without words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its texts in them (null: empty)."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII white space separates words: \x20 and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and its inverse (mod 2^64) for i < n; kept for the task's next batch."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 18)
        for name, base in (("up", int(_R)), ("down", pow(int(_R), -1, 1 << 64))):
            x = np.ones(size, np.uint64)
            if size > 1:
                x[1:] = np.uint64(base)
                with np.errstate(over="ignore"):
                    np.multiply.accumulate(x, out=x)
            _POWERS[name] = x
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
    """Starts and ends (byte places) of all words, A-Z lowered, and each text's first word.

    A word never crosses a text's border. Returns (starts, ends, first) where first has
    n + 1 entries: text i owns words first[i]:first[i + 1].
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's lowered bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts], 1)


def bounded(batches, at: int, most: int = 1 << 20, rows: int = 1000):
    """Batches cut so that column `at` has about `most` bytes of text and at most `rows`
    texts in each (at least one text each): what is made of a batch is bounded too."""
    for b in batches:
        _, offsets = utf8(b.column(at))
        i, n = 0, len(offsets) - 1
        while i < n:
            j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1), i + rows, n)
            yield b.slice(i, j - i)
            i = j


def slices(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 18):
    """Cut a batch into runs of texts of about `most` bytes (at least one text each)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingle_sets(column: pa.Array, width: int = 5):
    """Yield each text's sorted distinct 64-bit shingle hashes, in the column's order.

    A shingle is `width` consecutive words; a text with fewer words has its whole word
    sequence as its only shingle; a text without words has none.
    """
    data, offsets = utf8(column)
    for i, j, d, o in slices(data, offsets):
        starts, ends, first = words(d, o)
        h = word_hashes(d, starts, ends)
        with np.errstate(over="ignore"):
            if len(h) >= width:
                n = len(h) - width + 1
                s = np.zeros(n, np.uint64)
                for k in range(width):
                    s += mix(h[k : k + n], 2 + k)
                s = mix(s, 9)
            for a, b in zip(first[:-1], first[1:]):
                if b - a >= width:
                    yield np.unique(s[a : b - width + 1])
                elif b > a:
                    x = np.uint64(b - a)
                    for k in range(b - a):
                        x = x + mix(h[a + k : a + k + 1], 2 + k)[0]
                    yield mix(np.array([x]), 10)
                else:
                    yield np.zeros(0, np.uint64)


def matrix(column: pa.ChunkedArray, rows: np.ndarray, kind: type, width: int) -> np.ndarray:
    """The given rows of a column of byte strings as one array; nothing else is copied."""
    out, order, done = np.empty((len(rows), width), kind), np.argsort(rows), 0
    for chunk in column.chunks:
        inside = np.searchsorted(rows, [done, done + len(chunk)], sorter=order)
        for k in order[slice(*inside)]:
            out[k] = np.frombuffer(chunk[int(rows[k]) - done].as_buffer(), kind)
        done += len(chunk)
    return out
