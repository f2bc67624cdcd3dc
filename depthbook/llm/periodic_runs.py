"""Runs of repeated word sequences in whole texts, by names of power-of-two substrings.

Karp-Miller-Rosenberg naming: level 0 names the words of a text, level k + 1 names pairs
of level-k names 2^k words apart, so two places have the same name at level k exactly when
the 2^k words from there are the same. Places whose name occurs once in their text can
have no equal at a higher level; they leave the naming, which ends when none is left.

A run of period q and at least 4 q words holds, at the first multiple i of q inside it,
2 q words that are repeated q words on. So for every q only the multiples of q are looked
at, and only those go on where the largest name of at most 2 q words is equal at i and
i + q. From there the run is extended in both directions: the longest common extension is
found by descending through the levels. No fingerprints are compared and no suffixes
sorted. What lies inside a run of a smaller period is that run again and is not extended;
runs of one stretch that differ in period keep the smallest.

All texts of a bounded batch are named in one NumPy pass; names are of one text each, so
nothing reaches across a border.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textops import bounded

#: A run's least length in periods, and in words.
LEAST_PERIODS, LEAST_WORDS = 4, 6

OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def names(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Names of every level: equal at two places of a text where 2^k words are the same.

    `words` are word numbers of texts one after the other, `first` their n + 1 borders. A
    place whose words occur once in its text has a negative name that no other place has.
    The last level has no name twice.
    """
    n = len(words)
    alone = -1 - np.arange(n, dtype=np.int32)
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, key = np.arange(n), own * (int(words.max(initial=0)) + 1) + words
    levels, step = [], 1
    while True:
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[name] > 1
        at, name = at[again], name[again].astype(np.int32)
        level = alone.copy()
        level[at] = name
        levels.append(level)
        if not len(at):
            return levels
        inside = at < n - step
        at, name = at[inside], name[inside]
        other = level[at + step]
        at, name, other = at[other >= 0], name[other >= 0], other[other >= 0]
        key = name.astype(np.int64) * n + other
        step *= 2


def _ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i and from j on are the same."""
    n, i, j = len(levels[0]), i.copy(), j.copy()
    began = j.copy()
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(j < n)
        same = same[levels[k][i[same]] == levels[k][j[same]]]
        i[same] += 1 << k
        j[same] += 1 << k
    return j - began


def _behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i and before j are the same."""
    i, j = i.copy(), j.copy()
    began = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(i >= 1 << k)
        same = same[levels[k][i[same] - (1 << k)] == levels[k][j[same] - (1 << k)]]
        i[same] -= 1 << k
        j[same] -= 1 << k
    return began - i


def runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start and then period, of all runs of the texts;
    starts count over all texts."""
    none = np.zeros((0, 3), np.int64)
    if not len(words):
        return none
    n, levels, size, found = len(words), names(words, first), np.diff(first), [none]
    reach = np.zeros(n, np.int64)  # the furthest end of a found run that holds the place
    for level in range(1, len(levels)):
        lo, hi = 1 << (level - 1), 1 << level  # periods lo to hi - 1 look at names of 2 lo words
        active = (levels[level] >= 0) & (reach < np.arange(n) + 2 * (hi - 1))
        per = np.add.reduceat(np.append(active, False), first[:-1], dtype=np.int64)
        texts = np.flatnonzero((size >= LEAST_PERIODS * lo) & (per > 0))
        if not len(texts):
            continue
        # the texts that have such a name twice, one after the other, and where their words are
        at = np.concatenate([np.arange(first[t], first[t + 1]) for t in texts])
        name = levels[level][at]
        for q in range(lo, min(hi, int(size[texts].max()) // LEAST_PERIODS + 1)):
            i = at[np.flatnonzero(name[:-q:q] == name[q::q]) * q]
            # two periods of q inside a run of a smaller one belong to that run
            i = i[reach[i] < i + 2 * q] if len(i) else i
            if not len(i):
                continue
            ahead, behind = _ahead(levels, i, i + q), _behind(levels, i, i + q)
            run = np.unique((i - behind) * (n + 1) + behind + q + ahead)
            start, length = run // (n + 1), run % (n + 1)
            long = length >= max(LEAST_WORDS, LEAST_PERIODS * q)
            found.append(np.column_stack([start, length, np.full(len(run), q)])[long])
            for s, e in zip(start[long], start[long] + length[long]):
                np.maximum(reach[s:e], e, out=reach[s:e])
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    smallest = np.ones(len(every), bool)
    smallest[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[smallest]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def most_repeated(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length / period; ties to the smallest start, then period."""
    if not len(found):
        return None
    share = found[:, 1] / found[:, 2]
    near = found[share >= share.max() * (1 - 1e-12)]  # division rounds; the rest is exact
    return tuple(map(int, max(near, key=lambda r: (Fraction(int(r[1]), int(r[2])), -r[0], -r[2]))))


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of every tenth document (by crc32 of its id) the word order with a planted run."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a, at = g % n, np.arange(n)
    at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return at


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Runs of every whole text: their number, the most repeated one, and hashes of all
    runs and of the text with each run cut to its first period.

    Words are what stands between ASCII white space; null, empty and blank texts have none
    and so no run (four nulls, hashes of nothing). `order` may give the order in which a
    document's words are taken (None: as they stand). Every row is answered by itself, so
    ids may repeat or be null (a null id is passed to `order` as None); other columns are
    not looked at; an empty table gives an empty result. A very long text is a batch of
    its own and costs memory in proportion to its words and the levels it needs.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            ids, vocabulary = b.column(0).to_pylist(), {}
            texts, numbers = [], []
            for doc_id, text in zip(ids, b.column(1).to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                at = order(doc_id, len(words)) if order else None
                if at is not None:
                    words = [words[i] for i in at]
                texts.append(words)
                numbers.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)))
            first = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
            found = runs(np.concatenate([np.zeros(0, np.int64), *numbers]), first)
            cut, rows = np.searchsorted(found[:, 0], first), []
            for k, words in enumerate(texts):
                own = found[cut[k] : cut[k + 1]] - [first[k], 0, 0]
                best = most_repeated(own)
                listed = "".join("%d,%d,%d\n" % (s, n, q) for s, n, q in own.tolist())
                if best is not None:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), own))]
                hashes = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
                rows.append((ids[k], len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *hashes))
            types = [*[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in OUT.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, OUT)
