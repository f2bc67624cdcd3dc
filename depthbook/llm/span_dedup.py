"""Removal of repeated sentence spans across a whole corpus.

A text is cut into sentences: at . ! ? before white space and at line ends. A sentence
of ten words or more is cut further where its own words say so (winnowing: before the word
triple of smallest hash in each window of 8), so equal words are cut alike at any offset
and in sentences of any length. From every cut the shortest run forward, and the shortest run backward, that has at least
`least` pieces and `least_words` words is hashed (words compared without the case of
A-Z). With the default parameters any 51 words inside a long sentence hold a run wherever
they stand; of whole sentences, those that make up a run are needed. Runs meet globally
by hash; of equal runs the first by (doc_id, place) stays, and the words that another one
covers go, which may be a part of a long sentence.

These two kinds of runs find all that every run of at least `least` pieces and
`least_words` words would. Take a repeated run R from piece a, and a piece i of it. The
shortest run forward from a lies in R. If it does not reach i, then the pieces from a to i
are enough for a run, so the shortest run backward from i lies in R too. Either of them is
repeated where R is, and not the first of its kind where R is not; it covers i. Runs that
are longer thus add no word that goes, and only the shortest travel. (Both places of R must
be cut alike inside. Whole sentences are; a window that reaches over the border of R into
another context may cut a long sentence otherwise within ten words of that border.)

What travels is (hash, doc_id), never places or texts: a text whose runs are repeated is
told their hashes and finds their places itself. A hash has 96 bits, so that of 10^12 runs
no two unlike ones are expected to meet.

For the counts n_sentences and n_removed (sentences that lost words) a sentence of over
24 words counts as sentences of 12 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches
from .textops import mix, slices, utf8, word_hashes, words

LONG, CUT = 24, 12
#: Word triples in a window of which the smallest is a cut; words of a triple.
WINDOW, GRAM = 8, 3
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_R = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _sentences(d: np.ndarray, o: np.ndarray):
    """Words, their texts, and the first word and the words of every sentence of a slice
    of texts."""
    starts, ends, first = words(d, o)
    n = len(starts)
    if not n:
        return starts, ends, first, np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = np.concatenate([[0], np.cumsum(d == 10)])
    new = np.ones(n, bool)
    new[1:] = _STOP[d[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    new[first[:-1][first[:-1] < n]] = True
    at = np.flatnonzero(new)
    return starts, ends, first, at, np.diff(np.append(at, n))


def _units(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first word of every sentence as they are counted."""
    inside = np.arange(size.sum()) - np.repeat(at, size)
    return np.flatnonzero((inside == 0) | (np.repeat(size, size) > LONG) & (inside % CUT == 0))


def _cuts(h: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first word of every piece: sentences, and cuts by the hashes of the words of
    those that hold a window. One word over and over is cut every 12 words."""
    n = len(h)
    if n < WINDOW + GRAM - 1:
        return at
    with np.errstate(over="ignore"):
        g = np.zeros(n, np.uint64)
        for k in range(GRAM):
            g[: n - k] += mix(h[k:], 40 + k)
        g = mix(g, 44)
    inside = np.arange(n) - np.repeat(at, size)
    whole = np.repeat(size, size)
    # windows whose words lie inside one sentence
    q = np.flatnonzero(inside + WINDOW + GRAM - 1 <= whole)
    if not len(q):
        return at
    p = np.unique(q + np.lib.stride_tricks.sliding_window_view(g, WINDOW)[q].argmin(1))
    p = p[inside[p] > 0]
    same = g[p] == g[p - 1]
    new = np.zeros(n, bool)
    new[at] = new[p[~same]] = True
    sure = np.flatnonzero(new)
    last = -CUT
    for w, s in zip(p[same].tolist(), sure[np.searchsorted(sure, p[same], "right") - 1].tolist()):
        if w - max(last, s) >= CUT:
            new[w], last = True, w
    return np.flatnonzero(new)


def _runs(d: np.ndarray, o: np.ndarray, least: int, least_words: int):
    """(text, first word, last word, hash, check) of every run of a slice of texts, in the
    order of text and place; words count from 0 in each text."""
    starts, ends, first, at, size = _sentences(d, o)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.int32)
    hashes = word_hashes(d, starts, ends)
    unit = _cuts(hashes, at, size)
    n, u = len(starts), len(unit)
    text = np.searchsorted(first, unit, "right") - 1
    begin = np.searchsorted(unit, first)  # each text's first piece
    edge = np.append(unit, n)
    fwd_last = np.maximum(np.arange(u) + least - 1, np.searchsorted(edge, unit + least_words) - 1)
    bwd_first = np.minimum(np.arange(u) - least + 1, np.searchsorted(edge, edge[1:] - least_words, "right") - 1)
    a = np.concatenate([np.arange(u), bwd_first])
    z = np.concatenate([fwd_last, np.arange(u)])
    t = np.concatenate([text, text])
    ok = (a >= begin[t]) & (z < begin[t + 1])
    a, z, t = a[ok], z[ok], t[ok]
    key = np.unique(a * np.int64(u + 1) + z)
    a, z = key // (u + 1), key % (u + 1)
    t = text[a]
    with np.errstate(over="ignore"):
        up, down = np.full(n, _R), np.full(n, _INV)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up)])
        lo, hi = edge[a], edge[z + 1]
        both = (total[hi] - total[lo]) * down[lo]
        h = mix(both + (hi - lo).astype(np.uint64), 30)
        # of other hashes of the same words, so that no collision of the first is one of both
        other = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes, 31) * down)])
        check = mix((other[hi] - other[lo]) * up[lo], 32) >> np.uint64(32)
    return t, lo - first[t], hi - 1 - first[t], h.view(np.int64), check.astype(np.uint32).view(np.int32)


def spans(docs: DataFrame, least: int = 3, least_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, check, many) of every run of every document: one row for equal runs
    of one text; many says that there are several of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            data, offsets = utf8(b.column(1))
            for i, j, d, o in slices(data, offsets):
                t, _, _, h, c = _runs(d, o, least, least_words)
                order = np.lexsort((c, h, t))
                t, h, c = t[order], h[order], c[order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                at = np.flatnonzero(new)
                many = np.diff(np.append(at, len(t))) > 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][t[at]]), pa.array(h[at]), pa.array(c[at]), pa.array(many)], ["doc_id", "hash", "check", "many"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, hash long, check int, many boolean")


def _hidden(h: np.ndarray, c: np.ndarray, given: list) -> np.ndarray:
    """Which of a text's runs go, given (hash, check, first stays) of the repeated ones."""
    known = {(g["hash"], g["check"]): g["first"] for g in given}
    met, gone = set(), np.zeros(len(h), bool)
    for k, key in enumerate(zip(h.tolist(), c.tolist())):
        stays = known.get(key)
        if stays is not None:
            gone[k] = not stays or key in met
            met.add(key)
    return gone


def _cut(at: int, hashes_at: int, least: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            data, offsets = utf8(column)
            text, total, gone = [], [], []
            for i, j, d, o in slices(data, offsets):
                starts, _, first, sentence, size = _sentences(d, o)
                unit = _units(sentence, size)
                begin = np.searchsorted(unit, first)
                for k in range(j - i):
                    own = unit[begin[k] : begin[k + 1]] - first[k]
                    total.append(len(own))
                    given = b.column(hashes_at)[i + k].as_py()
                    keep = np.ones(first[k + 1] - first[k], bool)
                    if given:
                        alone = d[o[k] : o[k + 1]]
                        _, a, z, h, c = _runs(alone, np.array([0, len(alone)]), least, least_words)
                        hide = _hidden(h, c, given)
                        for x, y in zip(a[hide], z[hide]):
                            keep[x : y + 1] = False
                    if keep.all():
                        text.append(column[i + k].as_py())
                        gone.append(0)
                        continue
                    edge = np.append(starts[first[k] : first[k + 1]], o[k + 1])
                    edge[0] = o[k]
                    raw = d[o[k] : o[k + 1]].tobytes()
                    flips = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]])))
                    text.append(b"".join(raw[edge[s] - o[k] : edge[e] - o[k]] for s, e in zip(flips[::2], flips[1::2])).decode("utf-8", "replace").strip())
                    gone.append(int(np.logical_or.reduceat(~keep, own).sum()))
            cols = [c for n, c in enumerate(b.columns) if n != hashes_at]
            cols[at] = pa.array(text, pa.string())
            names = [c for n, c in enumerate(b.schema.names) if n != hashes_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int32()), pa.array(gone, pa.int32())], [*names, "n_sentences", "n_removed"])

    return run


def dedup_spans(docs: DataFrame, least: int = 3, least_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with repeated runs cut from the texts, and (n_sentences, n_removed).

    Texts without a repeated run pass unchanged, null, empty and short ones among them;
    so do rows whose id is null. Equal texts are repeats of the one with the smallest
    id, whose own text stays; rows that repeat an id count as one document, and each of
    them keeps the first place of what only they share. A very long text is one slice of
    its own. An empty table stays empty; columns named n_sentences or n_removed are
    replaced, and any other name may stand beside them. The joins are the same at every size.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop("n_sentences", "n_removed")
    found = spans(rest, least, least_words, id_col, text_col)
    groups = found.groupBy("hash", "check").agg(F.min("doc_id").alias("of"), F.max("doc_id").alias("upto"), F.max("many").alias("some_many"))
    repeated = settle(groups.where("of < upto or some_many").select("hash", "check", "of"), "spans")
    hits = found.join(repeated, ["hash", "check"]).where("doc_id <> of or many").select("doc_id", F.struct("hash", "check", (F.col("doc_id") == F.col("of")).alias("first")).alias("run"))
    key, runs = (next(n for n in (f"{p}{'_' * k}" for k in range(len(rest.columns) + 1)) if n not in rest.columns) for p in ("cut_of", "cut_runs"))
    cuts = hits.distinct().groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("run").alias(runs))
    joined = rest.join(cuts, F.col(id_col).cast("long") == F.col(key), "left").drop(key)
    kinds = ", ".join(f"`{n}` {t}" for n, t in rest.dtypes)
    return joined.mapInArrow(_cut(rest.columns.index(text_col), len(rest.columns), least, least_words), f"{kinds}, n_sentences int, n_removed int")
