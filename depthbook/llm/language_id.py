"""Hierarchical language identification.

A text's hashed byte n-grams (one to three bytes of its letters, words joined by single
spaces) give a linear profile. A family classifier (one linear support vector machine a
family) decides first; within the family one-versus-one machines separate the closely
related languages by votes, ties by margin. Families are a parameter; a learned language
that is in none is a family of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, held_out, settle, small_batches
from .textops import bounded, matrix, mix, slices, utf8

BUCKETS = 1 << 12
#: Training rows of each language, drawn by a hash of the text; a documented bound.
ROWS_A_LANGUAGE = 600
#: Rows of all languages together, which the driver holds as profiles of 8 KB at most; where
#: there are many languages each gets its share, two rows at least.
ALL_ROWS = 24_000
FAMILIES = {"germanic": ("de", "en", "nl", "sv", "da", "no"), "romance": ("es", "fr", "it", "pt", "ro", "ca")}

# ASCII letters lowered, bytes of longer characters kept, the rest one space
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


#: Bytes of texts that are looked at together; a longer text is counted block by block.
BLOCK = 1 << 18
#: Training rows that a gradient step looks at together.
ROWS = 128


def _squeezed(x: np.ndarray) -> np.ndarray:
    """Which bytes stay when runs of spaces become one."""
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    return keep


def _buckets(x: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte."""
    u = x.astype(np.uint64)
    code = u[: max(0, len(u) - n + 1)].copy()
    for k in range(1, n):
        code = code * np.uint64(257) + u[k : len(code) + k]
    return (mix(code, n) % np.uint64(BUCKETS)).astype(np.int32)


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Buckets of all n-grams of a slice of texts and each text's border in them."""
    x = _FOLD[data]
    keep = _squeezed(x)
    x = x[keep]
    border = np.concatenate([[0], np.cumsum(keep)])[offsets]
    # a space between texts keeps n-grams from crossing
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(border))
    out, own = [], []
    for n in (1, 2, 3):
        if len(x) < n:
            break
        first = owner[: len(x) - n + 1]
        same = first == owner[n - 1 :]
        out.append(_buckets(x, n)[same])
        own.append(first[same].astype(np.int32))
    return (np.concatenate(out), np.concatenate(own)) if out else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def _long(data: np.ndarray, block: int) -> np.ndarray:
    """Counts of one text's n-grams by blocks; a block begins with the two bytes before it."""
    total, before = np.zeros(BUCKETS, np.int64), np.zeros(0, np.uint8)
    for i in range(0, len(data), block):
        x = np.append(before, _FOLD[data[i : i + block]])
        x = x[_squeezed(x)]
        for n in (1, 2, 3):
            new = _buckets(x, n)[max(0, len(before) - n + 1) :]
            total += np.bincount(new, minlength=BUCKETS)
        before = x[-2:]
    return total


def profiles(column: pa.Array, block: int = BLOCK) -> np.ndarray:
    """Square-root-damped, length-one n-gram profiles of a small column."""
    data, offsets = utf8(column)
    rows = []
    for i, j, d, o in slices(data, offsets, block):
        if len(d) > block:  # one text
            x = _long(d, block)[None, :].astype(np.float32)
        else:
            g, own = _grams(d, o)
            x = np.bincount(own * np.int64(BUCKETS) + g, minlength=(j - i) * BUCKETS).reshape(j - i, BUCKETS).astype(np.float32)
        rows.append(_damped(x))
    return np.concatenate(rows) if rows else np.zeros((0, BUCKETS), np.float32)


def _damped(x: np.ndarray) -> np.ndarray:
    x = np.sqrt(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60, rows: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Squared-hinge linear support vector machine by accelerated gradient steps, on `rows`
    of x (all by default). Steps are in double precision and pass over x by blocks, so
    neither a copy of the rows nor one of wider numbers is made."""
    rows = np.arange(len(x)) if rows is None else rows
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1] + 1)
    z, t, step = w.copy(), 1.0, 1.0 / (2 * c * 2 + 1)
    for _ in range(rounds):
        grad = z / 10
        for i in range(0, len(rows), ROWS):
            b, s = x[rows[i : i + ROWS]].astype(float), slice(i, i + ROWS)
            slack = np.maximum(0, 1 - y[s] * (b @ z[:-1] + z[-1])) * weight[s] * y[s]
            grad[:-1] -= 2 * c * (slack @ b)
            grad[-1] -= 2 * c * slack.sum()
        new = z - step * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1].astype(np.float32), float(w[-1])


@dataclass
class LanguageModel:
    """All machines as columns of one weight matrix; at most a few hundred kB a language."""

    languages: list[str]
    families: list[list[int]]
    weights: np.ndarray
    bias: np.ndarray
    pairs: list[tuple[int, int]]

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score from 0 to 1, from all machines' margins."""
        n, nf = len(margins), len(self.families)
        family = margins[:, :nf].argmax(1) if nf else np.zeros(n, int)
        top = np.sort(margins[:, :nf], 1)
        sure = _logistic(2 * (top[:, -1] - top[:, -2])) if nf > 1 else np.ones(n)
        best, score = np.zeros(n, int), np.zeros(n)
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes = np.zeros((len(rows), len(self.languages)))
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    p = _logistic(2 * margins[rows, nf + k])
                    votes[:, a] += (p >= 0.5) + 1e-3 * p
                    votes[:, b] += (p < 0.5) + 1e-3 * (1 - p)
            out = [m for m in range(len(self.languages)) if m not in members]
            votes[:, out] = -1
            best[rows] = votes.argmax(1)
            inner = np.ones(len(rows))
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    p = _logistic(2 * margins[rows, nf + k])
                    inner = np.where(best[rows] == a, np.minimum(inner, p), np.where(best[rows] == b, np.minimum(inner, 1 - p), inner))
            score[rows] = sure[rows] * inner
        return best, np.clip(score, 0, 1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", families: dict[str, tuple[str, ...]] | None = None, rows_a_language: int = ROWS_A_LANGUAGE, all_rows: int = ALL_ROWS) -> LanguageModel:
    """Fit on at most `rows_a_language` texts of each language and about `all_rows` of all,
    those of smallest hash.

    Profiles are made by the executors; only they reach the driver, which holds them and
    the machines of every language that occurs. A text that several rows of a language
    repeat counts once. With no labelled row the model knows no language.
    """
    small_batches(docs.sparkSession)
    families = FAMILIES if families is None else families
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"))
    counts = settle(known.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    few = languages <= BROADCAST_ROWS
    rows_a_language = min(rows_a_language, max(2, all_rows // max(1, languages)))
    # a share of each language's distinct texts by their hash, at most the bound by
    # expectation, then the bound itself
    hashed = known.join(F.broadcast(counts) if few else counts, "lang")
    drawn = hashed.where(F.expr(f"pmod(h, 1000003) < 1000003 * {max(1.3 * rows_a_language, rows_a_language + 12)} / n")).dropDuplicates(["lang", "h"])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1, 1 << 18, 128):
            x = profiles(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "h", "x"])

    got = drawn.select("lang", "text", "h").mapInArrow(profile, "lang string, h long, x binary").toArrow()
    order = got.select(["lang", "h"]).to_pandas().sort_values(["h", "lang"])
    order = order.groupby("lang", sort=True).head(rows_a_language)
    names = sorted(order["lang"].unique())
    x = matrix(got.column("x"), order.index.to_numpy(), np.float16, BUCKETS)
    del got
    y = np.array([names.index(s) for s in order["lang"]], int)
    of = {s: next((f for f, m in families.items() if s in m), f"only {s}") for s in names}
    groups = [[names.index(s) for s in names if of[s] == f] for f in sorted(set(of.values()))]
    fits = [linear_svm(x, np.where(np.isin(y, g), 1, -1).astype(np.float32)) for g in groups] if len(groups) > 1 else [(np.zeros(BUCKETS, np.float32), 0.0)] * len(groups)
    pairs = [p for g in groups for p in combinations(g, 2)]
    for a, b in pairs:
        rows = np.flatnonzero((y == a) | (y == b))
        fits.append(linear_svm(x, np.where(y[rows] == a, 1, -1).astype(np.float32), rows=rows))
    weights = np.stack([w for w, _ in fits], 1).astype(np.float32) if fits else np.zeros((BUCKETS, 0), np.float32)
    return LanguageModel(names, groups, weights, np.array([b for _, b in fits], np.float32), pairs)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score to `docs`, whose own columns pass unchanged.

    Null texts and texts without a letter are `und` with score 0, as is everything if
    the model knows no language. Whole texts count, however long; equal texts get equal
    results; an empty table stays empty. Columns named lang_pred or score are replaced.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop("lang_pred", "score")
    kinds = ", ".join(f"`{n}` {t}" for n, t in rest.dtypes)
    at = rest.columns.index(text_col)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        ascii_letter = np.zeros(256, bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        # a block of 128 texts has 2 MB of counts
        for b in bounded(batches, at, 1 << 18, 128):
            texts = b.column(at)
            data, offsets = utf8(texts)
            best, score = np.zeros(b.num_rows, int), np.zeros(b.num_rows)
            if m.languages:
                best, score = m.decide(profiles(texts) @ m.weights + m.bias)
            has = np.add.reduceat(np.append(ascii_letter[data], False), np.minimum(offsets[:-1], len(data))) > 0
            has &= np.diff(offsets) > 0
            for k in np.flatnonzero(~has & (np.diff(offsets) > 0)):
                has[k] = any(c.isalpha() for c in texts[k].as_py())
            pred = [m.languages[v] if ok and m.languages else "und" for v, ok in zip(best, has)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(np.where(has, score, 0.0))], [*b.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; see learn() and predict()."""
    train = docs.where(~held_out(F.col(id_col)))
    model = learn(train, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return predict(rows, model, "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
