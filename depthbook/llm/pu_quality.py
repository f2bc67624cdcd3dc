"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents marked good; every text, marked or not, is unlabelled
web text. With the estimated class prior p the non-negative unbiased risk
    p E_pos[l(f)] + max(0, E_unl[l(-f)] - p E_pos[l(-f)])
is minimised with the logistic loss over a generalised additive model of form features
and a linear one of hashed words (no identifiers, languages or sources among them); a
step whose second term is negative climbs that term instead, so the model cannot overfit
the positives.

The prior comes from positives and unlabelled rows alone, never from rows marked bad: a
classifier that tells the two apart is fitted on one half of them, and of the other half
the prior is the least ratio, over thresholds, of the share of unlabelled rows above one
to the share of positives above it, where both shares are known well enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .textops import bounded, matrix, mix, slices, utf8, word_hashes, words

#: Rows the model is fitted on, those of smallest hash; documented bounds.
POSITIVES, UNLABELLED = 6_000, 20_000
BINS = 12
#: Buckets of hashed words.
WORDS = 256
FEATURES = ("log_words", "word_length", "upper", "digits", "marks", "symbols", "beyond_ascii", "lines", "short_words", "long_words", "ends_marked", "upper_words", "repeat_next", "distinct_words", "distinct_shingles", "stops", "letters")

_CLASS = {
    "upper": list(range(65, 91)), "digits": list(range(48, 58)), "marks": [33, 34, 39, 44, 46, 58, 59, 63], "lines": [10],
    "symbols": [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126], "letters": [*range(65, 91), *range(97, 123), *range(128, 256)],
}
_MASK = {k: np.isin(np.arange(256), v) for k, v in _CLASS.items()} | {"beyond_ascii": np.arange(256) >= 128}


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES and WORDS for every text, whatever stands beside it."""
    data, offsets = utf8(column)
    out = [_features(d, o) for _, _, d, o in slices(data, offsets)]
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES) + WORDS), np.float32)


def _features(d: np.ndarray, o: np.ndarray) -> np.ndarray:
    n = len(o) - 1
    size = np.maximum(np.diff(o), 1)
    at = {name: np.zeros(n) for name in FEATURES} | {"distinct_shingles": np.ones(n)}
    for name, mask in _MASK.items():
        total = np.concatenate([[0], np.cumsum(mask[d])])
        at[name] = (total[o[1:]] - total[o[:-1]]) / size
    starts, ends, first = words(d, o)
    count = np.diff(first)
    some = np.maximum(count, 1)
    own = np.repeat(np.arange(n), count)
    share = lambda hit: np.bincount(own, weights=hit.astype(float), minlength=n) / some
    if len(starts):
        length = ends - starts
        h = word_hashes(d, starts, ends)
        at["word_length"] = np.log1p(share(length))  # a text may be one word of any length
        at["short_words"], at["long_words"] = share(length <= 2), share(length >= 14)
        at["ends_marked"] = share(~_MASK["letters"][d[ends - 1]] & ~_MASK["digits"][d[ends - 1]])
        at["stops"] = share(np.isin(d[ends - 1], (33, 46, 63)))
        at["upper_words"] = share(_MASK["upper"][d[starts]] & _MASK["upper"][d[np.minimum(starts + 1, ends - 1)]] & (length > 1))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
        at["repeat_next"] = share(again)
        at["distinct_words"] = _distinct(h, own, n) / some
        with np.errstate(over="ignore"):
            if len(h) > 2:
                three = mix(h[:-2], 1) + mix(h[1:-1], 2) + mix(h[2:], 3)
                inside = own[:-2] == own[2:]
                at["distinct_shingles"] = np.where(count > 2, _distinct(three[inside], own[:-2][inside], n) / np.maximum(count - 2, 1), 1.0)
    at["log_words"] = np.log1p(count)
    lexical = np.zeros((n, WORDS), np.float32)
    if len(starts):
        bucket = (mix(h, 7) % np.uint64(WORDS)).astype(np.int64)
        lexical = np.sqrt(np.bincount(own * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS).astype(np.float32))
        lexical /= np.maximum(np.linalg.norm(lexical, axis=1, keepdims=True), 1e-9)
    return np.concatenate([np.stack([at[k] for k in FEATURES], 1).astype(np.float32), lexical], 1)


def _distinct(h: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = mix(h + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5)
    _, i = np.unique(key, return_index=True)
    return np.bincount(own[i], minlength=n).astype(float)


@dataclass
class QualityModel:
    """Quantile bins of every form feature, the hashed words, and a logistic model over them."""

    cuts: list[np.ndarray]
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        form, lexical = x[:, : len(self.cuts)], x[:, len(self.cuts) :]
        sizes = [len(cut) + 1 for cut in self.cuts]
        at = len(sizes) + 1
        out = np.zeros((len(x), at + sum(sizes) + lexical.shape[1]), np.float32)
        out[:, : at - 1] = np.clip((form - self.centre) / self.spread, -4, 4)
        out[:, at - 1] = 1
        for k, cut in enumerate(self.cuts):
            out[np.arange(len(x)), at + np.searchsorted(cut, form[:, k], "right")] = 1
            at += sizes[k]
        out[:, at:] = lexical
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the prior for every text where nothing could be learned."""
        if not len(self.weights):
            return np.full(len(x), self.prior)
        return np.concatenate([np.zeros(0), *(_logistic((self.design(x[i : i + 1024]) @ self.weights).astype(float)) for i in range(0, len(x), 1024))])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _shape(unlabelled: np.ndarray, prior: float) -> QualityModel:
    """A model without weights, its bins from the unlabelled rows."""
    form = unlabelled[:, : len(FEATURES)]
    cuts = [np.unique(np.quantile(form[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(form.shape[1])]
    return QualityModel(cuts, form.mean(0), np.maximum(form.std(0), 1e-9), np.zeros(0), prior)


def _adam(gradient, w: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        grad = gradient(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2  # all in single precision, as the rows are
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _penalty(w: np.ndarray, decay: float) -> np.ndarray:
    return np.float32(decay) * np.where(np.arange(len(w)) == len(FEATURES), np.float32(0), w)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 150, rate: float = 0.05, decay: float = 1e-2) -> float:
    """The share of positives among the unlabelled rows, from these two alone.

    Even rows fit the classifier that tells them apart, odd rows are counted. A threshold
    counts by the ratio of shares above it plus what chance may add (at 90 %).
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    model = _shape(unlabelled[::2], 0.5)
    p, u = model.design(positive[::2]), model.design(unlabelled[::2])
    half = lambda w: 0.5 * (p.T @ (_logistic(p @ w) - 1) / len(p) + u.T @ _logistic(u @ w) / len(u)) + _penalty(w, decay)
    model.weights = _adam(half, np.zeros(p.shape[1], np.float32), rounds, rate)
    sp, su = np.sort(model.score(positive[1::2])), np.sort(model.score(unlabelled[1::2]))
    above = lambda s, c: (len(s) - np.searchsorted(s, c)) / len(s)
    qp, qu = above(sp, sp), above(su, sp)
    chance = np.sqrt(np.log(4 / 0.1) / 2) * (len(sp) ** -0.5 + len(su) ** -0.5)
    best = np.argmin(qu / qp + 1.01 * chance / qp)
    edge = 1 / (len(su) + 2)
    return float(np.clip(qu[best] / qp[best], edge, 1 - edge))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, rounds: int = 600, rate: float = 0.05, decay: float = 1e-3) -> QualityModel:
    """Minimise the non-negative risk by full-batch Adam steps; the prior is estimated
    unless it is given."""
    if not len(positive) or not len(unlabelled):
        return QualityModel([np.zeros(0)] * len(FEATURES), np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(0), 0.5 if prior is None else prior)
    prior = estimate_prior(positive, unlabelled) if prior is None else prior
    model = _shape(unlabelled, prior)
    p, u = model.design(positive), model.design(unlabelled)
    w = np.zeros(p.shape[1], np.float32)
    w[len(FEATURES)] = np.log(prior / (1 - prior))

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _logistic(p @ w), _logistic(u @ w)
        loss_neg = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        neg = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        grad = prior * (p.T @ (sp - 1)) / len(p) + neg if loss_neg >= 0 else -neg
        return grad + _penalty(w, decay)

    model.weights = _adam(gradient, w, rounds, rate)
    if not np.isfinite(model.weights).all():
        raise ArithmeticError("the risk has no finite minimum on these rows")
    return model


def _with_features(rows: DataFrame) -> DataFrame:
    """(positive, at, text) to (positive, at, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 2):
            x = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["positive", "at", "x"])

    return rows.mapInArrow(run, "positive boolean, at long, x binary")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel:
    """Fit on the rows of `docs`, with the positives that `labels` marks 1.

    Rows marked 0 are never looked at as such: the class prior is estimated from positives
    and unlabelled rows unless it is given. Both are those of smallest id hash, up to the
    two bounds; null texts count as empty. With no positive or no row the model scores
    every text the same. What is drawn are different (id, text) pairs, so neither an id
    with many texts nor a row with many copies brings more rows than the bounds.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text"), F.col(text_col).alias("text")).where("_id is not null")
    keys = keyed.select("_id", "_text")
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_id")).distinct()
    draw = lambda pairs, n: pairs.distinct().orderBy(F.xxhash64(F.col("_id")), "_id", "_text").limit(n)
    chosen = draw(keys.join(good, "_id", "left_semi"), positives).withColumn("positive", F.lit(True)).union(draw(keys, unlabelled).withColumn("positive", F.lit(False)))
    rows = keyed.join(F.broadcast(chosen), ["_id", "_text"]).select("positive", F.xxhash64("_id", "_text").alias("at"), "text")
    got = _with_features(rows).dropDuplicates(["positive", "at"]).toArrow()
    order = got.select(["positive", "at"]).to_pandas().sort_values(["positive", "at"])
    is_positive, order = order["positive"].to_numpy(bool), order.index.to_numpy()
    positive, unlabelled = (matrix(got.column("x"), order[which], np.float32, len(FEATURES) + WORDS) for which in (is_positive, ~is_positive))
    del got
    return fit(positive, unlabelled, prior)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", into: str = "score") -> DataFrame:
    """Add the score (0 to 1) of every whole text; null texts score as empty ones.

    A very long text is a batch of its own; other columns pass unchanged; a column named
    as `into` is replaced; equal texts get equal scores; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(into)
    at, kinds = rest.columns.index(text_col), ", ".join(f"`{n}` {t}" for n, t in rest.dtypes)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, at):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.score(features(b.column(at))), pa.float64())], [*b.schema.names, into])

    return rest.mapInArrow(run, f"{kinds}, {into} double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; held-out rows teach nothing."""
    model = learn(docs.where(~held_out(F.col(id_col))), labels, id_col, text_col)
    rows = score(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
