"""Importance resampling towards a target distribution over hashed n-grams.

Features are runs of one to n words. A text is read once: a ring holds the running zlib
CRC-32 states of the last n starts; each word extends every state by a space and itself
and opens a new one, so the states after a word are the hashes of the n-grams that end
there, and no n-gram is ever put together. The corpus is read once for its bucket counts
and once for the weights; what is kept between is a table of as many rows as buckets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthbook.plans.ranks import number

from .common import settle, small_batches
from .textops import bounded

BUCKETS, LONGEST = 10_000, 3
#: A document needs so many words to be drawn; so many of a hundred are.
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of a text that are split into words at a time, about.
BLOCK = 1 << 18

#: Word bytes with A-Z lowered; everything else a space.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def blocks(text: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in lists of about `size` bytes; no word is cut."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def buckets(text: str | None, longest: int = LONGEST, n_buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the n-grams that end at them) of one block after the other."""
    ring: list[int] = []
    crc = zlib.crc32
    for words in blocks((text or "").encode("utf-8", "surrogatepass").translate(_WORD)):
        states: list[int] = []
        for word in words:
            more = b" " + word
            ring = [crc(more, state) for state in ring]
            ring.append(crc(word))
            states += ring
            if len(ring) == longest:
                del ring[0]
        yield len(words), np.array(states, np.int64) % n_buckets


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts: each task counts its own, then the counts are added."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in bounded(batches, 0):
            for text in b.column(0).to_pylist():
                for _, at in buckets(text, longest, n_buckets):
                    total += np.bincount(at, minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", longest: int = LONGEST, n_buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares of every bucket, rounded down."""
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for side, rows in (s, bucket_counts(docs, text_col, longest, n_buckets)), (t, bucket_counts(target, target_col, longest, n_buckets)):
        for bucket, n in rows.collect():  # n_buckets rows at most, whatever the corpus
            side[bucket] = n
    ratio = (t + 1) * (s.sum() + n_buckets) / ((s + 1) * (t.sum() + n_buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the sum of its features' gains."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            rows = []
            for text in b.column(1).to_pylist():
                n = features = weight = 0
                for words, at in buckets(text, longest, len(held.value)):
                    n, features, weight = n + words, features + len(at), weight + int(held.value[at].sum())
                rows.append((n, features, weight))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows)]], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = 42) -> Column:
    """1000 times a Gumbel variable of the id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document.

    Of the documents with `least_words` words and more, `percent` of a hundred are drawn
    without replacement, those of highest score (weight plus noise of the id); they have
    ranks from 1, ties to the smaller id, a null id after all others; the rest have null.
    Null, empty and wordless texts have no features and weigh 0. Ids may repeat: every row
    counts and is scored by itself. Other columns are not looked at. With an empty target
    or an empty corpus the counts are 0 and smoothing alone speaks; an empty corpus gives
    an empty result.
    """
    gain = gains(docs, target, text_col, target_col)
    weighed = weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = settle(weighed, "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    ranked = number(fit, [F.desc("score"), F.asc_nulls_last("doc_id")]).withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
