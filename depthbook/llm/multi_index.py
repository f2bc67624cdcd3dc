"""Approximate nearest neighbours by an inverted multi-index.

A vector's two halves are quantised separately; a pair of centroids is a cell. A query
walks the cells in the order of summed centroid distances with a heap (multi-sequence)
until the cells met hold its share of the collection, then its cells' entries are
reranked by the inner product of the original vectors.

The share is not guessed: of a documented sample of the queries the true neighbours are
found by brute force, and the share is the least that reaches `recall` of them. Clustered
vectors need a small one, whatever their number; vectors without structure need about half
of the collection, and then the work grows with queries times vectors, as it does for any
exact method.

Entries are dealt into buckets of neighbouring cells and queries into blocks of
neighbouring cells; a task meets one query block and one bucket, both of bounded size, and
returns each query's best in it. Queries of a block ask for much the same cells, so a
bucket travels to few blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .embeddings import block, fixed_sample, kmeans, usable

#: Vectors the centroids are fitted on, entries of a bucket and queries of a block, about;
#: queries that the share is measured with.
SAMPLE, BUCKET, BLOCK, ASKED = 20_000, 4_096, 1_024, 64


class MultiIndex:
    """Two codebooks; `counts[i, j]` is the number of entries of cell (i, j)."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.half = sample.shape[1] // 2
        self.first, self.second = kmeans(sample[:, : self.half], cells), kmeans(sample[:, self.half :], cells)
        self.counts = np.zeros((len(self.first), len(self.second)), np.int64)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to the centroids, up to each half's own length."""
        a, b = x[:, : self.half], x[:, self.half :]
        return (self.first**2).sum(1) - 2 * a @ self.first.T, (self.second**2).sum(1) - 2 * b @ self.second.T

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def shares(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entries that the walk has met once it has met each cell."""
        order = (a[:, None] + b[None, :]).ravel().argsort(kind="stable")
        out = np.empty(len(order), np.int64)
        out[order] = self.counts.ravel()[order].cumsum()
        return out

    def walk(self, a: np.ndarray, b: np.ndarray, wanted: float) -> list[int]:
        """Cells by a[i] + b[j], nearest first, until they hold `wanted` entries."""
        i_of, j_of = a.argsort(kind="stable"), b.argsort(kind="stable")
        a, b = a[i_of], b[j_of]
        heap, seen, out, held = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            n = int(self.counts[i_of[i], j_of[j]])
            if n:
                out.append(int(i_of[i]) * len(self.second) + int(j_of[j]))
                held += n
            for u, v in ((i + 1, j), (i, j + 1)):
                if u < len(a) and v < len(b) and (u, v) not in seen:
                    seen.add((u, v))
                    heapq.heappush(heap, (a[u] + b[v], u, v))
        return out


def _deal(rows: list[tuple[int, int]], size: int) -> dict[int, tuple[int, int]]:
    """Cells in order fill even parts of `size` at most, about: (first part, parts) of each
    cell; one larger than that gets several of its own."""
    of, used, filled = {}, 0, 0
    total = sum(m for _, m in rows)
    size = -(-total // max(1, -(-total // size)))
    for c, m in sorted(rows):
        if filled and filled + m > size:
            used, filled = used + 1, 0
        parts = max(1, -(-m // size))
        of[c] = (used, parts)
        used, filled = (used + parts, 0) if parts > 1 else (used, filled + m)
    return of


def measured_share(index: MultiIndex, entries: DataFrame, asked: DataFrame, k: int, recall: float) -> float:
    """The least share of the collection that holds `recall` of the k true neighbours of
    at most ASKED queries (those of smallest id hash), found by brute force."""
    sample = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED).toPandas()
    if not len(sample):
        return 0.0
    held = entries.sparkSession.sparkContext.broadcast((sample["vec_id"].to_numpy(), block(sample["x"])))

    def brute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = held.value
        for f in frames:
            if not len(f):
                continue
            s = q @ block(f["x"]).T
            s[ids[:, None] == f["vec_id"].to_numpy()[None, :]] = -np.inf
            best = np.argsort(-s, 1)[:, :k]
            r = np.repeat(np.arange(len(q)), best.shape[1])
            yield pd.DataFrame({"r": r, "cell": f["cell"].to_numpy()[best.ravel()], "s": s[r, best.ravel()]})

    near = entries.select("vec_id", "x", "cell").mapInPandas(brute, "r int, cell int, s double").where(F.col("s") > float("-inf"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("s"), "cell"))).where(F.col("n") <= k).select("r", "cell").toPandas()
    if not len(near):
        return 0.0
    a, b = index.distances(held.value[1])
    met = [index.shares(a[r], b[r])[own["cell"].to_numpy()] for r, own in near.groupby("r")]
    return float(np.quantile(np.concatenate(met), recall, method="higher") / index.counts.sum())


def spread(i: int, parts: int) -> int:
    """One of some parts for an id; ids that share a divisor fill all of them."""
    return ((int(i) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32) % parts


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, cells: int | None = None, share: float | None = None, least: int = 2_000, recall: float = 0.94, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by inner product.

    A query's own id is no candidate; ties go to the smaller vec_id; unusable vectors
    (null, zero, or holding null or non-finite components) take no part on either side;
    a query with fewer than k candidates gets them all; empty tables give no rows; extra
    columns are ignored. Rows that repeat an id are entries each, so such an id may fill
    several ranks. Every usable vector is indexed. `share` of the collection (at least
    `least` entries) is reranked, by default the one that measured_share() finds; `cells`
    centroids a half, by default an eighth of the root of the number of vectors.
    """
    spark = vectors.sparkSession
    base = settle(usable(vectors, id_col, vec_col), "vectors")
    asked = usable(queries, id_col, vec_col)
    schema = "query_id long, rank int, vec_id long, score double"
    n = base.count()
    if not n:
        return spark.createDataFrame([], schema)
    index = MultiIndex(fixed_sample(base, SAMPLE), cells or int(np.clip(np.sqrt(n) / 8, 16, 1024)))
    at = spark.sparkContext.broadcast(index)

    @F.pandas_udf("int")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(at.value.cells(block(x)).astype(np.int32))

    entries, asked = settle(base.withColumn("cell", cell("x")), "entries"), settle(asked.withColumn("cell", cell("x")), "asked")
    # at most cells^2 rows, whatever the collection
    rows = [tuple(r) for r in entries.groupBy("cell").count().collect()]
    for c, m in rows:
        index.counts[c // len(index.second), c % len(index.second)] = m
    bucket_of = _deal(rows, BUCKET)
    block_of = _deal([tuple(r) for r in asked.groupBy("cell").count().collect()], BLOCK)
    share = measured_share(index, entries, asked, k, recall) if share is None else share
    wanted = max(share * n, least)
    lay = spark.sparkContext.broadcast((index, bucket_of, block_of))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lay.value[1]
        for f in frames:
            to = [of[c] for c in f["cell"]]
            yield pd.DataFrame({"bucket": [u + spread(i, p) for i, (u, p) in zip(f["vec_id"], to)], "cell": f["cell"], "vec_id": f["vec_id"], "x": f["x"]})

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each bucket that a query's cells lie in."""
        ix, of, blocks = lay.value
        for f in frames:
            if not len(f):
                continue
            a, b = ix.distances(block(f["x"]))
            out = []
            for i, x, own, p, q in zip(f["vec_id"], f["x"], f["cell"], a, b):
                first, of_own = blocks[own]
                to = first + spread(i, of_own)
                by: dict[int, list[int]] = {}
                for c in ix.walk(p, q, wanted):
                    u, parts = of[c]
                    for v in range(u, u + parts):
                        by.setdefault(v, []).append(c)
                out += [(to, v, i, cs, x) for v, cs in by.items()]
            yield pd.DataFrame(out, columns=["block", "bucket", "query_id", "cells", "x"])

    dealt = entries.mapInPandas(place, "bucket int, cell int, vec_id long, x array<double>")
    probes = asked.mapInPandas(probe, "block int, bucket int, query_id long, cells array<int>, x array<double>")
    # an entry goes to the query blocks that ask for its bucket, as the buckets do
    needed = probes.select(F.col("bucket").alias("of"), F.col("block").alias("to")).distinct()
    copies = dealt.join(needed, F.col("bucket") == F.col("of")).drop("of")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values(["vec_id", "cell"], kind="stable").reset_index(drop=True)
            x, ids = block(right["x"]), right["vec_id"].to_numpy()
            names, code = np.unique(right["cell"].to_numpy(), return_inverse=True)
            q, asks = block(left["x"]), np.zeros((len(left), len(names)), bool)
            for r, cs in enumerate(left["cells"]):
                asks[r, np.searchsorted(names, np.intersect1d(names, cs))] = True
            s = q @ x.T
            s[~asks[:, code]] = -np.inf
            s[left["query_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
            # what rounding in the product may hide is summed again
            slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
            floor = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] - slack if len(ids) > k else np.full(len(s), -np.inf)
            for r, i in enumerate(left["query_id"]):
                rows = np.flatnonzero((s[r] >= floor[r]) & (s[r] > -np.inf))
                exact = (x[rows] * q[r]).sum(1)  # the same sum for equal vectors
                keep = np.lexsort((ids[rows], -exact))[:k]
                out.append(pd.DataFrame({"query_id": i, "vec_id": ids[rows[keep]], "score": exact[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = probes.groupBy("block", "bucket").cogroup(copies.groupBy("to", "bucket")).applyInPandas(best, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
