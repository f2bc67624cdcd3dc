"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample makes the signs of a vector's principal
directions balanced binary codes. Every hash table has a part of the code as its key; the
parts are cut from fixed shuffles of the bits. Vectors that meet under a key are compared
by the cosine of the original vectors.

One rule gives the width of a part and the number of tables at every size. The number is
the least with which a pair at the least cosine, whose signs differ as those of random
directions do, agrees in one part at least with probability `FOUND`; closer pairs are found
more surely still. The width is the one of least work: wider parts have fewer vectors under
a key and need more tables, and a row of a table counts as `ROW` comparisons. Work thus
grows with less than the square of the table (a vector's part by about n to the power 0.4),
beside the links themselves. A pair counts only under the first key its codes share, so
links need no deduplication and only counts and one edge a vector and group leave a task:
to the smallest id that it reaches through the group's links.

A key with many vectors is dealt as pairs of chunks, so no task holds an unbounded group.
Equal vectors are one class: compared once, counted as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settle
from .embeddings import block, fixed_sample, usable

#: Vectors the rotation is learned on; vectors in one chunk of a key; comparisons that a
#: row of a table costs; the share of pairs at the least cosine that is to be found.
SAMPLE, CHUNK, ROW, FOUND = 20_000, 512, 500, 0.99


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions turned so that signs lose least."""
    mean = x.mean(0)
    _, v = np.linalg.eigh(np.cov((x - mean).T).reshape(x.shape[1], x.shape[1]))
    v = v[:, ::-1][:, :bits]
    y = (x - mean) @ v
    r = np.linalg.qr(np.random.default_rng(11).standard_normal((y.shape[1],) * 2))[0]
    for _ in range(rounds):
        b = np.where(y @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ y)
        r = (u @ w).T
    return mean, v @ r


def tables(n: int, bits: int, least: float) -> np.ndarray:
    """The parts of a code of `bits` bits for n vectors, as masks of 64 bits."""
    turn = np.arccos(np.clip(least, -1, 1)) / np.pi
    differ = np.arange(bits + 1)
    chance = np.array([math.comb(bits, d) * turn**d * (1 - turn) ** (bits - d) for d in differ])

    def number(width: int) -> int:
        agree = np.array([math.comb(bits - d, width) / math.comb(bits, width) for d in differ])
        many = 1
        while many < 4096 and chance @ (1 - agree) ** many > 1 - FOUND:
            many += 1
        return many

    most = max(1, bits // (2 if bits >= 32 else 4))  # a short code needs short parts
    options = {w: number(w) for w in range(min(8, most), min(24, most) + 1)}
    width = min(options, key=lambda w: options[w] * (ROW + n / 2**w))
    rng, masks = np.random.default_rng(17), {}
    for _ in range(4 * options[width]):  # a short code has no more parts than that
        order = rng.permutation(bits)
        masks |= {sum(1 << int(b) for b in order[i : i + width]): 0 for i in range(0, bits - width + 1, width)}
        if len(masks) >= options[width]:
            break
    return np.array(list(masks)[: options[width]], np.uint64)


def codes(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    signs = (unit - mean) @ turn >= 0
    return (signs.astype(np.uint64) << np.arange(signs.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)


def spread(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column of a block of links can reach in it."""
    if not linked.any():
        return a, b
    none = np.iinfo(np.int64).max
    while True:
        low_a = np.minimum(a, np.where(linked, b[None, :], none).min(1))
        low_b = np.minimum(b, np.where(linked, low_a[:, None], none).min(0))
        if (low_a == a).all() and (low_b == b).all():
            return a, b
        a, b = low_a, low_b


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Unusable vectors (null, zero, or holding null or non-finite components) link with
    nothing and are kept; ties cannot arise; equal vectors link with each other; rows
    that repeat an id are linked as rows; an empty table gives no rows; extra columns,
    labels among them, are ignored.
    """
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    fine = usable(vectors, id_col, vec_col)
    if dict(vectors.dtypes)[vec_col] == "array<float>":  # as wide as it came, until it is compared
        fine = fine.withColumn("x", F.col("x").cast("array<float>"))
    same = settle(fine.groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    n = same.count()
    if not n:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    units = same.select(F.col("rep").alias("vec_id"), "x", "copies")
    sample = fixed_sample(units, SAMPLE)
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    bits = min(64, sample.shape[1])
    mean, turn = learn_rotation(sample, bits) if len(sample) > 1 else (np.zeros(sample.shape[1]), np.eye(sample.shape[1])[:, :bits])
    masks = tables(n, bits, least)
    held = spark.sparkContext.broadcast((mean, turn))

    @F.pandas_udf("long")
    def code(x: pd.Series) -> pd.Series:
        return pd.Series(codes(block(x).astype(float), *held.value).view(np.int64))

    coded = settle(units.withColumn("code", code("x")), "coded")
    parts = F.array(*[F.lit(int(m)) for m in masks.view(np.int64)])
    placed = coded.select("vec_id", "code", F.posexplode(parts).alias("t", "mask")).select("vec_id", "t", F.col("code").bitwiseAND(F.col("mask")).alias("key"))
    sizes = placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    # ids find their key's size; the vectors follow only where they meet another
    meets = placed.join(sizes, ["t", "key"]).withColumn("c", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    # chunk c meets every chunk, itself among them: pairs (i, j), i <= j
    meets = meets.withColumn("o", F.explode(F.expr("sequence(0, chunks - 1)")))
    meets = meets.withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o")).select("vec_id", "t", "key", "i", "j", "c")
    rows = meets.join(coded, "vec_id")

    def compare(f: dict) -> dict | None:
        t, i, j = int(f["t"][0]), f["i"][0], f["j"][0]
        left = right = np.arange(len(f["c"])) if i == j else np.flatnonzero(f["c"] == i)
        if i != j:
            right = np.flatnonzero(f["c"] == j)
        if not len(left) or not len(right):
            return None
        ids, x, copies, code = f["vec_id"], f["x"], f["copies"], f["code"]
        linked = x[left] @ x[right].T >= least
        if i == j:
            np.fill_diagonal(linked, False)
        a, b = np.nonzero(linked)
        differ = code[left[a]] ^ code[right[b]]
        for m in masks[:t]:  # met before
            again = (differ & m) == 0
            linked[a[again], b[again]] = False
        low_a, low_b = spread(linked, ids[left], ids[right])
        out = []
        for rows_, m, low, other in [(left, linked, low_a, right)] if i == j else [(left, linked, low_a, right), (right, linked.T, low_b, left)]:
            some = np.flatnonzero(m.any(1))
            out.append({"vec_id": ids[rows_[some]], "n_links": m[some] @ copies[other], "low": low[some]})
        return {k: np.concatenate([o[k] for o in out]) for k in out[0]}

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups (t, key, i, j) one after the other; a group may end in the next frame."""
        kept: dict = {}
        for f in frames:
            if not len(f):
                continue
            new = {c: f[c].to_numpy() for c in ("t", "key", "i", "j", "c", "vec_id", "copies")}
            new["code"] = f["code"].to_numpy().view(np.uint64)
            x = block(f["x"]).astype(float)
            new["x"] = x / np.linalg.norm(x, axis=1, keepdims=True)
            kept = {c: np.concatenate([kept[c], v]) for c, v in new.items()} if kept else new
            edge = np.flatnonzero(np.any([kept[c][1:] != kept[c][:-1] for c in ("t", "key", "i", "j")], axis=0)) + 1
            out = [compare({c: v[a:b] for c, v in kept.items()}) for a, b in zip([0, *edge[:-1]], edge)] if len(edge) else []
            kept = {c: v[edge[-1] :] for c, v in kept.items()} if len(edge) else kept
            out = [o for o in out if o]
            if out:
                yield pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})
        last = compare(kept) if kept else None
        if last:
            yield pd.DataFrame(last)

    group = ("t", "key", "i", "j")
    dealt = rows.repartition(*group).sortWithinPartitions(*group, "vec_id")
    met = settle(dealt.mapInPandas(meet, "vec_id long, n_links long, low long"), "met")
    links = met.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    parts_ = components(met.select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    of_class = same.join(links, F.col("rep") == links["vec_id"], "left").drop("vec_id").join(parts_, F.col("rep") == parts_["id"], "left")
    of_class = of_class.select("x", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = fine.join(of_class, "x").select("vec_id", "n_links", "component_id").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    whole = every.join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
