"""Vector columns as numpy blocks, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): rows whose vector is neither null, empty nor zero and has only finite
    components. A repeated id keeps each of its rows."""
    x = F.col(vec_col)
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))


def block(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 0))


def fixed_sample(vectors: DataFrame, most: int) -> np.ndarray:
    """At most `most` vectors, those of smallest id hash: a bounded, repeatable sample."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("x").toPandas()
    return block(got["x"])


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids from a fixed start; at most as many as there are rows."""
    k = min(k, len(x))
    c = x[np.random.default_rng(7).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c
