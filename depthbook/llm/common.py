"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthbook.plans.shared import settle, shared_dir

__all__ = ["settle", "shared_dir"]  # for the operators

#: A side is broadcast only if it has at most so many rows of ids (16 bytes each).
BROADCAST_ROWS = 1_000_000


def small_batches(spark: SparkSession) -> None:
    """Hand Python workers 1,000 rows at a time where the session has Spark's default of
    10,000: rows are whole texts here, and a worker holds a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_ids(df: DataFrame, ids: DataFrame, key: str, rows: int, how: str = "left_semi") -> DataFrame:
    """Semi or anti join; the ids are broadcast only if `rows`, their count, is proven small."""
    ids = ids.select(key)
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, key, how)


def fold(doc_id) -> int:
    """crc32 of the id's decimal text, mod 3; 1 marks held-out rows."""
    return zlib.crc32(str(doc_id).encode()) % 3


def held_out(column):
    """The same rule as a Column; a null id is not held out."""
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id = smallest reachable id) of every vertex of edges (a, b).

    Alternates large-star and small-star steps: both only shrink labels, use a
    map-side-combined min per vertex and a join, so a hub with a third of all vertices
    is combined before it is shuffled and its join is split by adaptive execution. An
    empty table gives an empty result.
    """
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = settle(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(e.select("v", "v").distinct())
