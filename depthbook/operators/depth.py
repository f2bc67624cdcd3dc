"""Operators that need a book's depth: slippage, exports, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthbook.functions import metrics
from depthbook.plans.state import in_time, point_keys
from depthbook.schema import INF, moment, sort_price


def with_depth(levels: DataFrame) -> DataFrame:
    """Add `depth`, the levels of the row's side, for negative indices."""
    return levels.withColumn("depth", F.count("*").over(Window.partitionBy(*point_keys(levels), "side")))


def with_best(levels: DataFrame) -> DataFrame:
    """Add `best`, the best price of the row's side."""
    w = Window.partitionBy(*point_keys(levels), "side")
    return levels.withColumn("best", F.when(F.col("side") == "b", F.max("price").over(w)).otherwise(F.min("price").over(w)))


def per_point(kept: DataFrame, levels: DataFrame, **columns) -> DataFrame:
    """Aggregate levels by point; points without levels get 0.0."""
    agg = levels.groupBy(*point_keys(levels)).agg(*[c.alias(n) for n, c in columns.items()])
    return kept.join(agg.drop("chunk"), ["book_id", "ts"], "left").select("book_id", "ts", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in columns])


def slippage(kept: DataFrame, live: DataFrame, top: DataFrame, side: str, volume: float) -> DataFrame:
    """(book_id, ts, slippage) of taking `volume` from a side, against the midprice: +inf
    where the side is too thin, NaN where the other is empty, 0.0 for no volume or the
    'midprice' side."""
    if volume <= 0 or side == "midprice":
        return kept.select("book_id", "ts", F.lit(0.0).alias("slippage"))
    if side not in ("a", "ask", "b", "bid"):
        raise ValueError(f"side must be midprice, a, ask, b or bid, not {side!r}")
    s = side[0]
    run = Window.partitionBy(*point_keys(live)).orderBy(sort_price()).rowsBetween(Window.unboundedPreceding, 0)
    v = F.lit(float(volume))
    part = live.where(F.col("side") == s).withColumn("cum", F.sum("size").over(run))
    take = F.greatest(F.lit(0.0), F.least(F.col("size"), v - (F.col("cum") - F.col("size"))))
    filled = part.withColumn("take", take).groupBy(*point_keys(live)).agg(F.sum(F.col("take") * F.col("price")).alias("cost"), F.max("cum").alias("there"))
    mid = metrics.midprice()
    signed = F.col("cost") / v - mid if s == "a" else mid - F.col("cost") / v
    thin = F.coalesce(F.col("there"), F.lit(0.0)) < v
    return kept.join(top, ["book_id", "ts"]).join(filled.drop("chunk"), ["book_id", "ts"], "left").select("book_id", "ts", F.when(thin, F.lit(INF)).otherwise(signed).alias("slippage"))


def export(levels: DataFrame, start=None, end=None) -> DataFrame:
    """The long table timestamp, side, level, price, size; ends inclusive, None open."""
    rows = time_slice(levels, start, end)
    return rows.orderBy("book_id", "ts", F.desc("side"), "level").select("book_id", F.col("ts").alias("timestamp"), "side", "level", "price", "size")


time_slice = in_time


def at_moments(points: DataFrame, moments: DataFrame) -> DataFrame:
    """`moments` (book_id, ts) with `there`: whether the series has a book at exactly that
    timestamp. Without a book_id in `points` or `moments`, any of the series."""
    keys = ["book_id", "ts"] if "book_id" in points.columns and "book_id" in moments.columns else ["ts"]
    known = points.select(*keys).distinct().withColumn("there", F.lit(True))
    return moments.join(known, keys, "left").withColumn("there", F.coalesce("there", F.lit(False)))


def at_moment(rows: DataFrame, ts) -> DataFrame:
    """The rows of points, levels or tops at exactly one timestamp."""
    return rows.where(F.col("ts") == moment(ts))


def split_budget(levels: DataFrame, n: int) -> DataFrame:
    """The best n levels of a book over both sides: (n + 1) // 2 bids, n // 2 asks."""
    return levels.where(F.col("level") < F.when(F.col("side") == "b", (n + 1) // 2).otherwise(n // 2))


def side_levels(levels: DataFrame, side: str | None = None, n: int | None = None) -> DataFrame:
    """The best n levels of one side ('b' or 'a'), or of any other `side` the best n of
    both together; None takes all."""
    if side in ("b", "a"):
        rows = levels.where(F.col("side") == side)
        return rows if n is None else rows.where(F.col("level") < n)
    return levels if n is None else split_budget(levels, n)
