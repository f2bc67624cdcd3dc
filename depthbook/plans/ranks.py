"""Ranks in a total order, without a task that holds more than a range of it.

Rows are dealt to ranges of the whole sort key (key, ties, and a number for rows that are
equal in both), each range is sorted by itself and starts after the rows of the ranges
before it. The number of ranges follows from the number of rows, and since the last part
of the key is unique, a key that a third of all rows share fills as many ranges as its
rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthbook.plans.shared import settle

#: Rows in a range, about; so many rows or fewer are one range and one sort.
RANGE_ROWS = 1 << 17
#: Ranges at most; the starts of so many ranges are broadcast.
MOST_RANGES = 1 << 14


def _ranges(rows: DataFrame, order: list[Column], n: int, range_rows: int) -> DataFrame:
    """The rows, written in ranges of the order: `_range` numbers them, `_at` the rows of
    each, both from 0. The order must tell all rows apart."""
    ranges = min(-(-n // range_rows), MOST_RANGES)
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # the id of a row is (number of its task) * 2^33 + its place there
    return settle(dealt, "ranges").withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at") - F.shiftleft("_range", 33))


def _before(sizes: DataFrame, into: str) -> DataFrame:
    """(_range, into): the sum of `_n` over the ranges before each."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over MOST_RANGES rows at most
    return sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(into))


def number(rows: DataFrame, order: list[Column], into: str = "rank", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add `into`, the rank of each row from 0, in the order of the columns.

    Rows equal in all of `order` get ranks next to each other, in any order: rows are
    written once with a number of their own, so that a task that runs again deals them
    alike. An empty table stays empty; a column named as `into` is replaced.
    """
    rows = rows.drop(into)
    n = rows.count()
    if n <= range_rows:  # one range
        return rows.withColumn(into, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    dealt = _ranges(settle(rows.withColumn("_row", F.monotonically_increasing_id()), "rows"), [*order, F.col("_row")], n, range_rows)
    starts = _before(dealt.groupBy("_range").agg(F.count("*").alias("_n")), "_start")
    return dealt.join(F.broadcast(starts), "_range").withColumn(into, F.col("_start") + F.col("_at")).drop("_row", "_range", "_at", "_start")


def running_sum(rows: DataFrame, order: list[Column], column: str, into: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add `into`, the sum of a column up to and with each row, in an order that tells all
    rows apart: inside a range by a window, over the ranges before it by their sums."""
    n = rows.count()
    upto = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if n <= range_rows:
        return rows.withColumn(into, F.sum(column).over(upto(Window)))
    dealt = _ranges(rows, order, n, range_rows)
    starts = _before(dealt.groupBy("_range").agg(F.sum(column).alias("_n")), "_start")
    own = dealt.withColumn("_own", F.sum(column).over(upto(Window.partitionBy("_range"))))
    return own.join(F.broadcast(starts), "_range").withColumn(into, F.col("_start") + F.col("_own")).drop("_range", "_at", "_start", "_own")
