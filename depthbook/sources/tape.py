"""Sources: book tapes from literal books and from the event and order tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depthbook.schema import POINTS, TAPE, side_short


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_books(spark: SparkSession, books: dict[int, list[dict]]) -> tuple[DataFrame, DataFrame]:
    """(tape, points) of literal batches by book: dicts with kind, ts and rows (side,
    price, size), in order of arrival."""
    every = [(book, n, b) for book, batches in books.items() for n, b in enumerate(batches)]
    tape = [(book, n, i, Decimal(b["ts"]), b["kind"], side, float(price), float(size)) for book, n, b in every for i, (side, price, size) in enumerate(b["rows"])]
    points = [(book, n, Decimal(b["ts"]), b["kind"]) for book, n, b in every]
    return spark.createDataFrame(tape, TAPE), spark.createDataFrame(points, POINTS)


def from_batches(spark: SparkSession, batches: list[dict], book_id: int = 0) -> tuple[DataFrame, DataFrame]:
    return from_books(spark, {book_id: batches})


def events_tape(events: DataFrame, shift: int = 0) -> DataFrame:
    """Incremental tape of the events table: ten books, one update an event, in event-time
    order. `shift` raises the bids of every seventeenth user, which crosses books."""
    bid = F.col("event_id") % 2 == 0
    off = (F.col("event_id") * 7919) % 41
    lift = F.when(F.col("user_id") % 17 == 0, F.lit(shift)).otherwise(F.lit(0))
    return events.select(
        (F.col("user_id") % 10).alias("book_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"),
        F.lit(0).alias("ord"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.lit("u").alias("kind"),
        F.when(bid, "b").otherwise("a").alias("side"),
        F.when(bid, 10000 - off + lift).otherwise(10000 + off).cast("double").alias("price"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(1 + F.floor("value") % 50).cast("double").alias("size"),
    )


#: Microseconds of a time step of the mixed tape.
STEP = 6 * 3600 * 1_000_000


def mixed_tape(events: DataFrame) -> DataFrame:
    """Snapshots and updates of ten books: a batch is a book's rows among forty consecutive
    events. Every seventh batch is a snapshot, every fifth arrives four steps late, and
    timestamps are whole steps of six hours, so that batches tie."""
    bid = F.col("event_id") % 2 == 0
    off = (F.col("event_id") * 7919) % 41
    rows = events.select(
        (F.col("user_id") % 10).alias("book_id"),
        F.expr("event_id div 40").alias("seq"),
        F.col("event_id").alias("ord"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.when(bid, "b").otherwise("a").alias("side"),
        F.when(bid, 10000 - off).otherwise(10000 + off).cast("double").alias("price"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(1 + F.floor("value") % 50).cast("double").alias("size"),
    )
    first = F.min("at").over(Window.partitionBy("book_id", "seq"))
    late = F.when(F.col("seq") % 5 == 3, 4 * STEP).otherwise(0)
    kind = F.when(F.col("seq") % 7 == 0, "s").otherwise("u")
    return rows.select("book_id", "seq", "ord", (first - first % STEP - late).alias("ts"), kind.alias("kind"), "side", "price", "size")


def orders_tape(orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshot tape of orders: twenty books, a snapshot a day and book (the largest order
    key wins), its line items the levels. Returns (tape, points)."""
    by_day = orders.select((F.col("o_custkey") % 20).alias("book_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"), "o_orderkey")
    points = by_day.groupBy("book_id", "ts").agg(F.max("o_orderkey").alias("o_orderkey"))
    bid = F.col("l_linenumber") % 2 == 1
    rows = lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(bid, "b").otherwise("a").alias("side"),
        F.when(bid, 10000 - F.col("l_partkey") % 50).otherwise(10001 + F.col("l_partkey") % 50).cast("double").alias("price"),
        F.col("l_quantity").cast("double").alias("size"),
        "l_linenumber",
    )
    # last write of a price wins
    tape = points.join(rows, "o_orderkey").groupBy("book_id", "ts", "side", "price").agg(F.max(F.struct("l_linenumber", "size")).alias("w"))
    tape = tape.select("book_id", F.col("ts").alias("seq"), F.lit(0).alias("ord"), "ts", F.lit("s").alias("kind"), "side", "price", F.col("w.size").alias("size"))
    return tape, points.select("book_id", F.col("ts").alias("seq"), "ts", F.lit("s").alias("kind"))


def known_sides(rows: DataFrame, unknown: str = "error") -> DataFrame:
    """Tape rows with sides 'b' and 'a' in either spelling. Another side is an error when
    it is read, or, as `unknown` says, the row is left out ('ignore') or an ask ('ask')."""
    s, known = side_short(F.col("side")), F.coalesce(F.col("side").isin("b", "bid", "a", "ask"), F.lit(False))
    if unknown == "ignore":
        return rows.where(known).withColumn("side", s)
    if unknown not in ("error", "ask"):
        raise ValueError(f"unknown must be error, ignore or ask, not {unknown!r}")
    other = F.lit("a") if unknown == "ask" else F.raise_error(F.concat(F.lit("unknown side "), F.coalesce("side", F.lit("null"))))
    return rows.withColumn("side", F.when(known, s).otherwise(other))


def points_of(tape: DataFrame) -> DataFrame:
    """The points of a tape without empty batches."""
    return tape.select("book_id", "seq", "ts", "kind").distinct()


def refused(points: DataFrame) -> DataFrame:
    """Snapshots that a series does not take without force: those at a timestamp at which
    an earlier batch of the book has arrived."""
    first = points.groupBy("book_id", "ts").agg(F.min("seq").alias("_first"))
    return points.where("kind = 's'").join(first, ["book_id", "ts"]).where("seq > _first").drop("_first")


def last_writes(tape: DataFrame) -> DataFrame:
    """One row per (batch, side, price): the last by `ord` (ties by size)."""
    w = Window.partitionBy("book_id", "seq", "side", "price").orderBy(F.desc("ord"), F.desc("size"))
    return tape.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
