"""Flow between consecutive points, series length and duration, deltas and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthbook.plans import ranks
from depthbook.plans.state import Books, met, numbered, place
from depthbook.schema import side_long, sort_price
from depthbook.sources.tape import last_writes


def flow_rows(tape: DataFrame, points: DataFrame, updates_only: bool = False) -> DataFrame:
    """(book_id, seq, arrivals, cancels) of every tape row of an in-order tape, and of
    levels that a snapshot drops; a book's first point counts nothing.

    One shuffle by (book, side, price): no book is ever densified.
    """
    rows = last_writes(tape)
    first = points.groupBy("book_id").agg(F.min("seq").alias("_first"))
    key = Window.partitionBy("book_id", "side", "price").orderBy("seq")
    if updates_only:
        d = F.col("size") - F.coalesce(F.lag("size").over(key), F.lit(0.0))
        moved = rows.withColumn("_d", d).join(first, "book_id").where("seq > _first")
        return moved.select("book_id", "seq", F.greatest("_d", F.lit(0.0)).alias("arrivals"), F.greatest(-F.col("_d"), F.lit(0.0)).alias("cancels"))
    placed = place(numbered(points))
    last = placed.groupBy("book_id").agg(F.max("epoch").alias("_last"))
    r = rows.join(placed.select("book_id", "seq", "epoch"), ["book_id", "seq"]).join(first, "book_id").join(last, "book_id")
    for n, f in (("p", F.lag), ("n", F.lead)):
        r = r.withColumn(f"{n}e", f("epoch").over(key)).withColumn(f"{n}s", f("size").over(key)).withColumn(f"{n}k", f("kind").over(key))
    old = F.when((F.col("pe") == F.col("epoch")) | ((F.col("pe") == F.col("epoch") - 1) & (F.col("kind") == "s")), F.col("ps")).otherwise(0.0)
    met = F.col("seq") > F.col("_first")
    carried = F.coalesce((F.col("ne") == F.col("epoch")) | ((F.col("ne") == F.col("epoch") + 1) & (F.col("nk") == "s")), F.lit(False))
    dropped = F.when((F.col("epoch") < F.col("_last")) & ~carried, F.col("size")).otherwise(0.0)
    return r.withColumn("_old", old).select(
        "book_id",
        "seq",
        F.when(met, F.greatest(F.col("size") - F.col("_old"), F.lit(0.0))).otherwise(0.0).alias("arrivals"),
        (F.when(met, F.greatest(F.col("_old") - F.col("size"), F.lit(0.0))).otherwise(0.0) + dropped).alias("cancels"),
    )


def absent_deletes(tape: DataFrame, points: DataFrame) -> DataFrame:
    """(book_id, seq, side, price) of updates of an in-order tape that delete a level which
    is not there. A level is there after a row of its price since the last snapshot (with
    its rows) that did not delete it."""
    placed = place(numbered(points)).select("book_id", "seq", "epoch")
    key = Window.partitionBy("book_id", "epoch", "side", "price").orderBy("seq")
    rows = last_writes(tape).join(placed, ["book_id", "seq"]).withColumn("_gone", (F.col("kind") == "u") & (F.col("size") == 0))
    before = F.coalesce(F.lag("_gone").over(key), F.lit(True))
    return rows.withColumn("_before", before).where("_gone and _before").select("book_id", "seq", "side", "price")


def flow_by_book(tape: DataFrame, points: DataFrame, updates_only: bool = False) -> DataFrame:
    """(book_id, arrivals, cancels, updates) of every book; 0.0 with a single point."""
    total = flow_rows(tape, points, updates_only).groupBy("book_id").agg(F.sum("arrivals").alias("a"), F.sum("cancels").alias("c"))
    all_books = points.select("book_id").distinct().join(total, "book_id", "left")
    a, c = F.coalesce("a", F.lit(0.0)), F.coalesce("c", F.lit(0.0))
    return all_books.select("book_id", a.alias("arrivals"), c.alias("cancels"), (a + c).alias("updates"))


def series_extent(kept: DataFrame) -> DataFrame:
    """(book_id, n_points, duration) of every series."""
    return kept.groupBy("book_id").agg(F.count("*").alias("n_points"), (F.max("ts") - F.min("ts")).alias("duration"))


def consecutive(kept: DataFrame) -> DataFrame:
    """(book_id, ts, next_ts) of neighbouring points: a point meets the one of the next
    rank, so no book is one window."""
    r = ranks.number(kept.select("book_id", "ts"), [F.col("book_id"), F.col("ts")], "_r")
    after = r.select("book_id", (F.col("_r") - 1).alias("_r"), F.col("ts").alias("next_ts"))
    return r.join(after, ["book_id", "_r"]).select("book_id", "ts", "next_ts")


def compare(old: DataFrame, new: DataFrame, keys: list[str], absent: str = "zero") -> DataFrame:
    """What turns the old levels into the new: keys, side, price, size, is_delete.

    Size 0.0 deletes. With absent='zero' a new level of size zero is no change (a
    delta); with absent='none' it is one (a diff).
    """
    o = old.select(*keys, "side", "price", F.col("size").alias("_old"), F.lit(True).alias("_was"))
    n = new.select(*keys, "side", "price", F.col("size").alias("_new"), F.lit(True).alias("_is"))
    both = o.join(n, [*keys, "side", "price"], "full_outer")
    gone = F.col("_is").isNull()
    changed = F.col("_new") != F.coalesce("_old", F.lit(0.0)) if absent == "zero" else F.col("_was").isNull() | (F.col("_new") != F.col("_old"))
    return both.where(gone | changed).select(*keys, "side", "price", F.coalesce("_new", F.lit(0.0)).alias("size"), gone.alias("is_delete"))


def in_diff_order(diff: DataFrame) -> DataFrame:
    """Bid upserts, bid deletes, ask upserts, ask deletes, each best first."""
    return diff.orderBy(F.desc("side"), "is_delete", sort_price()).select(side_long(F.col("side")).alias("side"), "price", "size")


def _delta_columns(rows: DataFrame, both: DataFrame) -> DataFrame:
    """Deltas (book_id, ts, side, price, size) gathered by point, over all points."""
    keys = ["book_id", "ts"]
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct(sort_price().alias("at"), "price", "size"))))
    many = lambda s: F.count(F.when(F.col("side") == s, 1))
    per = rows.groupBy(*keys).agg(side("b").alias("bids"), side("a").alias("asks"), many("b").alias("n_bids"), many("a").alias("n_asks"), F.sum("size").alias("qty"))
    flat = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_bids", "n_asks")]
    return both.join(per, keys, "left").select(*keys, flat("bids").alias("bids"), flat("asks").alias("asks"), F.coalesce("qty", F.lit(0.0)).alias("qty"), *zero)


def series_diff(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Per timestamp that both series have: (book_id, ts, n_bids, n_asks, qty) and the
    deltas as arrays of (price, size), best first; empty where nothing changes."""
    both = left[0].join(right[0], ["book_id", "ts"])
    keys = ["book_id", "ts"]
    a, b = (live.join(both, keys, "left_semi") for live in (left[1], right[1]))
    return _delta_columns(compare(a, b, keys), both)


def span_diff(left: Books, right: Books) -> DataFrame:
    """As series_diff, of books over one axis of points and without late ones.

    The spans of both series are spliced price by price into stretches of one pair of
    sizes; only stretches where the two differ are met with the points.
    """
    keys = ["book_id", "side", "price"]

    def changes(spans: DataFrame, name: str) -> DataFrame:
        """Where a span of one side begins (its size) and ends (null)."""
        edge = lambda at, size: F.struct(F.col(at).alias("no"), size.cast("double").alias("_size"))
        edges = F.array(edge("vf", F.col("size")), edge("vt", F.lit(None)))
        at = spans.select(*keys, F.inline(edges))
        return at.select(*keys, "no", *[F.lit(True if s == name else None).cast("boolean").alias(f"on_{s}") for s in "ab"], *[(F.col("_size") if s == name else F.lit(None).cast("double")).alias(s) for s in "ab"])

    # where a span ends and the next begins the beginning counts: an end has no size
    both = changes(left.spans, "a").union(changes(right.spans, "b")).groupBy(*keys, "no").agg(*[F.max(c).alias(c) for c in ("on_a", "on_b", "a", "b")])
    w = Window.partitionBy(*keys).orderBy("no")
    now = [F.last(F.when(F.col(f"on_{s}"), F.struct(s)), True).over(w)[s].alias(f"_{s}") for s in "ab"]
    pieces = both.select(*keys, F.col("no").alias("vf"), F.lead("no").over(w).alias("vt"), *now)
    gone = F.col("_b").isNull() & F.col("_a").isNotNull()
    changed = F.col("_b").isNotNull() & (F.col("_b") != F.coalesce("_a", F.lit(0.0)))
    unequal = pieces.where("vf < vt").where(gone | changed).select(*keys, F.coalesce("_b", F.lit(0.0)).alias("size"), "vf", "vt")
    return _delta_columns(met(left.points, unequal, left.most), left.kept)


def equal_sides(diff: DataFrame) -> DataFrame:
    """(book_id, ts, bids_equal, asks_equal) from a series diff: a side equals the other
    series' where nothing turns the one into the other. A new level of size zero is no
    change there."""
    return diff.select("book_id", "ts", (F.col("n_bids") == 0).alias("bids_equal"), (F.col("n_asks") == 0).alias("asks_equal"))
