"""State reconstruction: the book at every point of a tape.

The points of a book are numbered in order of arrival. A level is valid on a span of
numbers, from the row that sets it to the next row of its price (or the next snapshot),
and a point's book is the spans that hold its number. Two joins find them, both equi joins
whose keys hold a bounded number of points however a book's points lie in time, so a hot
book is many keys:

* whole books (`live`): numbers are cut into chunks of CHUNK_POINTS, spans at the borders
  of chunks, and the range test is a residual;
* best prices (`tops`): numbers are cut into blocks, and in a block a span is the union of a
  few nodes of a tree over the numbers (FAN nodes of one level make one of the next), each
  node knows the best prices of the spans that have it, and a point asks the one node of
  each level that holds it. A live level costs one row more for each block.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthbook.plans import ranks
from depthbook.plans.shared import settle
from depthbook.schema import moment, sort_price
from depthbook.sources.tape import last_writes

#: Points in a chunk; nodes in a node of the next level (a power of two).
CHUNK_POINTS, FAN = 256, 8
#: Points of a task that makes whole books of them, about.
TASK_POINTS = 64 * CHUNK_POINTS
#: Rows of a task that joins or sorts single rows, about.
TASK_ROWS = 8 * TASK_POINTS
#: Points of a task that finds their best prices, about; levels of the tree of a block.
TASK_TOPS, HEIGHT = 2 * TASK_POINTS, 4
COLUMNS = ("book_id", "ts", "side", "price", "size")


def numbered(points: DataFrame, dense: bool = False) -> DataFrame:
    """Points with `no`, their number in their book in order of arrival, from 0, and the
    chunk of that number. `dense` promises that seq is that number."""
    return _numbered(points, dense)[0]


def _numbered(points: DataFrame, dense: bool = False) -> tuple[DataFrame, int]:
    """The numbered points, and how many there are."""
    if dense:
        return points.withColumn("no", F.col("seq")).withColumn("chunk", _part("seq", CHUNK_POINTS)), points.count()
    points = settle(points, "points")
    n = points.count()
    if n <= ranks.RANGE_ROWS:  # one window is no larger than that
        w = Window.partitionBy("book_id").orderBy("seq")
        p = points.withColumn("no", (F.row_number().over(w) - 1).cast("long"))
    else:
        r = ranks.number(points, [F.col("book_id"), F.col("seq")], "_r")
        # written, so that its size is known and the points of few books aren't dealt by book
        first = settle(r.groupBy("book_id").agg(F.min("_r").alias("_first")), "first")
        p = r.join(first, "book_id").withColumn("no", F.col("_r") - F.col("_first")).drop("_r", "_first")
    return p.withColumn("chunk", _part("no", CHUNK_POINTS)), n


def _part(no: str, width: int) -> Column:
    return F.floor(F.col(no) / width).cast("long")


def running(points: DataFrame, column: str, how: str, into: str, before: bool = False, by: tuple[str, ...] = ("book_id",)) -> DataFrame:
    """A running sum or max of `column` in arrival order, in two levels: inside a chunk,
    and over the chunks' totals, so no window holds a whole book's points.

    With `before` the point itself is left out (null where nothing came before).
    """
    f = {"sum": F.sum, "max": F.max}[how]
    inside = Window.partitionBy(*by, "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = points.groupBy(*by, "chunk").agg(f(column).alias("_t")).withColumn("_before", f("_t").over(earlier)).drop("_t")
    own = points.withColumn("_own", f(column).over(inside)).join(totals, [*by, "chunk"])
    both = F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0)) if how == "sum" else F.greatest("_own", "_before")
    return own.withColumn(into, both).drop("_own", "_before")


def place(points: DataFrame, mode: str = "delta") -> DataFrame:
    """Numbered points with epoch (snapshots among the records so far) and record.

    A record is a point that the next update builds on: one at or after every earlier
    timestamp. In `latest` mode a snapshot forgets what came before it; in `current` mode
    there is one book at a time, on which every update builds.
    """
    p = points
    if mode == "current":
        p = p.withColumns({"record": F.lit(True), "_s": (F.col("kind") == "s").cast("long")})
        return running(p, "_s", "sum", "epoch").drop("_s")
    if mode == "latest":
        p = running(p.withColumn("_s", (F.col("kind") == "s").cast("long")), "_s", "sum", "reset").drop("_s")
        p = running(p, "ts", "max", "_max", before=True, by=("book_id", "reset"))
    else:
        p = running(p, "ts", "max", "_max", before=True)
    p = p.withColumn("record", F.col("_max").isNull() | (F.col("ts") >= F.col("_max"))).drop("_max")
    p = p.withColumn("_s", (F.col("record") & (F.col("kind") == "s")).cast("long"))
    return running(p, "_s", "sum", "epoch").drop("_s")


def survivors(placed: DataFrame, mode: str = "delta") -> DataFrame:
    """The points a series keeps: the last arrival of each timestamp, in `latest` mode of
    those since the last snapshot, in `current` mode of all."""
    if mode == "current":
        return placed.join(placed.groupBy("book_id").agg(F.max("seq").alias("seq")), ["book_id", "seq"], "left_semi")
    if mode == "latest":
        last = placed.groupBy("book_id").agg(F.max("reset").alias("_last"))
        placed = placed.join(last, "book_id").where(F.col("reset") == F.col("_last")).drop("_last", "reset")
    return placed.join(placed.groupBy("book_id", "ts").agg(F.max("seq").alias("seq")), ["book_id", "ts", "seq"], "left_semi")


def in_time(points: DataFrame, start: Any = None, end: Any = None) -> DataFrame:
    """Rows within a time range, both ends inclusive, None open."""
    points = points.where(F.col("ts") >= moment(start)) if start is not None else points
    return points.where(F.col("ts") <= moment(end)) if end is not None else points


@dataclass(frozen=True)
class Books:
    """points: those kept, (book_id, ts, no, chunk, record). spans: (book_id, side, price,
    size, vf, vt), the numbers from vf to before vt. own: rows of points that are no
    records, on top of the spans (updates) or alone (snapshots). most: no number is as
    large. rows: of the tape they were made of, which has no fewer spans."""

    points: DataFrame
    spans: DataFrame
    own: DataFrame | None = None
    most: int = 1
    rows: int = 0

    @property
    def kept(self) -> DataFrame:
        return self.points.select("book_id", "ts")


def _spans(rows: DataFrame, ends: DataFrame | None, bounds: DataFrame, n: int) -> DataFrame:
    """Spans of n record rows (book_id, seq, no, epoch, side, price, size, kind) within each
    book's bounds (book_id, lo, hi); a book without bounds has none.

    Tombstones end the level before them and then go; zero sizes of snapshots stay.
    """
    # dealt by a hash of the key: a window normalises doubles and folds an epoch that is
    # always 0, so rows dealt by the key itself would be dealt again, by shuffle partitions
    key = Window.partitionBy("_level", "book_id", "epoch", "side", "price").orderBy("seq")
    r = rows.join(bounds, "book_id").where("no < hi").withColumn("_level", F.xxhash64("book_id", "epoch", "side", "price"))
    if n > ranks.RANGE_ROWS:
        r = r.repartition(_tasks(r, n, TASK_ROWS), "_level")
    r = r.withColumn("vt", F.lead("no").over(key)).where("not (kind = 'u' and size = 0)")
    if ends is not None:
        r = r.join(ends, ["book_id", "epoch"], "left").withColumn("vt", F.coalesce("vt", "epoch_end"))
    r = r.withColumn("vt", F.least(F.coalesce("vt", "hi"), "hi"))
    return r.select("book_id", "side", "price", "size", F.greatest("no", "lo").alias("vf"), "vt").where("vf < vt")


def _points_of(tape: DataFrame, n: int) -> DataFrame:
    """The points of a tape of n rows without empty batches; of many rows dealt before they
    are told apart, as a task that reads a part of the tape may read any number."""
    rows = tape.select("book_id", "seq", "ts", "kind")
    return (rows.repartition(_tasks(rows, n, TASK_ROWS), "book_id", "seq") if n > ranks.RANGE_ROWS else rows).distinct()


def books(tape: DataFrame, points: DataFrame | None = None, mode: str = "delta", in_order: bool = False, collapsed: bool = False, dense: bool = False, start: Any = None, end: Any = None, axis: DataFrame | None = None) -> Books:
    """The books of a tape at the points (none given: those of its rows) that its series
    keep, of a time range if one is given, or at exactly the points (book_id, ts) of an `axis`: what no such point can see
    is left out before anything is joined.

    `in_order` promises that arrival and timestamp order agree, with unique timestamps
    and updates only; it saves the passes that find records and epochs. `collapsed`
    promises one tape row per (batch, side, price). Of an axis the points that the tape has
    are kept, and they alone are numbered.
    """
    rows = tape if collapsed else last_writes(tape)
    rows = rows.select("book_id", "seq", "side", "price", "size", "kind")
    many = tape.count()
    p, n = _numbered(_points_of(tape, many) if points is None else points, dense)
    many = max(n, many)
    placed = p.withColumns({"epoch": F.lit(0), "record": F.lit(True)}) if in_order else place(p, mode)
    if n > ranks.RANGE_ROWS:  # read several times
        placed = settle(placed, "placed")
    kept = in_time(placed if in_order else survivors(placed, mode), start, end)
    if axis is not None:
        # numbers that count the axis' points alone: between two of them nothing is seen
        flag = lambda df, keys: df.select(*keys, F.lit(1).alias("_on")).distinct()
        if in_order and start is None and end is None:  # every point is kept
            on = placed.join(flag(axis, ["book_id", "ts"]), ["book_id", "ts"], "left")
        else:
            kept = kept.join(axis.select("book_id", "ts").distinct(), ["book_id", "ts"], "left_semi")
            on = placed.join(flag(kept, ["book_id", "seq"]), ["book_id", "seq"], "left")
        on = on.withColumn("_on", F.coalesce("_on", F.lit(0)))
        placed = running(on, "_on", "sum", "_upto").withColumn("no", F.col("_upto") - F.col("_on")).withColumn("chunk", _part("no", CHUNK_POINTS)).drop("_upto")
        kept, placed = placed.where("_on = 1").drop("_on"), placed.drop("_on")
    ends = None if in_order else placed.where("record and kind = 's'").select("book_id", (F.col("epoch") - 1).alias("epoch"), F.col("no").alias("epoch_end"))
    at = placed.select("book_id", "seq", "no", "epoch", "record")
    if n > ranks.RANGE_ROWS:  # tasks of a bounded size, which compressed shuffles do not tell
        rows, at = (x.repartition(_tasks(x, many, TASK_ROWS), "book_id", "seq") for x in (rows, at))
    elif many > ranks.RANGE_ROWS:  # many rows of few points
        at = F.broadcast(at)
    marked = rows.join(at, ["book_id", "seq"])
    own = None if in_order else marked.where("not record").join(kept.select("book_id", "seq", "ts", "chunk"), ["book_id", "seq"])
    # a late snapshot stands on nothing
    no = F.col("no") if in_order else F.when(F.col("record") | (F.col("kind") == "u"), F.col("no"))
    kept = kept.select("book_id", "ts", no.alias("no"), "chunk", "record")
    return Books(kept, _spans(marked.where("record"), ends, _bounds(kept, many), many), own, n, many)


def _bounds(kept: DataFrame, n: int) -> DataFrame:
    """The numbers that a book's points lie in; of many points or rows written, as its size is then
    known and spans of few books are not dealt by book."""
    bounds = kept.groupBy("book_id").agg(F.min("no").alias("lo"), (F.max("no") + 1).alias("hi"))
    return settle(bounds, "bounds") if n > ranks.RANGE_ROWS else bounds


def between(b: Books, start: Any = None, end: Any = None) -> Books:
    """The books of a time range, both ends inclusive, None open: its points and what of
    the spans they can see."""
    kept = in_time(b.points, start, end)
    seen = b.spans.join(_bounds(kept, max(b.most, b.rows)), "book_id").where("vf < hi and lo < vt")
    seen = seen.select("book_id", "side", "price", "size", F.greatest("vf", "lo").alias("vf"), F.least("vt", "hi").alias("vt"))
    return Books(kept, seen, None if b.own is None else in_time(b.own, start, end), b.most, b.rows)


def _tasks(df: DataFrame, n: int, rows: int) -> int:
    """Tasks for n points or rows, of `rows` each or, where they are few, all that there are:
    what joins them makes many rows of each, which their own size does not tell."""
    return max(-(-n // rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def met(points: DataFrame, spans: DataFrame, n: int) -> DataFrame:
    """(book_id, chunk, ts, side, price, size) of each of n points and each span that holds it."""
    first, last = _part("vf", CHUNK_POINTS), F.floor((F.col("vt") - 1) / CHUNK_POINTS).cast("long")
    cut = spans.withColumn("chunk", F.explode(F.sequence(first, last)))
    # dealt by chunk once: what follows by point needs no shuffle. A broadcast of the points,
    # small as they may be, would leave all that is made of them to the few tasks of the spans
    pairs = points.select("book_id", "chunk", "no", "ts").repartition(_tasks(points, n, TASK_POINTS), "book_id", "chunk").hint("merge").join(cut, ["book_id", "chunk"]).where("vf <= no and no < vt")
    return pairs.select("book_id", "chunk", "ts", "side", "price", "size")


def live(b: Books) -> DataFrame:
    """Live levels (book_id, chunk, ts, side, price, size) of every point; the rows of a
    point have one chunk, by which they are dealt."""
    if b.own is None:
        return met(b.points, b.spans, b.most)
    return met(b.points.where("record"), b.spans, b.most).unionByName(_late(b))


def _late(b: Books) -> DataFrame:
    """Live levels of the points that are no records: the last record's, under their own."""
    base = met(b.points.where("not record and no is not null"), b.spans, b.most)
    base = base.join(b.own.select("book_id", "ts", "side", "price"), ["book_id", "ts", "side", "price"], "left_anti")
    own = b.own.where("not (kind = 'u' and size = 0)")
    return base.unionByName(own.select(*base.columns))


def snapshots_alone(points: DataFrame) -> bool:
    return not points.where("kind <> 's'").limit(1).count()


def live_levels(tape: DataFrame, points: DataFrame, mode: str = "delta", in_order: bool = False, collapsed: bool = False, dense: bool = False) -> tuple[DataFrame, DataFrame]:
    """(points kept, live levels (book_id, ts, side, price, size)) of a tape; see books()."""
    if not in_order and snapshots_alone(points):
        # every point is its own rows
        kept = points.join(points.groupBy("book_id", "ts").agg(F.max("seq").alias("seq")), ["book_id", "ts", "seq"], "left_semi")
        if mode != "delta":
            kept = points.join(points.groupBy("book_id").agg(F.max("seq").alias("seq")), ["book_id", "seq"], "left_semi")
        rows = tape if collapsed else last_writes(tape)
        return kept.select("book_id", "ts"), rows.join(kept.select("book_id", "seq"), ["book_id", "seq"], "left_semi").select(*COLUMNS)
    b = books(tape, points, mode, in_order, collapsed, dense)
    return b.kept, live(b).select(*COLUMNS)


def point_keys(df: DataFrame) -> list[str]:
    """What tells points apart: with their chunk, so that rows dealt by it stay there."""
    return ["book_id", *(["chunk"] if "chunk" in df.columns else []), "ts"]


def levels(live: DataFrame) -> DataFrame:
    """Live levels numbered best first: (book_id, ts, side, level, price, size)."""
    keys = point_keys(live)
    w = Window.partitionBy(*keys, "side").orderBy(sort_price())
    return live.select(*keys, "side", (F.row_number().over(w) - 1).alias("level"), "price", "size")


def _best() -> list[Column]:
    bid, ask = F.col("side") == "b", F.col("side") == "a"
    return [
        F.max(F.when(bid, F.col("price"))).alias("bid"),
        F.max_by(F.when(bid, F.col("size")), F.when(bid, F.col("price"))).alias("bidq"),
        F.min(F.when(ask, F.col("price"))).alias("ask"),
        F.min_by(F.when(ask, F.col("size")), F.when(ask, F.col("price"))).alias("askq"),
    ]


def _filled() -> list[Column]:
    return [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("bid", "bidq", "ask", "askq")]


def top(kept: DataFrame, live: DataFrame) -> DataFrame:
    """Best price and size of both sides of every point kept; 0.0 for an empty side."""
    best = live.groupBy("book_id", "ts").agg(*_best())
    return kept.join(best, ["book_id", "ts"], "left").select("book_id", "ts", *_filled())


def _in_nodes(spans: DataFrame, height: int) -> DataFrame:
    """Rows with nodes (level, node) of a tree of `height` levels: spans with those that
    each is the union of, of each level those that no node of the next level covers, and
    points (rows with a number) with the one node of each level that holds them."""
    bits = FAN.bit_length() - 1
    by_level = spans.withColumn("level", F.explode(F.array(*map(F.lit, range(height)))))
    down = lambda c, k: F.expr(f"shiftright({c}, {bits} * ({k}))")
    up = lambda c, k: -F.expr(f"shiftright(-{c}, {bits} * ({k}))")
    ends = {"_a": up("vf", "level"), "_b": down("vt", "level"), "_c": up("vf", "level + 1") * FAN, "_d": down("vt", "level + 1") * FAN}
    run = lambda a, b: F.when(F.col(a) < F.col(b), F.sequence(F.col(a), F.col(b) - 1)).otherwise(F.array().cast("array<long>"))
    covered = (F.col("_c") < F.col("_d")) & (F.col("level") < height - 1)
    asks = F.array(down("no", "level"))
    node = F.explode(F.when(F.col("no").isNotNull(), asks).when(covered, F.concat(run("_a", "_c"), run("_d", "_b"))).otherwise(run("_a", "_b")))
    return by_level.withColumns(ends).where("no is not null or _a < _b").withColumn("node", node).drop(*ends)


def _nulls(like: DataFrame, *names: str) -> list[Column]:
    return [F.lit(None).cast(like.schema[n].dataType).alias(n) for n in names]


def tops(b: Books) -> DataFrame:
    """Best price and size of both sides of every point kept; 0.0 for an empty side.

    Costs a few rows for each span and one for each point and level of the tree, and a cut
    of each live level at the borders of blocks of FAN ** HEIGHT numbers, fewer where a
    point has many rows. Points and spans are shuffled once, by block, so a task holds about
    TASK_TOPS points or spans however many there are.
    """
    height = HEIGHT
    while height > 1 and b.rows >= b.most * FAN ** (HEIGHT + 1 - height):
        height -= 1
    width = FAN**height
    record = b.points.where("record") if b.own is not None else b.points
    points = record.select("book_id", _part("no", width).alias("block"), "no", "ts", *_nulls(b.spans, "side", "price", "size", "vf", "vt"))
    cut = b.spans.withColumn("block", F.explode(F.sequence(_part("vf", width), F.floor((F.col("vt") - 1) / width).cast("long"))))
    edge = F.col("block") * width
    cut = cut.select("book_id", "block", *_nulls(points, "no", "ts"), "side", "price", "size", F.greatest("vf", edge).alias("vf"), F.least("vt", edge + width).alias("vt"))
    # dealt by block once: all that follows has the block among its keys
    dealt = points.unionByName(cut).repartition(_tasks(points, max(b.most, b.rows), TASK_TOPS), "book_id", "block")
    levels = _in_nodes(dealt.withColumns({"vf": F.coalesce("vf", "no"), "vt": F.coalesce("vt", F.col("no") + 1)}), height)
    by_node = levels.groupBy("book_id", "block", "level", "node", "no", "ts").agg(*_best())
    w = Window.partitionBy("book_id", "block", "level", "node")
    bids, asks = F.max("bid").over(w), F.min("ask").over(w)
    sizes = F.max_by("bidq", "bid").over(w), F.min_by("askq", "ask").over(w)
    asked = by_node.select("book_id", "block", "no", "ts", bids.alias("bid"), sizes[0].alias("bidq"), asks.alias("ask"), sizes[1].alias("askq")).where("no is not null")
    best = asked.groupBy("book_id", "block", "no", "ts").agg(F.max("bid").alias("bid"), F.max_by("bidq", "bid").alias("bidq"), F.min("ask").alias("ask"), F.min_by("askq", "ask").alias("askq"))
    best = best.select("book_id", "ts", *_filled())
    return best if b.own is None else best.unionByName(top(b.points.where("not record").select("book_id", "ts"), _late(b)))
