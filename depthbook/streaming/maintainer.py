"""Live books: a stream of tape rows through keyed state.

State is a level: a map (side, price) -> size in the state store, one entry a level, and a
head with the last point, the best prices and what late points need (the largest timestamp
so far, snapshots so far). A micro-batch reads the levels that its rows touch the best of,
writes back those that they change, and holds one Arrow batch of rows and the NEAR best
levels of each side; the rest of a deep book stays in the store.

A book's rows must be met in order of arrival. The stream is dealt by book and sorted by
(book, seq, ord) within its tasks before the stateful operator, which needs the same
dealing and therefore adds no shuffle of its own; a book that is met out of order all the
same is an error, not a wrong result.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from depthbook.plans.shared import shared_dir

TOP = "book_id long, seq long, ts long, reset long, late boolean, bid double, bidq double, ask double, askq double"
LEVELS = "book_id long, seq long, ts long, reset long, late boolean, kind string, side string, price double, size double"
HEAD = "seq long, ts long, reset long, bid double, bidq double, ask double, askq double"

#: Levels of a side that a task knows by heart, at least.
NEAR = 64
#: Changed levels that wait to be written, at most.
WAITING = 10_000

OPTIONS = {
    # the order within a micro-batch is what is asked for; sorting an endless stream is not
    "spark.sql.streaming.unsupportedOperationCheck": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


class _Levels:
    """A book's levels: those in the store, and the changes that are not yet there."""

    def __init__(self, store, best: dict[str, tuple[float | None, float | None]], near: int | None):
        self.store, self.most, self.changed = store, near, {}
        # near: the best levels of a side; horizon: the worst price down to which all are
        # in it (None: no level is missing)
        self.near = {s: {p: q} if p is not None else {} for s, (p, q) in best.items()}
        self.horizon = {s: p for s, (p, _) in best.items()}

    @staticmethod
    def _rank(side: str, price: float) -> float:
        return -price if side == "b" else price

    def clear(self) -> None:
        self.store.clear()
        self.changed, self.near, self.horizon = {}, {"b": {}, "a": {}}, {"b": None, "a": None}

    def put(self, side: str, price: float, size: float | None) -> None:
        """Set a level; None deletes it."""
        self.changed[side, price] = size
        near, horizon = self.near[side], self.horizon[side]
        if size is None:
            near.pop(price, None)
        elif horizon is None or self._rank(side, price) <= self._rank(side, horizon):
            near[price] = size
            if self.most is not None and len(near) > 2 * self.most:
                kept = heapq.nsmallest(self.most, near, key=lambda p: self._rank(side, p))
                self.near[side], self.horizon[side] = {p: near[p] for p in kept}, kept[-1]
        if len(self.changed) > WAITING:
            self.flush()

    def flush(self) -> None:
        for key, size in self.changed.items():
            if size is None:
                self.store.removeKey(key)
            else:
                self.store.updateValue(key, (size,))
        self.changed = {}

    def _refill(self, side: str, n: int | None) -> None:
        """The n best levels of a side, from the store."""
        self.flush()
        own = ((key[1], value[0]) for key, value in self.store.iterator() if key[0] == side)
        if n is None:
            self.near[side], self.horizon[side] = dict(own), None
            return
        best = heapq.nsmallest(n + 1, own, key=lambda x: self._rank(side, x[0]))
        self.near[side], self.horizon[side] = dict(best[:n]), best[n - 1][0] if len(best) > n else None

    def all(self, side: str) -> dict[float, float]:
        if self.horizon[side] is not None:
            self._refill(side, None)
        return self.near[side]

    def best(self, side: str, over: dict[float, float | None]) -> tuple[float | None, float | None]:
        """The best price and size with the levels of `over` in place of one's own."""
        while True:
            near = self.near[side]
            own = min((self._rank(side, p) for p in near if p not in over), default=None) if over else min((self._rank(side, p) for p in near), default=None)
            if own is None and self.horizon[side] is not None:
                self._refill(side, self.most + len(over) if self.most is not None else None)
                continue
            there = [self._rank(side, p) for p, q in over.items() if q is not None]
            ranks = there if own is None else [own, *there]
            if not ranks:
                return None, None
            price = self._rank(side, min(ranks))  # its own inverse
            return price, over[price] if price in over else near[price]


class BookProcessor(StatefulProcessor):
    """Points of a book in order of arrival: its best prices after each, or all its levels.

    A point that is earlier than one before it is no base for later ones; an update of that
    kind stands on the book of the last record, a snapshot on nothing. In `latest` mode a
    snapshot forgets what came before it. With `delay`, a point earlier than the largest
    timestamp before it by more than that is late: it changes nothing, and comes out marked,
    with all its rows as they came where levels are put out.
    """

    def __init__(self, depth: bool, mode: str = "delta", delay: int | None = None, near: int = NEAR):
        self.depth, self.mode, self.delay, self.most = depth, mode, delay, None if depth else near

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "size double")
        self.head = handle.getValueState("head", HEAD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.head.get() if self.head.exists() else (None, None, 0, None, None, None, None)
        self.seq, self.ts, self.reset = was[0], was[1], was[2]
        self.book = _Levels(self.levels, {"b": (was[3], was[4]), "a": (was[5], was[6])}, self.most)
        self.point, out = None, []
        columns = [c.split()[0] for c in (LEVELS if self.depth else TOP).split(", ")]
        for frame in rows:
            for seq, ts, kind, side, price, size in zip(*(frame[c].tolist() for c in ("seq", "ts", "kind", "side", "price", "size"))):
                if self.point is None or seq != self.point[0]:
                    out += self._finish(key[0])
                    self._begin(seq, ts, kind)
                self._row(side, price, size)
            if out:  # of what this frame has finished
                yield pd.DataFrame(out, columns=columns)
                out = []
        out = self._finish(key[0])
        self.book.flush()
        best = (*self.book.best("b", {}), *self.book.best("a", {}))
        self.head.update((self.seq, self.ts, self.reset, *best))
        if out:
            yield pd.DataFrame(out, columns=columns)

    def _begin(self, seq: int, ts: int, kind: str) -> None:
        if self.seq is not None and seq < self.seq:
            raise ValueError(f"point {seq} comes after point {self.seq}")
        late = self.delay is not None and self.ts is not None and ts < self.ts - self.delay
        if not late and kind == "s":
            self.reset += 1
            if self.mode == "latest":
                self.ts = None
        record = not late and (self.ts is None or ts >= self.ts)
        if record:
            self.ts = ts
            if kind == "s":
                self.book.clear()
        self.seq, self.point = seq, (seq, ts, kind, record, late, [] if late else {"b": {}, "a": {}})

    def _row(self, side: str, price: float, size: float) -> None:
        _, _, kind, record, late, own = self.point
        if late:
            own.append((side, price, size))
            return
        size = None if kind == "u" and size == 0 else size
        if record:
            self.book.put(side, price, size)
        else:
            own[side][price] = size

    def _finish(self, book_id: int) -> list[tuple]:
        if self.point is None:
            return []
        seq, ts, kind, record, late, own = self.point
        self.point = None
        head = (book_id, seq, ts, self.reset, late)
        if late:
            return [(*head, kind, *row) for row in own] if self.depth else [(*head, *(None,) * 4)]
        alone = kind == "s" and not record
        if not self.depth:
            of = lambda s: _Levels(None, {s: (None, None)}, None).best(s, own[s]) if alone else self.book.best(s, own[s])
            return [(*head, *(0.0 if v is None else v for v in (*of("b"), *of("a"))))]
        rows = []
        for side in "ba":
            there = own[side] if alone else self.book.all(side) | own[side]
            rows += [(*head, kind, side, p, q) for p, q in there.items() if q is not None]
        return rows or [(*head, kind, None, None, None)]


def _live(tape: DataFrame, processor: BookProcessor, schema: str) -> DataFrame:
    rows = tape.withColumns({"seq": F.col("seq").cast("long"), "ts": F.col("ts").cast("long")})
    dealt = rows.repartition("book_id").sortWithinPartitions("book_id", "seq", "ord", "size")
    return dealt.groupBy("book_id").transformWithStateInPandas(processor, schema, "Append", "None")


def live_points(tape: DataFrame, mode: str = "delta", delay: int | None = None, near: int = NEAR) -> DataFrame:
    """(book_id, seq, ts, reset, late, bid, bidq, ask, askq) of every point of a streaming
    tape, in any order of timestamps.

    All rows of a point come in one micro-batch, and a book's points in order of arrival
    (seq), which files or offsets give. Late points (see BookProcessor) have no prices.
    """
    return _live(tape, BookProcessor(False, mode, delay, near), TOP)


def live_top(tape: DataFrame) -> DataFrame:
    """The top of book after every point of a streaming tape."""
    return live_points(tape).select("book_id", "seq", "ts", "bid", "bidq", "ask", "askq")


def live_levels(tape: DataFrame, mode: str = "delta", delay: int | None = None) -> DataFrame:
    """(book_id, seq, ts, reset, late, kind, side, price, size): all levels of every point;
    a point without a level has one row without a side. Late points are dead letters: their
    tape rows, as they came."""
    return _live(tape, BookProcessor(True, mode, delay), LEVELS)


def kept(points: DataFrame, mode: str = "delta") -> DataFrame:
    """What a series keeps of the rows that a stream has put out: the last arrival of each
    timestamp, in `latest` mode of those since the last snapshot; no late ones."""
    points = points.where("not late")
    if mode == "latest":
        points = points.join(points.groupBy("book_id").agg(F.max("reset").alias("reset")), ["book_id", "reset"], "left_semi")
    return points.join(points.groupBy("book_id", "ts").agg(F.max("seq").alias("seq")), ["book_id", "ts", "seq"], "left_semi")


@contextmanager
def _options(spark: SparkSession, options: dict[str, str]):
    """The session with some options, which are put back."""
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def start(stream: DataFrame, at: str, **options) -> StreamingQuery:
    """Start a live stream; its rows and its checkpoint go to the folder `at`, which a
    restart names again. Late rows have a folder of their own (late=true)."""
    sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/log").outputMode("append").trigger(**(options or {"availableNow": True}))
    with _options(stream.sparkSession, OPTIONS):
        return (sink.partitionBy("late") if "late" in stream.columns else sink).start(f"{at}/rows")


def run_available(stream: DataFrame, at: str | None = None) -> DataFrame:
    """Run a stream over all that its source has now; its output so far as a table.

    Without `at` the folder is a new one in that of spark.checkpoint.dir. With one, the
    stream goes on where its checkpoint there ends.
    """
    spark = stream.sparkSession
    at = at or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    start(stream, at).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows").select(*stream.columns)


def replay(tape: DataFrame, live, slices: int = 3) -> DataFrame:
    """A stored tape as a stream: `live` (a function of a streaming tape) over one slice of
    arrival numbers after the other, restarted from its checkpoint for each.

    Slices cut no point, so each comes whole in a micro-batch.
    """
    spark = tape.sparkSession
    at = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    lo, hi = tape.agg(F.min("seq"), F.max("seq")).first()
    if lo is None:
        return spark.createDataFrame([], live(tape.limit(0)).schema)
    edges = [lo + (hi + 1 - lo) * k // slices for k in range(slices + 1)]
    out = None
    for a, b in zip(edges, edges[1:]):
        tape.where((F.col("seq") >= a) & (F.col("seq") < b)).write.mode("append").parquet(f"{at}/tape")
        out = run_available(live(spark.readStream.schema(tape.schema).parquet(f"{at}/tape")), f"{at}/out")
    return out
