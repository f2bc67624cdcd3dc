"""Book and BookSeries: the object API over tapes.

Mutators extend a tape held as literal batches or append DataFrames; everything read
is a DataFrame built from the tape when it is asked for. A single book's answers are
scalars; a series' are DataFrames or, through to_pd and to_np, local tables.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import replace
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depthbook.functions import metrics
from depthbook.operators import depth, flow
from depthbook.plans import state
from depthbook.plans.shared import settle
from depthbook.schema import INF, moment, sort_price
from depthbook.sources import sinks
from depthbook.sources.tape import from_batches

_SIDES = {"b": "b", "bid": "b", "a": "a", "ask": "a"}


def _side(side: str) -> str:
    if side not in _SIDES:
        raise ValueError(f"side must be b, bid, a or ask, not {side!r}")
    return _SIDES[side]


class Accessor:
    """One measure by level: book.bid[2]; by itself it stands for level 0."""

    def __init__(self, book: Book, get):
        self.book, self.get = book, get

    def __getitem__(self, i: int) -> float:
        return self.get(i)

    def __eq__(self, other: Any) -> bool:
        return self[0] == (other[0] if isinstance(other, Accessor) else other)

    def __float__(self) -> float:
        return float(self[0])

    def __repr__(self) -> str:
        return str(self[0])


class SideAccessor(Accessor):
    def __init__(self, book: Book, side: str, what: str):
        self.side = side
        super().__init__(book, lambda i: book._at(side, i, what))

    def __eq__(self, other: Any) -> bool:
        if isinstance(other, SideAccessor):  # whole sides
            return self.book._rows(self.side) == other.book._rows(other.side)
        return self[0] == other


class Book:
    """A single limit order book."""

    def __init__(self, spark: SparkSession, name: str | None = None, tick_size: float = 1, *, bids=None, asks=None, compat: bool = False):
        self.compat = compat  # an unknown side is an ask in set_updates and nothing in update
        self.spark, self.name, self.tick_size = spark, name or f"book-{id(self)}", tick_size
        self.timestamp: Any = int(time.time() * 1000)
        self._batches: list[dict] = []
        self._frame: DataFrame | None = None
        if bids or asks:
            self._snapshot(bids or [], asks or [])

    def __repr__(self) -> str:
        return f"<Book[{self.name}]>"

    # state

    def _snapshot(self, bids, asks) -> None:
        self._frame = None
        self._batches = [{"kind": "s", "ts": 0, "rows": [("b", p, q) for p, q in bids] + [("a", p, q) for p, q in asks]}]

    def set_snapshot(self, bids, asks, timestamp=0) -> None:
        self._snapshot(bids, asks)
        self.timestamp = timestamp

    def set_updates(self, updates, timestamp=0) -> None:
        """Absolute sizes, in order; size 0 deletes; an unknown side is an error."""
        side = (lambda s: _SIDES.get(s, "a")) if self.compat else _side
        self._batches.append({"kind": "u", "ts": 0, "rows": [(side(s), p, q) for s, p, q in updates]})
        if timestamp != 0:
            self.timestamp = timestamp

    def update(self, side, price, size, timestamp=0) -> None:
        if not self.compat or side in _SIDES:
            self.set_updates([(side, price, size)], timestamp)

    def delete(self, side, price) -> bool:
        """Delete a level; whether it was there."""
        s = _side(side)
        there = bool(self.levels().where((F.col("side") == s) & (F.col("price") == float(price))).limit(1).count())
        if there:
            self.set_updates([(s, price, 0)])
        return there

    def levels(self) -> DataFrame:
        """side, level, price, size: the last write of every price."""
        if self._frame is not None and not self._batches:
            rows = self._frame
        else:
            tape, _ = from_batches(self.spark, self._batches)
            if self._frame is not None:
                base = self._frame.select(F.lit(0).alias("book_id"), F.lit(-1).alias("seq"), F.lit(0).alias("ord"), F.lit(0).alias("ts"), F.lit("s").alias("kind"), "side", "price", "size")
                tape = tape.unionByName(base)
            w = Window.partitionBy("side", "price").orderBy(F.desc("seq"), F.desc("ord"))
            rows = tape.withColumn("_n", F.row_number().over(w)).where("_n = 1 and not (kind = 'u' and size = 0)")
        w = Window.partitionBy("side").orderBy(sort_price())
        return rows.select("side", (F.row_number().over(w) - 1).alias("level"), "price", "size")

    def _keyed(self) -> DataFrame:
        return self.levels().withColumn("book_id", F.lit(0)).withColumn("ts", F.lit(0))

    def _one(self, column) -> Any:
        return depth.with_best(depth.with_depth(self._keyed())).agg(column.alias("x")).first()[0]

    def _at(self, side: str, i: int, what: str) -> float:
        if i < 0 and not self._one(F.count(F.when(F.col("side") == side, 1))):
            raise IndexError("an empty side has no worst level")
        return self._one(metrics.at_level(side, i, what))

    def _rows(self, side: str) -> list[tuple[float, float]]:
        return [tuple(r) for r in self.levels().where(F.col("side") == side).orderBy("level").select("price", "size").collect()]

    def _top(self, column) -> Any:
        kept = self.spark.range(1).select(F.lit(0).alias("book_id"), F.lit(0).alias("ts"))
        return state.top(kept, self._keyed()).select(column).first()[0]

    # metrics

    bid = property(lambda s: SideAccessor(s, "b", "price"))
    ask = property(lambda s: SideAccessor(s, "a", "price"))
    bidq = property(lambda s: SideAccessor(s, "b", "size"))
    askq = property(lambda s: SideAccessor(s, "a", "size"))
    vi = property(lambda s: Accessor(s, lambda i: 0.0 if i < 0 else s._one(metrics.volume_imbalance(i))))
    spread = property(lambda s: s._top(metrics.spread()))
    spread_tick = property(lambda s: s._top(metrics.spread_tick(s.tick_size)))
    spread_rel = property(lambda s: s._top(metrics.spread_rel()))
    midprice = property(lambda s: s._top(metrics.midprice()))
    vw_midprice = property(lambda s: s._top(metrics.vw_midprice()))

    def check(self) -> bool:
        return self._top(metrics.check())

    def len_in_tick(self, side: str, price: float) -> float:
        x = self._top(metrics.ticks_from_best(_side(side), float(price), float(self.tick_size)))
        return x if x == INF else int(x)

    def aggq(self, side: str, nlevel: int | None = None, ticks: float | None = None, price: float | None = None) -> float:
        s = _side(side)
        if not self._one(F.count(F.when(F.col("side") == s, 1))):
            return 0.0
        if nlevel is not None:
            return self._one(metrics.aggq_nlevel(s, nlevel))
        if ticks is not None:
            return self._one(metrics.aggq_ticks(s, ticks, self.tick_size))
        if price is not None:
            return self._one(metrics.aggq_price(s, price))
        raise ValueError("give nlevel, ticks or price")

    def get_slippage(self, volume: float, side: str = "midprice") -> float:
        if volume <= 0 or side == "midprice":
            return 0.0
        kept, live = self.spark.range(1).select(F.lit(0).alias("book_id"), F.lit(0).alias("ts")), self._keyed()
        return depth.slippage(kept, live, state.top(kept, live), side, volume).first()["slippage"]

    # comparison

    def get_delta(self, bids, asks, timestamp=0) -> tuple[list, list]:
        """What changes from this book to the given one, which then replaces it."""
        old = self.levels()
        new = Book(self.spark, bids=bids, asks=asks)
        rows = flow.compare(old, new.levels(), []).orderBy(sort_price()).collect()
        self._snapshot(bids, asks)
        if timestamp != 0:
            self.timestamp = timestamp
        return tuple([(r["price"], r["size"]) for r in rows if r["side"] == s] for s in "ba")

    def diff(self, other: Book) -> list[tuple[str, float, float]]:
        return [tuple(r) for r in flow.in_diff_order(flow.compare(self.levels(), other.levels(), [], "none")).collect()]

    # exports

    def _export(self, side: str | None, nlevels: int | None) -> DataFrame:
        return depth.side_levels(self.levels(), side, nlevels).orderBy(F.desc("side"), "level")

    def to_np(self, side: str | None = None, nlevels: int | None = None):
        one = side in ("b", "a")
        rows = self._export(side, nlevels)
        return sinks.to_numpy(rows.select("price", "size") if one else rows.select("side", "price", "size"), one)

    def _table(self, side: str | None, nlevels: int | None) -> DataFrame:
        rows = self._export(side, nlevels)
        return rows.select("price", "size") if side in ("b", "a") else rows.select("price", "size", "side")

    def to_pd(self, side: str | None = None, nlevels: int | None = None):
        return sinks.to_pandas(self._table(side, nlevels))

    def to_csv(self, path: str, side: str | None = None, nlevels: int | None = None) -> None:
        sinks.write_csv(self._table(side, nlevels), path, single=True)

    def to_xlsx(self, path: str, side: str | None = None, nlevels: int | None = None) -> None:
        sinks.write_xlsx(self._table(side, nlevels), path)

    def to_parquet(self, path: str, side: str | None = None, nlevels: int | None = None) -> None:
        sinks.write_parquet(self._table(side, nlevels), path)


class BookSeries:
    """Books by timestamp. `strict` refuses updates at a timestamp that is there. Mode
    `latest` keeps the books since the last snapshot, `current` the last one alone. With
    `compat` updates of an unknown side are nothing instead of an error."""

    def __init__(self, spark: SparkSession, name: str | None = None, tick_size: float = 1, mode: str = "delta", strict: bool = False, compat: bool = False):
        self.compat = compat
        self.spark, self.name, self.tick_size, self.strict = spark, name or f"series-{id(self)}", tick_size, strict
        self._mode, self._fixed = mode, False
        self._batches: list[dict] = []
        self._held: tuple[DataFrame, DataFrame] | None = None
        self._books: state.Books | None = None
        self._tops: DataFrame | None = None

    mode = property(lambda s: s._mode)

    def __repr__(self) -> str:
        return f"<BookSeries[{self.name}] mode={self.mode} snapshots={self.len}>"

    @staticmethod
    def of_tape(tape: DataFrame, points: DataFrame, tick_size: float = 1, mode: str = "delta") -> BookSeries:
        """A series over a tape table of any size. Its points and spans are written once, and
        what is asked for is made of them."""
        s = BookSeries(tape.sparkSession, tick_size=tick_size, mode=mode)
        b = state.books(tape, points, mode)
        b = replace(b, points=settle(b.points, "kept"), spans=settle(b.spans, "spans"), own=settle(b.own, "own"))
        if not b.points.where("not record").limit(1).count():
            b = replace(b, own=None)
        return s._over(b)

    def _over(self, b: state.Books) -> BookSeries:
        self._books, self._held, self._fixed = b, (b.kept, state.live(b).drop("chunk")), True
        return self

    def _add(self, kind: str, rows: list, timestamp: Any) -> None:
        if self._fixed:
            raise TypeError("a series over a table or a slice is read only")
        self._batches.append({"kind": kind, "ts": timestamp, "rows": rows})
        self.release()

    def release(self) -> None:
        """Let go of the frames that are kept in memory; they are made again when needed."""
        if self._held is not None and not self._fixed:
            for f in self._held:
                f.unpersist()
            self._held = None

    def _known(self) -> set:
        known: set = set()
        for b in self._batches:
            known = {b["ts"]} if self.mode == "current" or self.mode == "latest" and b["kind"] == "s" else known | {b["ts"]}
        return known

    def set_snapshot(self, bids, asks, timestamp=0, force: bool = False) -> None:
        if self.mode == "delta" and not force and timestamp in self._known():
            raise ValueError(f"there is a book at {timestamp}")
        self._add("s", [("b", p, q) for p, q in bids] + [("a", p, q) for p, q in asks], timestamp)

    def set_updates(self, updates, timestamp=0) -> None:
        if self.strict and timestamp in self._known():
            raise ValueError(f"there is a book at {timestamp}")
        known = [u for u in updates if u[0] in _SIDES] if self.compat else updates
        self._add("u", [(_side(s), p, q) for s, p, q in known], timestamp)

    def update(self, side, price, size, timestamp=0) -> None:
        self.set_updates([(side, price, size)], timestamp)

    def _frames(self) -> tuple[DataFrame, DataFrame]:
        if self._held is None:
            whole = all(isinstance(b["ts"], int) for b in self._batches)
            # other timestamps are ordered by place in the sorted list, and shown as given
            names = sorted({b["ts"] for b in self._batches})
            batches = self._batches if whole else [b | {"ts": names.index(b["ts"])} for b in self._batches]
            tape, points = from_batches(self.spark, batches)
            kept, live = state.live_levels(tape, points, self.mode, dense=True)
            if not whole:
                shown = self.spark.createDataFrame([(Decimal(i), float(t)) for i, t in enumerate(names)], "ts decimal(38,0), _ts double")
                kept, live = (f.join(F.broadcast(shown), "ts").withColumn("ts", F.col("_ts")).drop("_ts") for f in (kept, live))
            # literal batches are small, and every access reads them
            self._held = kept.cache(), live.cache()
        return self._held

    kept = property(lambda s: s._frames()[0])
    live = property(lambda s: s._frames()[1])

    def levels(self) -> DataFrame:
        # of a table dealt by chunk, which the ranks of a point's levels keep
        return state.levels(state.live(self._books) if self._books else self.live).drop("chunk")

    def top(self) -> DataFrame:
        if self._books and self._tops is None:  # every property of a table reads it
            self._tops = settle(state.tops(self._books), "tops")
        return self._tops if self._books else state.top(self.kept, self.live)

    # access

    @property
    def timestamps(self) -> list:
        return [self._plain(r[0]) for r in self.kept.select("ts").distinct().orderBy("ts").collect()]

    @staticmethod
    def _plain(ts: Any) -> Any:
        return ts if isinstance(ts, float) else int(ts)

    def _book(self, ts: Any) -> Book:
        b = Book(self.spark, f"{self.name}@{ts}", self.tick_size)
        b.timestamp, b._frame = ts, depth.at_moment(self.live, ts).select("side", "price", "size")
        return b

    def get_at_timestamp(self, timestamp: Any) -> Book | None:
        return self._book(timestamp) if timestamp in self else None

    def get_range(self, start: Any = None, end: Any = None) -> BookSeries:
        """Both ends inclusive; None leaves an end open."""
        out = BookSeries(self.spark, f"{self.name}_range", self.tick_size, self.mode)
        if self._books:
            return out._over(state.between(self._books, start, end))
        out._fixed, out._held = True, tuple(depth.time_slice(f, start, end) for f in self._frames())
        return out

    def __getitem__(self, at: Any) -> Book | BookSeries | None:
        return self.get_range(at.start, at.stop) if isinstance(at, slice) else self.get_at_timestamp(at)

    def __contains__(self, timestamp: Any) -> bool:
        return bool(depth.at_moment(self.kept, timestamp).limit(1).count())

    def __iter__(self) -> Iterator[Book]:
        return (self._book(t) for t in self.timestamps)

    def __len__(self) -> int:
        return self.kept.count()

    len = property(__len__)

    @property
    def len_ts(self) -> Any:
        lo, hi, n = self.kept.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
        return self._plain(hi - lo) if n > 1 else 0

    # series, as DataFrames (ts, value) in time order

    def _series(self, name: str, column, start: Any = None, end: Any = None) -> DataFrame:
        return depth.time_slice(self.top(), start, end).orderBy("ts").select("ts", column.alias(name))

    def spread_ts(self, start=None, end=None) -> DataFrame:
        return self._series("spread", metrics.spread(), start, end)

    def midprice_ts(self, start=None, end=None) -> DataFrame:
        return self._series("midprice", metrics.midprice_raw(), start, end)

    def bid_ts(self, start=None, end=None) -> DataFrame:
        return self._series("bid", F.col("bid"), start, end)

    def ask_ts(self, start=None, end=None) -> DataFrame:
        return self._series("ask", F.col("ask"), start, end)

    spread = property(spread_ts)
    midprice = property(midprice_ts)
    bid = property(bid_ts)
    ask = property(ask_ts)
    vw_midprice = property(lambda s: s._series("vw_midprice", metrics.vw_midprice_raw()))
    vi = property(lambda s: s._series("vi", metrics.vi_raw()))

    # flow: each point's rows against the point before, so any arrival order is right

    def _flow(self) -> tuple[float, float]:
        pairs = flow.consecutive(self.kept)
        old = self.live.join(pairs, ["book_id", "ts"]).select("book_id", F.col("next_ts").alias("ts"), "side", "price", F.col("size").alias("_old"))
        after = pairs.select("book_id", F.col("next_ts").alias("ts"))
        both = old.join(self.live.join(after, ["book_id", "ts"]), ["book_id", "ts", "side", "price"], "full_outer")
        d = F.coalesce("size", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0))
        a, c = both.agg(F.sum(F.greatest(d, F.lit(0.0))), F.sum(F.greatest(-d, F.lit(0.0)))).first()
        return a or 0, c or 0

    arrival_frequency = property(lambda s: s._flow()[0])
    cancel_frequency = property(lambda s: s._flow()[1])

    def update_frequency(self) -> float:
        return sum(self._flow())

    def diff(self, other: BookSeries) -> dict[Any, tuple[list, list]]:
        rows = flow.series_diff(self._frames(), other._frames()).orderBy("ts").collect()
        return {self._plain(r["ts"]): ([tuple(x) for x in r["bids"]], [tuple(x) for x in r["asks"]]) for r in rows}

    # exports

    def table(self, start: Any = None, end: Any = None) -> DataFrame:
        return depth.export(self.levels(), start, end).drop("book_id")

    def to_pd(self, start=None, end=None):
        return sinks.to_pandas(self.table(start, end))

    def to_np(self, start=None, end=None):
        import numpy as np

        rows = sinks.to_numpy(self.table(start, end))
        return rows if len(rows) else np.array([])

    def to_csv(self, path: str, start=None, end=None) -> None:
        sinks.write_csv(self.table(start, end), path, single=True)

    def to_xlsx(self, path: str, start=None, end=None) -> None:
        sinks.write_xlsx(self.table(start, end), path)

    def to_parquet(self, path: str, start=None, end=None) -> None:
        sinks.write_parquet(self.table(start, end), path)

