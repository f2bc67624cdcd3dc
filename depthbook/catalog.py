"""Registered queries and, beside each, the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthbook.engine import BookSeries
from depthbook.functions import metrics
from depthbook.operators import depth, flow
from depthbook.operators.ordered import Ordered
from depthbook.plans import state
from depthbook.plans.shared import settle, shared_dir
from depthbook.sources import sinks
from depthbook.sources.tape import STEP, events_tape, mixed_tape, orders_tape, points_of, refused, table
from depthbook.streaming import maintainer

QUERIES: dict = {}
ORACLES: dict = {}

TICK = 0.5
#: Timestamps of the look-up and slice queries, from the tables themselves.
RANGE = ("2024-01-05", "2024-01-20")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# The books of the events tape (incremental) and of the orders tape (snapshots)


def _tape(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    return events_tape(table(spark, sf_dir, "events"), shift)


def _books(spark: SparkSession, sf_dir: str, shift: int = 0, **options) -> state.Books:
    tape = _tape(spark, sf_dir, shift)
    return state.books(tape, in_order=True, collapsed=True, **options)


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = _books(spark, sf_dir)
    return b.kept, state.live(b)


def _top(spark: SparkSession, sf_dir: str, shift: int = 0, **options) -> DataFrame:
    return state.tops(_books(spark, sf_dir, shift, **options))


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return orders_tape(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def _live(shift: int = 0) -> str:
    return f"""tape AS (SELECT user_id % 10 AS book_id, epoch_us(ts) AS ts,
  CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'a' END AS side,
  CAST(CASE WHEN event_id % 2 = 0 THEN 10000 - (event_id * 7919) % 41 + CASE WHEN user_id % 17 = 0 THEN {shift} ELSE 0 END
       ELSE 10000 + (event_id * 7919) % 41 END AS DOUBLE) AS price,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 + CAST(floor(value) AS BIGINT) % 50 END AS DOUBLE) AS size FROM events),
pts AS (SELECT DISTINCT book_id, ts FROM tape),
iv AS (SELECT *, lead(ts) OVER (PARTITION BY book_id, side, price ORDER BY ts) AS vt FROM tape),
live AS (SELECT p.book_id, p.ts, i.side, i.price, i.size FROM pts p JOIN iv i ON i.book_id = p.book_id AND i.ts <= p.ts AND (i.vt IS NULL OR p.ts < i.vt) WHERE i.size > 0)"""


_LEVELS = ", levels AS (SELECT *, row_number() OVER (PARTITION BY book_id, ts, side ORDER BY CASE side WHEN 'b' THEN -price ELSE price END) - 1 AS level FROM live)"
_TOP = """, best AS (SELECT book_id, ts, max(price) FILTER (side = 'b') AS bid, max_by(size, price) FILTER (side = 'b') AS bidq,
  min(price) FILTER (side = 'a') AS ask, min_by(size, price) FILTER (side = 'a') AS askq FROM live GROUP BY ALL),
top AS (SELECT p.book_id, p.ts, coalesce(bid, 0.0::DOUBLE) AS bid, coalesce(bidq, 0.0::DOUBLE) AS bidq, coalesce(ask, 0.0::DOUBLE) AS ask, coalesce(askq, 0.0::DOUBLE) AS askq
  FROM pts p LEFT JOIN best USING (book_id, ts))"""
_SNAPS = """days AS (SELECT o_custkey % 20 AS book_id, epoch_us(o_orderdate) AS ts, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL),
rows_ AS (SELECT book_id, ts, CASE WHEN l_linenumber % 2 = 1 THEN 'b' ELSE 'a' END AS side,
  CAST(CASE WHEN l_linenumber % 2 = 1 THEN 10000 - l_partkey % 50 ELSE 10001 + l_partkey % 50 END AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS size, l_linenumber
  FROM days JOIN lineitem ON l_orderkey = o_orderkey),
pts AS (SELECT book_id, ts FROM days),
live AS (SELECT book_id, ts, side, price, size FROM rows_ QUALIFY row_number() OVER (PARTITION BY book_id, ts, side, price ORDER BY l_linenumber DESC, size DESC) = 1)"""


def _on_top(select: str, shift: int = 0) -> str:
    return f"WITH {_live(shift)}{_TOP} SELECT book_id, ts, {select} FROM top"


def _on_levels(select: str) -> str:
    return f"WITH {_live()}{_LEVELS}, agg AS (SELECT book_id, ts, {select} FROM levels GROUP BY ALL) "


_NAN = "'nan'::DOUBLE"
_SPREAD = f"CASE WHEN bid > 0 AND ask > 0 THEN ask - bid ELSE {_NAN} END"


def _series(spark: SparkSession, sf_dir: str) -> BookSeries:
    """All events as one series over a table."""
    tape = _tape(spark, sf_dir).withColumn("book_id", F.lit(0))
    return BookSeries.of_tape(tape, points_of(tape), TICK)


_ONE = _live().replace("tape AS (SELECT user_id % 10 AS book_id", "rows_ AS (SELECT 0 AS book_id").replace("FROM events),", "FROM events),\ntape AS (SELECT book_id, ts, side, price, max(size) AS size FROM rows_ GROUP BY ALL),", 1)


# Top of book and its metrics


@query(_on_top("bid, bidq, ask, askq"))
def top_of_book(spark, sf_dir):
    return _top(spark, sf_dir)


@query(_on_top(f"{_SPREAD} AS spread, {_SPREAD} / {TICK}::DOUBLE AS spread_tick, CASE WHEN bid > 0 THEN ({_SPREAD}) / bid ELSE {_NAN} END AS spread_rel"))
def spread_metrics(spark, sf_dir):
    return _top(spark, sf_dir).select("book_id", "ts", metrics.spread().alias("spread"), metrics.spread_tick(TICK).alias("spread_tick"), metrics.spread_rel().alias("spread_rel"))


@query(_on_top(f"{_SPREAD} / CASE WHEN book_id % 2 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS spread_tick"))
def spread_by_tick_size(spark, sf_dir):
    """Spreads in ticks of books that differ in the size of a tick."""
    tick = F.when(F.col("book_id") % 2 == 0, 0.25).otherwise(0.5)
    return _top(spark, sf_dir).select("book_id", "ts", metrics.spread_tick(tick).alias("spread_tick"))


@query(_on_top(f"CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 ELSE {_NAN} END AS midprice"))
def midprice(spark, sf_dir):
    return _top(spark, sf_dir).select("book_id", "ts", metrics.midprice().alias("midprice"))


_VW = "(bid * bidq + ask * askq) / (bidq + askq)"


@query(_on_top(f"CASE WHEN bid > 0 AND ask > 0 AND bidq > 0 AND askq > 0 THEN {_VW} ELSE {_NAN} END AS vw_midprice"))
def vw_midprice(spark, sf_dir):
    return _top(spark, sf_dir).select("book_id", "ts", metrics.vw_midprice().alias("vw_midprice"))


@query(_on_top("(bid + ask) / 2 AS midprice"))
def series_mid(spark, sf_dir):
    return _top(spark, sf_dir).select("book_id", "ts", metrics.midprice_raw().alias("midprice"))


@query(_on_top(f"CASE WHEN bidq + askq <> 0 THEN {_VW} ELSE {_NAN} END AS vw_midprice"))
def series_vw_mid(spark, sf_dir):
    return _top(spark, sf_dir).select("book_id", "ts", metrics.vw_midprice_raw().alias("vw_midprice"))


@query(_on_top("bidq - askq AS vi"))
def series_vi(spark, sf_dir):
    return _top(spark, sf_dir).select("book_id", "ts", metrics.vi_raw().alias("vi"))


@query(_on_top(f"{_SPREAD} AS spread"))
def series_spread(spark, sf_dir):
    return _top(spark, sf_dir).select("book_id", "ts", metrics.spread().alias("spread"))


@query(_on_top("bid"))
def series_bid(spark, sf_dir):
    return _top(spark, sf_dir).select("book_id", "ts", "bid")


@query(_on_top("ask"))
def series_ask(spark, sf_dir):
    return _top(spark, sf_dir).select("book_id", "ts", "ask")


@query(_on_top("CASE WHEN bid > 0 AND ask > 0 THEN bid < ask ELSE true END AS ok"))
def book_check(spark, sf_dir):
    return _top(spark, sf_dir).select("book_id", "ts", metrics.check().alias("ok"))


@query(f"WITH {_live(2)}{_TOP} SELECT book_id, ts, bid, ask FROM top WHERE bid > 0 AND ask > 0 AND NOT bid < ask")
def crossed_points(spark, sf_dir):
    return _top(spark, sf_dir, 2).where(~metrics.check()).select("book_id", "ts", "bid", "ask")


_TICKS = "CASE WHEN bid > 0 THEN round_even((bid - 9990.25) / 0.5, 0) ELSE 'inf'::DOUBLE END AS bid_ticks, CASE WHEN ask > 0 THEN round_even((10010.25 - ask) / 0.5, 0) ELSE 'inf'::DOUBLE END AS ask_ticks"


@query(_on_top(_TICKS))
def ticks_from_best(spark, sf_dir):
    b, a = metrics.ticks_from_best("b", 9990.25, TICK), metrics.ticks_from_best("a", 10010.25, TICK)
    return _top(spark, sf_dir).select("book_id", "ts", b.alias("bid_ticks"), a.alias("ask_ticks"))


# Depth


def _aggregated(spark, sf_dir, prepare=lambda x: x, **columns):
    kept, live = _events(spark, sf_dir)
    return depth.per_point(kept, prepare(state.levels(live)), **columns)


def _filled(*names: str) -> str:
    return "SELECT p.book_id, p.ts, " + ", ".join(f"coalesce({n}, 0.0::DOUBLE) AS {n}" for n in names) + " FROM pts p LEFT JOIN agg USING (book_id, ts)"


def _level_sql(what: str, *at: tuple[str, str, int]) -> str:
    return _on_levels(", ".join(f"max({what}) FILTER (side = '{s}' AND level = {i}) AS {n}" for n, s, i in at)) + _filled(*[n for n, _, _ in at])


_AT = (("bid_1", "b", 1), ("bid_4", "b", 4), ("ask_1", "a", 1), ("ask_4", "a", 4))


@query(_level_sql("price", *_AT))
def level_i_prices(spark, sf_dir):
    return _aggregated(spark, sf_dir, **{n: metrics.at_level(s, i) for n, s, i in _AT})


@query(_level_sql("size", *_AT))
def level_i_sizes(spark, sf_dir):
    return _aggregated(spark, sf_dir, **{n: metrics.at_level(s, i, "size") for n, s, i in _AT})


_DEPTH = ", deep AS (SELECT *, count(*) OVER (PARTITION BY book_id, ts, side) AS depth FROM levels)"


@query(f"WITH {_live()}{_LEVELS}{_DEPTH}, agg AS (SELECT book_id, ts, max(price) FILTER (side = 'b' AND level = depth - 1) AS worst_bid, max(price) FILTER (side = 'a' AND level = depth - 2) AS last_but_one_ask FROM deep GROUP BY ALL) " + _filled("worst_bid", "last_but_one_ask"))
def level_from_worst(spark, sf_dir):
    return _aggregated(spark, sf_dir, depth.with_depth, worst_bid=metrics.at_level("b", -1), last_but_one_ask=metrics.at_level("a", -2))


def _vi_sql(i: int) -> str:
    b, a = (f"coalesce(sum(size) FILTER (side = '{s}' AND level <= {i}), 0)" for s in "ba")
    return f"CASE WHEN {b} + {a} = 0 THEN 0.0::DOUBLE ELSE ({b} - {a}) / ({b} + {a}) END AS vi_{i}"


@query(_on_levels(", ".join(map(_vi_sql, (0, 2, 9)))) + _filled("vi_0", "vi_2", "vi_9"))
def volume_imbalance_k(spark, sf_dir):
    return _aggregated(spark, sf_dir, **{f"vi_{i}": metrics.volume_imbalance(i) for i in (0, 2, 9)})


@query(f"WITH {_live()}{_LEVELS}{_DEPTH}, agg AS (SELECT book_id, ts, sum(size) FILTER (side = 'b' AND level < 3) AS bid_3, sum(size) FILTER (side = 'a' AND level < 3) AS ask_3, sum(size) FILTER (side = 'a' AND level < depth - 2) AS ask_but_2 FROM deep GROUP BY ALL) " + _filled("bid_3", "ask_3", "ask_but_2"))
def aggq_nlevel(spark, sf_dir):
    return _aggregated(spark, sf_dir, depth.with_depth, bid_3=metrics.aggq_nlevel("b", 3), ask_3=metrics.aggq_nlevel("a", 3), ask_but_2=metrics.aggq_nlevel("a", -2))


_BEST = ", near AS (SELECT *, max(price) OVER w AS hi, min(price) OVER w AS lo FROM live WINDOW w AS (PARTITION BY book_id, ts, side))"


@query(f"WITH {_live()}{_BEST}, agg AS (SELECT book_id, ts, sum(size) FILTER (side = 'b' AND price >= hi - 5) AS bid_5, sum(size) FILTER (side = 'a' AND price <= lo + 5) AS ask_5 FROM near GROUP BY ALL) " + _filled("bid_5", "ask_5"))
def aggq_ticks(spark, sf_dir):
    return _aggregated(spark, sf_dir, depth.with_best, bid_5=metrics.aggq_ticks("b", 10, TICK), ask_5=metrics.aggq_ticks("a", 10, TICK))


@query(f"WITH {_live()}{_BEST}, agg AS (SELECT book_id, ts, sum(size) FILTER (side = 'b' AND price >= hi - 3) AS bid_3, sum(size) FILTER (side = 'a' AND price <= lo + 3) AS ask_3 FROM near GROUP BY ALL) " + _filled("bid_3", "ask_3"))
def aggq_whole_ticks(spark, sf_dir):
    """Prices of a tenth, where differences of doubles fall beside the tick: three whole ticks."""
    cheap = lambda levels: depth.with_best(levels.withColumn("price", F.col("price") / 10))
    return _aggregated(spark, sf_dir, cheap, bid_3=metrics.aggq_whole_ticks("b", 3, 0.1), ask_3=metrics.aggq_whole_ticks("a", 3, 0.1))


@query(f"WITH {_live()}, agg AS (SELECT book_id, ts, sum(size) FILTER (side = 'b' AND price >= 9985) AS bid_9985, sum(size) FILTER (side = 'a' AND price <= 10015) AS ask_10015 FROM live GROUP BY ALL) " + _filled("bid_9985", "ask_10015"))
def aggq_price(spark, sf_dir):
    kept, live = _events(spark, sf_dir)
    return depth.per_point(kept, live, bid_9985=metrics.aggq_price("b", 9985.0), ask_10015=metrics.aggq_price("a", 10015.0))


def _slippage_sql(s: str, v: int) -> str:
    mid = f"CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 ELSE {_NAN} END"
    order = "-price" if s == "b" else "price"
    signed = f"cost / {v}::DOUBLE - ({mid})" if s == "a" else f"({mid}) - cost / {v}::DOUBLE"
    return f"""WITH {_live()}{_TOP}, cum AS (SELECT *, sum(size) OVER (PARTITION BY book_id, ts ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS cum FROM live WHERE side = '{s}'),
filled AS (SELECT book_id, ts, sum(greatest(0, least(size, {v} - (cum - size))) * price) AS cost, max(cum) AS there FROM cum GROUP BY ALL)
SELECT t.book_id, t.ts, CASE WHEN coalesce(there, 0) < {v} THEN 'inf'::DOUBLE ELSE {signed} END AS slippage FROM top t LEFT JOIN filled f USING (book_id, ts)"""


@query(_slippage_sql("a", 60))
def slippage_ask(spark, sf_dir):
    b = _books(spark, sf_dir)
    return depth.slippage(b.kept, state.live(b), state.tops(b), "a", 60)


@query(_slippage_sql("b", 60))
def slippage_bid(spark, sf_dir):
    b = _books(spark, sf_dir)
    return depth.slippage(b.kept, state.live(b), state.tops(b), "b", 60)


# Slices and look-ups

_FROM, _TO = (f"epoch_us(TIMESTAMP '{t}')" for t in RANGE)


def _micros(day: str) -> int:
    return int(datetime.fromisoformat(f"{day}T00:00:00+00:00").timestamp()) * 1_000_000


@query(f"WITH {_live()}{_TOP} SELECT book_id, ts, bid, ask FROM top WHERE ts BETWEEN {_FROM} AND {_TO}")
def range_slice(spark, sf_dir):
    start, end = map(_micros, RANGE)
    return _top(spark, sf_dir, start=start, end=end).select("book_id", "ts", "bid", "ask")


@query(f"WITH {_live()}, last AS (SELECT book_id, max(ts) AS ts FROM pts GROUP BY ALL) SELECT book_id, ts, side, price, size FROM live SEMI JOIN last USING (book_id, ts)")
def point_lookup(spark, sf_dir):
    """The whole book at one timestamp of each series: an exact match."""
    tape = _tape(spark, sf_dir)
    last = points_of(tape).groupBy("book_id").agg(F.max("ts").alias("ts"))
    return state.live(state.books(tape, points_of(tape), in_order=True, collapsed=True, axis=last)).drop("chunk")


@query("SELECT DISTINCT user_id % 10 AS book_id, epoch_us(ts) AS ts FROM events")
def timestamps(spark, sf_dir):
    return points_of(_tape(spark, sf_dir)).select("book_id", "ts").distinct()


@query(f"WITH {_SNAPS} SELECT e.book_id, e.ts, EXISTS (SELECT 1 FROM pts p WHERE p.ts = e.ts) AS there FROM (SELECT DISTINCT user_id % 10 AS book_id, epoch_us(date_trunc('day', ts)) AS ts FROM events) e")
def contains_ts(spark, sf_dir):
    """Whether the midnight of each event's day is a timestamp of the order books."""
    _, points = _orders(spark, sf_dir)
    days = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("book_id"), F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("ts")).distinct()
    return depth.at_moments(points.select("ts"), days).select("book_id", "ts", "there")


@query(f"WITH {_SNAPS}{_LEVELS} SELECT book_id, ts AS timestamp, side, level, price, size FROM levels")
def levels_export(spark, sf_dir):
    tape, points = _orders(spark, sf_dir)
    _, live = state.live_levels(tape, points, collapsed=True)
    return depth.export(state.levels(live)).withColumn("level", F.col("level").cast("long"))


def _written(spark, sf_dir, kind: str) -> DataFrame:
    """The export through a sink and back."""
    rows, path = levels_export(spark, sf_dir), f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    {"csv": sinks.write_csv, "parquet": sinks.write_parquet}[kind](rows, path)
    return spark.read.schema(rows.schema).option("header", True).format(kind).load(path)


@query(ORACLES["levels_export"])
def levels_csv(spark, sf_dir):
    return _written(spark, sf_dir, "csv")


@query(ORACLES["levels_export"])
def levels_parquet(spark, sf_dir):
    return _written(spark, sf_dir, "parquet")


@query(f"WITH {_SNAPS}{_LEVELS} SELECT book_id, ts, side, level, price, size FROM levels WHERE level < CASE side WHEN 'b' THEN 2 ELSE 1 END")
def levels_topn_split(spark, sf_dir):
    tape, points = _orders(spark, sf_dir)
    _, live = state.live_levels(tape, points, collapsed=True)
    return depth.split_budget(state.levels(live), 3).withColumn("level", F.col("level").cast("long"))


def _order_levels(spark, sf_dir) -> DataFrame:
    tape, points = _orders(spark, sf_dir)
    _, live = state.live_levels(tape, points, collapsed=True)
    return state.levels(live).withColumn("level", F.col("level").cast("long")).select("book_id", "ts", "side", "level", "price", "size")


@query(f"WITH {_SNAPS}{_LEVELS} SELECT book_id, ts, side, level, price, size FROM levels WHERE side = 'b' AND level < 2")
def levels_bids(spark, sf_dir):
    """The best two bids of every book."""
    return depth.side_levels(_order_levels(spark, sf_dir), "b", 2)


@query(f"WITH {_SNAPS}{_LEVELS} SELECT book_id, ts, side, level, price, size FROM levels WHERE side = 'a'")
def levels_asks(spark, sf_dir):
    return depth.side_levels(_order_levels(spark, sf_dir), "a")


@query(f"WITH {_ONE}{_LEVELS} SELECT ts AS timestamp, side, level, price, size FROM levels WHERE ts BETWEEN {_FROM} AND {_TO}")
def series_slice_table(spark, sf_dir):
    """The table of a slice of a series."""
    start, end = map(_micros, RANGE)
    return _series(spark, sf_dir)[start:end].table().withColumn("level", F.col("level").cast("long"))


@query(f"WITH {_ONE}{_TOP} SELECT ts, bid, ask, {_SPREAD} AS spread, bidq - askq AS vi FROM top")
def series_properties(spark, sf_dir):
    """Properties of one series over a table, side by side."""
    s = _series(spark, sf_dir)
    return s.bid.join(s.ask, "ts").join(s.spread, "ts").join(s.vi, "ts")


@query(f"WITH {_ONE}{_LEVELS}, last AS (SELECT max(ts) AS ts FROM pts) SELECT side, level, price, size FROM levels SEMI JOIN last USING (ts)")
def series_last_book(spark, sf_dir):
    """The book that a series has at exactly its last timestamp."""
    s = _series(spark, sf_dir)
    last = s.kept.agg(F.max("ts")).first()[0]
    return s.get_at_timestamp(int(last)).levels().withColumn("level", F.col("level").cast("long"))


@query(f"WITH {_SNAPS} SELECT * FROM live SEMI JOIN (SELECT book_id, max(ts) AS ts FROM pts GROUP BY ALL) USING (book_id, ts)")
def latest_book(spark, sf_dir):
    """`latest` mode keeps the book since the last snapshot."""
    tape, points = _orders(spark, sf_dir)
    return state.live_levels(tape, points, "latest", collapsed=True)[1]


# Flow, extent, differences

_FLOW = f"""WITH {_live()}, moved AS (SELECT book_id, ts, size - coalesce(lag(size) OVER (PARTITION BY book_id, side, price ORDER BY ts), 0) AS d, min(ts) OVER (PARTITION BY book_id) AS first FROM tape)
SELECT book_id, sum(greatest(d, 0)) FILTER (ts > first) AS arrivals, sum(greatest(-d, 0)) FILTER (ts > first) AS cancels FROM moved GROUP BY book_id"""


def _flow(spark, sf_dir):
    tape = _tape(spark, sf_dir)
    return flow.flow_by_book(tape, points_of(tape), updates_only=True)


@query(f"SELECT book_id, arrivals FROM ({_FLOW})")
def arrival_by_book(spark, sf_dir):
    return _flow(spark, sf_dir).select("book_id", "arrivals")


@query(f"SELECT book_id, cancels FROM ({_FLOW})")
def cancel_by_book(spark, sf_dir):
    return _flow(spark, sf_dir).select("book_id", "cancels")


@query(f"SELECT book_id, arrivals + cancels AS updates FROM ({_FLOW})")
def update_total(spark, sf_dir):
    return _flow(spark, sf_dir).select("book_id", "updates")


_PAIRS = ", pairs AS (SELECT * FROM (SELECT book_id, ts, lead(ts) OVER (PARTITION BY book_id ORDER BY ts) AS next_ts FROM pts) WHERE next_ts IS NOT NULL)"
_BOTH = ", old_ AS (SELECT p.book_id, p.next_ts AS ts, side, price, size FROM live l JOIN pairs p USING (book_id, ts)), new_ AS (SELECT l.* FROM live l JOIN pairs p ON p.book_id = l.book_id AND p.next_ts = l.ts), both_ AS (SELECT book_id, ts, side, price, o.size AS old, n.size AS new FROM old_ o FULL JOIN new_ n USING (book_id, ts, side, price))"


@query(f"WITH {_SNAPS}{_PAIRS}{_BOTH} SELECT book_id, sum(greatest(coalesce(new, 0) - coalesce(old, 0), 0)) AS arrivals, sum(greatest(coalesce(old, 0) - coalesce(new, 0), 0)) AS cancels FROM both_ GROUP BY book_id")
def snapshot_flow(spark, sf_dir):
    tape, points = _orders(spark, sf_dir)
    return flow.flow_by_book(tape, points).select("book_id", "arrivals", "cancels")


@query(f"""WITH {_live()} SELECT book_id, ts AS seq, side, price FROM (SELECT *, lag(size) OVER (PARTITION BY book_id, side, price ORDER BY ts) AS before FROM tape)
WHERE size = 0 AND coalesce(before, 0) = 0""")
def absent_deletes(spark, sf_dir):
    """Deletes of levels that are not there."""
    tape = _tape(spark, sf_dir)
    return flow.absent_deletes(tape, points_of(tape))


@query("SELECT user_id % 10 AS book_id, count(DISTINCT ts) AS n_points FROM events GROUP BY ALL")
def series_len(spark, sf_dir):
    return flow.series_extent(points_of(_tape(spark, sf_dir))).select("book_id", "n_points")


@query("SELECT user_id % 10 AS book_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration FROM events GROUP BY ALL")
def series_duration(spark, sf_dir):
    return flow.series_extent(points_of(_tape(spark, sf_dir))).select("book_id", "duration")


def _neighbours(spark, sf_dir):
    tape, points = _orders(spark, sf_dir)
    kept, live = state.live_levels(tape, points, collapsed=True)
    pairs = flow.consecutive(kept)
    old = live.join(pairs, ["book_id", "ts"]).select("book_id", F.col("next_ts").alias("ts"), "side", "price", "size")
    return old, live.join(pairs.select("book_id", F.col("next_ts").alias("ts")), ["book_id", "ts"])


@query(f"WITH {_SNAPS}{_PAIRS}{_BOTH} SELECT book_id, ts, side, price, coalesce(new, 0.0::DOUBLE) AS size FROM both_ WHERE new IS NULL OR new <> coalesce(old, 0)")
def snapshot_delta(spark, sf_dir):
    return flow.compare(*_neighbours(spark, sf_dir), ["book_id", "ts"]).drop("is_delete")


@query(f"WITH {_SNAPS}{_PAIRS}{_BOTH} SELECT book_id, ts, side, price, coalesce(new, 0.0::DOUBLE) AS size, new IS NULL AS is_delete FROM both_ WHERE new IS NULL OR old IS NULL OR new <> old")
def snapshot_diff(spark, sf_dir):
    return flow.compare(*_neighbours(spark, sf_dir), ["book_id", "ts"], "none")


@query(f"""WITH {_live()}, l2 AS (SELECT * FROM ({"WITH " + _live(2) + " SELECT * FROM live"})),
both_ AS (SELECT book_id, ts, side, price, o.size AS old, n.size AS new FROM live o FULL JOIN l2 n USING (book_id, ts, side, price)),
agg AS (SELECT book_id, ts, count(*) FILTER (side = 'b') AS n_bids, count(*) FILTER (side = 'a') AS n_asks, sum(coalesce(new, 0)) AS qty FROM both_ WHERE new IS NULL OR new <> coalesce(old, 0) GROUP BY ALL)
SELECT p.book_id, p.ts, coalesce(n_bids, 0) AS n_bids, coalesce(n_asks, 0) AS n_asks, coalesce(qty, 0.0::DOUBLE) AS qty FROM pts p LEFT JOIN agg USING (book_id, ts)""")
def series_diff(spark, sf_dir):
    tapes = [_tape(spark, sf_dir, shift) for shift in (0, 2)]
    a, b = map(points_of, tapes)
    axis = settle(a.join(b, ["book_id", "ts"], "left_semi").select("book_id", "ts"), "axis")
    left, right = (state.books(t, p, in_order=True, collapsed=True, axis=axis) for t, p in zip(tapes, (a, b)))
    return flow.span_diff(left, right).select("book_id", "ts", "n_bids", "n_asks", "qty")


@query(ORACLES["series_diff"].replace("SELECT p.book_id, p.ts, coalesce(n_bids, 0) AS n_bids, coalesce(n_asks, 0) AS n_asks, coalesce(qty, 0.0::DOUBLE) AS qty", "SELECT p.book_id, p.ts, coalesce(n_bids, 0) = 0 AS bids_equal, coalesce(n_asks, 0) = 0 AS asks_equal"))
def side_equality(spark, sf_dir):
    """Whether the sides of two series' books are equal, point by point."""
    return flow.equal_sides(series_diff(spark, sf_dir).select("book_id", "ts", "n_bids", "n_asks"))


# The mixed tape: snapshots and updates, late points, equal timestamps


def _mixed(mode: str) -> str:
    """Records by their definition, then each kept point's rows by last write."""
    by = "book_id, reset" if mode == "latest" else "book_id"
    last = "QUALIFY reset = max(reset) OVER (PARTITION BY book_id)" if mode == "latest" else ""
    return f"""tape AS (SELECT user_id % 10 AS book_id, event_id // 40 AS seq, event_id, min(epoch_us(ts)) OVER (PARTITION BY user_id % 10, event_id // 40) AS began,
  CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'a' END AS side,
  CAST(CASE WHEN event_id % 2 = 0 THEN 10000 - (event_id * 7919) % 41 ELSE 10000 + (event_id * 7919) % 41 END AS DOUBLE) AS price,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 + CAST(floor(value) AS BIGINT) % 50 END AS DOUBLE) AS size FROM events),
arrived AS (SELECT DISTINCT book_id, seq, began - began % {STEP} - CASE WHEN seq % 5 = 3 THEN {4 * STEP} ELSE 0 END AS ts, CASE WHEN seq % 7 = 0 THEN 's' ELSE 'u' END AS kind FROM tape),
resets AS (SELECT *, count(*) FILTER (kind = 's') OVER (PARTITION BY book_id ORDER BY seq) AS reset FROM arrived),
marked AS (SELECT *, ts >= coalesce(max(ts) OVER (PARTITION BY {by} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) AS record FROM resets),
epochs AS (SELECT *, count(*) FILTER (record AND kind = 's') OVER (PARTITION BY book_id ORDER BY seq) AS epoch FROM marked),
since AS (SELECT * FROM epochs {last}),
kept AS (SELECT * FROM since QUALIFY row_number() OVER (PARTITION BY book_id, ts ORDER BY seq DESC) = 1),
written AS (SELECT p.book_id, p.ts, p.seq, r.seq AS set_at, r.kind, side, price, size FROM kept p
  JOIN epochs r ON r.book_id = p.book_id AND r.epoch = p.epoch AND r.seq <= p.seq AND (r.seq = p.seq OR (r.record AND p.kind = 'u'))
  JOIN tape t ON t.book_id = r.book_id AND t.seq = r.seq
  QUALIFY row_number() OVER (PARTITION BY p.book_id, p.seq, side, price ORDER BY r.seq DESC, event_id DESC) = 1),
pts AS (SELECT book_id, ts FROM kept),
live AS (SELECT book_id, ts, side, price, size FROM written WHERE NOT (kind = 'u' AND size = 0))"""


def _mixed_live(spark: SparkSession, sf_dir: str, mode: str) -> tuple[DataFrame, DataFrame]:
    tape = mixed_tape(table(spark, sf_dir, "events"))
    return state.live_levels(tape, points_of(tape), mode)


@query(f"WITH {_mixed('delta')} SELECT book_id, ts, seq FROM arrived a WHERE seq % 7 = 0 AND EXISTS (SELECT 1 FROM arrived b WHERE b.book_id = a.book_id AND b.ts = a.ts AND b.seq < a.seq)")
def refused_snapshots(spark, sf_dir):
    """Snapshots at a timestamp that the book has already."""
    return refused(points_of(mixed_tape(table(spark, sf_dir, "events")))).select("book_id", "ts", "seq")


@query(f"WITH {_mixed('delta')} SELECT * FROM live")
def mixed_levels(spark, sf_dir):
    return _mixed_live(spark, sf_dir, "delta")[1]


@query(f"WITH {_mixed('delta')}{_TOP} SELECT book_id, ts, bid, bidq, ask, askq FROM top")
def mixed_top(spark, sf_dir):
    tape = mixed_tape(table(spark, sf_dir, "events"))
    return state.tops(state.books(tape, points_of(tape)))


@query(f"WITH {_mixed('latest')} SELECT * FROM live")
def mixed_latest(spark, sf_dir):
    return _mixed_live(spark, sf_dir, "latest")[1]


@query(f"WITH {_mixed('latest')} SELECT * FROM pts")
def mixed_latest_points(spark, sf_dir):
    return _mixed_live(spark, sf_dir, "latest")[0]


@query(f"""WITH {_mixed('latest')}, newest AS (SELECT book_id, max_by(ts, seq) AS ts, max(seq) FILTER (kind = 's') AS since FROM arrived GROUP BY ALL),
last AS (SELECT n.book_id, n.ts, side, price, size, CASE WHEN t.seq % 7 = 0 THEN 's' ELSE 'u' END AS kind FROM tape t JOIN newest n ON n.book_id = t.book_id AND t.seq >= coalesce(since, 0)
  QUALIFY row_number() OVER (PARTITION BY t.book_id, side, price ORDER BY t.seq DESC, event_id DESC) = 1)
SELECT book_id, ts, side, price, size FROM last WHERE NOT (kind = 'u' AND size = 0)""")
def mixed_current(spark, sf_dir):
    """The one book that a series keeps whose mode is `current`."""
    return _mixed_live(spark, sf_dir, "current")[1]


# Ordered relations over parts and orders


def _parts(spark, sf_dir) -> Ordered:
    return Ordered.of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", ("p_partkey",))


_RANKED = "(SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS rank FROM part)"


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20")
def sc_irange(spark, sf_dir):
    return _parts(spark, sf_dir).irange(10, 20, (True, False))


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 7 > 2 AND p_size % 7 <= 5")
def sc_irange_key(spark, sf_dir):
    return Ordered.of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_size") % 7, ("p_size", "p_partkey")).irange_key(2, 5, (False, True))


@query(f"SELECT * FROM {_RANKED} WHERE rank >= 20 AND rank < 90")
def sc_islice(spark, sf_dir):
    return _parts(spark, sf_dir).islice(20, 90)


@query(f"SELECT * FROM {_RANKED} WHERE rank >= 5 AND (rank - 5) % 7 = 0")
def sc_slice_step(spark, sf_dir):
    return _parts(spark, sf_dir).islice(5, None, 7)


@query("SELECT v.v AS value, (SELECT count(*) FROM part WHERE p_size < v.v) AS lo, (SELECT count(*) FROM part WHERE p_size <= v.v) AS hi FROM (VALUES (1), (17), (50)) v(v)")
def sc_bisect(spark, sf_dir):
    return _parts(spark, sf_dir).bisect_frame([1, 17, 50])


@query("SELECT c_custkey, p_size, (SELECT count(*) FROM part WHERE part.p_size % 7 < v.p_size % 7) AS lo, (SELECT count(*) FROM part WHERE part.p_size % 7 <= v.p_size % 7) AS hi FROM (SELECT c_custkey, c_nationkey AS p_size FROM customer) v")
def sc_bisect_value(spark, sf_dir):
    """Insertion ranks of a table of values, through the key function."""
    values = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("p_size"))
    return Ordered.of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_size") % 7).bisect_rows(values)


def _part_map(spark, sf_dir) -> Ordered:
    """Types of parts by key, as a map."""
    return Ordered.of(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey", unique="key")


@query("SELECT p_partkey AS key FROM part QUALIFY (row_number() OVER (ORDER BY p_partkey) - 1) >= 3 AND (row_number() OVER (ORDER BY p_partkey) - 4) % 5 = 0")
def sc_view_keys(spark, sf_dir):
    """Every fifth key of a map, from the fourth, through its view."""
    return _part_map(spark, sf_dir).keys()[3::5]


@query("SELECT p_partkey AS key, p_type FROM part QUALIFY row_number() OVER (ORDER BY p_partkey DESC) <= 40")
def sc_view_items(spark, sf_dir):
    return _part_map(spark, sf_dir).items("p_type")[-40:]


@query("SELECT p_type FROM part QUALIFY (row_number() OVER (ORDER BY p_partkey DESC) - 1) % 4 = 0")
def sc_view_values(spark, sf_dir):
    return _part_map(spark, sf_dir).values("p_type")[::-4]


@query("SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def sc_view_algebra(spark, sf_dir):
    """Keys of a map that another map has not."""
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return (_part_map(spark, sf_dir).keys() - Ordered.of(sold, "p_partkey", unique="key").keys()).rows


@query("SELECT p_partkey, p_type FROM part QUALIFY (row_number() OVER (ORDER BY p_partkey) - 1) % 3 <> 0")
def sc_view_delete(spark, sf_dir):
    return _part_map(spark, sf_dir).keys().delete(slice(None, None, 3)).rows


@query(f"SELECT p_size, min(rank) AS first_rank FROM {_RANKED} GROUP BY p_size")
def sc_index(spark, sf_dir):
    return _parts(spark, sf_dir).first_ranks("p_size")


@query("SELECT p_size, count(*) AS n FROM part GROUP BY p_size")
def sc_count(spark, sf_dir):
    return _parts(spark, sf_dir).counts("p_size")


@query(f"SELECT p_partkey, p_size FROM {_RANKED} WHERE rank IN (0, (SELECT count(*) - 1 FROM part))")
def sc_peek(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return p.peek(0).union(p.peek(-1))


@query("SELECT c_custkey, c_nationkey AS p_size, EXISTS (SELECT 1 FROM part WHERE part.p_size = c_nationkey) AS there FROM customer")
def sc_contains(spark, sf_dir):
    """Whether values of a table are in a list."""
    return _parts(spark, sf_dir).contains_rows(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("p_size")))


@query("SELECT l_orderkey, l_linenumber, l_partkey * 2 AS p_partkey, coalesce(p_type, 'none') AS p_type FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2")
def sc_get(spark, sf_dir):
    """What a map gives the keys of a table, with a default."""
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("p_partkey"))
    return _part_map(spark, sf_dir).get_rows(keys, "p_type", default="none")


@query("SELECT l_partkey, l_quantity, l_orderkey * 8 + l_linenumber AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1")
def sc_map_of_rows(spark, sf_dir):
    """A map of rows that repeat keys: the newest row of a key stays."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"))
    return Ordered.of(rows, "l_partkey", unique="key", newest="n").rows


@query("SELECT DISTINCT l_partkey, 7 AS v FROM lineitem")
def sc_fromkeys(spark, sf_dir):
    return Ordered.fromkeys(table(spark, sf_dir, "lineitem"), "l_partkey", "v", 7).rows


@query("SELECT p_partkey, p_size FROM part UNION ALL SELECT c_custkey, c_nationkey FROM customer")
def sc_update(spark, sf_dir):
    """A list takes all rows of another table."""
    more = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("p_partkey"), F.col("c_nationkey").alias("p_size"))
    return _parts(spark, sf_dir).update(more).rows


@query("SELECT l_partkey AS v FROM lineitem EXCEPT ALL SELECT p_partkey FROM part")
def sc_remove(spark, sf_dir):
    """A list of the parts sold without one of each."""
    sold = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("v"))
    return Ordered.of(sold, "v").discard_rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"))).rows


@query("SELECT p_partkey, p_size FROM part")
def sc_reversed(spark, sf_dir):
    return _parts(spark, sf_dir).sorted(reverse=True)


@query("SELECT 'list' AS name, count(*) AS n FROM part UNION ALL SELECT 'updated copy', 2 * count(*) FROM part UNION ALL SELECT 'cleared copy', 0")
def sc_copies(spark, sf_dir):
    """What is done to a copy leaves the list as it was."""
    p = _parts(spark, sf_dir)
    sizes = {"list": p, "updated copy": p.copy().update(p.rows), "cleared copy": p.copy().clear()}
    one, two, three = (o.counts().select(F.lit(name).alias("name"), "n") for name, o in sizes.items())
    return one.union(two).union(three)


@query(f"SELECT p_partkey, p_size FROM {_RANKED} WHERE rank <> 10")
def sc_pop(spark, sf_dir):
    return _parts(spark, sf_dir).pop(10)[1].rows


@query(f"SELECT p_partkey, p_size FROM {_RANKED} WHERE NOT (rank >= 5 AND (rank - 5) % 7 = 0)")
def sc_delete_slice(spark, sf_dir):
    return _parts(spark, sf_dir).delete(5, None, 7).rows


@query(f"SELECT p_partkey, p_size FROM {_RANKED} WHERE ((SELECT count(*) - 1 FROM part) - rank) % 3 <> 0")
def sc_delete_down(spark, sf_dir):
    return _parts(spark, sf_dir).delete(None, None, -3).rows


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey <> (SELECT min(p_partkey) FROM part WHERE p_size = 17)")
def sc_discard_one(spark, sf_dir):
    return _parts(spark, sf_dir).discard(F.col("p_size") == 17, one=True).rows


@query("SELECT k, coalesce(a.v, b.v) AS v FROM (SELECT p_partkey AS k, p_size AS v FROM part) a FULL JOIN (SELECT p_partkey * 2 AS k, p_size + 100 AS v FROM part) b USING (k)")
def sc_setdefault(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return Ordered.of(p.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v")), "k", unique="key").setdefault(p.select((F.col("p_partkey") * 2).alias("k"), (F.col("p_size") + 100).alias("v"))).rows


@query("SELECT p_type, p_partkey, row_number() OVER (ORDER BY p_type, p_partkey) - 1 AS rank FROM part")
def sc_text_ranks(spark, sf_dir):
    return Ordered.of(table(spark, sf_dir, "part").select("p_type", "p_partkey"), "p_type", ("p_partkey",)).ranked()


@query("""WITH l AS (SELECT (SELECT list(p_size ORDER BY p_size) FROM part) AS a, (SELECT list(c_nationkey ORDER BY c_nationkey) FROM customer) AS b)
SELECT CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS ab, CASE WHEN b < a THEN -1 WHEN b > a THEN 1 ELSE 0 END AS ba, 0 AS aa FROM l""")
def sc_compare(spark, sf_dir):
    a = Ordered.of(table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("v")), "v")
    b = Ordered.of(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("v")), "v")
    ab, ba, aa = (x.compare_frame(y).select(F.col("order").alias(n)) for n, x, y in (("ab", a, b), ("ba", b, a), ("aa", a, a)))
    return ab.join(F.broadcast(ba)).join(F.broadcast(aa))  # of one row each


def _days(spark, sf_dir, name: str, column: str, unique: str = "row") -> Ordered:
    return Ordered.of(table(spark, sf_dir, name).select(F.to_date(column).alias("day")), "day", unique=unique)


def _both_days(spark, sf_dir, unique: str = "row") -> tuple[Ordered, Ordered]:
    """The days of all orders and of all events."""
    return _days(spark, sf_dir, "orders", "o_orderdate", unique), _days(spark, sf_dir, "events", "ts", unique)


_A = "SELECT CAST(o_orderdate AS DATE) AS day FROM orders"
_B = "SELECT CAST(ts AS DATE) AS day FROM events"


@query(f"{_A} UNION {_B}")
def sc_union(spark, sf_dir):
    a, b = _both_days(spark, sf_dir)
    return a.union(b).rows


@query(f"{_A} INTERSECT {_B}")
def sc_intersect(spark, sf_dir):
    a, b = _both_days(spark, sf_dir)
    return a.intersection(b).rows


@query(f"{_A} EXCEPT {_B}")
def sc_difference(spark, sf_dir):
    a, b = _both_days(spark, sf_dir)
    return a.difference(b).rows


@query(f"(({_A}) EXCEPT ({_B})) UNION (({_B}) EXCEPT ({_A}))")
def sc_symdiff(spark, sf_dir):
    a, b = _both_days(spark, sf_dir)
    return a.symmetric_difference(b).rows


@query(f"{_A} UNION ALL {_B}")
def sc_multiset_add(spark, sf_dir):
    a, b = _both_days(spark, sf_dir, "no")
    return a.concat(b).rows


@query("SELECT p_partkey, p_size FROM part, range(3)")
def sc_repeat(spark, sf_dir):
    return _parts(spark, sf_dir).repeat(3).rows


@query("SELECT k, coalesce(b.v, a.v) AS v FROM (SELECT p_partkey AS k, p_size AS v FROM part) a FULL JOIN (SELECT p_partkey * 2 AS k, p_size + 100 AS v FROM part) b USING (k)")
def sc_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = Ordered.of(p.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v")), "k", unique="key")
    b = Ordered.of(p.select((F.col("p_partkey") * 2).alias("k"), (F.col("p_size") + 100).alias("v")), "k", unique="key")
    return a.merge(b).rows


@query(f"SELECT NOT EXISTS (({_A}) EXCEPT ({_B})) AS a_in_b, NOT EXISTS (({_B}) EXCEPT ({_A})) AS b_in_a, NOT EXISTS (({_A}) INTERSECT ({_B})) AS apart")
def sc_subset_flags(spark, sf_dir):
    a, b = _both_days(spark, sf_dir)
    return a.flags_frame(b).toDF("a_in_b", "b_in_a", "apart")


@query(_on_top("ts AS seq, bid, bidq, ask, askq"))
def streaming_top(spark, sf_dir):
    """The events tape as a stream, through keyed state."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return maintainer.run_available(maintainer.live_top(events_tape(stream)))


def _replayed(spark, sf_dir, mode: str) -> DataFrame:
    tape = mixed_tape(table(spark, sf_dir, "events"))
    rows = maintainer.kept(maintainer.replay(tape, lambda t: maintainer.live_levels(t, mode)), mode)
    return rows.where("side is not null").select("book_id", "ts", "side", "price", "size")


@query(f"WITH {_mixed('delta')} SELECT * FROM live")
def streaming_mixed_levels(spark, sf_dir):
    """The mixed tape as a stream: records, late points and epochs by state."""
    return _replayed(spark, sf_dir, "delta")


@query(f"WITH {_mixed('latest')} SELECT * FROM live")
def streaming_mixed_latest(spark, sf_dir):
    return _replayed(spark, sf_dir, "latest")


#: How much earlier than the latest a point may be, in the query of late rows.
DELAY = 2 * STEP


@query(f"""WITH {_mixed('delta')},
timed AS (SELECT *, ts < coalesce(max(ts) OVER (PARTITION BY book_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts) - {DELAY} AS late FROM epochs),
books AS (SELECT p.book_id, p.seq, side, price, size, r.kind FROM timed p
  JOIN epochs r ON r.book_id = p.book_id AND r.epoch = p.epoch AND r.seq <= p.seq AND (r.seq = p.seq OR (r.record AND p.kind = 'u'))
  JOIN tape t ON t.book_id = r.book_id AND t.seq = r.seq WHERE NOT p.late
  QUALIFY row_number() OVER (PARTITION BY p.book_id, p.seq, side, price ORDER BY r.seq DESC, event_id DESC) = 1)
SELECT p.book_id, p.seq, p.ts, late, side, price, size FROM timed p LEFT JOIN (SELECT * FROM books WHERE NOT (kind = 'u' AND size = 0)) USING (book_id, seq) WHERE NOT late
UNION ALL SELECT p.book_id, p.seq, p.ts, late, side, price, size FROM timed p JOIN tape USING (book_id, seq) WHERE late""")
def streaming_dead_letters(spark, sf_dir):
    """Levels of every point in time, and the tape rows of those that come too late."""
    tape = mixed_tape(table(spark, sf_dir, "events"))
    return maintainer.replay(tape, lambda t: maintainer.live_levels(t, delay=DELAY)).select("book_id", "seq", "ts", "late", "side", "price", "size")
