"""Metrics of a book as Columns over `top` or `levels` rows.

The names with `_raw` are the series forms, which do not guard against empty sides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depthbook.schema import INF, NAN

_C = F.col


def _nan() -> Column:
    return F.lit(NAN)


def both() -> Column:
    return (_C("bid") > 0) & (_C("ask") > 0)


def spread() -> Column:
    return F.when(both(), _C("ask") - _C("bid")).otherwise(_nan())


def spread_tick(tick_size: float | Column) -> Column:
    """The spread in ticks; the size of a tick may be a column, as books differ in it."""
    return spread() / F.lit(tick_size)


def spread_rel() -> Column:
    return F.when(_C("bid") > 0, spread() / F.when(_C("bid") > 0, _C("bid"))).otherwise(_nan())


def midprice() -> Column:
    return F.when(both(), (_C("bid") + _C("ask")) / 2).otherwise(_nan())


def midprice_raw() -> Column:
    return (_C("bid") + _C("ask")) / 2


def _weighted() -> Column:
    total = _C("bidq") + _C("askq")
    return (_C("bid") * _C("bidq") + _C("ask") * _C("askq")) / F.when(total != 0, total)


def vw_midprice() -> Column:
    return F.when(both() & (_C("bidq") > 0) & (_C("askq") > 0), _weighted()).otherwise(_nan())


def vw_midprice_raw() -> Column:
    return F.when(_C("bidq") + _C("askq") != 0, _weighted()).otherwise(_nan())


def vi_raw() -> Column:
    return _C("bidq") - _C("askq")


def check() -> Column:
    """True unless both sides are there and bid >= ask."""
    return F.when(both(), _C("bid") < _C("ask")).otherwise(F.lit(True))


# Aggregates over the `levels` rows of a point


def at_level(side: str, i: int, what: str = "price") -> Column:
    """The i-th best price or size of a side; 0.0 beyond its depth; negative i counts from
    the worst (needs a column `depth` with the side's number of levels)."""
    hit = _C("level") == (F.lit(i) if i >= 0 else _C("depth") + i)
    return F.coalesce(F.max(F.when((_C("side") == side) & hit, _C(what))), F.lit(0.0))


def volume_imbalance(i: int) -> Column:
    """(B - A) / (B + A) over the best i + 1 levels of each side; 0.0 if both are empty."""
    amount = lambda side: F.coalesce(F.sum(F.when((_C("side") == side) & (_C("level") <= i), _C("size"))), F.lit(0.0))
    b, a = amount("b"), amount("a")
    return F.coalesce((b - a) / F.when(b + a != 0, b + a), F.lit(0.0))


def aggq_nlevel(side: str, n: int) -> Column:
    """Size of the best n levels; a negative n leaves the worst |n| out."""
    inside = _C("level") < (F.lit(n) if n >= 0 else _C("depth") + n)
    return F.coalesce(F.sum(F.when((_C("side") == side) & inside, _C("size"))), F.lit(0.0))


def aggq_ticks(side: str, ticks: float, tick_size: float, best: str = "best") -> Column:
    """Size within `ticks` of the best price (column `best` of the row's side)."""
    limit = F.lit(ticks * tick_size)
    inside = _C("price") >= _C(best) - limit if side == "b" else _C("price") <= _C(best) + limit
    return F.coalesce(F.sum(F.when((_C("side") == side) & (_C(best) > 0) & inside, _C("size"))), F.lit(0.0))


def in_ticks(price: str | Column, tick_size: float) -> Column:
    """A price as a whole number of ticks, the nearest."""
    return F.rint((_C(price) if isinstance(price, str) else price) / F.lit(tick_size)).cast("long")


def aggq_whole_ticks(side: str, ticks: int, tick_size: float, best: str = "best") -> Column:
    """As aggq_ticks, with prices as whole numbers of ticks: no rounding of a difference of
    doubles decides whether a level counts."""
    away = in_ticks("price", tick_size) - in_ticks(best, tick_size)
    inside = away >= -ticks if side == "b" else away <= ticks
    return F.coalesce(F.sum(F.when((_C("side") == side) & (_C(best) > 0) & inside, _C("size"))), F.lit(0.0))


def aggq_price(side: str, price: float) -> Column:
    """Size at or better than a price."""
    inside = _C("price") >= price if side == "b" else _C("price") <= price
    return F.coalesce(F.sum(F.when((_C("side") == side) & inside, _C("size"))), F.lit(0.0))


def ticks_from_best(side: str, price: float | Column, tick_size: float) -> Column:
    """Signed distance from the side's best in ticks, half to even; +inf without a best."""
    price = price if isinstance(price, Column) else F.lit(price)
    best = _C("bid") if side == "b" else _C("ask")
    distance = best - price if side == "b" else price - best
    return F.when(best > 0, F.rint(distance / F.lit(tick_size))).otherwise(F.lit(INF))
