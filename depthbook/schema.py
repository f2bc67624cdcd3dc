"""Canonical relations.

tape    one row per price level of a snapshot or update:
        book_id, seq (arrival), ord (place in its batch), ts, kind 's' | 'u', side 'b' | 'a', price, size
points  one row per snapshot or update batch (it may have no tape rows): book_id, seq, ts, kind
levels  reconstructed state: book_id, ts, side, level (0 = best), price, size
top     one row per point: book_id, ts, bid, bidq, ask, askq (0.0 where a side is empty)
"""

from __future__ import annotations

from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

TAPE = "book_id long, seq long, ord int, ts decimal(38,0), kind string, side string, price double, size double"
POINTS = "book_id long, seq long, ts decimal(38,0), kind string"

NAN, INF = float("nan"), float("inf")


def side_short(side: Column) -> Column:
    """'b' or 'a' for either spelling; anything else passes unchanged."""
    return F.when(side.isin("b", "bid"), "b").when(side.isin("a", "ask"), "a").otherwise(side)


def side_long(side: Column) -> Column:
    return F.when(side.isin("b", "bid"), "bid").when(side.isin("a", "ask"), "ask").otherwise(side)


def sort_price(side: str = "side", price: str = "price") -> Column:
    """Ascending in this is best first on either side."""
    return F.when(F.col(side) == "b", -F.col(price)).otherwise(F.col(price))


def moment(ts: Any) -> Column:
    """A timestamp as a literal; whole numbers may be wider than 64 bits."""
    return F.lit(Decimal(ts) if isinstance(ts, int) else ts)
