"""Golden cases of a single book and its documented edge cases."""

import math
import zipfile

import pytest
from depthbook.engine import Book, BookSeries
from depthbook.sources.tape import known_sides


# The books and numbers of the documented example (FIXTURES.md), in natural order.


@pytest.fixture(scope="module")
def static(spark):
    return Book(spark, "static", 0.1, bids=[(99.8, 10), (99.7, 20), (99.2, 30)], asks=[(100.1, 15), (101, 25)])


def test_metrics(static):
    assert static.spread == 0.29999999999999716
    assert static.spread_tick == pytest.approx(2.9999999999999716)
    assert static.spread_rel == 0.003006012024048068
    assert static.midprice == 99.94999999999999
    assert static.vw_midprice == pytest.approx(99.98)
    assert static.vi[0] == -0.2 and static.vi[1] == pytest.approx(-1 / 7) and static.vi[-1] == 0.0
    assert static.aggq("a", nlevel=3) == 40 and static.aggq("b", ticks=5) == 30 and static.aggq("bid", price=99.7) == 30
    assert static.aggq("b", nlevel=0) == 0 and static.aggq("b", nlevel=-1) == 30
    assert static.len_in_tick("b", 99.2) == 6
    assert static.check()


def test_accessors(static, spark):
    assert static.bid[0] == 99.8 and static.bid[-1] == 99.2 and static.bid[9] == 0.0 and static.askq[1] == 25
    assert static.bid == 99.8 and repr(static.bid) == "99.8" and static.bidq == 10
    same = Book(spark, bids=[(99.8, 10), (99.7, 20), (99.2, 30)])
    assert static.bid == same.bid and not static.ask == same.ask
    with pytest.raises(IndexError):
        same.ask[-1]


def test_updates_can_cross(spark):
    b = Book(spark, tick_size=0.1, bids=[(99.8, 10), (99.7, 20), (99.2, 30)], asks=[(100.1, 15), (101, 25)])
    b.set_updates([("b", 99.7, 0), ("b", 101.5, 10), ("a", 100.1, 10), ("a", 101, 0), ("a", 102.0, 10)], 7)
    assert b._rows("b") == [(101.5, 10), (99.8, 10), (99.2, 30)] and b._rows("a") == [(100.1, 10), (102.0, 10)]
    assert not b.check() and b.timestamp == 7
    b.update("bid", 101.5, 0)
    assert b.check() and b.timestamp == 7
    with pytest.raises(ValueError):
        b.update("x", 1, 1)


def test_empty_and_one_sided(spark):
    e = Book(spark)
    assert e.bid == 0.0 and e.ask == 0.0 and math.isnan(e.spread) and e.check() and e.aggq("a") == 0.0
    assert e.len_in_tick("a", 5) == math.inf
    assert e.to_np().shape == (0, 3) and e.to_np("b").shape == (0, 2)
    one = Book(spark, bids=[(100, 10)])
    assert math.isnan(one.spread) and math.isnan(one.midprice) and one.vi[0] == 1.0
    assert math.isnan(Book(spark, asks=[(101, 8)]).get_slippage(5, "ask"))


def test_odd_snapshots(spark):
    zero = Book(spark, bids=[(100, 0), (99, 5)])
    assert zero.bid[0] == 100 and zero.bidq[0] == 0
    assert Book(spark, bids=[(100, 10), (100, 7)])._rows("b") == [(100, 7)]
    assert not Book(spark, bids=[(100, 1)], asks=[(100, 1)]).check()


def test_slippage(spark):
    b = Book(spark, bids=[(100, 10), (99, 5)], asks=[(101, 8), (102, 4)])
    assert b.get_slippage(5, "ask") == 0.5 and b.get_slippage(10, "a") == pytest.approx(0.7000000000000028)
    assert b.get_slippage(13, "ask") == math.inf and b.get_slippage(12, "bid") == pytest.approx(0.6666666666666714)
    assert b.get_slippage(5) == 0.0 and b.get_slippage(0, "ask") == 0.0
    with pytest.raises(ValueError):
        b.get_slippage(1, "x")
    with pytest.raises(ValueError):
        b.aggq("a")


def test_delta_and_diff(spark):
    b = Book(spark, bids=[(100, 10), (99, 5)], asks=[(101, 8)])
    bids, asks = b.get_delta([(100, 15), (98, 3), (97, 0)], [(101, 8), (102, 4)])
    assert set(bids) == {(100, 15), (98, 3), (99, 0.0)} and asks == [(102, 4)]
    assert b.bid[1] == 98
    x = Book(spark, bids=[(99.8, 10), (99.7, 20), (99.2, 30)], asks=[(100.1, 15), (101, 25)])
    y = Book(spark, bids=[(99.7, 20), (99.2, 30)], asks=[(99.9, 15), (101, 25)])
    assert x.diff(y) == [("bid", 99.8, 0), ("ask", 99.9, 15), ("ask", 100.1, 0)]
    assert y.diff(Book(spark, bids=[(99.7, 20), (99.2, 30), (1, 0)], asks=[(99.9, 15), (101, 25)])) == [("bid", 1, 0)]


def test_exports(static, tmp_path):
    assert list(static.to_pd().columns) == ["price", "size", "side"]
    assert static.to_np(nlevels=3)[:, 0].tolist() == ["b", "b", "a"]
    static.to_csv(str(tmp_path / "b.csv"), "b", 2)
    assert (tmp_path / "b.csv").read_text().split() == ["price,size", "99.8,10.0", "99.7,20.0"]
    static.to_xlsx(str(tmp_path / "b.xlsx"))
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        assert z.read("xl/worksheets/sheet1.xml").count(b"<row>") == 6
    static.to_parquet(str(tmp_path / "b.parquet"))
    assert static.spark.read.parquet(str(tmp_path / "b.parquet")).count() == 5


def test_unknown_sides(spark):
    b = Book(spark, compat=True, bids=[(1.0, 1.0)], asks=[(3.0, 1.0)])
    b.set_updates([("x", 2.0, 5.0)])
    b.update("x", 7.0, 5.0)
    assert b._rows("a") == [(2.0, 5.0), (3.0, 1.0)] and b._rows("b") == [(1.0, 1.0)]
    with pytest.raises(ValueError):
        Book(spark).update("x", 7.0, 5.0)
    rows = spark.createDataFrame([("b", 1), ("ask", 2), ("x", 3), (None, 4)], "side string, n int")
    plain = lambda df: [tuple(r) for r in df.orderBy("n").collect()]
    assert plain(known_sides(rows, "ignore")) == [("b", 1), ("a", 2)]
    assert plain(known_sides(rows, "ask")) == [("b", 1), ("a", 2), ("a", 3), ("a", 4)]
    assert plain(known_sides(rows.where("n < 3"))) == [("b", 1), ("a", 2)]
    with pytest.raises(Exception, match="unknown side"):
        known_sides(rows).collect()


def test_deleting_a_level_says_whether_it_was_there(spark):
    b = Book(spark, bids=[(1.0, 1.0), (2.0, 1.0)])
    assert b.delete("bid", 2) and not b.delete("bid", 2) and not b.delete("ask", 1)
    assert b._rows("b") == [(1.0, 1.0)]


def test_current_mode_keeps_one_book(spark):
    s = BookSeries(spark, mode="current", compat=True)
    s.set_snapshot([(5.0, 1.0)], [(6.0, 1.0)], 10)
    s.update("b", 4.0, 2.0, 20)
    s.set_updates([("b", 5.0, 0), ("x", 9.0, 9.0)], 15)
    assert s.timestamps == [15] and s[15]._rows("b") == [(4.0, 2.0)] and s[15]._rows("a") == [(6.0, 1.0)]
