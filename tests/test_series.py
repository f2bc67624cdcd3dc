"""Series: documented example, retention modes, and random tapes against a dict model."""

import random
from decimal import Decimal

import pytest
from depthbook.engine import BookSeries
from depthbook.operators import depth, flow
from depthbook.plans import state
from depthbook.sources.tape import from_books
from pyspark.sql import functions as F

T = [1770990337346989262321, 1770990337346989262322, 1770990337346989262323]


@pytest.fixture(scope="module")
def example(spark):
    s = BookSeries(spark, "x", tick_size=0.01)
    s.set_snapshot([(49900.0, 1.5), (49899.0, 2.3), (49898.5, 1.8)], [(49901.0, 2.1), (49902.0, 1.7), (49903.0, 2.5)], T[0])
    s.set_updates([("b", 49900.0, 2.0), ("b", 49901.0, 1.0), ("a", 49901.0, 0), ("a", 49904.0, 1.5)], T[1])
    s.set_updates([("b", 49899.0, 0), ("b", 49897.0, 3.0)], T[2])
    return s


def test_example(example):
    top = [tuple(r) for r in example.top().orderBy("ts").select("bid", "ask").collect()]
    assert top == [(49900, 49901), (49901, 49902), (49901, 49902)]
    assert example.arrival_frequency == pytest.approx(6.0) and example.cancel_frequency == pytest.approx(4.4)
    assert example.update_frequency() == pytest.approx(10.4)
    assert example.len == 3 and len(example) == 3 and example.len_ts == 2 and example.timestamps == T
    part = example[T[1] : T[2]]
    assert part.arrival_frequency == pytest.approx(3.0) and part.cancel_frequency == pytest.approx(2.3)
    assert T[1] in example and 5 not in example and example[5] is None
    assert example[T[1]].bid == 49901 and [b.timestamp for b in example] == T
    assert repr(example) == "<BookSeries[x] mode=delta snapshots=3>"


def test_series_forms(spark):
    s = BookSeries(spark)
    s.set_snapshot([(100, 10)], [], 1000.5)
    s.set_snapshot([], [], 2000.25)
    assert [r.midprice for r in s.midprice.collect()] == [50.0, 0.0]
    vw = [r.vw_midprice for r in s.vw_midprice.collect()]
    assert vw[0] == 100.0 and vw[1] != vw[1]
    assert [r.vi for r in s.vi.collect()] == [10.0, 0.0]
    assert s[2000.25].check() and s.timestamps == [1000.5, 2000.25]


def test_duplicates_and_modes(spark):
    s = BookSeries(spark)
    s.set_snapshot([(1, 1)], [], 5)
    with pytest.raises(ValueError):
        s.set_snapshot([(2, 1)], [], 5)
    s.set_snapshot([(2, 1)], [], 5, force=True)
    assert s[5].bid == 2 and s.len == 1
    late = BookSeries(spark, mode="latest")
    late.set_snapshot([(1, 1)], [], 5)
    late.set_snapshot([(2, 1)], [], 5)
    late.set_updates([("b", 3, 1)], 6)
    assert late.len == 2 and late[6].bid == 3
    strict = BookSeries(spark, strict=True)
    strict.set_updates([("b", 3, 1)], 6)
    with pytest.raises(ValueError):
        strict.update("b", 3, 2, 6)


def test_late_update_builds_on_the_newest_book(spark):
    s = BookSeries(spark)
    s.set_snapshot([(100, 10)], [(101, 5)], 3000)
    s.set_updates([("b", 100, 7)], 1000)
    assert s[1000].bidq == 7 and s[3000].bidq == 10 and s[1000].askq == 5


def test_series_diff_keeps_unchanged_points(spark):
    a, b = BookSeries(spark), BookSeries(spark)
    for s, q in ((a, 10), (b, 12)):
        s.set_snapshot([(100, 10)], [(101, 5)], 1)
        s.set_snapshot([(100, q)], [(101, 5)], 2)
    b.set_snapshot([], [], 3)
    assert a.diff(b) == {1: ([], []), 2: ([(100.0, 12.0)], [])}


def model(batches, mode):
    books = {}
    for b in batches:
        if b["kind"] == "s":
            if mode == "latest":
                books = {}
            book = {(s, p): q for s, p, q in b["rows"]}
        else:
            book = dict(books[max(books)]) if books else {}
            for s, p, q in b["rows"]:
                if q == 0:
                    book.pop((s, p), None)
                else:
                    book[s, p] = q
        books[b["ts"]] = book
    return books


def tape(rng, ordered):
    out, t = [], 0
    for _ in range(rng.randint(1, 14)):
        t = t + 1 if ordered else rng.randint(0, 9)
        kind = "s" if rng.random() < 0.3 else "u"
        out.append({"kind": kind, "ts": t, "rows": [(rng.choice("ba"), rng.randint(1, 5), rng.randint(0, 3)) for _ in range(rng.randint(0, 4))]})
    return out


@pytest.mark.parametrize("mode", ["delta", "latest"])
def test_random_tapes(spark, mode, monkeypatch):
    """Many random tapes at once, each a book of its own."""
    rng, expected, books, points = random.Random(3), set(), {}, set()
    for book in range(60):
        batches = tape(rng, book % 2)
        books[book] = batches
        for ts, levels in model(batches, mode).items():
            points.add((book, ts))
            expected |= {(book, ts, s, float(p), float(q)) for (s, p), q in levels.items()}
    t, p = from_books(spark, books)
    for width, fan in ((3, 2), (256, 8)):
        monkeypatch.setattr(state, "CHUNK_POINTS", width)
        monkeypatch.setattr(state, "FAN", fan)
        kept, live = state.live_levels(t, p, mode)
        assert {(r[0], int(r[1])) for r in kept.collect()} == points
        assert {(r[0], int(r[1]), *r[2:]) for r in live.collect()} == expected
        plain = lambda df: sorted((r["book_id"], int(r["ts"]), r["bid"], r["bidq"], r["ask"], r["askq"]) for r in df.collect())
        assert plain(state.tops(state.books(t, p, mode))) == plain(state.top(kept, live))


def test_random_flow(spark):
    rng, expected, tapes = random.Random(5), {}, {}
    for book in range(40):
        batches = tape(rng, True)
        tapes[book] = batches
        books = model(batches, "delta")
        a = c = 0
        for x, y in zip(sorted(books), sorted(books)[1:]):
            for k in books[x].keys() | books[y].keys():
                d = books[y].get(k, 0) - books[x].get(k, 0)
                a, c = a + max(d, 0), c + max(-d, 0)
        expected[book] = (a, c)
    t, p = from_books(spark, tapes)
    got = {r["book_id"]: (r["arrivals"], r["cancels"]) for r in flow.flow_by_book(t, p).collect()}
    assert got == expected


def test_slices_and_moments_read_their_part(spark, monkeypatch):
    """Books of a range or of single moments equal those of the whole, from fewer spans."""
    rng = random.Random(11)
    tapes = {book: tape(rng, True) + [{"kind": "u", "ts": 100 + i, "rows": [(rng.choice("ba"), rng.randint(1, 5), rng.randint(0, 3))]} for i in range(300)] for book in range(3)}
    t, p = from_books(spark, tapes)
    monkeypatch.setattr(state, "CHUNK_POINTS", 16)
    whole = state.books(t, p)
    rows = lambda df, *where: sorted((r["book_id"], int(r["ts"]), r["side"], r["price"], r["size"]) for r in df.where(F.expr(*where) if where else F.lit(True)).collect())
    part = state.books(t, p, start=150, end=160)
    assert rows(state.live(part)) == rows(state.live(whole), "ts between 150 and 160") and rows(state.live(part))
    moments = p.where("ts in (120, 333)").select("book_id", "ts").union(spark.createDataFrame([(0, Decimal(7777))], "book_id long, ts decimal(38,0)"))
    at = state.books(t, p, axis=moments)
    assert rows(state.live(at)) == rows(state.live(whole), "ts in (120, 333)")
    assert at.spans.count() < 2 * 3 * 10 and part.spans.count() < whole.spans.count() / 5
    there = {(r["book_id"], int(r["ts"])): r["there"] for r in depth.at_moments(whole.kept, moments).collect()}
    assert there == {(b, ts): True for b in range(3) for ts in (120, 333)} | {(0, 7777): False}


def test_chunks_of_points_that_lie_close(spark):
    """Nine points of ten in a hundredth of the arrival numbers: chunks hold alike many."""
    seqs = sorted({*range(10_000, 10_900), *range(0, 90_000, 900)})
    points = spark.createDataFrame([(b, s, Decimal(s), "u") for b in (1, 2) for s in seqs], "book_id long, seq long, ts decimal(38,0), kind string")
    sizes = [r["count"] for r in state.numbered(points).groupBy("book_id", "chunk").count().collect()]
    assert max(sizes) == state.CHUNK_POINTS and sum(sizes) == 2 * len(seqs)


def test_span_diff_equals_the_diff_of_books(spark, monkeypatch):
    """Two series over different points: only timestamps of both count."""
    rng = random.Random(12)
    left, right = ({b: [x for x in tape(rng, True) + tape(rng, True)] for b in range(25)} for _ in range(2))
    for tapes in (left, right):
        for batches in tapes.values():
            for i, x in enumerate(batches):
                x["ts"] = 2 * i + (rng.random() < 0.3)
    (t1, p1), (t2, p2) = (from_books(spark, x) for x in (left, right))
    monkeypatch.setattr(state, "CHUNK_POINTS", 4)
    axis = p1.join(p2, ["book_id", "ts"], "left_semi").select("book_id", "ts")
    got = flow.span_diff(*(state.books(t, p, axis=axis) for t, p in ((t1, p1), (t2, p2))))
    want = flow.series_diff(*(state.live_levels(t, p) for t, p in ((t1, p1), (t2, p2))))
    plain = lambda df: sorted((r["book_id"], int(r["ts"]), r["n_bids"], r["n_asks"], r["qty"], r["bids"], r["asks"]) for r in df.collect())
    assert plain(got) == plain(want) and any(r["n_bids"] for r in want.collect())


@pytest.mark.parametrize("mode", ["delta", "latest", "current"])
def test_series_over_a_table(spark, mode):
    """The same answers as of a series of literal batches."""
    rng = random.Random(21)
    batches = tape(rng, False) + tape(rng, False) + [{"kind": "u", "ts": 3, "rows": [("b", 2, 2)]}]
    literal = BookSeries(spark, mode=mode)
    for b in batches:
        rows = [(s, float(p), float(q)) for s, p, q in b["rows"]]
        if b["kind"] == "s":
            literal.set_snapshot(*[[(p, q) for s, p, q in rows if s == side] for side in "ba"], b["ts"], force=True)
        else:
            literal.set_updates(rows, b["ts"])
    over = BookSeries.of_tape(*from_books(spark, {0: batches}), mode=mode)
    assert over.timestamps == literal.timestamps and over.len == literal.len
    plain = lambda df: [tuple(map(str, r)) for r in df.collect()]
    for name in ("spread", "bid", "ask", "vi"):
        assert plain(getattr(over, name)) == plain(getattr(literal, name)), name
    assert plain(over.table()) == plain(literal.table()) and over.update_frequency() == literal.update_frequency()
    literal.release()
    assert literal.len == over.len


def _long_tape(spark, n=150):
    from depthbook.sources.tape import from_batches

    rng = random.Random(8)
    batches = [{"kind": "u", "ts": i, "rows": [("b" if rng.random() < 0.5 else "a", 10 + rng.randrange(9), rng.randrange(4))]} for i in range(n)]
    return batches, *from_batches(spark, batches)


def test_best_prices_by_blocks(spark, monkeypatch):
    """Tasks of best prices follow the number of points, and blocks cut long spans."""
    monkeypatch.setattr(state, "FAN", 2)
    monkeypatch.setattr(state, "TASK_TOPS", 10, raising=False)
    batches, tape, points = _long_tape(spark)
    tops = state.tops(state.books(tape, points))
    assert tops.rdd.getNumPartitions() == 15  # 4 by shuffle partitions alone
    book, want = {}, {}
    for b in batches:
        for side, price, size in b["rows"]:
            book.pop((side, price), None)
            if size:
                book[side, price] = size
        bid, ask = (f((p for s, p in book if s == x), default=0) for f, x in ((max, "b"), (min, "a")))
        want[b["ts"]] = (bid, book.get(("b", bid), 0), ask, book.get(("a", ask), 0))
    assert {int(r["ts"]): (r["bid"], r["bidq"], r["ask"], r["askq"]) for r in tops.collect()} == want


def _sizes_by_time(batches):
    """{(side, price): size} after each batch of updates, by its timestamp."""
    book, out = {}, {}
    for b in batches:
        for side, price, size in b["rows"]:
            book.pop((side, price), None)
            if size:
                book[side, price] = size
        out[b["ts"]] = dict(book)
    return out


def test_best_prices_of_points_of_many_rows(spark, monkeypatch):
    """Tasks follow the rows where points are few, and blocks get shorter with them."""
    from depthbook.sources.tape import from_batches

    monkeypatch.setattr(state.ranks, "RANGE_ROWS", 100)
    monkeypatch.setattr(state, "FAN", 2)
    monkeypatch.setattr(state, "TASK_TOPS", 20)
    rng = random.Random(9)
    batches = [{"kind": "u", "ts": i, "rows": [(s, 10 + x, rng.randrange(3)) for s in "ba" for x in rng.sample(range(12), 5)]} for i in range(50)]
    tape, points = from_batches(spark, batches)
    tops = state.tops(state.books(tape, points))
    monkeypatch.setattr(state, "TASK_ROWS", 50)
    assert state.books(tape, points, in_order=True, collapsed=True).spans.rdd.getNumPartitions() == 10
    assert tops.rdd.getNumPartitions() == 25  # 4 by the number of points
    per = tops.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert per <= 10  # a block of sixteen points was one task's
    want = {}
    for ts, book in _sizes_by_time(batches).items():
        bid, ask = (f((p for s, p in book if s == x), default=0) for f, x in ((max, "b"), (min, "a")))
        want[ts] = (bid, book.get(("b", bid), 0), ask, book.get(("a", ask), 0))
    assert {int(r["ts"]): (r["bid"], r["bidq"], r["ask"], r["askq"]) for r in tops.collect()} == want


def test_spans_and_points_of_many_rows_are_dealt_once(spark, monkeypatch):
    """The window over a level's rows keeps the tasks that follow from the number of rows."""
    monkeypatch.setattr(state.ranks, "RANGE_ROWS", 20)
    monkeypatch.setattr(state, "TASK_ROWS", 10)
    batches, tape, points = _long_tape(spark)
    b = state.books(tape, in_order=True, collapsed=True)
    assert b.spans.rdd.getNumPartitions() == 15  # one, of all rows, when it is dealt again
    assert state._points_of(tape, 150).rdd.getNumPartitions() == 15
    live = {}
    for r in state.live(b).collect():
        live.setdefault(int(r["ts"]), {})[r["side"], r["price"]] = r["size"]
    assert live == {ts: book for ts, book in _sizes_by_time(batches).items() if book}
    few = [tuple(r) for r in state.tops(b).orderBy("ts").collect()]
    assert few == [tuple(r) for r in state.tops(state.books(tape, points)).orderBy("ts").collect()]


def test_properties_of_a_table_find_best_prices_once(spark, monkeypatch):
    _, tape, points = _long_tape(spark, 40)
    made, tops = [], state.tops
    monkeypatch.setattr(state, "tops", lambda b: (made.append(1), tops(b))[1])
    s = BookSeries.of_tape(tape, points)
    assert s.bid.join(s.ask, "ts").join(s.spread, "ts").join(s.vi, "ts").count() == 40
    assert len(made) == 1


def test_slice_of_a_table_reads_its_spans(spark):
    """A slice keeps what of the spans its points can see, and is a series like any other."""
    _, tape, points = _long_tape(spark)
    s = BookSeries.of_tape(tape, points)
    part = s[60:70]
    cut = part._books.spans.selectExpr("min(vf) lo", "max(vt) hi", "count(*) n").first()
    assert (cut.lo, cut.hi) == (60, 71) and cut.n < s._books.spans.count()
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(part.table()) == rows(s.table(60, 70))
    assert rows(part.bid) == rows(s.bid_ts(60, 70))
    assert s[200:300].table().count() == 0
