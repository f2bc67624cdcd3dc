"""Live books: keyed state against the batch engine and plain dicts."""

import random
from decimal import Decimal

import pytest
from depthbook.plans import state
from depthbook.sources.tape import points_of
from depthbook.streaming import maintainer
from pyspark.sql import functions as F

TAPE = "book_id long, seq long, ord int, ts decimal(38,0), kind string, side string, price double, size double"


class Store(dict):
    """The map state's interface."""

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)

    def iterator(self):
        return iter(list(self.items()))


@pytest.mark.parametrize("near", [1, 2, 64, None])
def test_best_prices_of_a_deep_book(near):
    rng, store, book = random.Random(near), Store(), {"b": {}, "a": {}}
    levels = maintainer._Levels(store, {"b": (None, None), "a": (None, None)}, near)
    for n in range(3000):
        side, price = rng.choice("ba"), float(rng.randrange(60))
        size = None if rng.random() < 0.55 else float(n)
        levels.put(side, price, size)
        book[side].pop(price, None) if size is None else book[side].update({price: size})
        if rng.random() < 0.02:
            levels.clear()
            book = {"b": {}, "a": {}}
        over = {float(rng.randrange(60)): rng.choice((None, 7.0)) for _ in range(rng.randrange(4))}
        for s, best in (("b", max), ("a", min)):
            there = {p: q for p, q in (book[s] | over).items() if q is not None}
            assert levels.best(s, over) == ((best(there), there[best(there)]) if there else (None, None))
        if near:
            assert all(len(x) <= 2 * near + 4 for x in levels.near.values())
        if n % 700 == 0:  # the next micro-batch
            levels.flush()
            levels = maintainer._Levels(store, {s: levels.best(s, {}) for s in "ba"}, near)
    levels.flush()
    assert {k: v[0] for k, v in store.items()} == {(s, p): q for s in "ba" for p, q in book[s].items()}


def random_tape(spark, seed, points=240, prices=40, disorder=0):
    """Three books, one with most of the points; rows in any order within the table."""
    rng, rows = random.Random(seed), []
    for seq in range(points):
        book = rng.choice((0, 0, 0, 1, 2))
        kind = "s" if rng.random() < 0.04 else "u"
        ts = Decimal(seq // 2 * 10 - (rng.randrange(disorder) if disorder and rng.random() < 0.4 else 0))
        for i in range(rng.randint(1, 6)):
            rows.append((book, seq, i // 2, ts, kind, rng.choice("ba"), float(rng.randrange(prices)), float(rng.choice((0, 0, 1, 2, 3)))))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, TAPE)


def rows_of(df, *columns):
    return sorted(tuple(-1.0 if v is None else v for v in r) for r in df.select(*[F.col(c).cast("long") if c == "ts" else c for c in columns]).collect())


def test_restarts_and_small_batches_change_nothing(spark):
    """A hot book in pieces of 16 rows, near levels fewer than the book has, two restarts."""
    tape = random_tape(spark, 1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = maintainer.replay(tape, maintainer.live_points, 1)
    spark.conf.set(name, "16")
    try:
        pieces = maintainer.replay(tape, lambda t: maintainer.live_points(t, near=2), 3)
        got = rows_of(pieces, *pieces.columns)
    finally:
        spark.conf.unset(name)
    assert got == rows_of(whole, *whole.columns) and len(got) == tape.select("book_id", "seq").distinct().count()
    assert spark.conf.get("spark.sql.streaming.unsupportedOperationCheck", "true") == "true"


@pytest.mark.parametrize("mode", ["delta", "latest"])
def test_late_points_as_in_the_batch_engine(spark, mode):
    tape = random_tape(spark, 2, disorder=90)
    held, live = state.live_levels(tape, points_of(tape), mode)
    got = maintainer.kept(maintainer.replay(tape, lambda t: maintainer.live_levels(t, mode), 2), mode)
    columns = ("book_id", "ts", "side", "price", "size")
    assert rows_of(got.where("side is not null"), *columns) == rows_of(live, *columns)
    assert rows_of(got.select("book_id", "ts").distinct(), "book_id", "ts") == rows_of(held, "book_id", "ts")
    tops = maintainer.kept(maintainer.replay(tape, lambda t: maintainer.live_points(t, mode, near=1), 2), mode)
    columns = ("book_id", "ts", "bid", "bidq", "ask", "askq")
    assert rows_of(tops, *columns) == rows_of(state.top(held, live), *columns)


def test_dead_letters_lose_nothing(spark):
    tape = random_tape(spark, 3, disorder=90)
    out = maintainer.replay(tape, lambda t: maintainer.live_levels(t, delay=30), 2)
    tops, late = {}, set()
    for r in tape.select("book_id", "seq", F.col("ts").cast("long").alias("ts")).distinct().orderBy("seq").collect():
        if r["ts"] < tops.get(r["book_id"], r["ts"]) - 30:
            late.add(r["seq"])
        tops[r["book_id"]] = max(tops.get(r["book_id"], r["ts"]), r["ts"])
    assert late and {r["seq"] for r in out.where("late").select("seq").distinct().collect()} == late
    columns = ("book_id", "seq", "ts", "kind", "side", "price", "size")
    assert rows_of(out.where("late"), *columns) == rows_of(tape.where(F.col("seq").isin(*late)), *columns)
    # the others are those of a tape without them
    rest = maintainer.replay(tape.where(~F.col("seq").isin(*late)), maintainer.live_levels, 1)
    assert rows_of(out.where("not late"), *columns) == rows_of(rest, *columns)


def test_points_out_of_order_are_refused(spark):
    tape = random_tape(spark, 4, points=20)
    path = f"{maintainer.shared_dir(spark)}/backwards"
    stream = lambda: maintainer.live_top(spark.readStream.schema(tape.schema).parquet(f"{path}/tape"))
    tape.where("seq >= 10").write.parquet(f"{path}/tape")
    maintainer.run_available(stream(), f"{path}/out")
    tape.where("seq < 10").write.mode("append").parquet(f"{path}/tape")
    with pytest.raises(Exception, match="comes after point"):
        maintainer.run_available(stream(), f"{path}/out")


def test_empty_tape(spark):
    assert not maintainer.replay(random_tape(spark, 5).limit(0), maintainer.live_top).count()
