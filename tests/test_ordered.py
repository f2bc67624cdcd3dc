"""Ordered relations against Python lists."""

import random

import pyarrow.parquet as pq
import pytest
from depthbook.operators.ordered import Ordered
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(53)) for i in range(300)]
    return sorted(rows, key=lambda r: (r[1], r[0])), Ordered.of(spark.createDataFrame(rows, "i int, v int"), "v", ("i",))


def vals(df):
    return [(r["i"], r["v"]) for r in df.collect()]


def test_rank_and_slices(data):
    rows, rel = data
    assert vals(rel.sorted()) == rows and vals(rel.sorted(reverse=True)) == rows[::-1]
    for a, b, s in ((0, 10, 1), (5, None, 7), (-20, -3, 2), (None, None, -1), (250, 100, -9)):
        assert vals(rel.islice(a, b, s)) == rows[a:b:s], (a, b, s)
    assert vals(rel.peek(-3)) == [rows[-3]] and vals(rel.peek(0)) == [rows[0]]
    got, rest = rel.pop(4)
    assert vals(got) == [rows[4]] and len(rest) == 299
    assert vals(rel.delete(2, 50).sorted()) == rows[:2] + rows[50:]


@pytest.mark.parametrize("inclusive", [(True, True), (True, False), (False, True), (False, False)])
def test_irange(data, inclusive):
    rows, rel = data
    want = [r for r in rows if (10 <= r[1] if inclusive[0] else 10 < r[1]) and (r[1] <= 30 if inclusive[1] else r[1] < 30)]
    assert vals(rel.irange(10, 30, inclusive)) == want
    assert vals(rel.irange(10, 30, inclusive, reverse=True)) == want[::-1]


def test_search(data):
    rows, rel = data
    keys = [r[1] for r in rows]
    assert rel.bisect_left({"v": 17}) == rel.bisect_left(17)
    assert rel.bisect_left(17) == sum(k < 17 for k in keys) and rel.bisect_right(17) == sum(k <= 17 for k in keys)
    assert rel.index(F.col("v") == 17) == keys.index(17) and rel.count_of(F.col("v") == 17) == keys.count(17)
    with pytest.raises(ValueError):
        rel.index(F.col("v") == 17, 0, 3)
    assert rel.contains(F.col("v") == 17) and not rel.contains(F.col("v") == 99)
    with pytest.raises(ValueError):
        rel.remove(F.col("v") == 99)
    assert len(rel.discard(F.col("v") == 17, one=True)) == 299
    with pytest.raises(NotImplementedError):
        rel.append(1)


def test_algebra(spark):
    make = lambda xs, u: Ordered.of(spark.createDataFrame([(x,) for x in xs], "v int"), "v", unique=u)
    a, b = make([1, 2, 2, 3], "row"), make([3, 4], "row")
    got = lambda o: sorted(r[0] for r in o.rows.collect())
    assert got(a.union(b)) == [1, 2, 3, 4] and got(a.intersection(b)) == [3] and got(a.difference(b)) == [1, 2]
    assert got(a.symmetric_difference(b)) == [1, 2, 4] and not a.isdisjoint(b) and make([2], "row").issubset(a) and a.issuperset(make([2], "row"))
    m = make([1, 2, 2], "no")
    assert got(m.concat(m)) == [1, 1, 2, 2, 2, 2] and got(m.repeat(2)) == [1, 1, 2, 2, 2, 2] and len(m.repeat(0)) == 0
    assert m.equals(make([2, 1, 2], "no")) and not m.equals(make([2, 1], "no")) and len(m.clear()) == 0


def test_maps(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k int, v int, n int")
    m = Ordered.of(frame([(1, 10, 0), (1, 11, 1), (2, 20, 2)]), "k", unique="key", newest="n")
    other = Ordered.of(frame([(2, 99, 0), (3, 30, 0)]), "k", unique="key", newest="n")
    got = lambda o: sorted((r["k"], r["v"]) for r in o.rows.collect())
    assert got(m) == [(1, 11), (2, 20)] and got(m.merge(other)) == [(1, 11), (2, 99), (3, 30)]
    assert got(m.setdefault(other.rows)) == [(1, 11), (2, 20), (3, 30)]


def test_deletes_and_places_as_a_list(spark):
    rows = spark.createDataFrame([(i,) for i in range(9)], "v int")
    for start, stop, step in ((None, None, -2), (7, 1, -3), (2, 8, 2), (-3, None, 1)):
        want = list(range(9))
        del want[start:stop:step]
        assert sorted(r[0] for r in Ordered.of(rows, "v").delete(start, stop, step).rows.collect()) == want
    for index in (9, -10):
        with pytest.raises(IndexError):
            Ordered.of(rows, "v").pop(index)
    assert Ordered.of(rows, "v").pop(-9)[0].first()[0] == 0


def test_map_values(spark):
    m = Ordered.of(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "k", unique="key")
    assert m.get("a", "v") == 1 and m.get("z", "v") is None and m.get("z", "v", 7) == 7
    value, rest = m.pop_key("a", "v")
    assert value == 1 and [tuple(r) for r in rest.rows.collect()] == [("b", 2)]
    assert m.pop_key("z", "v", 9)[0] == 9
    with pytest.raises(KeyError):
        m.pop_key("z", "v")
    same = Ordered.fromkeys(m.rows, "k", "v", 5)
    assert sorted(map(tuple, same.rows.collect())) == [("a", 5), ("b", 5)]
    assert m.iloc(0) == "a" and m.iloc(-1) == "b"
    with pytest.raises(IndexError):
        m.iloc(2)


@pytest.mark.parametrize("kind, values", [("string", ["b", "é", "", "abcdefgh", "abcdefgz", "中", "b"]), ("date", ["2024-02-01", "1969-12-31", "2024-01-31"]), ("timestamp", ["2024-02-01 01:00:00", "1969-12-31 23:00:00", "2024-01-31 00:00:01"]), ("double", [2.5, -1.0, 0.25])])
def test_ranks_of_any_type(spark, kind, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").selectExpr(f"cast(v as {kind}) as v")
    got = [r["v"] for r in Ordered.of(rows, "v").ranked().orderBy("rank").collect()]
    assert got == sorted(r["v"] for r in rows.collect())


@pytest.mark.parametrize("a, b", [([1, 2], [1, 2, 3]), ([1, 3], [1, 2, 3]), ([], [1]), ([1, 2], [1, 2]), ([], [])])
def test_compare_as_sequences(spark, a, b):
    x, y = (Ordered.of(spark.createDataFrame([(v,) for v in values], "v int"), "v") for values in (a, b))
    assert (x < y, x <= y, x > y, x >= y) == (a < b, a <= b, a > b, a >= b)


def test_discard_keeps_null_rows(spark):
    rows = Ordered.of(spark.createDataFrame([(1,), (1,), (None,)], "v int"), "v")
    assert sorted(r["v"] or 0 for r in rows.discard(rows.key == 1).rows.collect()) == [0]
    assert sorted(r["v"] or 0 for r in rows.discard(rows.key == 1, one=True).rows.collect()) == [0, 1]


@pytest.fixture(scope="module")
def hot(spark):
    """9,000 rows in ranges of about 500: a key and a whole row that a third of them share."""
    rng = random.Random(3)
    rows = [(7, 0) if i % 3 == 0 else (7, i) if i % 3 == 1 else (rng.randrange(1000), i) for i in range(9000)]
    made = spark.createDataFrame(rows, "v int, i int").repartition(4)
    return sorted(rows), Ordered(made, F.col("v"), ("i",), range_rows=500)


def test_ranks_of_a_hot_key(hot):
    rows, rel = hot
    ranked = rel.ranked()
    assert [(r["v"], r["i"]) for r in ranked.orderBy("rank").collect()] == rows
    assert sorted(r["rank"] for r in ranked.select("rank").collect()) == list(range(9000))
    files = [f.removeprefix("file://") for f in ranked.inputFiles() if "/ranges-" in f]
    sizes = [n for n in (pq.read_metadata(f).num_rows for f in files) if n]
    assert len(sizes) >= 18 and max(sizes) < 2 * 500


def test_slices_of_many_ranges(hot):
    rows, rel = hot
    for a, b, s in ((450, 1100, 1), (5, None, 701), (-20, -3, 2), (None, None, -899)):
        assert [(r["v"], r["i"]) for r in rel.islice(a, b, s).collect()] == rows[a:b:s]
    assert rel.index(F.col("v") == 7) == [v for v, _ in rows].index(7)
    got, rest = rel.pop(4000)
    assert tuple(got.first()) == rows[4000] and sorted(map(tuple, rest.rows.collect())) == rows[:4000] + rows[4001:]


def test_bisect_through_the_key_function(spark, hot):
    rows, _ = hot
    made = spark.createDataFrame(rows, "v int, i int")
    rel = Ordered(made, F.col("v") % 10, ("i",), range_rows=3)
    keys = [v % 10 for v, _ in rows]
    assert rel.key_of({"v": 123}) == 3
    assert rel.bisect([{"v": 123}, {"v": 9}, {"v": 123}]) == {i: sum(k <= w for k in keys) for i, w in enumerate((3, 9, 3))}
    assert rel.bisect_left({"v": 55}) == sum(k < 5 for k in keys) and rel.bisect_key([5], right=False) == {5: sum(k < 5 for k in keys)}
    values = spark.createDataFrame([(1, 17), (2, 17), (3, 123), (4, 1008), (5, -5)], "n int, v int")
    key = lambda v: v % 10 if v >= 0 else -(-v % 10)
    got = {r["n"]: (r["lo"], r["hi"]) for r in rel.bisect_rows(values).collect()}
    assert got == {n: (sum(k < key(v) for k in keys), sum(k <= key(v) for k in keys)) for n, v in ((1, 17), (2, 17), (3, 123), (4, 1008), (5, -5))}


def test_views(spark):
    make = lambda pairs: Ordered.of(spark.createDataFrame(pairs, "k string, v int"), "k", unique="key")
    pairs = [(c, i % 3) for i, c in enumerate("abcdefgh")]
    m, other = make(pairs), make([("c", 2), ("d", 9), ("z", 1)])
    keys, items, values = m.keys(), m.items("v"), m.values("v")
    plain = lambda rows: [tuple(r) for r in rows.collect()]
    assert keys[0][0] == "a" and keys[-1][0] == "h" and tuple(items[2]) == ("c", 2) and values[4][0] == 1
    for cut in (slice(2, 5), slice(None, None, -2), slice(-3, None), slice(6, 1, -3)):
        assert plain(keys[cut]) == [(k,) for k, _ in pairs[cut]]
        assert plain(items[cut]) == pairs[cut] and plain(values[cut]) == [(v,) for _, v in pairs[cut]]
        want = list(pairs)
        del want[cut]
        assert sorted(plain(keys.delete(cut).rows)) == want
    with pytest.raises(IndexError):
        keys[8]
    with pytest.raises(IndexError):
        items.delete(-9)
    assert len(values) == 8 and values.count_of(1) == 3 and values.index(2) == 2 and values.index(2, start=3) == 5
    assert keys.contains("c") and not keys.contains("z") and items.contains("c", 2) and not items.contains("c", 1)
    assert plain(keys.sorted(reverse=True))[0] == ("h",) and sorted(plain(items.delete(0).rows)) == pairs[1:]
    own, more = {k for k, _ in pairs}, {"c", "d", "z"}
    for got, want in ((keys & other.keys(), own & more), (keys | other.keys(), own | more), (keys - other.keys(), own - more), (keys ^ other.keys(), own ^ more)):
        assert {r[0] for r in got.rows.collect()} == want
    assert plain((items & other.items("v")).rows) == [("c", 2)] and not keys.isdisjoint(other.keys())
    with pytest.raises(TypeError):
        values & values


def test_flags(spark):
    make = lambda xs: Ordered.of(spark.createDataFrame([(x,) for x in xs], "v int"), "v", unique="row")
    for a, b in (([1, 2], [1, 2, 3]), ([1], [2]), ([], []), ([], [1]), ([1, None], [None, 1])):
        got = tuple(make(a).flags_frame(make(b)).first())
        assert got == (set(a) <= set(b), set(a) >= set(b), set(a).isdisjoint(b))


def test_tables_of_values(spark):
    """Membership, look-ups and removals for tables of values, nulls and repeats among them."""
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "c")], "k long, v string")
    o = Ordered.of(rows, "k")
    asked = spark.createDataFrame([(7, 1), (8, 1), (9, None), (10, 5)], "who long, k int")
    assert {r["who"]: r["there"] for r in o.contains_rows(asked).collect()} == {7: True, 8: True, 9: True, 10: False}
    assert o.contains_rows(asked.limit(0)).count() == 0 and not any(r["there"] for r in o.clear().contains_rows(asked).collect())
    with pytest.raises(ValueError):
        o.contains_rows(asked.select("who"))
    m = Ordered.of(rows, "k", unique="key")
    assert {r["who"]: r["v"] for r in m.get_rows(asked, "v", default="x").collect()} == {7: "a", 8: "a", 9: "c", 10: "x"}
    less = o.remove_rows(spark.createDataFrame([("a", 1), ("c", None)], "v string, k long")).rows
    assert sorted(map(str, less.collect())) == sorted(map(str, [rows.first(), *rows.where("k = 2").collect()]))
    with pytest.raises(ValueError):
        o.remove_rows(rows.union(rows))
    assert o.discard_rows(rows.union(rows)).count() == 0
