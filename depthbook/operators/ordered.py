"""Ordered relations: a DataFrame with a sort key and a tie-break, addressed by value,
key or rank.

Ranks come from ranges of the whole sort key (plans/ranks.py), so neither a long relation
nor a frequent key is one task.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthbook.plans import ranks


@dataclass(frozen=True)
class Ordered:
    """rows, the key (a Column expression, the identity for plain values) and the columns
    that order equal keys. unique: 'no' (multiset), 'row' (set), 'key' (map)."""

    rows: DataFrame
    key: Column
    tie: tuple[str, ...] = ()
    unique: str = "no"
    range_rows: int = ranks.RANGE_ROWS

    # construction and bulk change

    @staticmethod
    def of(rows: DataFrame, key: str | Column, tie: tuple[str, ...] = (), unique: str = "no", newest: str | None = None) -> Ordered:
        """A set keeps one of equal rows; a map the newest row of each key."""
        key = F.col(key) if isinstance(key, str) else key
        if unique == "row":
            rows = rows.distinct()
        elif unique == "key":
            w = Window.partitionBy(key).orderBy(F.desc(newest) if newest else F.lit(0))
            rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        return Ordered(rows, key, tie, unique)

    def with_rows(self, rows: DataFrame) -> Ordered:
        return replace(self, rows=rows)

    def update(self, more: DataFrame) -> Ordered:
        """Add rows: all of them, the new ones of a set, or those that win in a map."""
        if self.unique == "key":
            old = self.rows.withColumn("_k", self.key).join(more.select(self.key.alias("_k")), "_k", "left_anti").drop("_k")
            return self.with_rows(old.unionByName(more))
        both = self.rows.unionByName(more)
        return self.with_rows(both.distinct() if self.unique == "row" else both)

    add = update

    def discard(self, value: Column, one: bool = False) -> Ordered:
        """Without the rows that meet a condition; with `one`, without the first of them."""
        if not one:
            return self.with_rows(self.rows.where(~F.coalesce(value, F.lit(False))))
        return self.with_rows(self.rows.exceptAll(self.rows.where(value).orderBy(self.key, *self.tie).limit(1)))

    def remove(self, value: Column) -> Ordered:
        if not self.contains(value):
            raise ValueError("no such row")
        return self.discard(value, one=True)

    def clear(self) -> Ordered:
        return self.with_rows(self.rows.limit(0))

    def copy(self) -> Ordered:
        return self

    def setdefault(self, more: DataFrame) -> Ordered:
        """Insert rows whose key is absent."""
        new = more.withColumn("_k", self.key).join(self.rows.select(self.key.alias("_k")), "_k", "left_anti").drop("_k")
        return self.with_rows(self.rows.unionByName(new))

    def get(self, key, column: str, default=None):
        """The value of a map's key."""
        row = self.rows.where(self.key == key).select(column).first()
        return default if row is None else row[0]

    def pop_key(self, key, column: str, *default):
        """(value, map without the key); an absent key needs a default."""
        row = self.rows.where(self.key == key).select(column).first()
        if row is None and not default:
            raise KeyError(key)
        return (row[0] if row is not None else default[0]), self.discard(self.key == key)

    @staticmethod
    def fromkeys(rows: DataFrame, key: str, column: str, value=None) -> Ordered:
        """A map that gives every key of `rows` one value."""
        return Ordered(rows.select(key).distinct().withColumn(column, F.lit(value)), F.col(key), unique="key")

    def keys(self) -> View:
        return View(self, (self.key.alias("key"),), True)

    def items(self, *columns: str) -> View:
        """Keys with the values of some columns (all by default)."""
        return View(self, (self.key.alias("key"), *map(F.col, columns or self.rows.columns)), True)

    def values(self, *columns: str) -> View:
        return View(self, tuple(map(F.col, columns or self.rows.columns)), False)

    # order and rank

    def sorted(self, reverse: bool = False) -> DataFrame:
        by = [self.key, *map(F.col, self.tie)]
        return self.rows.orderBy(*([c.desc() for c in by] if reverse else by))

    def ranked(self) -> DataFrame:
        """rows and `rank`, from 0."""
        return ranks.number(self.rows, [self.key, *map(F.col, self.tie)], "rank", self.range_rows)

    def count(self) -> int:
        return self.rows.count()

    __len__ = count

    def _span(self, start: int | None, stop: int | None) -> tuple[int, int | None]:
        """Bounds from 0; negative ones count from the end."""
        n = self.count() if (start or 0) < 0 or (stop or 0) < 0 else 0
        start = max(0, start + n) if start is not None and start < 0 else start or 0
        return start, max(0, stop + n) if stop is not None and stop < 0 else stop

    def islice(self, start: int | None = None, stop: int | None = None, step: int = 1, reverse: bool = False) -> DataFrame:
        """Rows of rank start <= rank < stop, every step-th."""
        if step < 0:  # as Python slices count down
            n = self.count()
            hi, lo, _ = slice(start, stop, step).indices(n)
            r = F.col("rank")
            return self.ranked().where((r <= hi) & (r > lo) & ((F.lit(hi) - r) % -step == 0)).orderBy(F.desc("rank"))
        start, stop = self._span(start, stop)
        rows = self.ranked().where(F.col("rank") >= start)
        rows = rows.where(F.col("rank") < stop) if stop is not None else rows
        rows = rows.where((F.col("rank") - start) % step == 0) if step != 1 else rows
        return rows.orderBy(F.desc("rank") if reverse else "rank")

    def peek(self, index: int = -1) -> DataFrame:
        """The row at a rank; the ends need no ranks."""
        if index in (0, -1):
            return self.sorted(reverse=index < 0).limit(1)
        start = self._place(index)
        return self.ranked().where(F.col("rank") == start).drop("rank")

    def iloc(self, index: int):
        """The key at a rank."""
        self._place(index)
        return self.peek(index).select(self.key).first()[0]

    def _place(self, index: int) -> int:
        """The rank at an index, which must be there."""
        n = self.count()
        if not -n <= index < n:
            raise IndexError(f"no rank {index} among {n} rows")
        return index + n if index < 0 else index

    def pop(self, index: int = -1) -> tuple[DataFrame, Ordered]:
        start = self._place(index)
        r = self.ranked()
        return r.where(F.col("rank") == start).drop("rank"), self.with_rows(r.where(F.col("rank") != start).drop("rank"))

    def delete(self, start: int | None = None, stop: int | None = None, step: int = 1) -> Ordered:
        r = F.col("rank")
        if step < 0:  # the ranks that a Python slice counting down names
            hi, lo, _ = slice(start, stop, step).indices(self.count())
            hit = (r <= hi) & (r > lo) & ((F.lit(hi) - r) % -step == 0)
        else:
            lo, hi = self._span(start, stop)
            hit = (r >= lo) & (r < hi if hi is not None else F.lit(True)) & ((r - lo) % step == 0)
        return self.with_rows(self.ranked().where(~hit).drop("rank"))

    # by value

    def _asked(self, values: DataFrame) -> tuple[DataFrame, list[str]]:
        """Rows of `values` beside what they share with this relation's rows, in its types."""
        kinds = {f.name: f.dataType for f in self.rows.schema.fields}
        on = [c for c in values.columns if c in kinds]
        if not on:
            raise ValueError(f"none of {values.columns} is a column of the relation")
        return values.select(F.struct("*").alias("_v"), F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in on]).alias("_k")), on

    def contains_rows(self, values: DataFrame) -> DataFrame:
        """`values` with `there`: whether a row has their values in the columns that both
        have. Null equals null; rows of `values` that repeat are answered each."""
        asked, on = self._asked(values)
        known = self.rows.select(F.struct(*on).alias("_of")).distinct()
        met = asked.join(known, F.col("_k").eqNullSafe(F.col("_of")), "left")
        return met.select("_v.*", F.col("_of").isNotNull().alias("there"))

    def get_rows(self, keys: DataFrame, *columns: str, default=None) -> DataFrame:
        """`keys`, whose columns the key expression reads, with the values that a map gives
        them in some columns; `default` where the key is absent."""
        asked = keys.select(F.struct("*").alias("_v"), self.key.alias("_k"))
        held = self.rows.select(self.key.alias("_of"), F.struct(*columns).alias("_is"))
        met = asked.join(held, F.col("_k").eqNullSafe(F.col("_of")), "left")
        value = lambda c: F.when(F.col("_is").isNotNull(), F.col(f"_is.{c}")).otherwise(F.lit(default)).alias(c)
        return met.select("_v.*", *map(value, columns))

    def discard_rows(self, values: DataFrame) -> Ordered:
        """Without one row for each row of `values` that is there; both have the same
        columns. Equal rows are counted, not numbered, so a frequent one is one count."""
        return self.with_rows(self.rows.exceptAll(values.select(*self.rows.columns)))

    def remove_rows(self, values: DataFrame) -> Ordered:
        """As discard_rows, but every row of `values` must be there, as often as it occurs."""
        if values.select(*self.rows.columns).exceptAll(self.rows).limit(1).count():
            raise ValueError("rows that are not there")
        return self.discard_rows(values)

    def contains(self, value: Column) -> bool:
        return bool(self.rows.where(value).limit(1).count())

    def irange(self, low=None, high=None, inclusive: tuple[bool, bool] = (True, True), reverse: bool = False, ordered: bool = True) -> DataFrame:
        """Rows whose key lies in a range, each end open or closed, None unbounded."""
        rows = self.rows
        if low is not None:
            rows = rows.where((operator.ge if inclusive[0] else operator.gt)(self.key, low))
        if high is not None:
            rows = rows.where((operator.le if inclusive[1] else operator.lt)(self.key, high))
        return self.with_rows(rows).sorted(reverse) if ordered else rows

    irange_key = irange

    def bisect_frame(self, keys: list) -> DataFrame:
        """(value, lo, hi): the left and right insertion ranks of several keys, in one pass
        when the frame is read."""
        lo, hi = (F.array(*[F.count(F.when(cmp(self.key, v), 1)) for v in keys]) for cmp in (operator.lt, operator.le))
        both = self.rows.agg(F.arrays_zip(F.array(*map(F.lit, keys)).alias("value"), lo.alias("lo"), hi.alias("hi")).alias("at"))
        return both.select(F.inline("at").alias("value", "lo", "hi"))

    def bisect_key(self, keys: list, right: bool = True) -> dict:
        """Insertion ranks of several keys."""
        return {r["value"]: r["hi" if right else "lo"] for r in self.bisect_frame(list(keys)).collect()}

    def key_of(self, value: dict):
        """The key that the key expression gives a row, named by its columns."""
        kinds = {f.name: f.dataType for f in self.rows.schema.fields}
        return self.rows.sparkSession.range(1).select(*[F.lit(v).cast(kinds[n]).alias(n) for n, v in value.items()]).select(self.key).first()[0]

    def bisect(self, values: list, right: bool = True) -> dict:
        """Insertion ranks of several values; a value is a row (a dict of the columns that
        the key reads, which then is the answer's place) or, of plain values, the key."""
        keys = [self.key_of(v) if isinstance(v, dict) else v for v in values]
        found = self.bisect_key(sorted(set(keys)), right)
        return {i if isinstance(v, dict) else v: found[k] for i, (v, k) in enumerate(zip(values, keys))}

    def bisect_left(self, value) -> int:
        return next(iter(self.bisect([value], right=False).values()))

    def bisect_right(self, value) -> int:
        return next(iter(self.bisect([value]).values()))

    def bisect_rows(self, values: DataFrame) -> DataFrame:
        """`values` with lo and hi: the insertion ranks of a table of values, whose columns
        the key expression reads.

        Rows are counted by key and the counts summed in the order of the keys, so no row
        meets every value and a frequent key is one count.
        """
        asked = values.select(F.struct("*").alias("_v"), self.key.alias("_k"))
        both = self.rows.select(self.key.alias("_k"), F.lit(1).alias("_own")).union(asked.select("_k", F.lit(0)))
        per = both.groupBy("_k").agg(F.sum("_own").alias("_n"))
        upto = ranks.running_sum(per, [F.col("_k")], "_n", "_hi", self.range_rows)
        met = asked.join(upto.withColumnRenamed("_k", "_of"), F.col("_k").eqNullSafe(F.col("_of")))
        return met.select("_v.*", (F.col("_hi") - F.col("_n")).alias("lo"), F.col("_hi").alias("hi"))

    def count_of(self, value: Column) -> int:
        return self.rows.where(value).count()

    def counts(self, *columns: str) -> DataFrame:
        """How often every value of some columns occurs: columns and n."""
        return self.rows.groupBy(*columns).agg(F.count("*").alias("n"))

    def first_ranks(self, *columns: str) -> DataFrame:
        """The smallest rank of every value of some columns: columns and first_rank."""
        return self.ranked().groupBy(*columns).agg(F.min("rank").alias("first_rank"))

    def index(self, value: Column, start: int | None = None, stop: int | None = None) -> int:
        """The smallest rank of a row that meets a condition, within [start, stop)."""
        lo, hi = self._span(start, stop)
        found = self.ranked().where(value & (F.col("rank") >= lo) & (F.col("rank") < hi if hi is not None else F.lit(True))).agg(F.min("rank")).first()[0]
        if found is None:
            raise ValueError("no such row in the range")
        return found

    # algebra

    def union(self, other: Ordered) -> Ordered:
        return self.update(other.rows)

    def concat(self, other: Ordered) -> Ordered:
        return self.with_rows(self.rows.unionByName(other.rows))

    def repeat(self, n: int) -> Ordered:
        return self.with_rows(self.rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("_i") if n > 0 else self.rows.limit(0))

    def intersection(self, other: Ordered) -> Ordered:
        return self.with_rows(self.rows.intersect(other.rows.select(*self.rows.columns)))

    def difference(self, other: Ordered) -> Ordered:
        return self.with_rows(self.rows.subtract(other.rows.select(*self.rows.columns)))

    def symmetric_difference(self, other: Ordered) -> Ordered:
        o = other.rows.select(*self.rows.columns)
        return self.with_rows(self.rows.subtract(o).union(o.subtract(self.rows)))

    def merge(self, other: Ordered) -> Ordered:
        """Of two maps; the other's value wins."""
        return replace(self, unique="key").update(other.rows)

    def flags_frame(self, other: Ordered) -> DataFrame:
        """(subset, superset, disjoint) of the two relations' different rows, in one
        aggregate when the frame is read."""
        side = lambda rows, a, b: rows.select(*self.rows.columns, F.lit(a).alias("_a"), F.lit(b).alias("_b"))
        both = side(self.rows, True, False).union(side(other.rows, False, True))
        rows = both.groupBy(*self.rows.columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
        flags = {"subset": F.col("_b"), "superset": F.col("_a"), "disjoint": ~(F.col("_a") & F.col("_b"))}
        return rows.agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(n) for n, c in flags.items()])

    def issubset(self, other: Ordered) -> bool:
        return not self.difference(other).rows.limit(1).count()

    def issuperset(self, other: Ordered) -> bool:
        return other.issubset(self)

    def isdisjoint(self, other: Ordered) -> bool:
        return not self.intersection(other).rows.limit(1).count()

    def equals(self, other: Ordered) -> bool:
        a, b = self.rows, other.rows.select(*self.rows.columns)
        return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()

    def compare_frame(self, other: Ordered) -> DataFrame:
        """(order): -1, 0 or 1, the lexicographic order of the two sequences of (key, ties).

        Two sorted sequences part at the smallest value that one has more often; there the
        other goes on with a larger value or ends. So counts decide, and no ranks are needed.
        """
        side = lambda o, a, b: o.rows.select(F.struct(o.key.alias("k"), *o.tie).alias("_v"), F.lit(a).alias("_a"), F.lit(b).alias("_b"))
        per = side(self, 1, 0).union(side(other, 0, 1)).groupBy("_v").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
        parts = per.agg(
            F.min(F.when(F.col("_a") != F.col("_b"), F.struct("_v", "_a", "_b"))).alias("at"),
            F.max(F.when(F.col("_a") > 0, F.col("_v"))).alias("last_a"),
            F.max(F.when(F.col("_b") > 0, F.col("_v"))).alias("last_b"),
        )
        goes_on = lambda last: F.coalesce(F.col(last) > F.col("at._v"), F.lit(False))
        order = F.when(F.col("at").isNull(), 0).when(F.col("at._a") > F.col("at._b"), F.when(goes_on("last_b"), -1).otherwise(1)).otherwise(F.when(goes_on("last_a"), 1).otherwise(-1))
        return parts.select(order.alias("order"))

    def compare(self, other: Ordered) -> int:
        """-1, 0 or 1: lexicographic order of the two sequences of (key, ties)."""
        return self.compare_frame(other).first()[0]

    def __lt__(self, other: Ordered) -> bool:
        return self.compare(other) < 0

    def __le__(self, other: Ordered) -> bool:
        return self.compare(other) <= 0

    def __gt__(self, other: Ordered) -> bool:
        return self.compare(other) > 0

    def __ge__(self, other: Ordered) -> bool:
        return self.compare(other) >= 0

    # what an ordered relation refuses

    def _no(self, *_, **__):
        raise NotImplementedError("an ordered relation has no such position")

    reverse = append = extend = insert = set_at = _no


@dataclass(frozen=True)
class View:
    """The keys, items or values of an ordered relation in its order, as a sequence; keys
    and items also as a set."""

    of: Ordered
    columns: tuple[Column, ...]
    is_set: bool

    @property
    def rows(self) -> DataFrame:
        return self.of.rows.select(*self.columns)

    def __len__(self) -> int:
        return self.of.count()

    def sorted(self, reverse: bool = False) -> DataFrame:
        return self.of.sorted(reverse).select(*self.columns)

    def slice(self, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
        return self.of.islice(start, stop, step).select(*self.columns)

    def __getitem__(self, index: int | slice):
        """A row, or the rows of a slice as a DataFrame in order."""
        if isinstance(index, slice):
            return self.slice(index.start, index.stop, 1 if index.step is None else index.step)
        self.of._place(index)
        return self.of.peek(index).select(*self.columns).first()

    def delete(self, index: int | slice) -> Ordered:
        """The relation without what the view has at an index or a slice."""
        if isinstance(index, slice):
            return self.of.delete(index.start, index.stop, 1 if index.step is None else index.step)
        return self.of.pop(index)[1]

    def _hit(self, values: tuple) -> Column:
        return reduce(operator.and_, [c.eqNullSafe(F.lit(v)) for c, v in zip(self.columns, values)])

    def contains(self, *values) -> bool:
        return self.of.contains(self._hit(values))

    def count_of(self, *values) -> int:
        return self.of.count_of(self._hit(values))

    def index(self, *values, start: int | None = None, stop: int | None = None) -> int:
        return self.of.index(self._hit(values), start, stop)

    def as_set(self) -> Ordered:
        """The view's rows as an ordered set of their own."""
        if not self.is_set:
            raise TypeError("values are no set")
        rows = self.rows
        return Ordered.of(rows, rows.columns[0], tuple(rows.columns[1:]), "row")

    def __and__(self, other: View) -> Ordered:
        return self.as_set().intersection(other.as_set())

    def __or__(self, other: View) -> Ordered:
        return self.as_set().union(other.as_set())

    def __sub__(self, other: View) -> Ordered:
        return self.as_set().difference(other.as_set())

    def __xor__(self, other: View) -> Ordered:
        return self.as_set().symmetric_difference(other.as_set())

    def isdisjoint(self, other: View) -> bool:
        return self.as_set().isdisjoint(other.as_set())
