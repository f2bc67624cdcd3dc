"""Exact n-gram Jaccard similarity join with token-combination prefixes.

Two documents link when the Jaccard similarity of their word-shingle sets reaches a
threshold t. Steps, all over every document:

1. Sets of 64-bit shingle hashes; documents with equal sets form one class with a
   representative, so exact copies are never paired.
2. Extended prefixes in hash order. A pair that links misses at most m = n - ceil(t n)
   tokens of either side, so it shares at least k tokens within the first m + k of both.
   A representative with fewer than k shared tokens there can link with nothing.
3. For what is left, exact document frequencies over all its tokens, rarest first. A
   prefix is m + 2 tokens: a pair that links shares two of them at least. Tokens that
   occur once are in no pair, so only the others are indexed, and a representative with
   more than m unique tokens leaves.
4. First keys: rare tokens by themselves, and for tokens of the frequent class
   (`frequent` postings or more) the combination of k consecutive prefix tokens, which
   most near copies share. Under every key each member is paired with the key's most
   central member only, so a group of copies makes pairs in proportion to its size.
5. Verification on whole sets; components of what links.
6. All keys, where they still span several components: every token by itself that has fewer
   than `frequent` postings outside its largest component, however many inside, and every
   combination of two of the others (hot tokens). Of a pair that links, the smaller
   document shares 2t / (1 + t) of its own tokens at least, so only the leading ones of
   its prefix are asked, and pairs of near misses of one template are not made. Nor are
   pairs whose parities (256 bits a set) differ in more bits than linked sets can differ in
   tokens. Members of a key's largest component are not paired with each other, so what a
   group of copies has linked already is not met again. What is asked is verified the same
   way: no link between components is lost, whatever the frequency; pairs inside a
   component can change nothing. A document with over `most_frequent` hot tokens in
   its prefix has them indexed one by one instead of in all combinations, against all,
   which finds the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, keep_ids, settle, small_batches
from .textops import bounded, mix, shingle_sets


def _sums(s: np.ndarray) -> tuple[int, int]:
    """An order-free 128-bit signature of a set."""
    with np.errstate(over="ignore"):
        return int(mix(s, 20).sum(dtype=np.uint64).view(np.int64)), int(mix(s, 21).sum(dtype=np.uint64).view(np.int64))


def _miss(n: int, percent: int) -> int:
    """Tokens of a set of n that a linked partner may miss."""
    return n - -(-percent * n // 100)


#: 64-bit words of a set's parities: bit i is odd where an odd number of tokens falls on i.
PARITIES = 4
_P = [f"p{k}" for k in range(PARITIES)]


def _parities(s: np.ndarray) -> np.ndarray:
    """Two sets differ in as many tokens at least as their parities differ in bits."""
    odd = np.bincount(mix(s.view(np.uint64), 22).view(np.int64) & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def _signed(percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            sets = list(shingle_sets(b.column(1), width))
            n = [len(s) for s in sets]
            sums = [_sums(s) for s in sets]
            ext = [s[: _miss(x, percent) + max(1, x // 20)].view(np.int64) for s, x in zip(sets, n)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x for x, _ in sums], pa.int64()), pa.array([x for _, x in sums], pa.int64()), _lists(ext)], ["doc_id", "n", "s1", "s2", "ext"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            sets = [s.view(np.int64) for s in shingle_sets(b.column(1), width)]
            odd = np.array([_parities(s) for s in sets], np.int64).reshape(len(sets), PARITIES)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets), *(pa.array(odd[:, k].copy()) for k in range(PARITIES))], ["doc_id", "n", "tokens", *_P])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, one pair at a time."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("n"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    met = pairs.join(a, "a").join(b, "b").select("a", "b", "n", "m", both.cast("long").alias("both"))
    return met.where(f"100 * both >= {percent} * (n + m - both)").select("a", "b")


def _combinations(few: DataFrame, side: list[str]) -> DataFrame:
    """All combinations of two of a document's hot tokens `f`. Under its first two common
    tokens a pair shares the first and what is left from the second on."""
    twos = F.expr("flatten(transform(f, (t, i) -> transform(slice(f, i + 2, size(f)), u -> struct(xxhash64(t.token, u.token) as key, u.rest + 1 as rest))))")
    return few.select(*side, F.explode(twos).alias("k")).select("k.key", "k.rest", *side)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5, frequent: int = 100, combine: int = 3, most_frequent: int = 64) -> DataFrame:
    """Return (doc_id, n_shingles, component_id) of every row.

    A null or empty text has no shingles and links with nothing; a text of fewer than
    `width` words is one shingle; equal texts share a component; a very long text is one
    batch of its own; other columns of `docs` are ignored; an empty table gives an empty
    result; ties cannot arise, since a component is a set of ids. Rows that repeat an id
    keep one row each; where their texts differ, the id stands for its smallest set, and
    the other rows are linked with equal texts only.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = settle(text.mapInArrow(_signed(percent, width), "doc_id long, n long, s1 long, s2 long, ext array<long>"), "signed")
    members = signed.select("doc_id", "n", "s1", "s2")
    classes = members.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    # an id that represents several texts does so for the first of them
    chosen = classes.groupBy("rep").agg(F.min(F.struct("n", "s1", "s2")).alias("c")).select(F.col("rep").alias("doc_id"), "c.*")

    # 2. extended prefixes in hash order: who shares enough of them to link at all. A token
    # that occurs once is charged to its only owner, so no token's rows ever meet
    own = signed.join(chosen.select("doc_id", F.col("s1").alias("c1"), F.col("s2").alias("c2")), "doc_id").where("s1 = c1 and s2 = c2")
    lone = own.select("doc_id", F.explode("ext").alias("token")).groupBy("token").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).where("c = 1").groupBy("doc_id").agg(F.count("*").alias("lone"))
    enough = own.select("doc_id", "n", F.size("ext").alias("size")).join(lone, "doc_id", "left").where("size - coalesce(lone, 0) >= greatest(1, n div 20)")
    left = settle(enough.select("doc_id").distinct(), "left")
    sets = keep_ids(text, left, "doc_id", left.count()).mapInArrow(_sets(width), f"doc_id long, n long, tokens array<long>, {', '.join(f'{c} long' for c in _P)}")
    repeated = members.join(members.groupBy("doc_id").count().where("count > 1"), "doc_id", "left_semi").limit(1).count()
    if repeated:
        sets = sets.groupBy("doc_id").agg(F.min_by(F.struct("n", "tokens", *_P), F.struct("n", F.hash("tokens"))).alias("s")).select("doc_id", "s.*")
    sets = settle(sets, "sets")

    # 3. document frequencies of all their tokens; rarest first
    tokens = sets.select(F.explode("tokens").alias("token"), F.col("doc_id").alias("rep"), "n")
    known = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token")
    by_doc = Window.partitionBy("rep")
    ranked = known.withColumn("alone", F.col("n") - F.count("*").over(by_doc)).withColumn("at", F.row_number().over(by_doc.orderBy("df", "token")))
    ranked = ranked.where(f"alone <= n - ceil({percent} * n / 100) and at <= n - ceil({percent} * n / 100) + 2 - alone")
    # a pair's first common token leaves both sides the tokens from there on at most
    prefix = settle(ranked.select("token", "rep", "n", "df", "alone", "at", F.expr("n - alone - at + 1").alias("rest")), "prefix")

    # 4. first keys, by the basic prefix
    near = Window.partitionBy("rep").orderBy("at")
    combined = F.xxhash64(*[F.lead("token", i, 0).over(near) for i in range(combine)])
    keyed = prefix.withColumn("key", F.when(F.col("df") >= frequent, combined).otherwise(F.col("token"))).where(f"at <= n - ceil({percent} * n / 100) + 1 - alone")
    central = keyed.groupBy("key").agg(F.min(F.struct("alone", "rep", "n", "rest")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    close = f"{100 + percent} * least(rest, rest_m) >= {percent} * (n + m)"
    star = keyed.join(central, "key").where("rep <> hub.rep").withColumn("m", F.col("hub.n")).withColumn("rest_m", F.col("hub.rest")).where(close)
    pairs = settle(star.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct(), "pairs")
    links = settle(_verify(pairs, sets, percent), "links")

    # 6. what still spans several components
    first = components(links)
    placed = prefix.select("token", "rep", "n", "df", "at", "rest").join(first.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    spans = placed.groupBy("token").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo < hi").select("token")
    open_ = placed.join(spans, "token", "left_semi").join(sets.select(F.col("doc_id").alias("rep"), *_P), "rep")
    side = ["rep", "n", "component_id", *_P]
    open_ = settle(open_.select("token", "df", "at", "rest", *side), "open")
    # a token by itself makes pairs with those outside its largest component alone
    outside = open_.groupBy("token", "component_id").count().groupBy("token").agg((F.sum("count") - F.max("count")).alias("out"))
    hot = outside.where(F.col("out") >= frequent).select("token", F.lit(True).alias("hot"))
    told = open_.join(hot, "token", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    common = told.where("hot").groupBy(*side).agg(F.array_sort(F.collect_list(F.struct("at", "token", "rest"))).alias("f"))
    few = common.where(F.size("f") <= most_frequent)
    combos = _combinations(few, side)
    many = common.where(F.size("f") > most_frequent).select(*side, F.explode("f").alias("k")).select(F.col("k.token").alias("key"), "k.rest", *side)
    every = told.where("hot").select(F.col("token").alias("key"), "rest", *side)
    # the first common token of a pair may be hot where its second is not: one more is shared then
    alone = told.where("not hot").select(F.col("token").alias("key"), F.when(F.col("df") >= frequent, F.col("rest") + 1).otherwise(F.col("rest")).alias("rest"), *side)

    def postings(*parts: DataFrame) -> DataFrame:
        """Parts of one posting table; each meets the same part of another table only."""
        return reduce(DataFrame.union, [p.select(F.xxhash64(F.lit(i), "key").alias("key"), "rest", *side) for i, p in enumerate(parts)])

    asking, asked = postings(alone, combos, many, every).where(f"{100 + percent} * rest >= 2 * {percent} * n"), postings(alone, combos, every, many)
    # members of a key's largest component ask, and answer, the others under that key only
    largest = asked.groupBy("key", "component_id").count().groupBy("key").agg(F.max(F.struct("count", "component_id")).alias("top"))
    largest = largest.select("key", F.col("top.component_id").alias("inner"))
    is_inner = F.col("component_id") == F.col("inner")
    x = asking.join(largest, "key").withColumn("within", is_inner).drop("inner").withColumnRenamed("rep", "x")
    y = asked.join(largest, "key").withColumn("within", F.explode(F.when(is_inner, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    y = y.select("key", "within", F.col("rep").alias("y"), F.col("n").alias("m"), F.col("rest").alias("rest_m"), F.col("component_id").alias("other"), *(F.col(c).alias(f"y{c}") for c in _P))
    differ = " + ".join(f"bit_count({c} ^ y{c})" for c in _P)
    alike = f"{100 + percent} * (n + m - ({differ})) >= 2 * {percent} * (n + m)"
    met = x.join(y, ["key", "within"]).where("component_id <> other and (n < m or n = m and x < y)").where(close).where(alike)
    asked = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    across = asked.distinct().join(pairs, ["a", "b"], "left_anti")
    more = settle(_verify(across, sets, percent), "links")
    whole = components(links.union(more))
    by_class = classes.join(whole.withColumnRenamed("id", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component_id", "rep").alias("component_id"))
    out = members.join(by_class, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
