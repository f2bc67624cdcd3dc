"""Learned operators: held-out accuracy, recall against brute force, and edge cases."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from depthbook.llm import itq_dedup, language_id, multi_index, pu_quality
from depthbook.llm.common import components, fold
from depthbook.llm.textops import matrix
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def test_language_id(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [fold(i) == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98


def test_language_edge_cases(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(200)
    model = language_id.learn(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 $%"), (4, "é"), (5, "the and " * 50_000)], "doc_id long, text string").withColumn("lang_pred", F.lit(7))
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] != "und"
    assert language_id.predict(odd.limit(0), model).count() == 0
    none = language_id.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}


def test_copies_do_not_empty_a_language(spark):
    rows = [("xx", "the same text")] * 20_000 + [("xx", f"other text number {i}") for i in range(300)] + [("yy", f"ein anderer satz {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    drawn = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(language_id, "linear_svm", lambda x, y: (drawn.append((y > 0).sum()), np.zeros(x.shape[1]), 0.0)[1:])
        model = language_id.learn(docs, rows_a_language=10)
    assert model.languages == ["xx", "yy"] and min(drawn) >= 4


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "linear_svm", lambda x, y: (np.zeros(x.shape[1]), 0.0))
    docs = spark.createDataFrame([(f"l{i}", f"text {i}") for i in range(1010)], "lang string, text string")
    assert len(language_id.learn(docs, rows_a_language=2).languages) == 1010


def test_many_languages_share_the_bound(spark, monkeypatch):
    """30 languages of 40 texts each under a bound of 90 rows; every language is learned."""
    rows = [(f"l{k:02}", " ".join(f"w{k}x{i % 7}{j}" for j in range(20 + i))) for k in range(30) for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    fitted, fit = [], language_id.linear_svm
    monkeypatch.setattr(language_id, "linear_svm", lambda x, y: fitted.append(len(x)) or fit(x, y))
    model = language_id.learn(docs, all_rows=90)
    assert len(model.languages) == 30 and max(fitted) <= 90


def test_families_come_first():
    m = language_id.LanguageModel(["de", "en", "es"], [[0, 1], [2]], np.zeros((1, 3)), np.zeros(3), [(0, 1)])
    best, score = m.decide(np.array([[1.0, -1.0, -2.0], [1.0, -1.0, 2.0], [-1.0, 1.0, 5.0]]))
    assert best.tolist() == [1, 0, 2] and ((score > 0) & (score <= 1)).all()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = pu_quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert ((got.predicted == 0) & (got.quality == 1)).mean() < 0.01


def test_quality_from_positives_alone(spark):
    """The PU setting: no row is marked bad. Same scores, since such marks are not read."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    only = labels.where("quality = 1").select("doc_id", "quality")
    a, b = pu_quality.learn(docs, only), pu_quality.learn(docs, labels)
    assert a.prior == b.prior and np.allclose(a.weights, b.weights)
    truth = labels.agg(F.avg("quality")).first()[0]
    assert abs(a.prior - truth) < 0.05
    got = pu_quality.score(docs, a).join(labels, "doc_id").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.99


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_of_a_mixture(share):
    rng = np.random.default_rng(1)
    width = len(pu_quality.FEATURES) + pu_quality.WORDS
    draw = lambda n, at: rng.standard_normal((n, width)).astype(np.float32) * 0.2 + np.where(np.arange(width) < 3, at, 0).astype(np.float32)
    positive = draw(2000, 1.0)
    good = rng.random(6000) < share
    unlabelled = np.where(good[:, None], draw(6000, 1.0), draw(6000, -1.0))
    assert abs(pu_quality.estimate_prior(positive, unlabelled) - share) < 0.04
    model = pu_quality.fit(positive, unlabelled)
    assert ((model.score(unlabelled) >= 0.5) == good).mean() > 0.98


def test_quality_scores_are_the_models(spark):
    """Every row's score is that of its own text, whatever the batches."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = pu_quality.learn(docs, labels)
    got = pu_quality.score(docs.limit(150), model).toPandas()
    for text, score in zip(got.text, got.score):
        x = pu_quality.features(pa.array([text], pa.string()))
        assert abs(score - 1 / (1 + np.exp(-float((model.design(x) @ model.weights)[0])))) < 1e-4


def test_quality_edge_cases(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = pu_quality.learn(docs.limit(100), labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "x" * 200_000)], "doc_id long, text string").withColumn("score", F.lit("z"))
    got = {r["doc_id"]: r["score"] for r in pu_quality.score(odd, model).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    assert pu_quality.score(odd.limit(0), pu_quality.learn(docs.limit(0), labels)).count() == 0


def test_quality_survives_any_training_text(spark):
    """One word of 200,000 characters, or of 30,000 wide ones, among the rows that teach."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    long = spark.createDataFrame([(10**9 + i, t, None, None, None) for i, t in enumerate(("x" * 200_000, "語" * 30_000, "word " * 40_000))], docs.schema)
    marked = labels.union(spark.createDataFrame([(10**9, 1, 0), (10**9 + 1, 1, 0)], labels.schema))
    before, after = pu_quality.learn(docs, labels), pu_quality.learn(docs.union(long), marked)
    assert np.isfinite(after.weights).all() and abs(after.prior - before.prior) < 0.05
    got = pu_quality.score(docs.union(long), after).join(marked, "doc_id").toPandas()
    assert got.score.between(0, 1).all()
    known = got[got.doc_id < 10**9]
    assert ((known.score >= 0.5) == (known.quality == 1)).mean() > 0.95


def test_quality_draws_bounded_rows(spark):
    """An id with many texts, or a row with many copies, brings no more rows than the bound."""
    rows = [(1, f"text {i} of one id") for i in range(300)] + [(2, "a copy")] * 300 + [(i, f"other text {i}") for i in range(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    seen = []
    fit = pu_quality.fit
    try:
        pu_quality.fit = lambda p, u, prior: seen.append((len(p), len(u))) or fit(p, u, prior)
        pu_quality.learn(docs, labels, positives=50, unlabelled=60)
        pu_quality.learn(docs, labels)
    finally:
        pu_quality.fit = fit
    assert seen == [(50, 60), (301, 338)]


def test_quality_risk_is_minimal():
    """The fitted weights against the risk written out in double precision."""
    rng = np.random.default_rng(3)
    width, prior, decay = len(pu_quality.FEATURES) + pu_quality.WORDS, 0.6, 0.05
    draw = lambda n, at: (rng.standard_normal((n, width)) * 0.5 + np.where(np.arange(width) < 4, at, 0)).astype(np.float32)
    positive = draw(900, 0.5)
    unlabelled = np.concatenate([draw(1080, 0.5), draw(720, -0.5)])
    model = pu_quality.fit(positive, unlabelled, prior, decay=decay)
    p, u = model.design(positive).astype(float), model.design(unlabelled).astype(float)

    def risk(w):
        loss = lambda z: np.log1p(np.exp(-z))
        negative = loss(-(u @ w)).mean() - prior * loss(-(p @ w)).mean()
        free = np.arange(len(w)) != len(pu_quality.FEATURES)
        return prior * loss(p @ w).mean() + max(0.0, negative) + decay / 2 * (w[free] ** 2).sum()

    w = model.weights.astype(float)
    least = risk(w)
    assert least < risk(np.zeros(len(w)))
    for k in range(0, len(w), 5):
        for step in (-0.3, 0.3):
            there = w.copy()
            there[k] += step
            assert risk(there) > least - 1e-4


def vectors(spark, rows):
    rows = [(i, v and [None if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("x", F.lit("clash"))


def test_search(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    p = e.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    got = multi_index.search(e, e.where("vec_id % 20 = 0"), least=100).toPandas()
    hit = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        s[i] = -np.inf
        own = got[got.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, s[np.searchsorted(ids, own.vec_id)], atol=1e-12)
        assert sorted(zip(-own.score, own.vec_id)) == list(zip(-own.score, own.vec_id))
        hit += len(set(own.vec_id) & set(ids[np.lexsort((ids, -s))[:20]]))
    assert hit / 20 / (ids % 20 == 0).sum() >= 0.9


@pytest.mark.parametrize("n", [3_000, 15_000])
def test_search_of_clusters_reads_a_small_share(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((n // 60, 32)) * 3
    x = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, 32)) * 0.3
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    shares = []
    measured = multi_index.measured_share
    with pytest.MonkeyPatch.context() as m:
        m.setattr(multi_index, "measured_share", lambda *a: (shares.append(measured(*a)), shares[0])[1])
        got = multi_index.search(e, e.where("vec_id % 20 = 0"), least=100).toPandas()
    hit = 0
    for i in range(0, n, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(set(got.vec_id[got.query_id == i]) & set(np.argsort(-s)[:20].tolist()))
    recall = hit / 20 / len(range(0, n, 20))
    print("share", shares, "recall", recall)
    assert recall >= 0.9 and shares[0] < 0.3


def test_search_repeated_ids(spark):
    v = vectors(spark, [(0, [1.0, 0, 0, 0]), (1, [2.0, 0, 0, 0]), (1, [3.0, 0, 0, 0])])
    got = [tuple(r) for r in multi_index.search(v, v.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3.0), (0, 2, 1, 2.0)]


def test_search_edge_cases(spark):
    rows = [(0, [1.0, 0.0, 0.0, 1.0]), (1, [2.0, 0, 0, 0]), (2, [2.0, 0, 0, 0]), (3, None), (4, [0.0] * 4), (5, [NAN, 1, 1, 1]), (6, [INF, 1, 1, 1]), (7, [None, 1.0, 1, 1]), (8, []), (20, [0.0, 0, 0, 3])]
    v = vectors(spark, rows)
    got = [tuple(r) for r in multi_index.search(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 3.0), (0, 2, 1, 2.0), (0, 3, 2, 2.0), (20, 1, 0, 3.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert multi_index.search(v.limit(0), v.limit(0)).count() == 0


def test_query_blocks_of_ids_with_a_common_divisor():
    for parts in (2, 5, 20):
        filled = np.bincount([multi_index.spread(20 * i, parts) for i in range(5000)], minlength=parts)
        assert filled.min() > 0.8 * 5000 / parts and multi_index.spread(-20, parts) in range(parts)


def test_cells_are_walked_in_order():
    rng = np.random.default_rng(0)
    ix = multi_index.MultiIndex(rng.standard_normal((300, 8)), 6)
    ix.counts[:] = 1
    a, b = rng.random(6), rng.random(6)
    cells = ix.walk(a, b, 36)
    sums = [a[c // 6] + b[c % 6] for c in cells]
    assert sorted(cells) == list(range(36)) and sums == sorted(sums)


def reach(linked, ids):
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], 1 << 60).min(1))
        if (new == low).all():
            return low
        low = new


def test_blocks_keep_components():
    rng = np.random.default_rng(5)
    for _ in range(50):
        m = rng.random((9, 9)) < 0.12
        m |= m.T
        np.fill_diagonal(m, False)
        ids = np.arange(9)
        assert (itq_dedup.spread(m, ids, ids)[0] == reach(m, ids)).all()
        half = m[:4, 4:]
        whole = np.zeros((9, 9), bool)
        whole[:4, 4:], whole[4:, :4] = half, half.T
        a, b = itq_dedup.spread(half, ids[:4], ids[4:])
        assert (np.concatenate([a, b]) == reach(whole, ids)).all()


def test_near_duplicate_chains(spark):
    """Vectors on an arc: neighbours link, ends do not, all are one component."""
    angle = np.random.default_rng(3).permutation(40) * 0.12
    v = [(i, [float(np.cos(t)), float(np.sin(t)), 0.0, 0.0]) for i, t in enumerate(angle)]
    got = itq_dedup.near_duplicates(vectors(spark, v)).toPandas().sort_values("vec_id")
    x = np.array([e for _, e in v])
    linked = (x @ x.T >= 0.95) & ~np.eye(40, dtype=bool)
    # four bits tell little: a pair may meet under no key, but none is made up
    assert (got.n_links.to_numpy() <= linked.sum(1)).all() and got.n_links.sum() >= 0.95 * linked.sum()
    assert (got.component_id.to_numpy() == reach(linked, np.arange(40))).all()


@pytest.mark.parametrize("chunk", [512, 7])
def test_near_duplicates(spark, chunk, monkeypatch):
    monkeypatch.setattr(itq_dedup, "CHUNK", chunk)
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    p = e.toPandas().sort_values("vec_id")
    x = np.stack(p.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = itq_dedup.near_duplicates(e).toPandas().sort_values("vec_id")
    assert (got.n_links.to_numpy() == linked.sum(1)).all()
    assert (got.component_id.to_numpy() == reach(linked, p.vec_id.to_numpy())).all()
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_tables_find_pairs_at_any_size():
    """One rule of width and number: the same recall at cosine 0.95, work below the square."""
    rng = np.random.default_rng(1)
    a = rng.standard_normal((4000, 64))
    off = rng.standard_normal(a.shape)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(a)
    off = unit(off - (off * a).sum(1, keepdims=True) * a)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * off
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    differ = itq_dedup.codes(a, np.zeros(64), turn) ^ itq_dedup.codes(b, np.zeros(64), turn)
    work = []
    for n in (100, 10_000, 10**6, 10**8):
        masks = itq_dedup.tables(n, 64, 0.95)
        width = int(masks[0]).bit_count()
        found = ((differ[:, None] & masks[None, :]) == 0).any(1).mean()
        work.append(len(masks) * (itq_dedup.ROW + n / 2**width))
        print(n, width, len(masks), found)
        assert {int(m).bit_count() for m in masks} == {width} and len(set(masks.tolist())) == len(masks) and found >= 0.985
    assert all(b < 10 * a for a, b in zip(work, work[1:]))  # a hundred times the vectors


@pytest.mark.parametrize("row", [500, 1])
def test_pairs_near_the_threshold(spark, monkeypatch, row):
    monkeypatch.setattr(itq_dedup, "ROW", row)
    rng = np.random.default_rng(12)
    # a rotation that was not fitted on these few vectors
    monkeypatch.setattr(itq_dedup, "learn_rotation", lambda x, bits: (np.zeros(64), np.linalg.qr(rng.standard_normal((64, 64)))[0]))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.standard_normal((1500, 64)))
    off = rng.standard_normal(a.shape)
    off = unit(off - (off * a).sum(1, keepdims=True) * a)
    cos = rng.uniform(0.951, 0.96, (1500, 1))
    b = cos * a + np.sqrt(1 - cos**2) * off
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = itq_dedup.near_duplicates(vectors(spark, rows)).toPandas()
    found = got.n_links.sum() / 3000
    print("recall at 0.951 to 0.96:", found)
    assert 0.98 <= found <= 1


def test_near_duplicates_edge_cases(spark):
    rows = [(i, [1.0, 0.5, 0.1, 0.0]) for i in range(5)] + [(9, [2.0, 1.0, 0.2, 0.0]), (10, None), (11, [0.0] * 4), (12, [NAN, 1, 1, 1]), (13, [-1.0, 0.5, 0.1, 7.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in itq_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert got[0] == (5, 0, True) and got[4] == (5, 0, False) and got[9] == (5, 0, False)
    assert all(got[i] == (0, i, True) for i in (10, 11, 12, 13))
    assert itq_dedup.near_duplicates(vectors(spark, []).limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 3), (5, 4), (7, 7), *((100 + i, 101 + i) for i in range(30))]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, **{100 + i: 100 for i in range(31)}}


def test_profiles_by_blocks():
    """A text that is longer than a block has the profile that counting its n-grams one by
    one gives, wherever blocks end."""
    texts = ["  A  b", None, "", "the cat sat  on\n\nthe mat, " * 9, "x", " \t ", "é ß 漢字  q"]
    want = np.zeros((len(texts), language_id.BUCKETS))
    for row, text in zip(want, texts):
        letters = bytes(b if b > 127 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in (text or "").encode())
        while b"  " in letters:
            letters = letters.replace(b"  ", b" ")
        for n in (1, 2, 3):
            for k in range(len(letters) - n + 1):
                row[language_id._buckets(np.frombuffer(letters[k : k + n], np.uint8), n)[0]] += 1
    want = np.sqrt(want)
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    for block in (1, 2, 3, 7, 50, 1 << 18):
        assert np.allclose(language_id.profiles(pa.array(texts), block), want, atol=1e-6), block


def most_held(run):
    """Bytes that `run` holds at once, besides what there was before, and its result."""
    tracemalloc.start()
    try:
        out = run()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_fits_hold_no_second_copy_of_their_rows():
    r = np.random.default_rng(5)
    x = r.random((1500, language_id.BUCKETS), np.float32)
    x[:700, :300] += 0.4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(np.arange(1500) < 700, 1, -1).astype(np.float32)
    held, (w, b) = most_held(lambda: language_id.linear_svm(x, y, rounds=6))
    assert held < x.nbytes
    some = np.arange(0, 1500, 3)
    w2, b2 = language_id.linear_svm(x, y[some], rounds=6, rows=some)
    w3, b3 = language_id.linear_svm(x[some], y[some], rounds=6)
    assert np.array_equal(w2, w3) and b2 == b3 and w.dtype == np.float32 and np.isfinite(w).all()
    rows = r.random((4000, len(pu_quality.FEATURES) + pu_quality.WORDS), np.float32)
    model = pu_quality._shape(rows, 0.5)
    held, made = most_held(lambda: model.design(rows))
    assert held < 1.3 * made.nbytes


def test_matrix_takes_the_rows_asked_for():
    x = np.arange(40, dtype=np.float32).reshape(10, 4)
    chunk = lambda a: pa.array([v.tobytes() for v in a], pa.binary())
    column = pa.chunked_array([chunk(x[:3]), chunk(x[3:3]), chunk(x[3:8]), chunk(x[8:])], pa.binary())
    for rows in ([9, 0, 3, 2, 7], [], list(range(10))):
        assert np.array_equal(matrix(column, np.array(rows, int), np.float32, 4), x[rows])
    assert matrix(pa.chunked_array([], pa.binary()), np.zeros(0, int), np.float32, 4).shape == (0, 4)
