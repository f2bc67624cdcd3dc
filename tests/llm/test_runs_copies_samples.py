"""Periodic runs, exact copies and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from depthbook.llm import exact_dedup, importance, periodic_runs

SCHEMA = "doc_id long, text string"
#: Columns with the names that the operators use themselves.
CLASHING = "doc_id long, text string, _row string, rank string, _length string, n_words string, period string, _at string, _size string"


def frame(spark, rows, schema=SCHEMA):
    width = len(schema.split(", "))
    return spark.createDataFrame([(*r, *["x"] * (width - 2)) for r in rows], schema).repartition(3)


# runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_run_row(doc_id, text, order=None):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = order(doc_id, len(words)) if order else None
    words = words if at is None else [words[i] for i in at]
    found = brute_runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def repetitive(rng, n, letters):
    words = [rng.choice("abcdefg"[:letters]) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, 9)
        words[a:] = [words[a + i % min(p, n - a)] for i in range(n - a)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        texts = [repetitive(rng, rng.choice((0, 1, 5, 6, 7, 25, 80)), rng.choice((1, 2, 3))) for _ in range(rng.randrange(7))]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = periodic_runs.runs(np.array([ord(w) for t in texts for w in t], np.int64), first)
        assert [tuple(r) for r in got.tolist()] == [(s + o, n, q) for t, o in zip(texts, first.tolist()) for s, n, q in brute_runs(t)]


def test_names_are_equal_where_words_are():
    rng = random.Random(9)
    words = [rng.randrange(3) for _ in range(200)]
    levels = periodic_runs.names(np.array(words), np.array([0, 120, 200]))
    for k, level in enumerate(levels):
        for i in range(0, 200, 7):
            for j in range(i + 1, 200):
                same_text = (i < 120) == (j < 120)
                inside = j + 2**k <= (120 if j < 120 else 200)
                assert (level[i] == level[j]) == (same_text and inside and words[i : i + 2**k] == words[j : j + 2**k])


def test_most_repeated_is_exact():
    # 2^53 apart in floating point, not in fact: the second is a little more
    a, b = (0, 4 * 10**9 + 1, 10**9), (5, 8 * 10**9 + 3, 2 * 10**9)
    assert periodic_runs.most_repeated(np.array([a, b])) == b
    assert periodic_runs.most_repeated(np.array([(9, 8, 2), (1, 16, 4), (1, 12, 3)])) == (1, 12, 3)
    assert periodic_runs.most_repeated(np.zeros((0, 3), int)) is None


@pytest.mark.parametrize("order", [None, periodic_runs.planted])
def test_find_runs(spark, order):
    rng = random.Random(2)
    rows = [(i, " ".join(repetitive(rng, rng.randrange(60), 3))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "é é\né\x0bé é é"), (504, "a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a"), (None, "z " * 9), (7, rows[7][1]), (505, "w " * 30_000)]
    got = periodic_runs.find_runs(frame(spark, rows, CLASHING), order=order).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    want = [brute_run_row(i, t, order) for i, t in rows if i != 505]
    assert sorted((tuple(r) for r in got if r["doc_id"] != 505), key=key) == sorted(want, key=key)
    long = next(r for r in got if r["doc_id"] == 505)
    assert order or tuple(long)[1:6] == (1, 0, 30_000, 1, 30_000_000)
    assert not periodic_runs.find_runs(frame(spark, rows, CLASHING).limit(0)).count()


def test_planted_runs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: tuple(r) for r in periodic_runs.find_runs(docs, order=periodic_runs.planted).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got == {i: brute_run_row(i, t, periodic_runs.planted) for i, t in rows}
    assert any(got[i][1] for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0)


# copies


def brute_copies(rows):
    """Of every row (id, text, size of its group, the id that stays), and the rows that stay."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out, kept = [], []
    for norm, members in groups.items():
        stays = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        kept.append((stays[0], norm))
        out += [(i, stays[0], len(members), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return out, kept


@pytest.mark.parametrize("bits", [16, 0])
def test_exact_dedup(spark, bits, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_A_KEY", bits)  # 0: one block for all keys
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(7))) for _ in range(150)]
    head = "h" * exact_dedup.PREFIX  # equal length and prefix, other contents
    texts += [head + "x", head + "y", head + "y ", "é", "é", " é", "\xa0", "　", "😀" * 50_000, "😀 " * 50_000, None, None, "", "\x0b\x0c"]
    rows = list(enumerate(texts)) + [(None, "ab"), (None, "ab"), (3, texts[3]), (3, texts[3]), (3, texts[4])] + [(1000 + i, "one hot text") for i in range(300)]
    got = exact_dedup.dedup(frame(spark, rows, CLASHING), digest=True).collect()
    want, kept = brute_copies(rows)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    stay = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in stay) == sorted(hashlib.sha256(n.encode()).hexdigest() for _, n in kept)
    assert all(r["doc_id"] == r["keep_id"] for r in stay)
    plain = exact_dedup.dedup(frame(spark, rows, CLASHING))
    assert plain.columns == ["doc_id", "keep_id", "group_size", "kept"] and plain.where("kept").count() == len(kept)


def test_exact_dedup_of_nothing(spark):
    assert not exact_dedup.dedup(frame(spark, [], CLASHING), digest=True).count()
    assert [tuple(r) for r in exact_dedup.dedup(frame(spark, [(4, None)])).collect()] == [(4, 4, 1, True)]


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.dedup(frame(spark, [(1, "a"), (2, "a")]), digest=True)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_buckets(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_sample(rows, target, percent=5, least=20):
    made = [(i, *brute_buckets(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in brute_buckets(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, v or 0) for v in r))


@pytest.mark.parametrize("range_rows", [1 << 17, 50])
def test_resample(spark, range_rows, monkeypatch):
    number = importance.number
    monkeypatch.setattr(importance, "number", lambda rows, order: number(rows, order, range_rows=range_rows))
    rng = random.Random(6)
    some = "alpha BETA gamma3 déjà vu 東京 x-y o'clock Ω".split()
    rows = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, " .,\n"), (None, rows[0][1]), (903, "long Long LONG " * 30_000), (5, rows[5][1])]
    target = ["Beta gamma3 vu", None, "", "東京 Ω, alpha beta"]
    got = importance.resample(frame(spark, rows, CLASHING), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert ordered(got) == ordered(brute_sample(rows, target))


def test_resample_of_nothing(spark):
    none, one = spark.createDataFrame([], SCHEMA), frame(spark, [(1, "a b " * 20)])
    assert not importance.resample(none, one).count()
    assert ordered(importance.resample(one, none).collect()) == ordered(brute_sample([(1, "a b " * 20)], []))


def test_blocks_cut_no_word():
    text = b" ".join(b"w" * (i % 40) for i in range(500))
    assert [w for b in importance.blocks(text, 64) for w in b] == text.split()
    assert np.concatenate([b for _, b in importance.buckets("a b c d")]).tolist() == [zlib.crc32(x) % 10000 for x in (b"a", b"a b", b"b", b"a b c", b"b c", b"c", b"b c d", b"c d", b"d")]
