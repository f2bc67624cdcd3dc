"""The text operators against brute force, and their edge cases."""

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from depthbook.llm import jaccard_join, license_scan, packing, site_style, span_dedup, textops, trie_bpe
from pyspark.sql import functions as F

import public_tokenizers
from tokenizers import Tokenizer

ODD = [None, "", "   \n\t", "one", "Äpfel  ÖL \x85 x", "a b c d e", "A b c d e", "日本語 text 🙂", "x" * 300_000, "w " * 40_000]


def frame(spark, texts, start=0):
    """Rows with extra columns whose names clash with the operators' own."""
    rows = [(i + start, t, "score", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, token string, n long")


def brute_words(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_set(t):
    w = brute_words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(ids, sets):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def family(rng):
    """Near copies at many distances, shared passages, exact copies, odd texts."""
    vocabulary = [f"w{i}" for i in range(500)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = prose(30)
    texts = []
    for _ in range(4):
        base = prose(rng.randint(20, 120))
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [" ".join(prose(40) + passage + prose(10)) for _ in range(25)]
    return texts + texts[:6] + ODD + [None, "", "a b c d e"]


@pytest.mark.parametrize(("frequent", "most_frequent"), [(2, 64), (2, 3), (100, 64)])
def test_jaccard_components(spark, frequent, most_frequent):
    texts = family(random.Random(frequent + most_frequent))
    sets = {i: brute_set(t) for i, t in enumerate(texts)}
    want = brute_components(list(sets), sets)
    got = jaccard_join.jaccard_components(frame(spark, texts), frequent=frequent, most_frequent=most_frequent).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}


def test_jaccard_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join([*words[:59], "x"]), " ".join(f"z{i}" for i in range(70))
    rows = [(1, a), (1, a), (2, b), (5, a), (5, c), (7, c)]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 56, 1), (1, 56, 1), (2, 56, 1), (5, 56, 1), (5, 66, 5), (7, 66, 5)]


def test_jaccard_near_misses_of_a_template(spark, monkeypatch):
    """Documents that share 80 % of one template, and the rest in small groups, link with
    nothing; no pair of them may be made."""
    rng = random.Random(3)
    template = [f"t{i}" for i in range(160)]
    texts = [" ".join(template + [f"g{rng.randrange(40)}x{i // 9}" for i in range(44)]) for _ in range(400)]
    asked = []
    verify = jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "_verify", lambda pairs, *a: (asked.append(pairs.count()), verify(pairs, *a))[1])
    got = jaccard_join.jaccard_components(frame(spark, texts)).collect()
    sets = {i: brute_set(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(list(sets), sets)
    assert sum(asked) <= 4 * len(texts)


def test_jaccard_frequent_tokens_of_one_component(spark, monkeypatch):
    """Tokens that are frequent among linked copies and rare outside them make no
    combinations: the pairs that they make by themselves grow with their postings."""
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    copies = [[*base[:115], f"c{rng.randrange(9)}", *base[116:]] for _ in range(60)]
    apart = [base[:95] + [f"o{i // 2}x{k}" for k in range(22)] for i in range(8)]
    texts = [" ".join(w) for w in copies + apart]
    texts = [f"{t} e{i}" for i, t in enumerate(texts)]
    made = []
    combined = jaccard_join._combinations
    monkeypatch.setattr(jaccard_join, "_combinations", lambda few, side: (made.append(combined(few, side).count()), combined(few, side))[1])
    got = jaccard_join.jaccard_components(frame(spark, texts), frequent=20).collect()
    sets = {i: brute_set(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(list(sets), sets)
    assert made == [0]


def test_jaccard_empty_table(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_shingle_sizes_match():
    texts = ODD + family(random.Random(1))
    sets = list(textops.shingle_sets(pa.array(texts, pa.string())))
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]


def test_bpe_round_trip(spark, small):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    alphabet = "abcABZz019 '’\n\t\x1c\x85éñÜßΣİﬁ日한🙂️ tresd'll.,;!?"
    texts = ODD + ["<|endoftext|> x<|startoftext|>"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    got = {r["doc_id"]: r for r in trie_bpe.encode_documents(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        e = library.encode(t or "", add_special_tokens=False)
        assert got[i]["n_tokens"] == len(e.ids), repr(t)[:80]
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    bpe = trie_bpe.WordBpe(path)
    ids = library.encode("Hello there", add_special_tokens=False).ids
    assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_packing(spark, small):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ODD + ["<|endoftext|> x", "a \x1c  b\n\n c²½"] + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(80).collect()]
    rows = packing.pack_documents(frame(spark, texts), path).toPandas()
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids) and (own.length.iloc[1:] == 2048).all()
        at = 0
        for a, n, c in zip(own.start, own.length, own.ids_crc32):
            assert a == at and zlib.crc32(ids[a : a + n].tobytes()) == c
            at += n
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.cumsum([0, *s.length])[:-1]).all() and s.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= 1.05 * -(-rows.length.sum() // 2048) + 2
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_packing_is_online_and_close_to_the_bound(spark):
    """Pieces in arrival order, 64 open bins: within 2 % of the bound, and a later piece
    changes no earlier place."""
    rng = random.Random(6)
    lengths = [rng.randint(1, 2048) if rng.random() < 0.3 else rng.randint(1, 700) for _ in range(20_000)]
    bins = packing.OpenBins(2048, 64)
    most = 0
    for n in lengths:
        bins.put(n)
        most = max(most, bins.open)
    assert most == 64 and bins.made <= 1.02 * sum(lengths) / 2048
    rows = [(i, 0, n) for i, n in enumerate(lengths[:3000])]
    one = lambda k: {r["doc_id"]: (r["sequence_id"], r["offset"]) for r in packing.pack(spark.createDataFrame(rows[:k], "doc_id long, piece int, length long")).collect()}
    short, whole = one(1500), one(3000)
    assert all(whole[i] == at for i, at in short.items())


def test_caches_are_bounded_in_bytes():
    bpe = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), most=50_000)
    text = " ".join(f"w{i}" for i in range(3000))
    library = Tokenizer.from_file(bpe.path)
    for k in range(3):
        assert bpe.encode(text + str(k)) == np.array(library.encode(text + str(k), add_special_tokens=False).ids, "<u4").tobytes()
        assert bpe.held <= 50_000 and len(bpe.known) < 1000
    word = trie_bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"), most_bytes=10_000)
    first = word.encode(["x" * 5000 + " hello", "hello there"])
    assert word.encode(["hello there"])[0] == first[1] and len(word.ids) < 20


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.put(6) == (0, 0) and bins.put(7) == (1, 0) and bins.put(5) == (2, 0)
    assert bins.put(3)[0] == 0  # bin 1, the fuller one, has closed
    assert bins.put(5) == (2, 5)


def test_license_scan(spark):
    texts = ODD + ["apache license apache license x", "CC-BY cc by cc by by", "é mit license cc by", "GNU  general-public\nlicense"]
    texts += ["SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "SPDX-License-Identifier: MIT OR"]
    got = {r["doc_id"]: r for r in license_scan.scan_documents(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = brute_words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        hits = [(k, v) for p, v in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in hits]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({v for _, v in hits})) and 0 <= r["score"] <= 1
    assert got[len(texts) - 2]["labels"] == "apache-2.0,gpl-2.0-only with classpath-exception-2.0,mit"
    assert got[len(texts) - 1]["labels"] == "mit"  # the longest beginning that is an expression


def brute_needed(postfix):
    """Licences without which no choice of the others meets the expression."""

    def met(allowed):
        stack = []
        for t in postfix:
            if t in ("AND", "OR"):
                b, a = stack.pop(), stack.pop()
                stack.append(a and b if t == "AND" else a or b)
            else:
                stack.append(t.lower() in allowed)
        return stack[0]

    names = {t.lower() for t in postfix} - {"and", "or"}
    return names, {x for x in names if not met(names - {x})}


def test_license_expressions():
    assert license_scan.parse("MIT OR GPL-2.0 AND BSD-3-Clause") == ["MIT", "GPL-2.0", "BSD-3-Clause", "AND", "OR"]
    for bad in ("", "AND", "MIT AND", "(MIT", "MIT)", "MIT MIT", "(A OR B) WITH C", "A WITH (X OR Y)", "A WITH B WITH C", "(A) WITH B", "MIT ()", "MIT !!!", "MIT /", "/ MIT"):
        assert license_scan.parse(bad) is None, bad
    rng = random.Random(2)

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice("ABCDEFG")
        a, b = expression(depth - 1), expression(depth - 1)
        return f"({a} {rng.choice(['AND', 'or'])} {b})" if rng.random() < 0.6 else f"{a} {rng.choice(['and', 'OR'])} {b}"

    for _ in range(300):
        post = license_scan.parse(expression(4))
        assert license_scan.evaluate(post) == brute_needed(post)
    long = " OR ".join(["MIT", "ISC"] * 20_000)
    assert license_scan.evaluate(license_scan.beginning(long + " ! x")) == ({"mit", "isc"}, set())


def test_license_and_differs_from_or(spark):
    tag = "SPDX-License-Identifier: "
    texts = [tag + "MIT OR GPL-2.0", tag + "MIT AND GPL-2.0", tag + "MIT AND (GPL-2.0 WITH x OR Zlib)", f"{tag}MIT OR ISC\n{tag}ISC"]
    got = [(r["labels"], r["needed"], r["choices"]) for r in license_scan.scan_documents(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [("gpl-2.0,mit", "", "gpl-2.0,mit"), ("gpl-2.0,mit", "gpl-2.0,mit", ""), ("gpl-2.0 with x,mit,zlib", "mit", "gpl-2.0 with x,zlib"), ("isc,mit", "isc", "mit")]
    assert license_scan.scan_documents(frame(spark, [])).count() == 0


def test_license_tag_inside_a_line():
    labels = lambda t: license_scan.scan(t)[5]
    tag = "SPDX-License-Identifier: "
    assert labels(tag + "MIT Permission is hereby granted") == "mit"
    assert labels('{"c": "' + tag + 'MIT", "name": "x"}') == "mit"
    assert labels(tag + "(MIT OR Apache-2.0) AND ISC. Then more (text)") == "apache-2.0,isc,mit"
    assert labels(tag + "GPL-2.0 WITH x-exception OR (MIT AND text goes on") == "gpl-2.0 with x-exception"
    assert labels(f"{tag}MIT text {tag}Zlib\nISC") == "mit,zlib"
    assert labels(tag + "OR MIT") == "" and labels(tag) == "" and labels(tag + "(MIT text") == ""


def brute_notices(text):
    """Labels of the notices whose words no longer notice holds."""
    w = brute_words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    hits = [(k, k + len(p.split()), v) for p, v in license_scan.NOTICES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and a[:2] != b[:2]
    return {h[2] for h in hits if not any(inside(h, o) for o in hits)} - {None}


def test_license_labels_equal_brute_force():
    rng = random.Random(7)
    words = sorted({w for p in [*license_scan.NOTICES, *license_scan.BASE] for w in p.split()} | {"x"})
    phrases = [*license_scan.NOTICES, *license_scan.BASE]
    for _ in range(600):
        text = " ".join(rng.choice(phrases) if rng.random() < 0.6 else rng.choice(words) for _ in range(rng.randrange(6)))
        w = brute_words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        base = {v for p, v in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
        assert license_scan.scan(text)[5] == ",".join(sorted(base | brute_notices(text))), text


def test_license_names_of_other_licences():
    labels = lambda t: license_scan.scan(t)[5]
    assert labels("Creative Commons Attribution-NonCommercial 4.0") == "cc-by-nc"
    assert labels("Creative Commons Attribution-Non-Commercial-ShareAlike") == "cc-by-nc-sa"
    assert labels("BSD 3-Clause License") == "bsd-3-clause" and labels("the 2-clause BSD license") == "bsd-2-clause"
    assert labels("Not in the public domain") == "" and labels("not in the public domain. public domain") == "public-domain"
    tag = "SPDX-License-Identifier: "
    assert labels(tag + "the licence applies") == labels(tag + "NONE") == labels(tag + "NOASSERTION") == ""
    assert labels(tag + "LicenseRef-Mine-1 OR DocumentRef-x:LicenseRef-Y") == "documentref-x:licenseref-y,licenseref-mine-1"
    assert labels(tag + "GPL-2.0+ and other files") == "gpl-2.0+"


def test_license_choices_that_are_met():
    got = license_scan.scan("SPDX-License-Identifier: (MIT OR Apache-2.0) AND MIT")
    assert got[5] == "apache-2.0,mit" and got[7:] == ("mit", "")
    got = license_scan.scan("SPDX-License-Identifier: (MIT OR Apache-2.0) AND (ISC OR Zlib) AND MIT")
    assert got[7:] == ("mit", "isc,zlib")


# pages


def main_text(source):
    return site_style.Page(source, {}).main_text()


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<script>var x='<p>no</p>';</script></head><body>{body}</body></html>"


def test_main_text(spark):
    menu = "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
    cases = {
        menu + "<article><h1>Head &amp; more</h1><p>One <b>two</b><br>three<p>four &copy;</article><footer>foot</footer>": "Head & more\nOne two three\nfour ©",
        "<header>Site</header><div class='sidebar'>side</div><main><p>Text</p><form>in</form></main>": "Text",
        "<article><header><h1>T</h1></header><p>x</p><div class='comments'>c</div><aside>y</aside></article>": "T\nx",
        "<div id='cookie-notice'>ok?</div><p>plain</p><p hidden>h</p><!-- <p>no</p> -->": "plain",
        "<article><p>cut &am": "cut &am",
        "": "",
    }
    rows = [(i, f"http://h{i}.example/x", page(b)) for i, b in enumerate(cases)] + [(90, None, None), (91, "x", ""), (92, "http://a/", "<p>" * 3000 + "deep")]
    got = {r["page_id"]: r for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["text"] for i in range(len(cases))] == list(cases.values())
    assert got[90]["text"] == "" and got[91]["n_chars"] == 0 and got[92]["text"] == "deep"


def test_names_do_not_lose_the_article():
    main_text = lambda body: site_style.Page(page(body), {}).main_text()
    for name in ("page has-sidebar", "content no-sidebar", "post with-comments", "elementor-widget-text-editor", "widget"):
        assert main_text(f"<nav>m</nav><div class='{name}'><p>The whole article</p></div><div class='sidebar'>x</div>") == "The whole article", name
    assert main_text("<form id='f'><div><p>A page in a form</p><input><button>Go</button></div></form>") == "A page in a form"
    assert main_text("<p>A line<button>Go</button> with <span hidden>no</span>fields</p>") == "A line with fields"
    assert main_text("<div class='widget-area'><main><p>In a wrapper</p></main></div>") == "In a wrapper"
    card = "<main><h1>T</h1><p>long text of main itself</p><section><article>card</article></section></main>"
    assert main_text(card) == "T\nlong text of main itself\ncard"
    assert main_text("<main><article><p>The article, which is most of it</p></article><p>more</p></main>") == "The article, which is most of it"
    assert main_text("<article><p>Short</p></article><div class='comments'><p>" + "many words " * 50 + "</p></div>") == "Short"
    assert main_text("<div class='sidebar'>" + "<a href='/x'>link here</a> " * 20 + "</div><p>t</p>") == "t"


def test_names_of_comments_do_not_lose_the_article():
    whole = "<p>The whole article</p>"
    for name in ("class='post has-comments'", "class='post no-comments'", "class='post comments-open'", "data-comments-count='3'", "data-related-id=4", "id='promo-free'", "class='comment'"):
        for tag in ("article", "main"):
            assert main_text(f"<nav>m</nav><{tag} {name}>{whole}</{tag}><div class='sidebar'><p>other</p></div>") == "The whole article", (name, tag)
    replies = "<div class='comments'><article class='comment'><p>One reply</p></article><article class='media'><p>Another reply of more words</p></article></div>"
    for name in ("comments-open", "comments-enabled", "post-comments-wrapper", "reply-enabled content", "blog-comments"):
        assert main_text(f"<nav>m</nav><div class='{name}'>{whole}</div><p>x</p>").startswith("The whole article"), name
        for rest in ("", replies):
            assert main_text(f"<nav>m</nav><div class='{name}'><article>{whole}</article>{rest}</div>") == "The whole article", name
            assert main_text(f"<nav>m</nav><div class='{name}'><article>{whole}</article></div>{rest}") == "The whole article", name
    assert main_text(f"<article>{whole}</article><section class='related'><article class='card'><p>Another story</p></article></section><article class='teaser'><p>A third</p></article>{replies}") == "The whole article"


@pytest.mark.parametrize("source", ["<a" * 100_000, "<!a" * 100_000, "<" + "a" * 100_000, "<a" * 100_000 + ">", '<a ">"' * 40_000, "<a '" * 50_000 + ">", "<a =\"'>" * 30_000, '<p class="' * 50_000, "<!--" * 50_000, "<!--x->" * 50_000 + "<a"])
def test_malformed_tags_take_linear_time(source):
    began = time.time()
    site_style.Page(source, {}).main_text()
    assert time.time() - began < 2


def test_malformed_tags_keep_text():
    assert main_text("<p>1 < 2 and 3 > 2</p><p>a <b") == "1 < 2 and 3 > 2\na <b"
    assert main_text("<p title='a > b'>one</p><p title='open>two</p>") == "one\ntwo"


@pytest.mark.parametrize("source", ["<b>x" * 200_000, "<div>x" * 100_000, "<p>x" * 200_000, "<dd><div>" + "<b>" * 50_000 + "<dt>x</dt>" * 50_000, "<div class=ad>x" * 50_000, "</p>" * 300_000 + "x"])
def test_nested_pages_take_linear_time(source):
    began = time.time()
    site_style.Page(source, {}).main_text()
    assert time.time() - began < 8


def brute_importance(pages):
    """Composite importance of every node of one site, from each page's own tree."""
    styles, texts, parents = {}, {}, {}
    for p in pages:
        got = site_style.Page(p, {})
        for node, (parent, _, children) in got.nodes.items():
            parents[node] = parent
            styles.setdefault(node, []).append(tuple(children))
        for node, text in {(b[0], b[3]) for b in got.blocks}:
            texts.setdefault(node, []).append(text)

    def composite(node):
        m, own = len(styles[node]), texts.get(node, [])
        counts = np.unique([str(x) for x in styles[node]], return_counts=True)[1]
        presentation = -sum(c / m * np.log(c / m) for c in counts) / np.log(m) if m > 1 else 1.0
        of_text = np.unique(own, return_counts=True)[1]
        content = max(0.0, 1 - np.mean([np.log(c) / np.log(m) for c in of_text])) if m > 1 and own else 1.0
        below = [(composite(c)[0], len(styles[c])) for c, up in parents.items() if up == node] + ([(content, m)] if own else [])
        if not below:
            return presentation, m
        inner = sum(v * n for v, n in below) / sum(n for _, n in below)
        g = site_style.GAMMA ** len(counts)
        return (1 - g) * presentation + g * inner, m

    return {n: composite(n)[0] for n in styles}


def test_importance_equals_brute_force(spark):
    rng = random.Random(5)
    body = lambda i: f"<div class='top'><p>Same</p></div><div class='story'><h2>Head {rng.randrange(4)}</h2>" + "".join(f"<p>text {rng.randrange(9)}</p>" for _ in range(rng.randrange(4))) + (f"<ul><li>{i}</li></ul>" if i % 3 else "") + "</div>"
    sites = {f"h{k}": [page(body(i)) for i in range(n)] for k, n in enumerate((1, 2, 7, 25))}
    rows = spark.createDataFrame([(h, p) for h, ps in sites.items() for p in ps], "host string, html string")
    got = {(r["host"], r["node"]): r["composite"] for r in site_style.importance(rows).collect()}
    want = {(h, n): v for h, ps in sites.items() for n, v in brute_importance(ps).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_pages_edge_cases(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, host string, node long, weak string")
    assert site_style.extract(empty).count() == 0
    row = (1, "http://a.example/", page("<p>x</p>"), "clash", 3, "w")
    got = site_style.extract(spark.createDataFrame([row, row], empty.schema)).collect()
    assert [tuple(r) for r in got] == [(1, "http://a.example/", "x", 1)] * 2


def test_style_tree_removes_what_every_page_has(spark):
    rows = [(i, f"http://same.example/{i}", page(f"<div class='strip'><span>Read our paper daily</span></div><div class='story'><p>Story {i} of {i * 7}</p></div>")) for i in range(40)]
    got = site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Story {r['page_id']} of {r['page_id'] * 7}" for r in got)
    copies = [(i, "http://copy.example/", page("<article><p>The same</p></article>")) for i in range(40)]
    got = site_style.extract(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()
    assert all(r["text"] == "The same" for r in got)


def test_pages_of_the_small_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").limit(40)
    for r in site_style.extract(pages).join(pages, "page_id").collect():
        a = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", a)]
        assert r["text"] == "\n".join(filter(None, blocks))


# spans


def brute_units(text):
    units = []
    for line in (text or "").split("\n"):
        words, out = re.findall(r"[^\x20\x09-\x0D]+", line), []
        for w in words:
            out.append(w)
            if w[-1] in ".!?":
                units.append(out)
                out = []
        if out:
            units.append(out)
    return [c for u in units for c in ([u[i : i + 12] for i in range(0, len(u), 12)] if len(u) > 24 else [u])]


def brute_removed(texts, least=3, least_words=25):
    """The sentences that every run of sentences, of any length, would remove."""
    runs = []
    for d, t in enumerate(texts):
        u = brute_units(t)
        for i in range(len(u)):
            for j in range(i + least, len(u) + 1):
                words = tuple(w.lower() for k in range(i, j) for w in u[k])
                if len(words) >= least_words:
                    runs.append((words, d, i, j))
    first = {}
    for r in sorted(set(runs), key=lambda r: r[1:]):
        first.setdefault(r[0], r[1:3])
    gone = {}
    for words, d, a, z in runs:
        if first[words] != (d, a):
            gone.setdefault(d, set()).update(range(a, z))
    return gone


def test_span_dedup_equals_all_runs(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", "?", "\n"])
    passages = [" ".join(sentence() for _ in range(12)) for _ in range(4)]
    texts = [" ".join(sentence() for _ in range(rng.randint(0, 6))) + "\n" + rng.choice(passages) + "\n" + " ".join(sentence() for _ in range(5)) for _ in range(30)]
    texts += texts[:2] + ODD[:8]
    texts += ["Echo one two three four five.\n" * 20 + passages[0], "Echo one two three four five. " * 12]
    want = brute_removed(texts)
    got = {r["doc_id"]: r for r in span_dedup.dedup_spans(frame(spark, texts)).collect()}
    assert len(got) == len(texts) and want
    for i, t in enumerate(texts):
        units = brute_units(t)
        assert (got[i]["n_sentences"], got[i]["n_removed"]) == (len(units), len(want.get(i, ()))), i
        if i not in want:
            assert got[i]["text"] == t
        else:
            left = [w for k, u in enumerate(units) if k not in want[i] for w in u]
            assert re.findall(r"[^\x20\x09-\x0D]+", got[i]["text"]) == left
    assert span_dedup.dedup_spans(frame(spark, [])).count() == 0


def test_span_dedup_repeated_ids(spark):
    long = " ".join(f"Word{k} of the sentence {k}." for k in range(20))
    rows = [(1, long), (1, long), (2, long), (None, long), (3, None)]
    got = span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in got) == sorted([("1", long, 0), ("1", long, 0), ("2", "", 20), ("None", long, 0), ("3", None, 0)], key=lambda r: (r[0], str(r[1])))


@pytest.mark.parametrize("period", [60, 7, 2])
def test_passage_at_any_offset_of_unpunctuated_text(spark, period):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = " ".join((prose(period).split() * 60)[:60])
    texts = [prose(36 + k) + " " + passage + " " + prose(40) for k in range(12)] + [prose(150)]
    got = {r["doc_id"]: r for r in span_dedup.dedup_spans(frame(spark, texts)).collect()}
    assert got[12]["n_removed"] == 0 and got[12]["text"] == texts[12]
    for k in range(1, 12):
        left, own = got[k]["text"].split(), texts[k].split()
        assert 60 - 2 * 8 - 2 <= len(own) - len(left) <= 60, k
        assert left[: 36 + k] == own[: 36 + k] and left[-40:] == own[-40:] and got[k]["n_removed"] >= 4


def test_clashing_columns_pass(spark):
    docs = frame(spark, ["a b", None]).withColumn("hash", F.lit(1)).withColumn("cut_of", F.lit(2)).withColumn("n_removed", F.lit(9))
    out = span_dedup.dedup_spans(docs)
    assert out.columns == ["doc_id", "text", "token", "n", "hash", "cut_of", "n_sentences", "n_removed"] and out.count() == 2
