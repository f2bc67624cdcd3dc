"""Licence scan of whole texts: phrases and identifier tags by one Aho-Corasick automaton,
licence expressions by a shunting-yard parser.

Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z lowered. The automaton meets
the text as words joined by single spaces, so a phrase is found where its words stand
consecutively. An identifier tag is followed by an expression such as
``(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0``; its licences
become labels of their own. The expression's value tells which of them it needs whatever
is chosen (of an AND both sides', of an OR what both need) and which are a choice, so
``MIT OR GPL-2.0`` and ``MIT AND GPL-2.0`` differ. Where other text follows on the line,
the longest beginning that is an expression counts; a tag without one counts for less.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textops import bounded

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases and their labels; None: it says that there is none.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "2 clause bsd license": "bsd-2-clause",
    "3 clause bsd license": "bsd-3-clause",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "all rights reserved": "all-rights-reserved",
    "public domain": "public-domain",
    "not in the public domain": None,
    "not public domain": None,
}
# How the conditions of an attribution licence are written.
_CONDITIONS = {"nc": ("noncommercial", "non commercial"), "nd": ("noderivatives", "no derivatives", "noderivs"), "sa": ("sharealike", "share alike")}
for _parts in (("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa")):
    for _written in itertools.product(*(_CONDITIONS[p] for p in _parts)):
        NOTICES[f"creative commons attribution {' '.join(_written)}"] = f"cc-by-{'-'.join(_parts)}"
# What licence identifiers begin with, up to the first hyphen.
FAMILIES = frozenset(
    "0bsd afl agpl apache apsl artistic blueoak bsd bsl caldera cal catosl cc cc0 cddl cecill clartistic cpal cpl cua curl ecl efl entessa epl eudatagram eupl fair frameworx fsfap fsful ftl gfdl gpl hpnd icu ijg imagemagick intel ipl isc json lgpl libpng libtiff lppl mit mpl ms mulanpsl multics naumen ncsa ngpl nokia nposl ntp odbl ofl ogl openssl osl php pddl postgresql psf python qpl rpl rpsl ruby saxpath sgi simpl sissl sleepycat spl tcl ucl unicode unlicense upl vim vsl w3c watcom wtfpl x11 xnet zend zlib zpl".split()
)
TAG = "spdx license identifier"

_WORD_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_TAG_AT = re.compile(r"spdx-license-identifier:[ \t]*", re.IGNORECASE | re.ASCII)
_LINE = re.compile(r"[^\r\n]*")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"OR": 1, "AND": 2, "WITH": 3}


@functools.lru_cache(1)
def _automaton():
    a = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def is_identifier(token: str) -> bool:
    """Whether a token is a licence's identifier: one of a known family or a LicenseRef."""
    t = token.lower()
    return t.split("-", 1)[0].rstrip("+") in FAMILIES or re.match(r"(documentref-[a-z0-9.-]+:)?licenseref-", t) is not None


def _read(line: str, known: Callable[[str], bool] | None = None) -> tuple[list[str], int, bool]:
    """Tokens up to the first that cannot go on, how many of them are the longest
    expression, and whether nothing else is on the line.

    Only white space may stand between tokens. WITH stands between single identifiers. A
    stop after an identifier ends it, and the expression; so does a word where a licence
    should stand that is not `known` as one.
    """
    tokens: list[str] = []
    best = depth = upto = start = 0
    before, clean = "", True  # what was read: nothing or an operator, (, ), a licence, WITH or its exception
    for m in _TOKEN.finditer(line):
        if not tokens:
            start = m.start()
        elif line[upto : m.start()].strip():
            break
        t, rank = m[0], _RANK.get(m[0].upper())
        ended = before in (")", "licence", "exception")
        if t == "(":
            if ended or before == "WITH":
                break
            depth, before = depth + 1, "("
        elif t == ")":
            if not ended or not depth:
                break
            depth, before = depth - 1, ")"
        elif rank:
            if not ended or rank == 3 and before != "licence":
                break
            t, before = t.upper(), "WITH" if rank == 3 else ""
        else:
            if ended or known and before != "WITH" and not known(t.rstrip(".:-") or t):
                break
            before = "exception" if before == "WITH" else "licence"
        upto = m.end()
        whole = t if rank else t.rstrip(".:-") or t
        tokens.append(whole)
        if not depth and before in (")", "licence", "exception"):
            best = len(tokens)
        if whole != t:
            clean = False
            break
    return tokens, best, clean and best == len(tokens) and not (line[:start] + line[upto:]).strip()


def _postfix(tokens: list[str]) -> list[str]:
    """Shunting yard: WITH binds closest, then AND, then OR, each from left to right."""
    out: list[str] = []
    ops: list[str] = []
    for t in tokens:
        if t == "(":
            ops.append(t)
        elif t == ")":
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif t in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                out.append(ops.pop())
            ops.append(t)
        else:
            out.append(t)
    return out + ops[::-1]


def parse(expression: str) -> list[str] | None:
    """The expression in postfix order, or None if the whole of it is not one."""
    tokens, _, clean = _read(expression)
    return _postfix(tokens) if tokens and clean else None


def beginning(line: str) -> list[str] | None:
    """The longest beginning of a line that is an expression of known licences, in postfix
    order, or None."""
    tokens, best, _ = _read(line, is_identifier)
    return _postfix(tokens[:best]) if best else None


def evaluate(postfix: list[str]) -> tuple[frozenset[str], frozenset[str]]:
    """(licences, those that every way to meet the expression needs), in lower case; a
    licence with an exception is one of its own."""
    stack: list[tuple[frozenset[str], frozenset[str]]] = []
    for t in postfix:
        if t in _RANK:
            (b, need_b), (a, need_a) = stack.pop(), stack.pop()
            if t == "WITH":
                one = frozenset({f"{next(iter(a))} with {next(iter(b))}"})
                stack.append((one, one))
            else:
                stack.append((a | b, need_a | need_b if t == "AND" else need_a & need_b))
        else:
            one = frozenset({t.lower()})
            stack.append((one, one))
    return stack[0]


def open_choices(postfix: list[str], needed: frozenset[str]) -> frozenset[str]:
    """Licences that still decide something where the needed ones are met: an OR that one
    of these meets leaves no choice."""
    stack: list[tuple[bool, frozenset[str]]] = []
    for t in postfix:
        if t == "WITH":
            (_, b), (_, a) = stack.pop(), stack.pop()
            one = f"{next(iter(a))} with {next(iter(b))}"
            stack.append((one in needed, frozenset({one})))
        elif t in _RANK:
            (met_b, b), (met_a, a) = stack.pop(), stack.pop()
            met = met_a and met_b if t == "AND" else met_a or met_b
            stack.append((met, (frozenset() if met_a else a) | (frozenset() if met_b else b)))
        else:
            stack.append((t.lower() in needed, frozenset({t.lower()})))
    met, left = stack[0]
    return frozenset() if met else left


def notices(hits: list[tuple[int, int, str]]) -> set[str]:
    """Labels of notice phrases (from, to, phrase): what lies in a longer one says nothing."""
    found, reach = set(), -1
    for _, end, phrase in sorted(hits, key=lambda h: (h[0], -h[1])):
        if end > reach:
            reach = end
            found.add(NOTICES[phrase])
    return found - {None}


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, str, str]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a text, and
    of its expressions the licences that are needed and those that are a choice."""
    text = text or ""
    flat = f" {_WORD_GAP.sub(' ', text.translate(_LOWER) if not text.islower() else text).strip(' ')} "
    if flat == "  ":
        return 0, 0, None, None, "", "", 0.0, "", ""
    n_words = flat.count(" ") - 1
    places, base, told, tags = [], set(), [], 0
    seen, upto = 0, 0  # words before `upto`, counted once
    for end, phrase in _automaton().iter(flat):
        if phrase in BASE:
            start = end - len(phrase) - 1
            # phrases may overlap, so a place can lie a little before the last one
            seen += flat.count(" ", upto, start) if start >= upto else -flat.count(" ", start, upto)
            upto = start
            places.append(seen)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tags += 1
        else:
            told.append((end - len(phrase), end, phrase))
    labels = notices(told)
    parsed, named, needed, choices = 0, set(), set(), set()
    if tags:
        found = list(_TAG_AT.finditer(text))
        for m, end in zip(found, [*(m.start() for m in found[1:]), len(text)]):
            line = _LINE.match(text, m.end(), end)[0].split("*/")[0].split("-->")[0]
            postfix = beginning(line)
            if postfix:
                parsed += 1
                every, need = evaluate(postfix)
                named |= every
                needed |= need
                choices |= open_choices(postfix, need)
    choices -= needed
    labels |= base | named
    evidence = len(places) + 2 * parsed + 0.5 * (tags - parsed) + 0.5 * len(labels - base)
    return n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), evidence / (evidence + 1.0), ",".join(sorted(needed)), ",".join(sorted(choices))


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan() of every document's whole text, beside its doc_id.

    A null or empty text has no words, no places, empty labels and score 0; a very long
    text is one string of its own; repeated rows give repeated results; an empty table
    gives none; other columns are ignored; ties cannot arise. What one expression needs
    is no choice, though another offers it. Of notices that lie in one another the longest
    counts. Ids may repeat or be null; other columns may have any names.
    """
    small_batches(docs.sparkSession)
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "needed": pa.string(), "choices": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            rows = [scan(t.as_py()) for t in b.column(1)]
            cols = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds.values()))], ["doc_id", *kinds])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, needed string, choices string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
