"""BPE encoding and decoding by prefix-sharing trie traversal.

Word-level BPE with an end-of-word mark. The distinct words of a batch go into a trie.
A depth-first walk carries, for every prefix, the last token of the prefix's own BPE
encoding and where that token began; the encoding of the prefix is then the encoding up
to there plus that token. A child's last token is the only vocabulary token that ends at
the child and merges validly with the token before it, so a shared prefix is encoded
once for all its words. Whether two tokens may stand side by side is decided by the
merge ranks alone and remembered.

The walk works on bytes as the vocabulary's printable symbols; the last symbol of a word
carries the mark and is a leaf of its own.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


def byte_symbols() -> list[str]:
    """The printable symbol of every byte: printable bytes are themselves, the others
    follow from code point 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary with end-of-word marks, read from a tokenizers JSON file."""

    def __init__(self, path: str, most_bytes: int = 64_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        # \\s there is Unicode's White_Space, a few controls fewer than Python's
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.white = regex.compile(r"\p{White_Space}+")
        # the same classes for texts within Latin-1, where the standard library is faster
        letter, number, space = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
        self.latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.symbols = byte_symbols()
        self.longest = max(map(len, self.vocab))
        self.heads: dict[str, bool] = {}
        self.sides: dict[tuple[str, str], bool] = {}
        self.ids, self.names = self._empty()
        self.most_bytes, self.held = most_bytes, 0

    def merged(self, parts: list[str]) -> list[str]:
        """Plain BPE: apply the best-ranked merge until none is left."""
        rank, none = self.rank, 1 << 60
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), none))
            a, b = parts[best], parts[best + 1]
            if (a, b) not in rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def parts(self, token: str) -> list[str]:
        """A token's symbols, the last of a word with its mark."""
        if token.endswith(self.end) and token != self.end:
            bare = token[: -len(self.end)]
            return [*bare[:-1], bare[-1] + self.end]
        return list(token)

    def whole(self, token: str) -> bool:
        """Whether the token is what its own symbols merge to."""
        if (ok := self.heads.get(token)) is None:
            ok = self.heads[token] = self.merged(self.parts(token)) == [token]
        return ok

    def side_by_side(self, a: str, b: str) -> bool:
        """Whether the symbols of a and b merge to exactly a, b."""
        if (ok := self.sides.get((a, b))) is None:
            if len(self.sides) > 2_000_000:
                self.sides.clear()
            ok = self.sides[a, b] = self.merged(self.parts(a) + self.parts(b)) == [a, b]
        return ok

    def encode_words(self, words: list[str]) -> None:
        """Encode distinct words through one trie; the results go to `ids` and `names`.

        The trie is held as its words in sorted order, which is its depth-first order:
        a node is a prefix, and walking from one word to the next keeps the states of
        the prefix they share and adds the states of the rest.
        """
        symbols, end, longest, vocab = self.symbols, self.end, self.longest, self.vocab
        whole, heads, sides, side_by_side = self.whole, self.heads, self.sides, self.side_by_side
        spelled = sorted((w if w.isascii() and w.isprintable() else "".join(map(symbols.__getitem__, w.encode())), w) for w in words)
        # last[d]: last token of the encoding of the first d symbols, begun[d]: its start
        last, begun, before = [""], [0], ""
        for text, word in spelled:
            n = len(text)
            shared, most = 0, min(len(last) - 1, n - 1)
            while shared < most and text[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], begun[shared + 1 :]
            for depth in range(shared + 1, n + 1):
                tail = "" if depth < n else end
                for i in range(depth - longest if depth > longest else 0, depth):
                    t = text[i:depth] + tail
                    if t not in vocab:
                        continue
                    ok = heads.get(t)
                    if not (whole(t) if ok is None else ok):
                        continue
                    if i:
                        pair = (last[i], t)
                        ok = sides.get(pair)
                        if not (side_by_side(*pair) if ok is None else ok):
                            continue
                    break
                else:
                    raise ValueError(f"no token of the vocabulary ends {text[:depth]!r}")
                if depth < n:
                    last.append(t)
                    begun.append(i)
            out = [t]
            while i > 0:
                out.append(last[i])
                i = begun[i]
            out.reverse()
            self.ids[word] = " ".join([str(vocab[x]) for x in out])
            self.names[word] = " ".join(out)
            before = text

    def pieces(self, text: str) -> list[str]:
        """A text's words; a special token stays as it is written."""
        if self.special and self.at_special.search(text):
            words, at = [], 0
            for m in self.at_special.finditer(text):
                words += [*self._plain(text[at : m.start()]), m[0]]
                at = m.end()
            return words + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.latin.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        lower = "".join(map(str.lower, text)) if "\u03a3" in text or "\u0130" in text else text.lower()  # each character by itself: no final sigma
        try:
            lower.encode("latin-1")
        except UnicodeEncodeError:
            return self.split.findall(self.white.sub(" ", lower))
        return self.latin.findall(lower)

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Each text's (number of tokens, ids joined by spaces, tokens joined by spaces)."""
        pieces = [self.pieces(t) for t in texts]
        words = set().union(*pieces)
        if self.held > self.most_bytes:
            self.ids, self.names, self.held = *self._empty(), 0
        new = words - self.ids.keys()
        self.encode_words(new)
        # about what a word, its ids and its tokens take in memory
        self.held += 250 * len(new) + 8 * sum(map(len, new))
        out, ids, names = [], self.ids.__getitem__, self.names.__getitem__
        for p in pieces:
            joined = " ".join(map(ids, p))
            out.append((joined.count(" ") + 1 if p else 0, joined, " ".join(map(names, p))))
        return out

    def _empty(self) -> tuple[dict[str, str], dict[str, str]]:
        return {s: str(i) for s, i in self.special.items()}, {s: s for s in self.special}

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by single spaces, as a tokenizer without a decoder does; ids
        without a token are left out."""
        return " ".join(self.name[i] for i in ids if i in self.name)


@functools.lru_cache(1)
def _held(path: str) -> WordBpe:
    """One vocabulary, with the words it knows, for all tasks of a Python worker."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document's whole text.

    A null or empty text has no tokens and decodes to the empty text; very long texts
    are encoded alone; repeated rows give repeated results; an empty table gives none;
    other columns are ignored. `vocabulary` is the path of the JSON file on every node.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _held(vocabulary)
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            n, a, z = [], [], []
            at = 0
            while at < len(texts):  # about 4 MB of text at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size < 4_000_000):
                    size += len(texts[to])
                    to += 1
                for count, joined, decoded in bpe.encode(texts[at:to]):
                    n.append(count)
                    a.append(hashlib.sha256(joined.encode()).hexdigest())
                    z.append(hashlib.sha256(decoded.encode()).hexdigest())
                at = to
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a), pa.array(z)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
