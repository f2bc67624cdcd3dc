"""Bounded-space online best-fit packing of tokenised documents into sequences.

Documents are tokenised where they lie; only their piece lengths travel. A packing task
meets its pieces online, in the order of the documents' ids and never of their lengths. It
keeps a fixed number of open bins, found through a bitset keyed by free space: a piece
goes to the open bin that it leaves fullest, and when a new bin is needed and all are
open, the fullest one closes first.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches
from .textops import bounded
from .trie_bpe import byte_symbols

#: Pieces for one packing task, about: many, so that the bins still open at its end waste
#: little. A task holds the open bins and a batch of pieces, whatever their number.
PIECES_A_TASK = 100_000
#: Open bins of a task.
OPEN_BINS = 256

# The pre-tokeniser's pattern, and the same within Latin-1.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_L, _N, _S = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class ByteBpe:
    """Token ids as little-endian unsigned 32-bit bytes; the pieces a task has met are
    remembered, with their ids at most `most` bytes of them."""

    def __init__(self, path: str, most: int = 48_000_000):
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.latin, self.any = re.compile(_LATIN), regex.compile(_PATTERN)
        # the same vocabulary by bytes; its merges must rank as the ids of what they make
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        byte = {c: i for i, c in enumerate(byte_symbols())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in self.special}
        self.piece = tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.most, self.held = most, 0

    def _library(self, text: str) -> bytes:
        """Texts with special tokens go the library's own way."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._library(text)
        try:
            text.encode("latin-1")
            pieces = self.latin.findall(text)
        except UnicodeEncodeError:
            pieces = self.any.findall(text)
        known = self.known
        for p in set(pieces):
            if p not in known:
                ids = known[p] = array("I", self.piece(p)).tobytes()
                self.held += 2 * len(p) + len(ids) + 150  # about what both take in memory
        out = b"".join(map(known.__getitem__, pieces))
        if self.held > self.most:
            known.clear()
            self.held = 0
        return out


class OpenBins:
    """At most `most` open bins of `size`; the bitset has bit f if a bin has f free."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.bits, self.open, self.made = size, most, 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, f: int) -> int:
        b = self.free[f].pop()
        if not self.free[f]:
            self.bits &= ~(1 << f)
        self.open -= 1
        return b

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the place in it for a piece of `length`."""
        fits = self.bits >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            b = self._take(f)
        else:
            if self.open == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            f, b = self.size, self.made
            self.made += 1
        if f > length:
            self.free[f - length].append(b)
            self.bits |= 1 << (f - length)
            self.open += 1
        return b, self.size - f


def tokenized_pieces(docs: DataFrame, vocabulary: str, size: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids, then the separator;
    a longer one is cut into pieces of `size`, of which the first may be shorter."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's own: a worker goes on to other work without it
        bpe, end = ByteBpe(vocabulary), separator.to_bytes(4, "little")
        for b in bounded(batches, 1):
            rows = []
            for i in range(b.num_rows):
                ids = bpe.encode(b.column(1)[i].as_py() or "") + end
                n = len(ids) // 4
                at, doc, k = 0, b.column(0)[i].as_py(), 0
                while at < n:
                    step = (n - at) % size or size
                    rows.append((doc, k, at, step, zlib.crc32(ids[4 * at : 4 * (at + step)])))
                    at, k = at + step, k + 1
            cols = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add (sequence_id, offset) to rows that have (doc_id, piece, length).

    Pieces are dealt over tasks by a hash and met in the order of (doc_id, piece), so each
    task's result is the same whenever it is run again; lengths above `size` are an error
    of the caller's.
    """
    tasks = max(1, -(-pieces.count() // PIECES_A_TASK))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, task = OpenBins(size, open_bins), None
        for f in frames:
            if task is None:
                task = int(f["task"].iloc[0]) << 40 if len(f) else None
            placed = [bins.put(x) for x in f["length"].tolist()]
            yield f.drop(columns="task").assign(sequence_id=[(task or 0) + b for b, _ in placed], offset=[o for _, o in placed])

    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece")).withColumn("task", F.spark_partition_id().cast("long"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return dealt.sortWithinPartitions("doc_id", "piece", "length").mapInPandas(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, separator: int = 0, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is its separator alone; a very long one becomes several pieces;
    repeated rows are packed as often as they occur, ties among bins go to the one used
    last; an empty table gives no rows; other columns are ignored.
    """
    return pack(settle(tokenized_pieces(docs, vocabulary, size, separator, id_col, text_col), "pieces"), size, open_bins)
