"""Exact duplicates by progressive refinement, in DataFrame functions alone.

Texts are equal when they are identical without ASCII white space. They are grouped by
length, groups of more than one by the hash of their first characters, and only texts of
what then still has company are hashed whole. The groups that survive the prefix become a
bitmap over hashed keys: its size is bounded, so it can be broadcast, and texts are never
shuffled. A key that shares its bit with a surviving one costs a hash and nothing else.
Counts are combined before they are shuffled and rows that travel hold no text, so a group
with a third of all rows is no one's burden; the join that tells rows their group is split
by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settle

#: Code points that the prefix hash reads.
PREFIX = 64
#: Bits of the map for each surviving key, and the largest map: 2^29 bits, 64 MB.
BITS_A_KEY, MOST_BITS = 16, 1 << 29
#: Bits of one bitmap of bitmap_construct_agg.
_BLOCK = 8 * 4096


def normalised(text: Column) -> Column:
    """The text without \\x20 and \\x09-\\x0D; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r ":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _bit(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key's bit and the bit's place in it."""
    at = F.pmod(key, F.lit(blocks * _BLOCK))
    return F.floor(at / _BLOCK).cast("int"), F.pmod(at, F.lit(_BLOCK))


def _surviving(rows: DataFrame) -> DataFrame:
    """Keys (length and prefix hash in one) of the groups with more than one row.

    The lengths that occur once go first; of the others, what shares its length with other
    texts alone goes by its prefix hash.
    """
    keys = settle(rows.select("_length", "_prefix"), "prefixes")
    lengths = settle(keys.groupBy("_length").count().where("count > 1").select("_length"), "lengths")
    company = keys.join(F.broadcast(lengths) if lengths.count() <= BROADCAST_ROWS else lengths, "_length", "left_semi")
    return company.groupBy("_length", "_prefix").count().where("count > 1").select(F.xxhash64("_length", "_prefix").alias("_key"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) of every row, dropped ones too.

    Of equal texts the row with the most code points stays, then the one of smallest id (a
    null id is larger than any); of rows equal in both any one, and one alone. keep_id is
    the id of the row that stays. Null, empty and blank texts are equal to each other. Ids
    may repeat: every row counts. Other columns are not looked at, whatever their names;
    an empty table gives an empty result. With `digest`, text_sha256 is the SHA-256 of each
    normalised text; only then are texts without company hashed whole too.
    """
    text, norm = F.col(text_col), normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).alias("_chars"), norm.alias("_text"))
    rows = rows.withColumns({"_length": F.length("_text"), "_prefix": F.xxhash64(F.substring("_text", 1, PREFIX))})
    survivors = settle(_surviving(rows), "survivors")
    blocks = max(1, min(MOST_BITS, survivors.count() * BITS_A_KEY) // _BLOCK)
    block, place = _bit(F.col("_key"), blocks)
    # bit positions of bitmap_construct_agg: byte place / 8, bit place % 8 of it
    maps = survivors.select(block.alias("_block"), place.alias("_place")).groupBy("_block").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    block, place = _bit(F.xxhash64("_length", "_prefix"), blocks)
    told = rows.withColumns({"_block": block, "_place": place}).join(F.broadcast(maps), "_block", "left")  # at most MOST_BITS bits
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    company = F.coalesce(F.getbit(byte, F.pmod(F.col("_place"), F.lit(8)).cast("int")) == 1, F.lit(False))
    whole = F.sha2(F.col("_text").cast("binary"), 256)
    columns = {"_full": F.when(company, whole), "_row": F.monotonically_increasing_id()}
    columns |= {"text_sha256": whole} if digest else {}
    hashed = settle(told.withColumns(columns).drop("_text", "_length", "_prefix", "_block", "_place", "_bits"), "hashed")
    first = F.min(F.struct((-F.col("_chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    groups = settle(hashed.where("_full is not null").groupBy("_full").agg(first.alias("_first"), F.count("*").alias("_size")).where("_size > 1"), "groups")
    # rows without company join nothing, each under a key of its own
    joined = hashed.withColumn("_key", F.coalesce("_full", F.col("_row").cast("string"))).join(groups.withColumnRenamed("_full", "_key"), "_key", "left")
    alone = F.col("_first").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_first.id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_first.row") == F.col("_row"))).alias("kept"),
        *(["text_sha256"] if digest else []),
    )
