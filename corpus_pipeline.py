"""A training corpus from `documents`, stage by stage.

Each stage works on all that the stage before kept, written as Parquet and read again.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from depthbook.llm import jaccard_join, language_id, packing, pu_quality, span_dedup
from depthbook.llm.common import held_out, keep_ids, settle, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A text without a letter has no language and goes, and so does one whose language the
#: model can hardly tell; clean prose scores far above this.
LEAST_LANGUAGE_SCORE = 0.25


def _aside(docs: DataFrame, *made: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with columns that bear the name of one that a stage makes put under another
    name, and the way back to the columns of `docs`."""
    free = lambda n: next(x for x in (f"{n}{'_' * k}" for k in range(1, len(docs.columns) + 2)) if x not in docs.columns)
    names = {n: free(n) for n in made if n in docs.columns}
    return docs.withColumnsRenamed(names), lambda out: out.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty. Null texts and texts without
    a letter go, repeated rows are judged each, an empty table stays empty, and other
    columns pass unchanged, whatever their names."""
    own, back = _aside(docs, "lang_pred", "score")
    model = language_id.learn(own.where(~held_out(F.col("doc_id"))))
    return back(language_id.predict(own, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of 0.5 and more. Null texts score as empty ones, ties at 0.5
    stay, repeated rows are scored each, an empty table stays empty, and other columns pass
    unchanged, whatever their names."""
    own, back = _aside(docs, "_quality")
    model = pu_quality.learn(own.where(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return back(pu_quality.score(own, model, into="_quality").where("_quality >= 0.5"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id stays of each group. Null and wordless texts are linked
    with nothing and stay, as do rows without an id; rows that repeat an id are one
    document and stay or go together; an empty table stays empty."""
    gone = settle(jaccard_join.jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return keep_ids(docs, gone, "doc_id", gone.count(), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentences go; a document whose every sentence is repeated stays, empty.
    Null texts pass as they are; n_chars is counted anew where there is one; of equal texts
    the one of smallest id keeps its own; an empty table stays empty; other columns pass
    unchanged, whatever their names."""
    own, back = _aside(docs, "n_sentences", "n_removed")
    cut = span_dedup.dedup_spans(own)
    return back(cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces. Null and empty texts are one token, the end mark; rows that
    repeat an id are packed each; an empty table gives no pieces; other columns are not
    looked at."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("quality", quality), ("near_duplicates", near_duplicates), ("repeated_spans", repeated_spans), ("packing", packed)]

#: No stage before the packing can be said in SQL: classifiers and tokenisers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: null texts go in the first, and an empty table gives no
    pieces. Each stage says what else it does with odd rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
