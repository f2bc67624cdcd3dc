"""The registered corpus queries: each applies its operator to its whole table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, importance, itq_dedup, jaccard_join, language_id, license_scan, multi_index, packing, periodic_runs, pu_quality, site_style, span_dedup, trie_bpe
from .common import table


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(table(spark, sf_dir, "pages"))


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.dedup_spans(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty and blank texts have no runs; see find_runs for other cases."""
    return periodic_runs.find_runs(table(spark, sf_dir, "documents"), order=periodic_runs.planted)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null counts as empty; of rows equal in text, length and id one is kept."""
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), digest=True)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without words have no features and weigh 0; undrawn rows have a null rank."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_site_style_tree, op2_inverted_multi_index, op3_license_scan, op4_ngram_jaccard_join, op5_trie_bpe, op6_pu_quality, op7_best_fit_packing, op8_itq_near_dedup, op9_language_id, op10_span_dedup, op11_periodic_runs, op12_exact_dedup, op13_importance_resampling, pipeline)
}
_SPACE = r"[\x20\x09-\x0D]"
EXACT = f"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS t FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY t) AS group_size, first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g"""
ORACLES: dict = {"op12_exact_dedup": EXACT} | {k: v for k, v in {"pipeline": corpus_pipeline.ORACLE_SQL}.items() if v}
