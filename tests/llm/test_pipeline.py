"""The pipeline's stages on the small tables, and the registered queries."""

import __spark_entry__
import corpus_pipeline
from depthbook.llm.queries import QUERIES
from pyspark.sql import functions as F


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 14))


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, small), name)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0] and seen[2] < seen[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.select("doc_id").distinct().count() == seen[-1]


BIG = 10**9
ODD = [(None, None), (BIG + 1, None), (BIG + 1, None), (BIG + 2, ""), (BIG + 3, " \n\t"), (BIG + 4, "12 34"), (None, "A plain sentence about the old harbour and its boats."), (BIG + 5, "word " * 20000)]


def odd(spark, docs):
    """Documents with null, empty, long and repeated rows, and columns named as the stages'."""
    rows = docs.limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], rows.schema)
    both = rows.union(more).union(rows.limit(3))
    return both.selectExpr("*", "7.0D as score", "'mine' as lang_pred", "8 as _quality", "9 as n_sentences", "10 as n_removed", "11 as component_id")


def test_stages_of_odd_rows(spark, small):
    docs = odd(spark, spark.read.parquet(f"{small}/documents.parquet")).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        rows = [r.asDict() for r in out.collect()]
        want = {"score": 7.0, "lang_pred": "mine", "_quality": 8, "n_sentences": 9, "n_removed": 10, "component_id": 11}
        assert rows and all(r[k] == v for r in rows for k, v in want.items()), name
        ids = [r["doc_id"] for r in rows]
        if name == "language_id":
            assert not {BIG + 1, BIG + 2, BIG + 3, BIG + 4} & set(ids)
        if name in ("near_duplicates", "repeated_spans"):
            assert ids.count(BIG + 1) == 2 and ids.count(None) == 2 and {BIG + 2, BIG + 3} <= set(ids)
        empty = stage(spark, docs.limit(0), small)
        assert empty.columns == docs.columns and not empty.count(), name
    pieces = corpus_pipeline.packed(spark, docs, small).where(F.col("doc_id") == BIG + 1).collect()
    assert [p["length"] for p in pieces] == [1, 1]
    assert not corpus_pipeline.packed(spark, docs.limit(0), small).count()
