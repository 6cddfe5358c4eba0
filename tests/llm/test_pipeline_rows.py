"""Rows that share an id, or have none, are judged one by one."""

import corpus_pipeline
from ravelin.llm import quality
from ravelin.llm.common import table
from test_operators import SF


def _rows(spark, good, bad):
    """The table's documents, and a good and a bad text without id, under one id, and twice each."""
    own = table(spark, SF, "documents")
    more = [(i, t, "en", "odd", len(t)) for i in (None, 40_000_000) for t in (good, bad, good, bad)]
    return own.unionByName(spark.createDataFrame(more, own.schema))


def _odd(df):
    return sorted(((r["doc_id"] or 0, r["text"]) for r in df.where("doc_id is null or doc_id = 40000000").collect()))


def test_quality_judges_rows_without_id(spark):
    judged = quality.classify(table(spark, SF, "documents"), table(spark, SF, "labels"))
    text = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    verdict = {r["doc_id"]: r["predicted"] for r in judged.collect()}
    good, bad = (next(text[i] for i in sorted(verdict) if verdict[i] == v and text[i]) for v in (1, 0))
    kept = corpus_pipeline.keep_quality(spark, _rows(spark, good, bad), SF)
    assert _odd(kept) == [(i, good) for i in (0, 0, 40_000_000, 40_000_000)]


def test_contamination_judges_rows_without_id(spark):
    bad = next(r["text"] for r in table(spark, SF, "benchmark").collect() if len(r["text"].split()) >= 20)
    good = "nothing of any benchmark stands in here"
    kept = corpus_pipeline.drop_contaminated(spark, _rows(spark, good, bad), SF)
    assert _odd(kept) == [(i, good) for i in (0, 0, 40_000_000, 40_000_000)]
