"""The pipeline against the same stages by brute force, on the smallest tables with odd rows."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from ravelin.llm import quality, secrets
from ravelin.llm.common import table
from test_operators import ODD, SF, brute_components, brute_overlap, brute_spans


def _docs(spark):
    own = table(spark, SF, "documents")
    more = [(30_000_000 + k, t, "en", "odd", len(t or "")) for k, t in enumerate(ODD)] + [(None, "no id here", None, None, None)]
    return own.unionByName(spark.createDataFrame(more, own.schema)).unionByName(own.limit(5))


def test_near_copies_leave_one(spark):
    docs = _docs(spark)
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    groups = {}
    for i, _, c in brute_components(data):
        groups.setdefault(c, set()).add(i)
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == sorted(-1 if c is None else c for c in groups)


def test_contaminated_documents_go(spark):
    docs = table(spark, SF, "documents")
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    bad = {i for i, n, hit, _ in brute_overlap(data, items) if hit and 20 * hit >= n}
    kept = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in data} - bad and bad


def test_secrets_are_redacted_and_all_documents_stay(spark):
    docs = _docs(spark)
    out = corpus_pipeline.redact_secrets(spark, docs, SF)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.where("text is not null and n_chars is not null").collect():
        assert not [s for s in brute_spans(r["text"]) if s[2] != "assign"]
        assert r["n_chars"] == len(r["text"])


def test_quality_keeps_good_documents(spark):
    docs = _docs(spark)
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert kept.columns == docs.columns
    judged = quality.classify(docs, table(spark, SF, "labels")).where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    assert kept.where("doc_id is not null").select("doc_id").distinct().count() == judged.count()


def test_run_applies_the_stages_in_order(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
    assert [re.sub(r"\W", "", n) for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_rows_without_secrets_are_not_shuffled(spark):
    """However large the findings are held to be, only rows that may have some meet them in a join; the rows are the same in one part."""
    docs = _docs(spark)
    found = secrets.found_in(docs)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        given, clean = secrets.parted(docs, found)
        assert "hashpartitioning" not in clean._jdf.queryExecution().toString() and 0 < given.count() < clean.count()
        assert given.count() + clean.count() == docs.count()
        assert {r["doc_id"] for r in given.collect()} == {r["doc_id"] for r in secrets.findings(docs).where("size(spans) > 0").collect()}
        rows = lambda df: sorted(map(repr, df.collect()))
        parts = rows(corpus_pipeline.redact_secrets(spark, docs, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert secrets.parted(docs, found, most=0)[1] is None
    whole = secrets.findings(docs).withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    assert parts == rows(whole.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")).select(docs.columns))
