"""The text operators as queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html, language, lines, negatives, oracles, ppm, quality, rules, search, secrets, simhash, urls
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE_RULES]
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in base], F.sha2(secrets.listed(own).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *counts, "base_failed", "kept", "lost_words")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "n_near",
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), relabel=moved)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_common_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_urls": op2_urls,
        "op3_secrets": op3_secrets,
        "op4_simhash": op4_simhash,
        "op5_rules": op5_rules,
        "op6_language": op6_language,
        "op7_ppm": op7_ppm,
        "op8_decontaminate": op8_decontaminate,
        "op9_html": op9_html,
        "op10_quality": op10_quality,
        "op11_negatives": op11_negatives,
        "op12_lines": op12_lines,
        "op13_search": op13_search,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it; tests/llm compares the other queries with brute force, exact round trips or held-out rows."""
    return {
        "op2_urls": oracles.op2(), "op3_secrets": oracles.op3(), "op5_rules": oracles.op5(), "op8_decontaminate": oracles.op8(), "op11_negatives": oracles.op11(), "op12_lines": oracles.op12(),
        "op13_search": oracles.op13(),
    }
