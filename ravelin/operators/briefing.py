"""Look-back statistics for briefings: window totals, samples, rendered block, anchoring of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers, times
from ..functions import text as T

#: Labels that name a sector.
SECTOR_LABELS = ("finance", "government", "healthcare", "energy", "defense")


def totals(rows: DataFrame, hours: int, until: Column) -> DataFrame:
    """One row: indicators touched and created in the window, and those that were only updated. Bounds are strict."""
    out = rows.agg(F.count_if(times.in_window(F.col("updated_at"), hours, until)).alias("total_touched"), F.count_if(times.in_window(F.col("created_at"), hours, until)).alias("total_new"))
    return out.withColumn("updated_only", F.greatest(F.col("total_touched") - F.col("total_new"), F.lit(0)).cast("bigint"))


def curated(rows: DataFrame, authors: DataFrame | None, by: str = "author_id") -> DataFrame:
    """Rows by the given authors; no list means no filter."""
    return rows if authors is None else rows.join(authors.select(F.col("id").alias(by)).distinct(), by, "left_semi")


def sample(rows: DataFrame, newest: int = 50, top: int = 25, updated: str = "updated_at", score: str = "score", tie: str = "id") -> DataFrame:
    """Of the newest rows those with the highest score; nulls count as 0 and ties keep the newest first."""
    recent = rows.orderBy(F.desc(updated), F.asc(tie)).limit(newest)
    return recent.orderBy(F.desc(F.coalesce(score, F.lit(0))), F.desc(updated), F.asc(tie)).limit(top)


def by_type(rows: DataFrame, kind: str = "observable_type") -> DataFrame:
    return rows.groupBy(F.coalesce(kind, F.lit("Unknown")).alias(kind)).agg(F.count("*").alias("n"))


def top_confidence(rows: DataFrame, score: str = "score") -> DataFrame:
    return rows.agg((F.coalesce(F.max(F.coalesce(score, F.lit(0))), F.lit(0)) / 100).alias("top_confidence"))


def references(groups: DataFrame, legacy: DataFrame, each: int = 10, most: int = 10) -> DataFrame:
    """The newest groups, then the newest legacy actors, so many in all."""
    pick = lambda df, k: df.orderBy(F.desc("modified"), "id").limit(each).select("id", "name", "modified", F.lit(k).alias("kind"))
    return pick(groups, 0).unionByName(pick(legacy, 1)).orderBy("kind", F.desc("modified"), "id").limit(most)


def techniques(rows: DataFrame, most: int = 10) -> DataFrame:
    """Named techniques: an id of the T1 series and a name other than it."""
    return rows.where(F.col("x_mitre_id").startswith("T1") & (F.col("name") != F.col("x_mitre_id"))).orderBy("x_mitre_id").limit(most)


def sectors(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """One row: the sector labels of the sample, sorted."""
    each = rows.select(F.explode(labels).alias("label")).select(F.lower("label").alias("label")).where(F.col("label").isin(*SECTOR_LABELS))
    return each.agg(F.array_sort(F.collect_set("label")).alias("sectors"))


def block(indicators: DataFrame, names: DataFrame, counts: DataFrame, hours: int, until: str) -> DataFrame:
    """The text block from a sample (name, observable_type, score, pos), names (kind, name, pos) and window totals.

    The sentences are fixed values: what reads the block finds its numbers and names by them."""
    cleaned = T.clean(F.col("name"))
    lists = names.where(F.col("pos") < 10).groupBy().agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", cleaned.alias("n"))))), lambda x: x["n"]), ", ").alias(k) for k in ("actor", "malware", "campaign", "technique", "sector")])
    shown = F.concat(T.clean(F.col("name"), 120), F.lit(" ("), T.clean(F.coalesce("observable_type", F.lit("Unknown")), 30), F.lit(")"))
    first = F.when((F.col("pos") < 10) & F.col("name").isNotNull(), F.struct("pos", shown.alias("v")))  # only those that are shown are collected
    values = F.transform(F.sort_array(F.collect_list(first)), lambda x: x["v"])
    top = indicators.agg(F.array_join(values, ", ").alias("values"), F.count("*").alias("n"), (F.coalesce(F.max(F.coalesce("score", F.lit(0))), F.lit(0)) / 100).alias("top"))
    kinds = indicators.groupBy(F.coalesce("observable_type", F.lit("Unknown")).alias("t")).agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    kinds = kinds.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", F.concat_ws(" ", F.col("c").cast("string"), "t").alias("x")))), lambda x: x["x"]), ", ").alias("kinds"))
    rows = top.crossJoin(kinds).crossJoin(lists).crossJoin(counts)  # one row each
    none = lambda c, word: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(word))
    text = F.concat(
        F.lit(f"Period: last {hours}h (ending {until}).\n"),
        F.format_string("IOC activity in period: %d indicators total (%d newly created, %d pre-existing ones re-updated). The %d highest-confidence of them are sampled below: (", "total_touched", "total_new", "updated_only", "n"),
        none("kinds", "none"), F.lit(")"), F.when(F.col("n") > 0, F.format_string(", top confidence: %.2f", "top")).otherwise(""), F.lit(".\n"),
        F.when(F.col("values") != "", F.concat(F.lit("Highest-confidence indicator values, verbatim: "), "values", F.lit(".\n"))).otherwise(""),
        F.lit("Tracked threat actors (knowledge base, most recently updated first): "), none("actor", "none identified"), F.lit(".\nTracked malware families (knowledge base): "), none("malware", "none identified"),
        F.lit(".\nCampaigns tracked in knowledge base: "), none("campaign", "none"), F.lit(".\nATT&CK techniques tracked (knowledge base): "), none("technique", "none"), F.lit(".\nAffected sectors: "), none("sector", "none identified"), F.lit(".\n"),
    )
    return rows.select(text.alias("block"))


def unanchored(runs: DataFrame, text: str = "text", context: str = "context", key: str = "run_id") -> DataFrame:
    """(run, kind, value) of identifiers in a text that its context doesn't hold."""
    said = runs.select(key, F.explode(identifiers.facts(F.col(text))).alias("f")).select(key, "f.*")
    known = runs.select(key, F.explode(identifiers.context_facts(F.col(context))).alias("f")).select(key, "f.*")
    return said.join(known, [key, "kind", "value"], "left_anti")


def anchor_stats(runs: DataFrame, text: str = "text", context: str = "context") -> DataFrame:
    """runs with the number of identifiers in the text and those without support; both lie in one row, so no join is needed."""
    said, known = identifiers.facts(F.col(text)), identifiers.context_facts(F.col(context))
    loose = F.transform(F.array_except(said, known), lambda x: F.concat_ws(":", x["kind"], x["value"]))
    return runs.withColumns({"total_facts": F.size(said), "unanchored": loose})


def verify(drafts: DataFrame, second: DataFrame, key: str = "run_id") -> DataFrame:
    """Drafts after one retry: a second text replaces a draft with loose identifiers, and what is loose still is noted at its end.

    drafts: run_id, text, context; second: run_id, text of the retries."""
    first = anchor_stats(drafts).withColumn("retried", F.size("unanchored") > 0)
    again = first.drop("total_facts", "unanchored").join(second.select(key, F.col("text").alias("_second")), key, "left")
    again = anchor_stats(again.withColumn("text", F.when(F.col("retried"), F.coalesce("_second", "text")).otherwise(F.col("text"))).drop("_second"))
    note = F.concat(F.lit("\n\n[Unverified identifiers: "), F.array_join("unanchored", ", "), F.lit("]"))
    return again.withColumn("text", F.when(F.size("unanchored") > 0, F.concat("text", note)).otherwise(F.col("text")))
