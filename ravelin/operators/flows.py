"""Whole flows out of the operators: feeds to indexed indicators, documents to graph, windows to briefings, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import briefing, evaluate, extraction, graph, indicators, lifecycle, resolve


def ingest_feeds(candidates: DataFrame, seen: DataFrame | None, now: Column) -> DataFrame:
    """Indexed documents of the candidates that were not accepted in the last 24 hours.

    Of a pattern that several feeds report, the feed registered first counts. seen: pattern, at of earlier
    acceptances. Rows without a pattern are left out before they could count as seen."""
    rows = candidates.where(F.coalesce("pattern", F.lit("")) != "")
    others = [c for c in rows.columns if c != "pattern"]
    first = rows.groupBy("pattern").agg(F.min_by(F.struct(*others), F.struct("feed_rank", "name")).alias("_r")).select("pattern", "_r.*")
    if seen is not None:
        recent = seen.groupBy("pattern").agg(F.max("at").alias("at")).where(F.col("at") > now - F.expr(f"interval {indicators.TTL_SECONDS} seconds"))
        first = first.join(recent, "pattern", "left_anti")
    return indicators.documents(first, now)


def targeting(names: DataFrame, catalog: DataFrame, taxonomies: DataFrame, caps: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and quarantine candidates of names (doc_id, category, name, source_url) found in documents.

    Names are capped first and resolved then: actors and malware against the catalog's index, sectors and countries
    against taxonomies with compound phrases split; vulnerabilities need no catalog. What doesn't resolve is queued
    and never linked. Documents without a web source make no edges."""
    kept = resolve.capped(names, caps or graph.CAPS)
    world = kept.where(F.col("category").isin("actor", "malware"))
    fixed = kept.where(F.col("category").isin("sector", "country"))
    one = resolve.resolve(world, catalog).withColumn("part", F.col("name"))
    two = resolve.resolve_compound(fixed, taxonomies)
    columns = ["doc_id", "category", "part", "canonical", "source_url"]
    resolved = one.select(*columns).unionByName(two.select(*columns))
    free = kept.where(F.col("category") == "cve").select("doc_id", "category", F.col("name").alias("part"), F.upper("name").alias("canonical"), "source_url")
    known = resolved.where("canonical is not null").unionByName(free)
    members = known.where(F.col("source_url").rlike("^https?://")).select("doc_id", "category", F.col("canonical").alias("name"))
    queue = resolved.where("canonical is null").select("category", F.col("part").alias("candidate_name"), "source_url").distinct()
    return graph.axes(members), queue


def extract(docs: DataFrame, proposed: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """Indicators, rejections, grounded names and vulnerability ids of documents (doc_id, text, source_type).

    proposed: doc_id, type, value, pos of candidate indicators; names: doc_id, category, name."""
    judged = extraction.judge(extraction.unite(proposed, extraction.harvest(docs)), docs)
    ids = docs.select("doc_id", F.explode(_cves(F.col("text"))).alias("name"))
    return {
        "indicators": extraction.indicators(judged),
        "rejected": judged.where("reason is not null").select("doc_id", "type", "value", "reason"),
        "names": extraction.grounded_names(names, docs),
        "vulnerabilities": ids,
    }


def _cves(text: Column) -> Column:
    from ..functions.identifiers import cves
    from ..functions.text import refang

    return cves(refang(text))


def collect_briefing(indicators_: DataFrame, groups: DataFrame, legacy: DataFrame, techniques: DataFrame, authors: DataFrame | None, hours: int, until: Column) -> dict[str, DataFrame]:
    """The tables of a briefing: window totals, the sample, its types and sectors, reference entities and techniques."""
    mine = briefing.curated(indicators_, authors)
    from ..functions.times import in_window

    sample = briefing.sample(mine.where(in_window(F.col("updated_at"), hours, until)))
    return {
        "totals": briefing.totals(mine, hours, until),
        "sample": sample,
        "types": briefing.by_type(sample),
        "sectors": briefing.sectors(sample),
        "actors": briefing.references(groups, legacy),
        "techniques": briefing.techniques(techniques),
    }


def evaluate_corpus(docs: DataFrame, judged: DataFrame, gold: DataFrame) -> DataFrame:
    """Micro-averaged scores of kept indicators against gold values (doc_id, format, type, value)."""
    kept = judged.where("reason is null").join(docs.select("doc_id", "format"), "doc_id")
    return evaluate.micro(evaluate.outcomes(kept, gold))


def replay_claims(approved: DataFrame, members: DataFrame) -> DataFrame:
    """Edges of documents whose queued names were approved: the names join those resolved before."""
    return graph.axes(members.unionByName(approved.select("doc_id", "category", "name")))


def fold_log(events: DataFrame) -> dict[str, DataFrame]:
    """State, totals and newest documents of an event log."""
    state = lifecycle.documents(events)
    return {"state": state, "totals": lifecycle.totals(events), "recent": lifecycle.recent_documents(state)}
