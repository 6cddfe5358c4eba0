"""State from event logs: documents, jobs, briefings, sources, acknowledgements. Snapshots are folds of ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids, times
from ..functions import text as T


def documents(events: DataFrame, key: str = "document_key") -> DataFrame:
    """The state of each document after its events (kind previewed, failed or ingested; at; seq; report_id; error).

    A preview never takes back an ingestion and keeps failed_at and report_id; a failure does override, but keeps
    the first ingestion; report ids stay where a later event has none. Each field is that of the last or first event of
    some kind, so partial aggregates work it out and the events of a document never meet in one place."""
    order = F.struct("at", "seq", "kind", "report_id", "error")
    inside, failed, seen = (F.col("kind") == k for k in ("ingested", "failed", "previewed"))
    last = lambda test: F.max(F.when(test, order))
    at = lambda test: F.max(F.when(test, F.col("at")))
    folded = events.groupBy(key).agg(
        F.max(order).alias("_any"), last(~seen).alias("_main"), F.max(F.when(~seen & F.col("report_id").isNotNull(), order)).alias("_report"), F.min(F.when(inside, F.col("at"))).alias("first_ingested_at"),
        at(inside).alias("ingested_at"), at(failed).alias("failed_at"), at(seen).alias("previewed_at"), F.max("at").alias("updated_at"),
    )
    status = F.when(F.col("_main.kind") == "ingested", F.lit("ingested")).otherwise(F.col("_any.kind"))
    error = F.when(F.col("_main.kind") == "failed", T.sanitize_error(F.col("_main.error")))
    return folded.select(key, status.alias("status"), "first_ingested_at", "ingested_at", "failed_at", "previewed_at", F.col("_report.report_id").alias("report_id"), error.alias("error"), "updated_at")


def first_ingestions(events: DataFrame, key: str = "document_key") -> DataFrame:
    """The first ingested event of each document."""
    mine = events.where("kind = 'ingested'")
    others = [c for c in mine.columns if c != key]
    return mine.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("at", "seq")).alias("_r")).select(key, "_r.*")


def totals(events: DataFrame, key: str = "document_key") -> DataFrame:
    """One row: documents, indicators and last run, where a document counts once, on its first ingestion, if that updates totals."""
    rows = first_ingestions(events, key).where("update_totals")
    return rows.agg(F.count("*").alias("total_docs"), F.coalesce(F.sum("indicator_count"), F.lit(0)).alias("total_iocs"), F.max("at").alias("last_run"))


def running_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("total_docs"), F.coalesce(F.sum("iocs"), F.lit(0)).alias("total_iocs"), F.max("at").alias("last_run"))


def recent_documents(state: DataFrame, limit: int = 50) -> DataFrame:
    rows = state.orderBy(F.desc("updated_at"), F.asc("document_key")).limit(max(1, min(limit, 500)))
    return rows.select("*", F.coalesce("first_ingested_at", "updated_at").alias("shown_at"))


def latest(rows: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """The last row of each key: briefings, jobs, runs."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(at, seq)).alias("_r")).select(key, "_r.*")


def keep_jobs(jobs: DataFrame, most: int = 1000) -> DataFrame:
    """The register after evicting the oldest finished jobs, then the oldest; the rank is over the few jobs beyond the cap."""
    order = [F.col("status").isin("complete", "error").asc(), F.desc("created_at"), F.desc("job_id")]
    return jobs.orderBy(*order).limit(most)


def acknowledged(processed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Processed urls after outcomes: a complete job with a report adds both its keys, a transient failure takes its url back."""
    done = outcomes.where("status = 'complete' and report_id is not null")
    both = done.select(F.col("landing_key").alias("url")).unionByName(done.select(F.col("document_key").alias("url"))).where("url is not null")
    from ..functions.identifiers import is_transient

    lost = outcomes.where((F.col("status") == "error") & is_transient(F.col("error"))).select(F.col("document_key").alias("url"))
    return processed.select("url").join(lost, "url", "left_anti").unionByName(both).distinct()


def cycle_counts(items: DataFrame, by: str = "source") -> DataFrame:
    """new, known, processed and failed items of each source in a cycle."""
    is_ = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return items.groupBy(by).agg(is_("new"), is_("known"), is_("processed"), is_("failed"))


def cumulative(counts: DataFrame, by: str, at: str, columns: list[str]) -> DataFrame:
    w = W.partitionBy(by).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumns({f"total_{c}": F.sum(c).over(w) for c in columns})


def sources_due(sources: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    rows = sources.join(state, "source", "left")
    return rows.select("source", times.source_is_due(F.col("last_attempt"), F.col("last_polled"), now, F.col("interval_hours")).alias("due"))


def schedule(jobs: DataFrame, runs: DataFrame, now: Column, jitter: int = 60, workers: int = 5) -> DataFrame:
    """When each job (job, interval_seconds) runs next, and which start now.

    runs: job, started_at, ended_at (null while it runs). A job is due an interval after its last start plus a fixed
    delay of up to `jitter` seconds, which a hash of its name gives; intervals that were missed count as one; a job
    that still runs doesn't start again. Of those due, the ones that waited longest take the free workers."""
    last = runs.groupBy("job").agg(F.max("started_at").alias("last_start"), F.count_if(F.col("ended_at").isNull()).alias("_open"))
    delay = F.pmod(F.crc32(F.col("job").cast("binary")), F.lit(jitter + 1))
    at = F.timestamp_seconds(F.unix_timestamp("last_start") + F.col("interval_seconds") + delay)
    rows = jobs.join(last, "job", "left").withColumn("next_run", F.coalesce(at, now))
    running = F.coalesce("_open", F.lit(0)) > 0
    rows = rows.withColumns({"running": running, "due": ~running & (F.col("next_run") <= now)})
    order = W.partitionBy(F.col("due")).orderBy("next_run", "job")  # one row per registered job
    free = F.lit(workers) - F.sum(F.col("running").cast("int")).over(W.partitionBy(F.lit(0)))
    return rows.withColumn("starts", F.col("due") & (F.row_number().over(order) <= free)).select("job", "last_start", "next_run", "running", "due", "starts")


def poll_cycle(sources: DataFrame, state: DataFrame, items: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """One cycle over all sources: due, items polled, of them new, and the time stamp that due sources get.

    sources: source, interval_hours; state: source, last_attempt, last_polled; items: source, url; known: url."""
    due = sources_due(sources, state, now)
    fresh = items.join(known.select("url").distinct(), "url", "left_anti").groupBy("source").agg(F.count_distinct("url").alias("_new"))
    polled = items.groupBy("source").agg(F.count_distinct("url").alias("_all"))
    rows = due.join(polled, "source", "left").join(fresh, "source", "left").join(state.select("source", "last_attempt"), "source", "left")
    count = lambda c: F.when(F.col("due"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return rows.select("source", "due", count("_all").alias("polled"), count("_new").alias("fresh"), F.when(F.col("due"), now).otherwise(F.col("last_attempt")).alias("last_attempt"))


def collector_cycle(queue: DataFrame, index: DataFrame) -> DataFrame:
    """What the hourly loop does beside polling: pending names that a catalog knows by now, counted by category."""
    from .resolve import rematch

    before = queue.select("id", F.col("status").alias("_was"))
    rows = rematch(queue, index).join(before, "id")
    return rows.groupBy("category").agg(F.count_if(F.col("_was") == "pending").alias("pending"), F.count_if((F.col("_was") == "pending") & (F.col("status") == "auto_matched")).alias("matched"))


def pipeline_values(rows: DataFrame) -> DataFrame:
    """Defaults and bounds of a document's row: the title falls back to the landing, then the key; counts aren't negative."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), "landing_url", "document_key")
    return rows.withColumns({"title": title, "indicator_count": F.greatest(F.lit(0), F.coalesce("indicator_count", F.lit(0))), "vulnerability_count": F.greatest(F.lit(0), F.coalesce("vulnerability_count", F.lit(0)))})


def pending_failures(items: DataFrame) -> DataFrame:
    """Rows of invalid documents, with placeholders where they have no urls."""
    landing, url = F.coalesce("landing_url", F.lit("invalid:landing")), F.coalesce("document_url", F.lit("invalid:document"))
    return items.select(ids.document_key(landing, url).alias("document_key"), landing.alias("landing_url"), url.alias("document_url"), F.coalesce("title", landing).alias("title"), T.sanitize_error(F.col("error")).alias("error"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose content differs between two snapshots (path, digest): evidence that a dry run wrote nothing."""
    rows = before.select("path", F.col("digest").alias("old")).join(after.select("path", F.col("digest").alias("new")), "path", "full")
    return rows.where("not (old <=> new)")


def snapshot(files: DataFrame) -> DataFrame:
    """(path, size, digest) of files read as binaries."""
    return files.select("path", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("digest"))
