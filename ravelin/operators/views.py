"""Derived columns for display and monitoring: severities, staleness, health, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def severity(score: Column) -> Column:
    return F.when(score >= 65, "HIGH").when(score >= 55, "MED").otherwise("LOW")


def confidence_class(score: Column) -> Column:
    return F.when(score >= 75, "ok").when(score >= 55, "stale").otherwise("never_run")


def hours_since(at: Column, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(at)) / 3600


def feed_class(status: Column, last: Column, now: Column) -> Column:
    """ok, error and never_run as they are; others are stale an hour after their last run."""
    return F.when(status.isin("ok", "error", "never_run"), status).when(hours_since(last, now) > 1, "stale").otherwise("ok")


def connector_class(active: Column, last: Column, now: Column) -> Column:
    """never_run without a run, error when inactive, stale after 48 hours."""
    return F.when(last.isNull(), "never_run").when(~active, "error").when(hours_since(last, now) > 48, "stale").otherwise("ok")


def collector_class(last: Column, least_hours: Column, now: Column) -> Column:
    """By how many of the shortest intervals the last cycle is ago: beyond 2 never_run, beyond 1.5 stale."""
    age = hours_since(last, now)
    return F.when(last.isNull() | (age > 2 * least_hours), "never_run").when(age > 1.5 * least_hours, "stale").otherwise("ok")


def fleet(rows: DataFrame, status: str = "status") -> DataFrame:
    """ok if all feeds are, stale if some are, never_run if none is."""
    ok = F.col(status) == "ok"
    return rows.agg(F.when(F.bool_and(ok), "ok").when(F.bool_or(ok), "stale").otherwise("never_run").alias("fleet"))


def collector_health(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("new_found"), F.lit(0)).alias("new_found"), F.min("interval_hours").alias("least_hours"))


def stats_view(stats: DataFrame) -> DataFrame:
    return stats.select(F.coalesce("total_docs", F.lit(0)).alias("total_docs"), F.coalesce("total_iocs", F.lit(0)).alias("total_iocs"), "last_run", F.when(F.col("last_run").isNotNull(), "ok").otherwise("never_run").alias("status"))


def vulnerability_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.max("updated_at").alias("last_update")).withColumn("status", F.when(F.col("total") > 0, "ok").otherwise("never_run"))


def inventory(expected: DataFrame, running: DataFrame) -> DataFrame:
    """One verdict per expected service: missing, oom, restarting, unhealthy or ok."""
    rows = expected.join(running, "service", "left")
    verdict = F.when(F.col("state").isNull(), "missing").when(F.coalesce("oom_killed", F.lit(False)), "oom").when((F.col("state") == "restarting") | (F.coalesce("restarts", F.lit(0)) > 0), "restarting")
    return rows.select("service", verdict.when((F.col("state") != "running") | (F.coalesce("health", F.lit("healthy")) != "healthy"), "unhealthy").otherwise("ok").alias("verdict"))


def contract_violations(statuses: DataFrame, feeds: list[str], allowed: tuple[str, ...] = ("ok", "error", "running", "never_run", "disabled")) -> DataFrame:
    """Rows that break the status contract: unknown or repeated feeds, statuses outside the list, negative counts."""
    n = statuses.groupBy("feed").agg(F.count("*").alias("_n"))
    reason = F.when(~F.col("feed").isin(feeds), "unknown feed").when(F.col("_n") > 1, "repeated feed").when(~F.col("status").isin(*allowed), "status").when(F.col("ioc_count") < 0, "negative count")
    return statuses.join(n, "feed").withColumn("reason", reason).where("reason is not null").drop("_n")
