"""Indicator queries over events: each event is a sighting, its type the feed, its user and property the pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers, ids
from ..functions import text as T
from ..operators import indicators as I
from ..operators import views
from .registry import AS_OF, now, query, table

WEIGHTS = {"click": 30, "view": 25, "purchase": 20, "signup": 15}
_WEIGHT = "CASE event_type WHEN 'click' THEN 30 WHEN 'view' THEN 25 WHEN 'purchase' THEN 20 WHEN 'signup' THEN 15 ELSE 10 END"
_AGE = f"greatest(0, floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 86400))"
_SCORE = f"CAST(least(100, 25 + greatest(0, 10 - {_AGE}) + {_WEIGHT}) AS BIGINT)"
_K = "json_extract_string(props, '$.k')"
_URL = f"'http://u' || user_id || '.example.com/it''s?k=' || {_K}"
_PATTERN = f"'[url:value = ''' || replace({_URL}, '''', '\\''') || ''']'"


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    value = F.concat(F.lit("http://u"), F.col("user_id").cast("string"), F.lit(".example.com/it's?k="), F.get_json_object("props", "$.k"))
    return ev.select("event_id", "ts", F.col("event_type").alias("feed"), "user_id", value.alias("value"), identifiers.pattern_of(F.lit("url"), F.replace(value, F.lit("'"), F.lit(""))).alias("safe_pattern"), F.concat(F.lit("[url:value = '"), T.escape(value), F.lit("']")).alias("pattern"), F.col("value").alias("reading"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).withColumn("confidence", I.confidence(F.col("feed"), F.col("ts"), now(), weights=WEIGHTS).cast("bigint"))


@query(f"SELECT event_id, {_SCORE} AS confidence, CASE WHEN {_SCORE} >= 65 THEN 'HIGH' WHEN {_SCORE} >= 55 THEN 'MED' ELSE 'LOW' END AS severity, CASE WHEN {_SCORE} >= 75 THEN 'ok' WHEN {_SCORE} >= 55 THEN 'stale' ELSE 'never_run' END AS class FROM events")
def ioc_scores(spark, sf_dir):
    c = F.col("confidence")
    return scored(spark, sf_dir).select("event_id", "confidence", views.severity(c).alias("severity"), views.confidence_class(c).alias("class"))


@query(f"SELECT event_id, event_type AS feed, {_SCORE} AS confidence FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def ioc_score_newest(spark, sf_dir):
    return scored(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "feed", "confidence")


@query(f"SELECT event_id, {_SCORE} AS confidence FROM events WHERE {_SCORE} >= 55 ORDER BY ts DESC, event_id DESC LIMIT 100")
def ioc_alerts_top100(spark, sf_dir):
    return I.alerts(scored(spark, sf_dir), order=("ts", "event_id")).select("event_id", "confidence")


@query("""
WITH RECURSIVE r AS (SELECT event_id, event_type, user_id, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_id, event_type, user_id, ts AS last, true AS kept, n FROM r WHERE n = 1
UNION ALL SELECT r.event_id, r.event_type, r.user_id, CASE WHEN r.ts - f.last >= INTERVAL 24 HOUR THEN r.ts ELSE f.last END, r.ts - f.last >= INTERVAL 24 HOUR, r.n FROM f JOIN r ON r.event_type = f.event_type AND r.user_id = f.user_id AND r.n = f.n + 1)
SELECT event_id, event_type AS feed, user_id FROM f WHERE kept""")
def ioc_dedup_24h(spark, sf_dir):
    return I.accept_first(sightings(spark, sf_dir), ["feed", "user_id"], "ts", "event_id").select("event_id", "feed", "user_id")


@query(f"""
SELECT * FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'unknown' ELSE event_type END AS feed, CASE WHEN event_type = 'view' THEN 0 ELSE {_SCORE} END AS confidence, 'URL' AS type, {_URL} AS value, user_id
FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) WHERE user_id % 7 <> 0""")
def ioc_recent_fallbacks(spark, sf_dir):
    rows = scored(spark, sf_dir)
    rows = rows.withColumns({
        "value": F.when(F.col("user_id") % 7 != 0, F.col("value")), "ingested_at": F.lit(None).cast("timestamp"), "feed": F.when(F.col("feed") != "click", F.col("feed")),
        "confidence": F.when(F.col("feed") != "view", F.col("confidence")), "stix_id": F.col("event_id").cast("string"), "platform_standard_id": F.lit(None).cast("string"),
    })
    shown = I.recent(rows, 500, order=("ts", "event_id"))
    return shown.select(F.col("stix_id").cast("bigint").alias("event_id"), "feed", F.col("confidence").cast("bigint").alias("confidence"), "type", "value", F.regexp_extract("value", r"u(\d+)\.", 1).cast("bigint").alias("user_id"))


@query("SELECT event_type AS feed, count(*) AS fetched, count(*) FILTER (WHERE user_id % 5 <> 0) AS normalized, count(*) FILTER (WHERE user_id % 5 <> 0 AND value > 0) AS inserted FROM events GROUP BY 1")
def feed_funnel(spark, sf_dir):
    return I.funnel(sightings(spark, sf_dir).withColumns({"normalized": F.col("user_id") % 5 != 0, "inserted": F.col("reading") > 0}))


@query("""
SELECT feed, status, CASE WHEN status = 'running' THEN 0 ELSE n END AS ioc_count, epoch_us(tm) AS last_run FROM
(SELECT user_id AS feed, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'ok' ELSE 'error' END AS status, event_id % 97 AS n, ts AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def feed_status_latest(spark, sf_dir):
    ev = sightings(spark, sf_dir)
    status = F.when(F.col("feed") == "click", "running").when(F.col("feed") == "view", "ok").otherwise("error")
    log = ev.select(F.col("user_id").alias("feed"), status.alias("status"), (F.col("event_id") % 97).alias("ioc_count"), F.lit(0).alias("fetched_count"), F.lit(0).alias("normalized_count"), F.lit("").alias("error_msg"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return I.latest_status(log).select("feed", "status", F.col("ioc_count").cast("bigint").alias("ioc_count"), F.unix_micros("last_run").alias("last_run"))


@query(f"SELECT pattern, event_id, feed FROM (SELECT {_PATTERN} AS pattern, event_id, event_type AS feed, row_number() OVER (PARTITION BY {_PATTERN} ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def ioc_upsert_latest(spark, sf_dir):
    return I.upsert(sightings(spark, sf_dir).select("pattern", "event_id", "feed", "ts"), "pattern", "ts", "event_id").select("pattern", "event_id", "feed")


@query(f"""
WITH n AS (SELECT user_id, count(DISTINCT event_type) AS feeds FROM events GROUP BY 1)
SELECT event_id, feeds, CAST(least(100, feeds * 25 + greatest(0, 10 - {_AGE}) + {_WEIGHT}) AS BIGINT) AS confidence FROM events JOIN n USING (user_id)""")
def corroborated_score(spark, sf_dir):
    rows = I.corroborated(sightings(spark, sf_dir), "user_id", "feed")
    score = I.confidence(F.col("feed"), F.col("ts"), now(), F.col("feeds"), WEIGHTS)
    return rows.select("event_id", F.col("feeds").cast("bigint").alias("feeds"), score.cast("bigint").alias("confidence"))


@query(f"SELECT DISTINCT {_PATTERN} AS pattern, {_URL} AS value, 'URL' AS type FROM events")
def pattern_roundtrip(spark, sf_dir):
    p = F.col("pattern")
    return sightings(spark, sf_dir).select("pattern", T.value_of_pattern(p).alias("value"), identifiers.type_label(p).alias("type")).distinct()


@query("""
WITH p AS (SELECT DISTINCT '[ipv4-addr:value = ''10.0.' || (user_id % 256) || '.' || (event_id % 256) || ''']' AS pattern FROM events),
h AS (SELECT pattern, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(pattern)) AS h, sha256(pattern) AS key FROM p)
SELECT pattern, 'indicator--' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1))::INT % 4 AS INT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS stix_id, key FROM h""")
def stix_ids(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"))
    rows = ev.select(identifiers.pattern_of(F.lit("ip"), ip).alias("pattern")).distinct()
    return rows.select("pattern", ids.indicator_id(F.col("pattern"))[0].alias("stix_id"), ids.pattern_key(F.col("pattern")).alias("key"))


@query(f"""
SELECT user_id, CASE WHEN max(ts) IS NULL THEN 'never_run' WHEN (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts)))) / 3600 > 48 THEN 'stale' ELSE 'ok' END AS connector,
CASE WHEN (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts)))) / 3600 > 48 THEN 'never_run' WHEN (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts)))) / 3600 > 36 THEN 'stale' ELSE 'ok' END AS collector,
CASE WHEN (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts)))) / 3600 > 1 THEN 'stale' ELSE 'ok' END AS feed FROM events GROUP BY 1""")
def staleness_classes(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    at = F.col("last")
    return last.select("user_id", views.connector_class(F.lit(True), at, now()).alias("connector"), views.collector_class(at, F.lit(24), now()).alias("collector"), views.feed_class(F.lit("running"), at, now()).alias("feed"))


@query(f"""
WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), s AS (SELECT *, epoch(TIMESTAMP '{AS_OF}') - floor(epoch(last)) AS age FROM l)
SELECT user_id, age < 0 OR age >= 43200 AS run_due, age >= (1 + user_id % 48) * 3600 AS source_due FROM s""")
def schedule_due(spark, sf_dir):
    from ..functions import times

    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", times.run_is_due(F.col("last"), now(), 86_400).alias("run_due"), times.source_is_due(F.lit(None).cast("timestamp"), F.col("last"), now(), 1 + F.col("user_id") % 48).alias("source_due"))


@query(f"""
SELECT user_id, first_seen, CASE WHEN event_type = 'click' THEN last + 82800000000 ELSE last END AS valid_until, CASE event_type WHEN 'click' THEN 90 WHEN 'view' THEN 60 ELSE 20 END::BIGINT AS score, labels FROM
(SELECT user_id, event_type, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS last, CASE WHEN event_type = 'click' THEN max(epoch_us(ts)) ELSE min(epoch_us(ts)) END AS first_seen,
CASE event_type WHEN 'click' THEN 'gn-classification: malicious' WHEN 'view' THEN 'gn-classification: suspicious' ELSE 'gn-classification: benign|gn-benign-actor: a' || user_id || ' ' END ||
CASE WHEN user_id % 3 = 1 THEN '|gn-trust-level: reasonably ignore|gn-provider: p' || user_id || ' ' WHEN user_id % 3 = 2 THEN '|gn-trust-level: commonly seen|gn-provider: p' || user_id || ' ' ELSE '' END AS labels FROM events GROUP BY 1, 2)""")
def intelligence_rows(spark, sf_dir):
    ev = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("lo"), F.max("ts").alias("last_seen"))
    kind = F.when(F.col("event_type") == "click", "malicious").when(F.col("event_type") == "view", "suspicious").otherwise("benign")
    name = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"))
    rows = ev.select(F.format_string("10.%d.%d.1", (F.col("user_id") / 256).cast("int"), (F.col("user_id") % 256).cast("int")).alias("ip"), kind.alias("classification"), name("a").alias("actor"), F.when(F.col("event_type") != "click", F.col("lo")).alias("first_seen"), "last_seen", (F.col("user_id") % 3).cast("string").alias("trust_level"), name("p").alias("provider"))
    out, _, _ = I.intelligence(rows)
    parts = F.split("ip", r"\.")
    return out.select((parts[1].cast("bigint") * 256 + parts[2].cast("bigint")).alias("user_id"), F.unix_micros("valid_from").alias("first_seen"), F.unix_micros("valid_until").alias("valid_until"), F.col("score").cast("bigint").alias("score"), F.array_join("labels", "|").alias("labels"))


@query("SELECT event_type AS feed, epoch_us(date_trunc('hour', ts)) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def sightings_hourly(spark, sf_dir):
    return I.sightings_per_window(sightings(spark, sf_dir)).select("feed", F.unix_micros("window_start").alias("window_start"), "n")


@query("""
SELECT event_type AS feed, epoch_us(date_trunc('hour', ts)) - k * 3600000000 AS window_start, count(*) AS n FROM events, range(0, 24) AS r(k) GROUP BY 1, 2""")
def sightings_sliding_day(spark, sf_dir):
    return I.sightings_per_window(sightings(spark, sf_dir), "24 hours", "1 hour").select("feed", F.unix_micros("window_start").alias("window_start"), "n")


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM o)
SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM s GROUP BY user_id, g""")
def user_sessions(spark, sf_dir):
    return I.sessions(sightings(spark, sf_dir), "6 hours", by="user_id").select("user_id", F.unix_micros("session_start").alias("session_start"), "n")


@query("SELECT count(*)::BIGINT AS objects FROM (SELECT 1 FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)")
def stix_bundle_size(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("stix_id", ids.indicator_id(F.col("pattern"))[0])
    return I.bundle(rows, order=("ts", "event_id")).select(F.col("n").cast("bigint").alias("objects"))


@query()
def stix_bundle(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("stix_id", ids.indicator_id(F.col("pattern"))[0])
    return I.bundle(rows, order=("ts", "event_id"))


@query("""
WITH o AS (SELECT 'e' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS id, CASE WHEN event_id % 3 = 0 THEN 'relationship' ELSE 'entity' END AS kind FROM events)
SELECT batch, count(*) AS n, count(*) FILTER (WHERE kind = 'relationship') AS edges FROM (SELECT kind, CAST(floor((row_number() OVER (ORDER BY kind = 'relationship', id) - 1) / 3000) AS BIGINT) AS batch FROM o) GROUP BY 1""")
def bundle_batches(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    rows = ev.select(F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("id"), F.when(F.col("event_id") % 3 == 0, "relationship").otherwise("entity").alias("kind"))
    return I.batches(rows, 3000).groupBy(F.col("batch").cast("bigint").alias("batch")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "relationship").alias("edges"))
