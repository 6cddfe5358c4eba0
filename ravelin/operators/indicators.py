"""Indicators: scoring, first-accepted deduplication, upserts, alerts, export, feed funnel and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identifiers, ids, times
from ..functions import text as T
from ..session import stored
from ..sources.feeds import FEEDS, WEIGHTS

ALERT_THRESHOLD = 55
TTL_SECONDS = 86_400


def weight(feed: Column, weights: dict[str, int] | None = None) -> Column:
    """How much the word of a feed counts; 10 for one that isn't known."""
    out = F.lit(10)
    for name, points in (weights or WEIGHTS).items():
        out = F.when(feed == name, points).otherwise(out)
    return out


def confidence(feed: Column, seen: Column, now: Column, feeds: Column | int = 1, weights: dict[str, int] | None = None) -> Column:
    """0 to 100: 25 for each reporting feed, up to 10 for being recent, and the weight of the feed."""
    many = F.lit(feeds) if isinstance(feeds, int) else feeds
    recent = F.greatest(F.lit(0), F.lit(10) - times.days_old(seen, now))
    return F.least(F.lit(100), many * 25 + recent + weight(feed, weights)).cast("int")


def corroborated(rows: DataFrame, pattern: str = "pattern", feed: str = "feed") -> DataFrame:
    """rows with `feeds`, the number of different feeds that report the pattern; pre-aggregated, so a common pattern costs no large task."""
    counts = rows.select(pattern, feed).distinct().groupBy(pattern).agg(F.count("*").cast("int").alias("feeds"))
    return rows.join(counts, pattern)


#: Keys with more rows than this are not folded in one aggregate.
FOLDED_ROWS = 20_000


def accept_first(rows: DataFrame, key: list[str], at: str, tie: str, seconds: int = TTL_SECONDS, inserted: str | None = None, most: int = FOLDED_ROWS) -> DataFrame:
    """Rows that are the first of their key for so long: each accepted row opens a time in which others are duplicates.

    Duplicates don't prolong it, and rows that were not inserted don't open it. tie names a row. The times of a key
    with at most `most` rows are folded in order inside one aggregate, to which only time and tie travel. For keys with
    more rows each row's successor, the first one that long after it, is found by a merge over ranges of time, and the
    rows that follow from the first of a key are marked by doubling: as many rounds as the logarithm of the longest
    chain, and no task holds the rows of a key."""
    own = rows.select(*key, F.col(at).alias("_at"), F.col(tie).alias("_tie"), (F.col(inserted) if inserted else F.lit(True)).alias("_ok")).where(F.col(at).isNotNull())
    sizes = own.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n")
    if not sizes.limit(1).count():
        kept = _folded(own, key, seconds)
    else:
        hot = stored(sizes, "hot")
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"h.{k}")) for k in key]
        few = own.alias("o").join(hot.alias("h"), same, "left_anti")
        many = own.alias("o").join(hot.alias("h"), same, "left_semi")
        kept = _folded(few, key, seconds).unionByName(_by_doubling(many, key, seconds))
    return rows.join(kept.withColumnRenamed("_tie", tie), tie, "left_semi")


def _folded(rows: DataFrame, key: list[str], seconds: int) -> DataFrame:
    lists = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_at", "_tie", "_ok"))).alias("_rows"))
    kind = f"struct<last: timestamp, out: array<{rows.schema['_tie'].dataType.simpleString()}>>"
    start = F.struct(F.lit(None).cast("timestamp").alias("last"), F.array().alias("out")).cast(kind)

    def step(acc: Column, row: Column) -> Column:
        fresh = acc["last"].isNull() | (F.unix_micros(row["_at"]) - F.unix_micros(acc["last"]) >= seconds * 1_000_000)
        return F.struct(F.when(fresh & row["_ok"], row["_at"]).otherwise(acc["last"]).alias("last"), F.when(fresh, F.concat(acc["out"], F.array(row["_tie"]))).otherwise(acc["out"]).alias("out")).cast(kind)

    return lists.select(F.explode(F.aggregate("_rows", start, step, lambda acc: acc["out"])).alias("_tie"))


def _successors(rows: DataFrame, key: list[str], span: int) -> DataFrame:
    """(_tie, _next): for each row (key, _t, _tie) the first of its key at _t + span or later, if there is one.

    Rows and the times they wait for are sorted together over ranges of key and time, so a hot key lies in many ranges.
    What a range doesn't hold is the first row of the key in a later one: a table with a row for each range."""
    names = {k: f"_h{i}" for i, k in enumerate(key)}
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    waits = rows.select(*key, (F.col("_t") + span).alias("_t"), F.lit(0).alias("_kind"), "_tie")
    both = waits.unionByName(rows.select(*key, "_t", F.lit(1).alias("_kind"), "_tie"))
    placed = stored(both.repartitionByRange(*key, "_t", "_kind", "_tie").withColumn("_part", F.spark_partition_id()), "merged")
    row = F.struct("_t", "_tie")
    back = W.partitionBy("_part", *key).orderBy(F.desc("_t"), F.desc("_kind"), F.desc("_tie")).rowsBetween(W.unboundedPreceding, 0)
    inside = placed.withColumn("_here", F.last(F.when(F.col("_kind") == 1, row), ignorenulls=True).over(back)).where("_kind = 0")
    first = placed.where("_kind = 1").groupBy("_part", *key).agg(F.min(row).alias("_first")).withColumnRenamed("_part", "_of")
    heads = placed.groupBy("_part").agg(F.min(F.struct(*key)).alias("_head")).select("_part", *[F.col(f"_head.{k}").alias(n) for k, n in names.items()])
    later = heads.join(first, [*same, F.col("_part") == F.col("_of")], "left").select("_part", *names.values(), "_first")
    later = later.withColumns({
        "_later": F.last("_first", ignorenulls=True).over(W.partitionBy(*names.values()).orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, 0)),
        "_after": F.lag("_part").over(W.orderBy("_part")),
    })
    later = later.select("_after", *names.values(), "_later")  # a row for each range
    found = inside.join(F.broadcast(later), [*same, F.col("_part") == F.col("_after")], "left")
    return found.select("_tie", F.coalesce("_here", "_later")["_tie"].alias("_next")).where("_next is not null")


def _by_doubling(rows: DataFrame, key: list[str], seconds: int) -> DataFrame:
    span = seconds * 1_000_000
    rows = stored(rows.withColumn("_t", F.unix_micros("_at")).drop("_at"), "rows")
    opening = rows.where("_ok").select(*key, "_t", "_tie")
    jump = stored(_successors(opening, key, span).select(F.col("_tie").alias("_a"), F.col("_next").alias("_b")), "jump")
    marked = stored(opening.groupBy(*key).agg(F.min(F.struct("_t", "_tie")).alias("_f")).select("_f._tie"), "marked")
    n = -1
    while n != (n := marked.count()):  # the first 1, 2, 4, 8 ... of each chain
        marked = stored(marked.unionByName(marked.join(jump, F.col("_tie") == F.col("_a")).select(F.col("_b").alias("_tie"))), "marked")
        jump = stored(jump.join(jump.select(F.col("_a").alias("_m"), F.col("_b").alias("_c")), F.col("_b") == F.col("_m")).select("_a", F.col("_c").alias("_b")), "jump")
    bucket = F.floor(F.col("_t") / span)
    names = {k: f"_k{i}" for i, k in enumerate(key)}
    opened = opening.join(marked, "_tie", "left_semi").withColumnsRenamed(names)
    opened = opened.select(*names.values(), F.col("_t").alias("_opened"), F.col("_tie").alias("_by"), F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    before = (F.col("_opened") < F.col("_t")) | (F.col("_opened") == F.col("_t")) & (F.col("_by") < F.col("_tie"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    free = rows.where(~F.col("_ok")).join(opened, [*same, bucket == F.col("_b"), before, F.col("_t") - F.col("_opened") < span], "left_anti")
    return marked.unionByName(free.select("_tie"))


def documents(rows: DataFrame, now: Column) -> DataFrame:
    """Indexed documents of candidates: value, score, type, id and where the id comes from. Rows without a pattern are left out."""
    rows = rows.where(F.coalesce("pattern", F.lit("")) != "")
    stix, origin = ids.indicator_id(F.col("pattern"))
    seen = times.feed_time(F.col("valid_from"), now)
    return rows.select(
        now.alias("ts"), now.alias("ingested_at"), T.value_of_pattern(F.col("pattern")).alias("value"), confidence(F.col("source_name"), seen, now).alias("confidence"),
        F.col("source_name").alias("feed"), F.col("observable_type").alias("type"), "pattern", stix.alias("stix_id"), origin.alias("stix_id_source"), seen.alias("valid_from"), "labels",
    )


def upsert(rows: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The last row of each key. Time and ties order an aggregate with partial sums, so a hot key isn't sorted in one task."""
    others = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(at, *ties))
    return rows.groupBy(key).agg(last.alias("_r")).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in others])


def alerts(rows: DataFrame, threshold: int = ALERT_THRESHOLD, newest: int = 100, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The newest documents whose score reaches the threshold."""
    return rows.where(F.col("confidence") >= threshold).orderBy(*[F.desc(c) for c in order]).limit(newest)


def recent(rows: DataFrame, limit: int = 200, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The newest documents as shown, at most 500; rows without time or value go after the limit is taken."""
    top = rows.orderBy(*[F.desc(c) for c in order]).limit(max(1, min(limit, 500))).where("ts is not null and value is not null")
    return top.select(
        "ts", F.coalesce("ingested_at", "ts").alias("ingested_at"), "value", F.coalesce("confidence", F.lit(0)).alias("confidence"), F.coalesce("feed", F.lit("unknown")).alias("feed"),
        identifiers.type_label(F.col("pattern")).alias("type"), "stix_id", F.coalesce("platform_standard_id", "stix_id").alias("standard_id"),
    )


def bundle(rows: DataFrame, newest: int = 1000, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """One row: a STIX 2.1 bundle of the newest documents. valid_from is when they came in; malformed rows go after the limit."""
    top = rows.orderBy(*[F.desc(c) for c in order]).limit(newest).where("stix_id is not null and pattern is not null and ts is not null")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.col("stix_id").alias("id"), stamp.alias("created"), stamp.alias("modified"), F.col("value").alias("name"),
        F.col("pattern"), F.lit("stix").alias("pattern_type"), stamp.alias("valid_from"), F.col("confidence"), F.array("feed").alias("labels"),
    )
    objects = top.agg(F.sort_array(F.collect_list(item)).alias("objects"))
    return objects.select(F.to_json(F.struct(F.lit("bundle").alias("type"), F.concat(F.lit("bundle--"), ids.uuid5(F.to_json("objects"))).alias("id"), "objects")).alias("bundle"), F.size("objects").alias("n"))


def funnel(rows: DataFrame, feed: str = "feed") -> DataFrame:
    """fetched, normalized and inserted rows of each feed; rows carry booleans normalized and inserted."""
    return rows.groupBy(feed).agg(F.count("*").alias("fetched"), F.count_if("normalized").alias("normalized"), F.count_if(F.col("normalized") & F.col("inserted")).alias("inserted"))


def latest_status(events: DataFrame) -> DataFrame:
    """The last status event of each feed; counts start at 0 when a run starts, errors are cut to 500 characters."""
    last = upsert(events, "feed", "at", "seq")
    zero = F.col("status") == "running"
    count = lambda c: F.when(zero, 0).otherwise(F.coalesce(c, F.lit(0))).alias(c)
    return last.select("feed", "status", F.col("at").alias("last_run"), *[count(c) for c in ("fetched_count", "normalized_count", "ioc_count")], F.substring(F.coalesce("error_msg", F.lit("")), 1, 500).alias("error_msg"))


def all_statuses(status: DataFrame) -> DataFrame:
    """A row for every registered feed: never_run where it has no status."""
    feeds = status.sparkSession.createDataFrame([(f.name, k) for k, f in enumerate(FEEDS)], "feed string, rank int")
    rows = feeds.join(status, "feed", "left")
    return rows.select("feed", F.coalesce("status", F.lit("never_run")).alias("status"), "last_run", F.coalesce("ioc_count", F.lit(0)).alias("ioc_count"), F.coalesce("error_msg", F.lit("")).alias("error_msg"), "rank")


def intelligence(rows: DataFrame, scores: tuple[int, int, int] = (90, 60, 20)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Indicators, observables and based-on edges of address intelligence.

    rows: ip, classification, actor, first_seen, last_seen, trust_level, provider. Without a first time the last
    one counts as first, and the last is 23 hours later. Rows without address or class are left out."""
    rows = rows.where("ip is not null and classification is not null")
    kind, trust = F.col("classification"), F.col("trust_level").cast("string")
    labels = F.array_compact(
        F.array(
            F.when(kind.isin("benign", "unknown", "malicious", "suspicious"), F.concat(F.lit("gn-classification: "), kind)),
            F.when(kind == "benign", F.concat(F.lit("gn-benign-actor: "), F.col("actor"), F.lit(" "))),
            F.when(trust == "1", F.lit("gn-trust-level: reasonably ignore")).when(trust == "2", F.lit("gn-trust-level: commonly seen")),
            F.when(trust.isin("1", "2"), F.concat(F.lit("gn-provider: "), F.col("provider"), F.lit(" "))),
        )
    )
    score = F.when(kind == "malicious", scores[0]).when(kind == "suspicious", scores[1]).otherwise(scores[2])
    first = F.coalesce("first_seen", "last_seen")
    until = F.when(F.col("first_seen").isNull(), F.col("last_seen") + F.expr("interval 23 hours")).otherwise(F.col("last_seen"))
    pattern = identifiers.pattern_of(F.lit("ip"), F.col("ip"))
    base = rows.select("ip", pattern.alias("pattern"), labels.alias("labels"), score.alias("score"), first.alias("valid_from"), until.alias("valid_until"))
    indicators = base.withColumn("id", ids.indicator_id(F.col("pattern"))[0])
    observables = base.select(F.concat(F.lit("ipv4-addr--"), ids.uuid5(F.col("ip"))).alias("id"), F.col("ip").alias("value"), "labels", "score")
    edges = indicators.select(F.col("id").alias("from_id"), F.concat(F.lit("ipv4-addr--"), ids.uuid5(F.col("ip"))).alias("to_id"), F.lit("based-on").alias("relationship_type"))
    return indicators, observables, edges


def batches(objects: DataFrame, size: int = 50_000) -> DataFrame:
    """objects (kind, id) with batch numbers, entities before relationships. Ranks come from counts per range, not from one sorted task."""
    ranked = objects.withColumns({"_later": (F.col("kind") == "relationship").cast("int")})
    # stored with the numbers of the ranges, which a plan that is run twice could give anew
    parts = stored(ranked.repartitionByRange("_later", "id").withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))  # one row per partition
    own = F.row_number().over(W.partitionBy("_part").orderBy("_later", "id"))
    numbered = parts.join(F.broadcast(before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")
    return numbered.withColumn("batch", F.floor((own - 1 + F.col("_before")) / size).cast("int")).drop("_part", "_before", "_later")


def sightings_per_window(rows: DataFrame, length: str = "1 hour", slide: str | None = None, at: str = "ts", by: str = "feed") -> DataFrame:
    """Extension: rows per tumbling or sliding window."""
    return rows.groupBy(by, F.window(at, length, slide or length).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def sessions(rows: DataFrame, gap: str = "30 minutes", at: str = "ts", by: str = "feed") -> DataFrame:
    """Extension: rows per session, which a gap ends."""
    return rows.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
