"""Strict ingestion of documents: provenance, manifests, diagnostics, and small readers of platform payloads.

Checks are rows: each function gives the reason why a row fails, null for a row that is good, so any number of
documents is judged at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers, ids, network, times
from ..functions import text as T

#: Where a title and a date may come from, and the stages that may reject a candidate.
TITLE_SOURCES = ("collection_anchor+landing_confirmed", "landing_main_h1", "landing_main_h2")
DATE_SOURCES = ("collection_card_time+landing_confirmed", "collection_card_text+landing_confirmed", "landing_main_time", "landing_main_text")
STAGES = ("response_parser", "grounding", "dedup", "bulletin_policy", "shape_validation")


@dataclass(frozen=True)
class Site:
    """An official publisher: hosts, and patterns of landing paths, document paths and titles with (number, year) as groups."""

    landing_host: str
    document_host: str
    landing_path: str
    document_path: str
    title: str


def official_url(url: Column, site: Site) -> Column:
    """The canonical form of a landing or document url of a site, else null: https, no user or port, no query on a landing."""
    part = lambda p: network.url_part(url, p)
    host = F.regexp_replace(part("host"), r"\.$", "")
    clean = (part("scheme") == "https") & ~part("authority").rlike(r"@|:\d")
    landing = (host == site.landing_host) & part("path").rlike(site.landing_path) & (part("query") == "")
    document = (host == site.document_host) & part("path").rlike(site.document_path)
    return F.when(clean & (landing | document), F.concat(F.lit("https://"), host, part("path")))


def coordinates(landing: Column, document: Column, title: Column, site: Site) -> Column:
    """(number, year) on which the paths and the title agree, else null."""
    pairs = [(network.url_part(landing, "path"), site.landing_path), (network.url_part(document, "path"), site.document_path), (T.fold_space(title), site.title)]
    found = [F.struct(F.regexp_extract(value, shape, 1).alias("number"), F.regexp_extract(value, shape, 2).alias("year")) for value, shape in pairs]
    return F.when((found[0] == found[1]) & (found[1] == found[2]) & (found[0]["number"] != ""), found[0])


def provenance_reason(title: Column, title_source: Column, date: Column, date_source: Column, landing: Column, document: Column) -> Column:
    blank = lambda c: F.coalesce(T.fold_space(c), F.lit("")) == ""
    return (
        F.when(blank(title), "title").when(~F.coalesce(title_source.isin(*TITLE_SOURCES), F.lit(False)), "title_source").when(~F.coalesce(date_source.isin(*DATE_SOURCES), F.lit(False)), "publication_date_source")
        .when(~F.coalesce(date.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)), "publication_date").when(blank(landing) | blank(document), "url")
    )


def is_complete(status: Column, chunk_count: Column, chunks: Column) -> Column:
    """Whether an extraction ended well: as many chunks as counted, at least one, all complete."""
    return F.coalesce((status == "complete") & (F.size(chunks) > 0) & (chunk_count == F.size(chunks)) & F.forall(chunks, lambda c: c["status"] == "complete"), F.lit(False))


def chunk_reason(chunks: Column) -> Column:
    """What is wrong with chunk diagnostics (chunk_index, status, attempts, retry_count, error), in the order of the checks."""
    some = lambda test: F.exists(F.transform(chunks, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), test)
    error = lambda x: F.coalesce(x["c"]["error"], F.lit(""))
    return (
        F.when(F.size(chunks) < 1, "missing").when(some(lambda x: ~x["c"]["chunk_index"].eqNullSafe(x["i"])), "order").when(some(lambda x: ~F.coalesce(x["c"]["status"].isin("complete", "error"), F.lit(False))), "status")
        .when(some(lambda x: F.coalesce((x["c"]["attempts"] < 1) | (x["c"]["retry_count"] != x["c"]["attempts"] - 1), F.lit(True))), "retries")
        .when(some(lambda x: (x["c"]["status"] == "complete") & x["c"]["error"].isNotNull()), "error_on_complete").when(some(lambda x: (x["c"]["status"] == "error") & (error(x) == "")), "error_missing")
    )


def retries(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0), lambda n, c: n + c["retry_count"])


def candidate_reason(accepted: Column, rejected: Column) -> Column:
    """What is wrong with accepted (type, value) and rejected (type, value, reason, stage) candidates."""
    leaked = F.exists(accepted, lambda c: F.upper(c["value"]).startswith("CVE-"))
    shape = F.exists(accepted, lambda c: ~identifiers.has_shape(c["type"], c["value"]))
    unstable = F.exists(rejected, lambda c: (F.coalesce(c["reason"], F.lit("")) == "") | ~F.coalesce(c["stage"].isin(*STAGES), F.lit(False)))
    return F.when(leaked, "vulnerability_as_indicator").when(shape, "indicator_shape").when(unstable, "rejection_diagnostics")


def previews(documents: DataFrame) -> DataFrame:
    """documents with reason, the first check of provenance, body, chunks and candidates that fails, and retry_count."""
    head = F.coalesce(F.substring(F.regexp_replace(F.decode(F.substring("content", 1, 64), "ISO-8859-1"), r"^\s+", ""), 1, 5), F.lit(""))
    own = provenance_reason(*[F.col(c) for c in ("title", "title_source", "publication_date", "publication_date_source", "landing_url", "document_url")])
    reason = F.coalesce(own, F.when(head != "%PDF-", "body"), chunk_reason(F.col("chunks")), candidate_reason(F.col("accepted"), F.col("rejected")))
    return documents.withColumns({"reason": reason, "retry_count": retries(F.col("chunks"))})


def manifest(documents: DataFrame, site: Site) -> DataFrame:
    """The graph objects of each document, or the reason why it has none.

    documents: the columns of previews plus status, chunk_count, vulnerabilities. Urls are made canonical; number
    and year agree everywhere, and the date with the year; vulnerability ids are well-formed and don't repeat."""
    landing, document = official_url(F.col("landing_url"), site), official_url(F.col("document_url"), site)
    rows = documents.withColumns({"_l": landing, "_d": document})
    place = coordinates(F.col("_l"), F.col("_d"), F.col("title"), site)
    rows = previews(rows).withColumn("_c", place)
    day = times.iso_day(F.col("publication_date"))
    bad_ids = F.exists("vulnerabilities", lambda v: ~F.coalesce(v.rlike(r"^CVE-[0-9]{4}-[0-9]{4,10}$"), F.lit(False))) | (F.size(F.array_distinct("vulnerabilities")) != F.size("vulnerabilities"))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_l").isNull() | F.col("_d").isNull(), "unofficial_url").when(F.col("_c").isNull(), "coordinates")
        .when(day.isNull() | (F.year(day).cast("string") != F.col("_c.year")), "date_year").when(~is_complete(F.col("status"), F.col("chunk_count"), F.col("chunks")), "incomplete").when(bad_ids, "vulnerabilities")
    )
    objects = F.concat(F.transform("vulnerabilities", lambda v: F.struct(F.lit("Vulnerability").alias("kind"), v.alias("name"))), F.transform(F.array_distinct("accepted"), lambda c: F.struct(F.lit("Indicator").alias("kind"), identifiers.pattern_of(c["type"], c["value"]).alias("name"))))
    return rows.select(
        ids.document_key(F.col("_l"), F.col("_d")).alias("document_key"), F.col("_c.number").alias("bulletin_number"), F.col("_l").alias("landing_url"), F.col("_d").alias("document_url"), T.fold_space(F.col("title")).alias("title"),
        "publication_date", ids.report_id(F.col("_l")).alias("report_standard_id"), F.size("vulnerabilities").alias("vulnerability_count"), F.size(F.array_distinct("accepted")).alias("indicator_count"), F.when(reason.isNull(), objects).alias("objects"), reason.alias("reason"),
    )


def same_manifest(expected: DataFrame, found: DataFrame, key: str = "position") -> DataFrame:
    """Positions at which two ordered manifests differ in any column, or that only one of them has."""
    columns = [c for c in expected.columns if c != key]
    one = expected.select(key, F.to_json(F.struct(*columns)).alias("_a"))
    two = found.select(key, F.to_json(F.struct(*columns)).alias("_b"))
    return one.join(two, key, "full").where("not (_a <=> _b)").select(key)


def report_text(summary: Column, source: Column, technologies: Column) -> Column:
    """A report's description: the summary or a standing phrase, and the systems targeted, sorted."""
    base = F.coalesce(F.nullif(summary, F.lit("")), F.concat(F.lit("Extracted from "), source))
    return F.concat(base, F.when(F.size(technologies) > 0, F.concat(F.lit("\n\nSystems targeted: "), F.array_join(F.array_sort(technologies), ", "))).otherwise(""))


def nodes(value: Column) -> Column:
    """Ids in a JSON payload that is a list, {edges: [{node}]} or null; a node's standard_id before its id, strings as they are."""
    edges = F.from_json(value, "edges array<struct<node struct<id string, standard_id string>>>")["edges"]
    listed = F.from_json(value, "array<string>")
    own = F.transform(listed, lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.standard_id"), F.get_json_object(x, "$.id"))).otherwise(x))
    found = F.when(value.startswith("["), own).otherwise(F.transform(edges, lambda e: F.coalesce(e["node"]["standard_id"], e["node"]["id"])))
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))


def last_object(raw: Column) -> Column:
    """The last line of mixed output that is a JSON object."""
    lines = F.filter(F.split(raw, r"\r?\n"), lambda x: F.ltrim(x).startswith("{") & F.try_parse_json(x).isNotNull())
    return F.when(F.size(lines) > 0, F.element_at(lines, -1))


def bounded_body(body: Column, most: int = 2048) -> Column:
    """A response body for diagnostics: its first bytes on one line, secrets redacted, marked where it was cut."""
    cut = F.decode(F.substring(body.cast("binary"), 1, most), "UTF-8")
    shown = F.regexp_replace(T.fold_space(cut), r"(?i)\b(token|password|authorization)\b(\s*[:=]\s*)(?:bearer\s+)?\S+", "$1$2[REDACTED]")
    return F.concat(shown, F.when(F.octet_length(body) > most, " [truncated]").otherwise(""))


def last_run_note(state: Column) -> Column:
    """A connector's last run in words: ISO time, or why there is none."""
    parsed = F.try_parse_json(state)
    run = F.get_json_object(F.when(parsed.isNotNull(), state), "$.last_run").try_cast("double").cast("bigint")
    return (
        F.when(F.coalesce(state, F.lit("")) == "", "no state").when(parsed.isNull(), F.concat(F.lit("unreadable state: "), F.substring(state, 1, 60))).when(~F.ltrim(state).startswith("{"), "no state")
        .when(F.coalesce(run, F.lit(0)) == 0, "state without last_run").otherwise(F.date_format(F.timestamp_seconds(run), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    )


def connectors(rows: DataFrame) -> DataFrame:
    """Connectors as listed: name, type, whether active, last run."""
    return rows.select("id", "name", "connector_type", F.coalesce("active", F.lit(False)).alias("active"), times.connector_last_run(F.col("connector_state")).alias("last_run"))


def briefing_rows(rows: DataFrame) -> DataFrame:
    """Stored briefings with their anchor statistics read from JSON; text that is no JSON is kept raw."""
    anchor = F.from_json("anchor", "total_facts int, unanchored array<string>")
    return rows.withColumns({"anchor_stats": F.when(F.try_parse_json("anchor").isNotNull(), anchor), "anchor_raw": F.when(F.try_parse_json("anchor").isNull(), F.col("anchor"))})


def source_rows(sources: DataFrame, state: DataFrame, processed: DataFrame) -> DataFrame:
    """One row per configured source with its state, zero where it has none, and the size of the registry of urls."""
    size = processed.agg(F.count_distinct("url").alias("registry_size"))
    rows = sources.join(state, "source", "left").crossJoin(size)  # a single row
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("source", F.coalesce("interval_hours", F.lit(24)).alias("interval_hours"), "last_polled", "last_attempt", count("new_found"), count("errors"), "registry_size")


def recipe_problems(recipe: dict) -> list[str]:
    """What is wrong with the recipe of a collection, in words; the driver checks it before any page is read."""
    import re

    found = [f"{k} is missing" for k in ("hosts", "landing_path", "document_path", "max_candidates") if not recipe.get(k)]
    for k in ("landing_path", "document_path"):
        try:
            re.compile(recipe.get(k) or "")
        except re.error as error:
            found.append(f"{k}: {error}")
    found += [f"host {h!r}" for h in recipe.get("hosts") or [] if not re.fullmatch(r"[a-z0-9-]+(\.[a-z0-9-]+)+", h)]
    most = recipe.get("max_candidates")
    if most and not (isinstance(most, int) and 1 <= most <= 100):
        found.append("max_candidates is not between 1 and 100")
    return found


def period(hours: int = 24) -> int:
    """The hours of a look-back, if they are between 1 and 720."""
    if not 1 <= hours <= 720:
        raise ValueError("a period has 1 to 720 hours")
    return hours
