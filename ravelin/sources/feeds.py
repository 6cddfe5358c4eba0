"""Twelve indicator feeds: how each body is read, and how its rows become indicator candidates.

A reader gives rows of strings; a projection gives candidates (name, pattern, observable_type, labels, source_name,
valid_from, description). Readers take paths, so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network
from ..functions import text as T

Reader = Callable[[SparkSession, str], DataFrame]

CANDIDATE = ("name", "pattern", "observable_type", "labels", "source_name", "valid_from", "description")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are neither blank nor comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not value like '#%'")


def _csv(spark: SparkSession, path: str, columns: str, header: bool = False, sep: str = ",") -> DataFrame:
    schema = ", ".join(f"{c} string" for c in columns.split())
    return spark.read.csv(path, schema=schema, header=header, comment="#", sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=True)


def _data(spark: SparkSession, path: str, row: str, status: bool = True) -> DataFrame:
    """Rows of the array `data` of a JSON body; with status only if query_status is ok."""
    body = spark.read.json(path, schema=f"query_status string, data array<struct<{row}>>", multiLine=True)
    return (body.where("query_status = 'ok'") if status else body).selectExpr("inline(data)")


def read_urlhaus(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "id dateadded url url_status last_online threat tags urlhaus_link reporter")


def read_malwarebazaar(spark: SparkSession, path: str) -> DataFrame:
    return _data(spark, path, "sha256_hash: string, md5_hash: string, sha1_hash: string, first_seen: string, signature: string, tags: array<string>, file_type: string, file_name: string")


def read_threatfox(spark: SparkSession, path: str) -> DataFrame:
    return _data(spark, path, "ioc: string, ioc_type: string, threat_type: string, malware: string, malware_printable: string, confidence_level: int, first_seen: string, last_seen: string, tags: array<string>, reporter: string")


def read_feodo(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "first_seen_utc dst_ip dst_port c2_status last_online malware").where("dst_ip is null or dst_ip <> 'dst_ip'")


def read_sslbl_cert(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "listing_date sha1 reason").where(F.trim("sha1").rlike("^[0-9a-fA-F]{40}$") & F.col("reason").isNotNull())


def read_sslbl_ja3(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "ja3_md5 first_seen last_seen reason").where(F.trim("ja3_md5").rlike("^[0-9a-fA-F]{32}$") & F.col("reason").isNotNull())


def read_openphish(spark: SparkSession, path: str) -> DataFrame:
    value = F.col("value")
    return lines(spark, path).where(network.url_part(value, "scheme").isin("http", "https") & (network.url_part(value, "authority") != ""))


def read_ipv4_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).where(network.is_ipv4(F.col("value")))


def read_spamhaus(spark: SparkSession, path: str) -> DataFrame:
    body = F.from_json("value", "cidr string, sblid string, rir string", {"mode": "PERMISSIVE"})
    rows = spark.read.text(path).select(body.alias("b")).select("b.*")
    return rows.withColumn("cidr", network.cidr(F.col("cidr"))).where("cidr is not null")


def read_dshield(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    rows = lines(spark, path).select(parts.alias("p")).where(F.size("p") >= 3)
    part = lambda k: F.trim(F.get("p", F.lit(k)))
    return rows.select(network.cidr(F.concat_ws("/", part(0), part(2))).alias("cidr"), part(0).alias("start_ip")).where("cidr is not null")


def read_abuseipdb(spark: SparkSession, path: str) -> DataFrame:
    return _data(spark, path, "ipAddress: string, countryCode: string, abuseConfidenceScore: int, lastReportedAt: string", status=False).where("trim(ipAddress) <> ''")


def _none() -> Column:
    return F.lit(None).cast("string")


def _literal(head: str, value: Column) -> Column:
    return F.concat(F.lit(f"[{head} = '"), T.escape(value), F.lit("']"))


def _labels(*values: Column, tags: Column | None = None) -> Column:
    """Labels in order without nulls and blanks."""
    given = F.array(*[v.cast("string") for v in values])
    out = given if tags is None else F.concat(given, F.coalesce(tags, F.array().cast("array<string>")))
    return F.filter(F.transform(out, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def _candidates(rows: DataFrame, source: str, name: Column, pattern: Column, observable: str | Column, labels: Column, seen: Column | None = None, description: Column | None = None) -> DataFrame:
    kind = F.lit(observable) if isinstance(observable, str) else observable
    return rows.select(
        name.alias("name"), pattern.alias("pattern"), kind.alias("observable_type"), labels.alias("labels"), F.lit(source).alias("source_name"),
        (seen if seen is not None else _none()).alias("valid_from"), (description if description is not None else _none()).alias("description"),
    )


def _filled(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)), F.lit("")) != ""


def from_urlhaus(rows: DataFrame) -> DataFrame:
    url = F.trim(F.col("url"))
    return _candidates(rows.where(_filled("url")), "urlhaus", url, _literal("url:value", url), "Url", _labels(tags=F.split(F.coalesce("tags", F.lit("")), ",")), F.col("dateadded"))


def from_malwarebazaar(rows: DataFrame) -> DataFrame:
    sha = F.trim(F.col("sha256_hash"))
    return _candidates(rows.where(_filled("sha256_hash")), "malwarebazaar", F.substring(sha, 1, 16), _literal("file:hashes.'SHA-256'", sha), "StixFile", _labels(F.col("signature"), tags=F.col("tags")), F.col("first_seen"))


#: ThreatFox type -> (object path, observable type).
THREATFOX = {
    "ip:port": ("ipv4-addr:value", "IPv4-Addr"),
    "domain": ("domain-name:value", "Domain-Name"),
    "url": ("url:value", "Url"),
    "md5_hash": ("file:hashes.MD5", "StixFile"),
    "sha256_hash": ("file:hashes.'SHA-256'", "StixFile"),
}


def from_threatfox(rows: DataFrame) -> DataFrame:
    kind = F.col("ioc_type")
    value = F.when(kind == "ip:port", F.regexp_replace("ioc", r":[^:]*$", "")).otherwise(F.col("ioc"))
    pattern, observable = _none(), _none()
    for name, (head, shown) in THREATFOX.items():
        pattern, observable = F.when(kind == name, _literal(head, value)).otherwise(pattern), F.when(kind == name, F.lit(shown)).otherwise(observable)
    return _candidates(rows.where(_filled("ioc")), "threatfox", value, pattern, observable, _labels(F.col("malware"), tags=F.col("tags")), F.col("first_seen")).where("pattern is not null")


def from_feodo(rows: DataFrame) -> DataFrame:
    ip = F.trim(F.col("dst_ip"))
    return _candidates(rows.where(_filled("dst_ip")), "feodo", ip, _literal("ipv4-addr:value", ip), "IPv4-Addr", _labels(F.lit("c2"), F.col("malware")), F.col("first_seen_utc"))


def from_sslbl_cert(rows: DataFrame) -> DataFrame:
    sha = F.trim(F.col("sha1"))
    seen = F.concat(F.replace(F.trim("listing_date"), F.lit(" "), F.lit("T")), F.lit("+00:00"))
    return _candidates(rows, "sslbl_cert", sha, _literal("x509-certificate:hashes.'SHA-1'", sha), "X509-Certificate", _labels(F.lit("c2"), F.col("reason")), seen)


def from_sslbl_ja3(rows: DataFrame) -> DataFrame:
    md5 = F.trim(F.col("ja3_md5"))
    return _candidates(rows, "sslbl_ja3", md5, _literal("text:value", md5), "Text", _labels(F.lit("ja3"), F.lit("c2"), F.lit("fp-prone"), F.col("reason")), F.col("first_seen"))


def from_openphish(rows: DataFrame) -> DataFrame:
    return _candidates(rows, "openphish", F.col("value"), _literal("url:value", F.col("value")), "Url", _labels(F.lit("phishing")))


def from_ipv4(rows: DataFrame, source: str, label: str) -> DataFrame:
    return _candidates(rows, source, F.col("value"), _literal("ipv4-addr:value", F.col("value")), "IPv4-Addr", _labels(F.lit(label)))


def from_spamhaus(rows: DataFrame) -> DataFrame:
    return _candidates(rows, "spamhaus_drop", F.col("cidr"), _literal("ipv4-addr:value", F.col("cidr")), "IPv4-Addr", _labels(F.lit("hijacked-netblock"), F.col("sblid")))


def from_dshield(rows: DataFrame) -> DataFrame:
    return _candidates(rows, "dshield", F.col("cidr"), _literal("ipv4-addr:value", F.col("cidr")), "IPv4-Addr", _labels(F.lit("attacker-netblock")))


def from_abuseipdb(rows: DataFrame) -> DataFrame:
    ip = F.trim(F.col("ipAddress"))
    six = F.instr(ip, ":") > 0
    text = F.concat(F.lit("Reported address"), F.when(_filled("countryCode"), F.concat(F.lit(" ("), F.col("countryCode"), F.lit(")"))).otherwise(F.lit("")))
    return _candidates(rows, "abuseipdb", ip, F.when(six, _literal("ipv6-addr:value", ip)).otherwise(_literal("ipv4-addr:value", ip)), F.when(six, "IPv6-Addr").otherwise("IPv4-Addr"), _labels(F.lit("abusive-ip")), F.col("lastReportedAt"), text)


@dataclass(frozen=True)
class Feed:
    """A feed: weight of its word in scores, hours between polls, whether no rows are an error, reader and projection."""

    name: str
    weight: int
    hours: int
    must_have_rows: bool
    read: Reader
    project: Callable[[DataFrame], DataFrame]


#: Fixed values (weights and hours); the order is that of registration, which settles who reports a pattern first.
FEEDS = (
    Feed("urlhaus", 15, 1, False, read_urlhaus, from_urlhaus),
    Feed("malwarebazaar", 15, 2, False, read_malwarebazaar, from_malwarebazaar),
    Feed("threatfox", 20, 2, False, read_threatfox, from_threatfox),
    Feed("feodo", 30, 4, False, read_feodo, from_feodo),
    Feed("sslbl_cert", 25, 2, True, read_sslbl_cert, from_sslbl_cert),
    Feed("sslbl_ja3", 10, 24, True, read_sslbl_ja3, from_sslbl_ja3),
    Feed("openphish", 20, 6, True, read_openphish, from_openphish),
    Feed("et_compromised", 20, 12, True, read_ipv4_lines, lambda rows: from_ipv4(rows, "et_compromised", "compromised-host")),
    Feed("spamhaus_drop", 30, 12, False, read_spamhaus, from_spamhaus),
    Feed("dshield", 20, 4, False, read_dshield, from_dshield),
    Feed("abuseipdb", 25, 24, True, read_abuseipdb, from_abuseipdb),
    Feed("cins", 15, 4, True, read_ipv4_lines, lambda rows: from_ipv4(rows, "cins", "attacker-ip")),
)
BY_NAME = {f.name: f for f in FEEDS}
WEIGHTS = {f.name: f.weight for f in FEEDS}


def candidates(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Candidates of all feeds that have a path, with the rank of the feed; feeds without one are off."""
    out = None
    for rank, feed in enumerate(FEEDS):
        if feed.name in paths:
            rows = feed.project(feed.read(spark, paths[feed.name])).select(*CANDIDATE, F.lit(rank).alias("feed_rank"))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no feed has a path")
    return out


def status_of(feed: Feed, fetched: int, keyed: bool = True) -> str:
    """disabled without its key, error when a feed that must have rows has none, else ok."""
    return "disabled" if not keyed else "error" if feed.must_have_rows and not fetched else "ok"
