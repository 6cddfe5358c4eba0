"""Feed queries: bodies of all twelve feeds are written from the tables, read back by their readers and projected.

Bodies hold comments, blank fields and malformed rows beside good ones. JSON feeds come as many bodies of a bounded
number of rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import feeds, paged
from .registry import query, table

#: Rows of one JSON body.
BODY = 1000


def _path(rows: DataFrame, name: str) -> str:
    return f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _text(rows: DataFrame, line: Column, name: str, *others: str) -> str:
    """A folder with a line for each row, and some lines beside."""
    path, spark = _path(rows, name), rows.sparkSession
    rows.select(line.alias("value")).unionByName(spark.createDataFrame([(x,) for x in others], "value string")).write.text(path)
    return path


def _json(rows: DataFrame, key: str, row: Column, name: str, status: Column) -> str:
    """A folder of JSON bodies with up to BODY rows each; status may differ by body."""
    path = _path(rows, name)
    of = rows.select(F.floor(F.col(key) / BODY).alias("body"), row.alias("row")).groupBy("body").agg(F.collect_list("row").alias("data"))
    of.select("body", F.to_json(F.struct(status.alias("query_status"), "data")).alias("value")).write.partitionBy("body").text(path)
    return path


def _read(spark, name: str, path: str) -> DataFrame:
    feed = feeds.BY_NAME[name]
    return feed.project(feed.read(spark, path)).select("name", "pattern", "observable_type", F.array_join("labels", "|").alias("labels"), "source_name", "valid_from")


def _sql(source: str, where: str, name: str, head: str, observable: str, labels: str, seen: str = "NULL", shown: str | None = None) -> str:
    """The candidates of a feed whose values are `name`; head is the object path of the pattern."""
    literal = f"replace(replace({shown or name}, '\\', '\\\\'), '''', '\\''')"
    heads = head if head.startswith("CASE") else "'" + head.replace("'", "''") + "'"
    kinds = observable if observable.startswith("CASE") else f"'{observable}'"
    return f"SELECT {name} AS name, '[' || {heads} || ' = ''' || {literal} || ''']' AS pattern, {kinds} AS observable_type, {labels} AS labels, '{{feed}}' AS source_name, CAST({seen} AS VARCHAR) AS valid_from FROM {source} WHERE {where}"


def _feed(name: str, sql: str) -> Callable:
    """Registers a function as query feed_<name>, with its SQL."""

    def add(make: Callable) -> Callable:
        def run(spark, sf_dir):
            return _read(spark, name, make(spark, sf_dir))

        run.__name__ = f"feed_{name}"
        run.__doc__ = make.__doc__
        query(sql.replace("{feed}", name))(run)
        return run

    return add


_DAY = "strftime(DATE '2024-01-01' + CAST(c_custkey % 28 AS INT), '%Y-%m-%d')"


def _customers(spark, sf_dir) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")), "yyyy-MM-dd")
    key = F.col("c_custkey").cast("string")
    quad = F.concat_ws(".", F.lit("203"), (F.col("c_custkey") % 250).cast("string"), (F.col("c_nationkey") % 250).cast("string"), (F.floor(F.col("c_custkey") / 250) % 250).cast("string"))
    return table(spark, sf_dir, "customer").select("*", day.alias("day"), key.alias("key"), quad.alias("quad"), F.sha2(key, 256).alias("sha256"), F.sha1(key).alias("sha1"), F.md5(key).alias("md5"))


_QUAD = "('203.' || (c_custkey % 250) || '.' || (c_nationkey % 250) || '.' || ((c_custkey // 250) % 250))"
_KEY = "CAST(c_custkey AS VARCHAR)"


@_feed("urlhaus", _sql("customer", "c_custkey % 7 <> 0", f"'http://h' || c_nationkey || '.example/it''s?c=' || {_KEY}", "url:value", "Url", "c_mktsegment || '|exe'", f"{_DAY} || ' 01:02:03'"))
def urlhaus(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    url = F.when(F.col("c_custkey") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("http://h"), F.col("c_nationkey").cast("string"), F.lit(".example/it's?c="), "key"))
    fields = [F.col("key"), F.concat("day", F.lit(" 01:02:03")), url, F.lit("online"), F.lit(""), F.lit("malware_download"), F.concat("c_mktsegment", F.lit(", exe ,")), F.lit("https://x.example"), F.lit("r")]
    return _text(rows, F.array_join(F.array(*[F.concat(F.lit('"'), f, F.lit('"')) for f in fields]), ","), "urlhaus", "# id,dateadded,url", "#")


@_feed("malwarebazaar", _sql("customer", "c_custkey % 5 <> 0", f"substr(sha256({_KEY}), 1, 16)", "file:hashes.'SHA-256'", "StixFile", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '|' ELSE '' END || 'exe|t' || c_nationkey", _DAY, shown=f"sha256({_KEY})"))
def malwarebazaar(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    row = F.struct(
        F.when(F.col("c_custkey") % 5 != 0, F.col("sha256")).otherwise(F.lit(" ")).alias("sha256_hash"), F.col("day").alias("first_seen"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("signature"),
        F.array(F.lit("exe"), F.lit(" "), F.concat(F.lit("t"), F.col("c_nationkey").cast("string"))).alias("tags"), F.lit("exe").alias("file_type"), F.lit("x").alias("file_name"),
    )
    return _json(rows, "c_custkey", row, "malwarebazaar", F.lit("ok"))


_TF = f"CASE c_custkey % 6 WHEN 0 THEN {_QUAD} WHEN 1 THEN 'd' || c_custkey || '.example' WHEN 2 THEN 'http://d' || c_custkey || '.example/' WHEN 3 THEN md5({_KEY}) ELSE sha256({_KEY}) END"


@_feed(
    "threatfox",
    _sql(
        "customer", "c_custkey % 6 <> 5 AND (c_custkey // 1000) % 2 = 0", _TF,
        "CASE c_custkey % 6 WHEN 0 THEN 'ipv4-addr:value' WHEN 1 THEN 'domain-name:value' WHEN 2 THEN 'url:value' WHEN 3 THEN 'file:hashes.MD5' ELSE 'file:hashes.''SHA-256''' END",
        "CASE c_custkey % 6 WHEN 0 THEN 'IPv4-Addr' WHEN 1 THEN 'Domain-Name' WHEN 2 THEN 'Url' ELSE 'StixFile' END", "c_mktsegment || '|tag'", f"{_DAY} || ' 00:00:00 UTC'",
    ),
)
def threatfox(spark, sf_dir):
    """Bodies whose status isn't ok give no rows, nor do unknown types."""
    rows, m = _customers(spark, sf_dir), F.col("c_custkey") % 6
    host = F.concat(F.lit("d"), "key", F.lit(".example"))
    value = F.when(m == 0, F.concat("quad", F.lit(":443"))).when(m == 1, host).when(m == 2, F.concat(F.lit("http://"), host, F.lit("/"))).when(m == 3, F.col("md5")).otherwise(F.col("sha256"))
    kind = F.element_at(F.array(*map(F.lit, ("ip:port", "domain", "url", "md5_hash", "sha256_hash", "sha3_hash"))), (m + 1).cast("int"))
    row = F.struct(value.alias("ioc"), kind.alias("ioc_type"), F.col("c_mktsegment").alias("malware"), F.concat("day", F.lit(" 00:00:00 UTC")).alias("first_seen"), F.array(F.lit("tag"), F.lit("")).alias("tags"))
    return _json(rows, "c_custkey", row, "threatfox", F.when(F.col("body") % 2 == 0, "ok").otherwise("no_results"))


@_feed("feodo", _sql("customer", "c_custkey % 4 <> 0", _QUAD, "ipv4-addr:value", "IPv4-Addr", "'c2|' || c_mktsegment", f"{_DAY} || ' 03:04:05'"))
def feodo(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    line = F.concat_ws(",", F.concat("day", F.lit(" 03:04:05")), F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.col("quad")), F.lit("443"), F.lit("online"), F.col("day"), F.col("c_mktsegment"))
    return _text(rows, line, "feodo", "# comment", "first_seen_utc,dst_ip,dst_port,c2_status,last_online,malware")


@_feed("sslbl_cert", _sql("customer", "c_custkey % 3 <> 0", f"sha1({_KEY})", "x509-certificate:hashes.'SHA-1'", "X509-Certificate", "'c2|' || c_mktsegment || ' C&C'", f"{_DAY} || 'T05:06:07+00:00'"))
def sslbl_cert(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    line = F.concat_ws(",", F.concat("day", F.lit(" 05:06:07")), F.when(F.col("c_custkey") % 3 == 0, F.substring("sha1", 1, 39)).otherwise(F.col("sha1")), F.concat("c_mktsegment", F.lit(" C&C")))
    return _text(rows, line, "sslbl-cert", "# Listingdate,SHA1,Listingreason", "", "2024-01-01")


@_feed("sslbl_ja3", _sql("customer", "c_custkey % 3 <> 0", f"md5({_KEY})", "text:value", "Text", "'ja3|c2|fp-prone|' || c_mktsegment", _DAY))
def sslbl_ja3(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    line = F.concat_ws(",", F.when(F.col("c_custkey") % 3 == 0, F.concat("md5", F.lit("0"))).otherwise(F.col("md5")), F.col("day"), F.lit("2024-02-01"), F.col("c_mktsegment"))
    return _text(rows, line, "sslbl-ja3", "# ja3_md5,Firstseen,Lastseen,Listingreason", "e" * 32 + ",2017-01-01")


@_feed("openphish", _sql("customer", "c_custkey % 4 < 2", f"CASE c_custkey % 4 WHEN 0 THEN 'http' ELSE 'https' END || '://p' || {_KEY} || '.example/login?u=o''neil'", "url:value", "Url", "'phishing'"))
def openphish(spark, sf_dir):
    rows, m = _customers(spark, sf_dir), F.col("c_custkey") % 4
    line = F.when(m == 2, F.concat(F.lit("ftp://p"), "key", F.lit(".example"))).when(m == 3, F.concat(F.lit("http:///"), "key"))
    return _text(rows, F.coalesce(line, F.concat(F.lit("  "), F.when(m == 0, "http").otherwise("https"), F.lit("://p"), "key", F.lit(".example/login?u=o'neil "))), "openphish", "# c", "", "no url")


def _addresses(spark, sf_dir, name: str) -> str:
    rows = _customers(spark, sf_dir)
    line = F.when(F.col("c_custkey") % 6 == 0, F.concat("quad", F.lit(".1"))).when(F.col("c_custkey") % 6 == 1, F.lit("2001:db8::1")).otherwise(F.concat(F.lit(" "), "quad"))
    return _text(rows, line, name, "# c", "", "256.1.1.1")


@_feed("et_compromised", _sql("customer", "c_custkey % 6 > 1", _QUAD, "ipv4-addr:value", "IPv4-Addr", "'compromised-host'"))
def et_compromised(spark, sf_dir):
    return _addresses(spark, sf_dir, "et-compromised")


@_feed("cins", _sql("customer", "c_custkey % 6 > 1", _QUAD, "ipv4-addr:value", "IPv4-Addr", "'attacker-ip'"))
def cins(spark, sf_dir):
    return _addresses(spark, sf_dir, "cins")


_NET = "('203.' || (c_custkey % 250) || '.' || (c_nationkey % 250) || '.0/24')"


@_feed("spamhaus_drop", _sql("customer", "c_custkey % 4 < 2", _NET, "ipv4-addr:value", "IPv4-Addr", "'hijacked-netblock|SBL' || c_custkey"))
def spamhaus_drop(spark, sf_dir):
    rows, m = _customers(spark, sf_dir), F.col("c_custkey") % 4
    good = F.to_json(F.struct(F.concat("quad", F.lit("/24")).alias("cidr"), F.concat(F.lit("SBL"), "key").alias("sblid"), F.lit("x").alias("rir")))
    line = F.when(m == 2, F.to_json(F.struct(F.lit("2001:db8::/32").alias("cidr"), F.col("key").alias("sblid")))).when(m == 3, F.concat(F.lit("{broken "), "key")).otherwise(good)
    return _text(rows, line, "spamhaus", '{"type":"metadata","timestamp":1}', "")


@_feed("dshield", _sql("customer", "c_custkey % 3 <> 0", _NET, "ipv4-addr:value", "IPv4-Addr", "'attacker-netblock'"))
def dshield(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    bits = F.when(F.col("c_custkey") % 3 == 0, F.lit("x")).otherwise(F.lit("24"))
    return _text(rows, F.concat_ws("\t", "quad", F.lit("203.255.255.255"), bits, F.lit("9"), "c_name"), "dshield", "# Start\tEnd\tNetmask", "", "short\trow")


@_feed(
    "abuseipdb",
    _sql("customer", "c_custkey % 5 <> 0", f"CASE WHEN c_custkey % 2 = 0 THEN {_QUAD} ELSE '2001:db8::' || (c_custkey % 9999) END", "CASE WHEN c_custkey % 2 = 0 THEN 'ipv4-addr:value' ELSE 'ipv6-addr:value' END", "CASE WHEN c_custkey % 2 = 0 THEN 'IPv4-Addr' ELSE 'IPv6-Addr' END", "'abusive-ip'", _DAY),
)
def abuseipdb(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    six = F.concat(F.lit("2001:db8::"), (F.col("c_custkey") % 9999).cast("string"))
    ip = F.when(F.col("c_custkey") % 5 == 0, F.lit("  ")).when(F.col("c_custkey") % 2 == 0, F.col("quad")).otherwise(six)
    row = F.struct(ip.alias("ipAddress"), F.lit("DE").alias("countryCode"), F.lit(90).alias("abuseConfidenceScore"), F.col("day").alias("lastReportedAt"))
    return _json(rows, "c_custkey", row, "abuseipdb", F.lit("ok"))


@query("""
WITH e AS (SELECT event_id, date_trunc('second', ts) AS moment, event_type FROM events) SELECT event_id, event_type AS kind, strftime(moment, '%Y-%m-%d %H:%M:%S') AS seen,
strftime(date_trunc('day', moment - INTERVAL 1 SECOND), '%Y-%m-%d %H:%M:%S') AS since FROM e WHERE moment > TIMESTAMP '2024-01-05 00:00:00' AND moment <= TIMESTAMP '2024-01-12 00:00:00'""")
def paged_windows(spark, sf_dir):
    """A week of a source that answers in pages, by windows of a day."""
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))
    rows.hint("rebalance", "hour").write.partitionBy("hour").json(path)
    rows = paged.of_windows(spark, "ravelin.sources.paged:folder_pages", "2024-01-05 00:00:00", "2024-01-12 00:00:00", 24, folder=path, size="5000")
    return rows.select("since", F.from_json("body", "event_id bigint, kind string, last_seen string").alias("b")).select("b.event_id", "b.kind", F.col("b.last_seen").alias("seen"), "since")
