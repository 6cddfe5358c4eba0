"""Queries over documents that are taken in: gates, landings, entries, listings, pages, payloads, briefings, registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers, network, times
from ..functions import text as T
from ..operators import briefing, extraction, graph, lifecycle, manifest, resolve, views
from ..sources import pages as P
from ..sources import tables
from .registry import AS_OF, dealt, query, table

SITE = manifest.Site("www.site.example", "cdn.site.example", r"^/alerts/(\d+)-(\d{4})$", r"^/files/\d+/alert-(\d+)-(\d{4})\.pdf$", r"^Alert N (\d+)-(\d{4})$")
_STR = lambda c: F.col(c).cast("string")


def _ingested(spark, sf_dir):
    """Documents with one flaw or none, by order key."""
    key, m = _STR("o_orderkey"), F.col("o_orderkey") % 12
    good = lambda k, value, bad: F.when(m == k, bad).otherwise(value)
    chunk = lambda index, status, attempts, retry, error: F.struct(F.lit(index).alias("chunk_index"), F.lit(status).alias("status"), F.lit(attempts).alias("attempts"), F.lit(retry).alias("retry_count"), F.lit(error).cast("string").alias("error"))
    fine, bad = F.array(chunk(0, "complete", 2, 1, None), chunk(1, "complete", 1, 0, None)), F.array(chunk(0, "complete", 1, 1, None))
    value = lambda kind, v: F.struct(F.lit(kind).alias("type"), F.lit(v).alias("value"))
    rejected = F.struct(F.lit("ip").alias("type"), F.lit("x").alias("value"), F.lit("shape").alias("reason"), F.lit("shape_validation").alias("stage"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("https://www.site.example/alerts/"), key, F.lit("-2024"), good(1, F.lit(""), F.lit("?page=1"))).alias("landing_url"),
        F.concat(F.lit("https://CDN.site.example/files/1/alert-"), good(2, key, F.concat(key, F.lit("0"))), F.lit("-2024.pdf?x=1")).alias("document_url"),
        F.concat(F.lit(" Alert  N "), key, F.lit("-2024")).alias("title"), good(3, F.lit("landing_main_h1"), F.lit("guess")).alias("title_source"),
        good(4, F.lit("2024-03-04"), F.lit("2023-03-04")).alias("publication_date"), good(5, F.lit("landing_main_time"), F.lit(None)).alias("publication_date_source"),
        good(6, F.lit(" %PDF-1.7"), F.lit("<html>")).cast("binary").alias("content"), F.lit("complete").alias("status"), good(7, F.lit(2), F.lit(3)).alias("chunk_count"), good(8, fine, bad).alias("chunks"),
        good(9, F.array(value("ip", "1.2.3.4"), value("ip", "1.2.3.4")), F.array(value("ip", "1.2.3"))).alias("accepted"), F.array(rejected).alias("rejected"),
        good(10, F.array(F.lit("CVE-2024-12345")), F.array(F.lit("CVE-2024-12345"), F.lit("CVE-2024-12345"))).alias("vulnerabilities"),
    )


_UUID5 = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', 1 + CAST(('0x' || substr({h}, 17, 1))::INT % 4 AS INT), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
_URL_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({}))"


@query(f"""
WITH d AS (SELECT o_orderkey AS k, o_orderkey % 12 AS m, CASE WHEN o_orderkey % 12 <> 1 THEN 'https://www.site.example/alerts/' || o_orderkey || '-2024' END AS landing,
'https://cdn.site.example/files/1/alert-' || o_orderkey || CASE WHEN o_orderkey % 12 = 2 THEN '0' ELSE '' END || '-2024.pdf' AS document FROM orders),
h AS (SELECT *, {_URL_SHA.format("landing")} AS h FROM d)
SELECT sha256(CASE WHEN landing IS NULL THEN document ELSE landing || chr(10) || document END) AS document_key, landing AS landing_url, document AS document_url, CASE WHEN landing IS NOT NULL THEN 'report--' || {_UUID5.format(h="h")} END AS report_id,
CASE m WHEN 1 THEN 'unofficial_url' WHEN 2 THEN 'coordinates' WHEN 3 THEN 'title_source' WHEN 4 THEN 'date_year' WHEN 5 THEN 'publication_date_source' WHEN 6 THEN 'body'
WHEN 7 THEN 'incomplete' WHEN 8 THEN 'retries' WHEN 9 THEN 'indicator_shape' WHEN 10 THEN 'vulnerabilities' END AS reason, CASE WHEN m IN (0, 11) THEN 2 END AS objects FROM h""")
def manifest_gates(spark, sf_dir):
    """Each document with its keys and objects, or with the flaw for which it is left out."""
    rows = manifest.manifest(_ingested(spark, sf_dir), SITE)
    return rows.select("document_key", "landing_url", "document_url", F.col("report_standard_id").alias("report_id"), "reason", F.when(F.col("objects").isNotNull(), F.size("objects")).alias("objects"))


@query("SELECT count(*) FILTER (WHERE o_orderkey % 12 = 8) AS one, count(*) FILTER (WHERE o_orderkey % 12 <> 8) AS others, CAST(sum(1) AS BIGINT) AS retries FROM orders")
def preview_retries(spark, sf_dir):
    rows = manifest.previews(_ingested(spark, sf_dir))
    return rows.agg(F.count_if(F.size("chunks") == 1).alias("one"), F.count_if(F.size("chunks") == 2).alias("others"), F.sum("retry_count").alias("retries"))


@query("SELECT o_orderkey AS position FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def manifest_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    expected = o.select(F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("name"))
    found = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("other")).otherwise(F.col("o_orderstatus")).alias("name"))
    return manifest.same_manifest(expected, found)


@query("""
SELECT page_id, 'Page ' || page_id || ' & more' AS title, url AS link, CASE WHEN page_id % 2 = 0 THEN 'Mon' ELSE '2024-01-02' END AS published FROM pages WHERE page_id % 3 <> 0""")
def feed_entries(spark, sf_dir):
    """RSS items and Atom entries, one usable and one not in each body."""
    link = F.replace("url", F.lit("&"), F.lit("&amp;"))
    rss = F.concat(F.lit("<rss><item><title>Page "), _STR("page_id"), F.lit(" &amp; more</title><link>"), link, F.lit("</link><pubDate> Mon </pubDate></item><item><title>x</title><link>mailto:x</link></item></rss>"))
    atom = F.concat(F.lit("<feed><entry><title><![CDATA[Page "), _STR("page_id"), F.lit(' & more]]></title><link rel="self" href="https://self.example/"/><link href="'), link, F.lit('"/><updated>2024-01-02</updated></entry></feed>'))
    bodies = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.lit("<rss><item><title>none</title></item></rss>")).when(F.col("page_id") % 2 == 0, rss).otherwise(atom).alias("xml"))
    return P.feed_entries(bodies).select("page_id", "title", "link", "published")


@query("""
SELECT page_id, CAST(CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS entries, CASE page_id % 4 WHEN 0 THEN 'no feed' WHEN 1 THEN 'no entries' END AS error FROM pages""")
def feed_states(spark, sf_dir):
    """Whole pages are no feeds; a body that breaks off still gives its whole entries."""
    m, item = F.col("page_id") % 4, F.concat(F.lit("<item><title>T</title><guid>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</guid></item>"))
    xml = F.when(m == 0, F.col("html")).when(m == 1, "<rss><channel><title>t</title></channel></rss>").when(m == 2, F.concat(F.lit("<rss><channel>"), item, F.lit("<item><title>cut"))).otherwise(F.concat(F.lit("<rss><channel>"), item, item, F.lit("</channel></rss>")))
    return P.feed_health(table(spark, sf_dir, "pages").select("page_id", xml.alias("xml")))


@query("SELECT 'a' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.json' AS name FROM part WHERE p_partkey % 2 = 0 ORDER BY 1 DESC LIMIT 10")
def latest_advisories(spark, sf_dir):
    name = F.concat(F.lit("a"), F.lpad(_STR("p_partkey"), 9, "0"))
    entry = lambda suffix, site: F.struct(F.concat(name, F.lit(suffix)).alias("name"), F.concat(F.lit(site), name).alias("download_url"))
    good, bad = entry(".json", "https://g.example/"), entry(".json", "https://o.example/")
    listing = table(spark, sf_dir, "part").select(F.to_json(F.array(F.when(F.col("p_partkey") % 2 == 0, good).otherwise(bad), entry(".txt", "https://g.example/"))).alias("body"))
    return P.advisories(listing, "body", "https://g.example/").select("name")


@query("""
SELECT 'https://s.example/l/' || o_orderkey AS landing, 'https://s.example/docs/' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '-a.pdf' ELSE '-b.pdf' END AS document, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""")
def confirmed_documents(spark, sf_dir):
    """Landings with the wrong title or day are not confirmed; the first link that proves to be a PDF is taken."""
    o, key = table(spark, sf_dir, "orders"), _STR("o_orderkey")
    landing, day = F.concat(F.lit("https://s.example/l/"), key), F.date_format("o_orderdate", "yyyy-MM-dd")
    cards = o.select(landing.alias("landing"), F.concat(F.lit("BULLETIN "), key).alias("title"), F.to_date("o_orderdate").alias("day"))
    shown = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd")).otherwise(day)
    html = F.concat(F.lit("<main><h1>Bulletin "), F.when(F.col("o_orderkey") % 7 == 0, F.lit("x")).otherwise(key), F.lit('</h1><time datetime="'), shown, F.lit('">t</time><a href="/docs/'), key, F.lit('-a.pdf">A</a><a href="/docs/'), key, F.lit('-b.pdf">B</a></main>'))
    body = lambda suffix: o.select(F.concat(F.lit("https://s.example/docs/"), key, F.lit(suffix)).alias("url"), F.lit("text/html").alias("content_type"), F.lit("<html").cast("binary").alias("head"))
    bodies = body("-a.pdf").where("url not rlike '[13579]-a'").unionByName(body("-b.pdf"))
    found = P.confirm_documents(cards, dealt(o).select(landing.alias("landing"), html.alias("html")), bodies, ["s.example"], "^/docs/")
    return found.select("landing", "document", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""
SELECT 'https://s.example/l/' || o_orderkey AS landing, CASE o_orderkey % 8 WHEN 6 THEN 'Heading ' ELSE 'Bulletin ' END || o_orderkey AS title,
CASE o_orderkey % 8 WHEN 2 THEN 'title conflict between collection and landing' WHEN 3 THEN 'publication date conflict between collection and landing' WHEN 4 THEN 'landing must contain exactly one main element' WHEN 5 THEN 'conflicting time and visible dates'
WHEN 7 THEN 'conflicting landing h2 titles' END AS reason, CASE o_orderkey % 8 WHEN 0 THEN 'collection_card_text+landing_confirmed' WHEN 4 THEN 'collection_card_time+landing_confirmed' WHEN 1 THEN 'landing_main_time' ELSE 'collection_card_time+landing_confirmed' END AS day_source
FROM orders""")
def judged_landings(spark, sf_dir):
    """Collections of a day's bulletins, their cards, and the landing pages behind them, with one flaw or none."""
    key, m, at = _STR("o_orderkey"), F.col("o_orderkey") % 8, F.col("o_orderdate")
    month = F.element_at(F.array(*map(F.lit, times.MONTHS)), F.month(at))
    written = F.concat(F.dayofmonth(at).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(at).cast("string"))
    day, next_ = (F.date_format(d, "yyyy-MM-dd") for d in (at, F.date_add(at, 1)))
    stamp = lambda d: F.concat(F.lit("<time datetime='"), d, F.lit("'>x</time>"))
    name = F.concat(F.when(m == 6, "Heading ").otherwise("Bulletin "), key)
    shown = F.when(m == 1, "").when(m == 0, written).when(m == 5, F.concat(stamp(day), F.lit(" 1 de enero de 1901"))).otherwise(stamp(day))
    card = F.concat(F.lit("<li class=card>"), shown, F.lit(" <p><a class='item' href='/l/"), key, F.lit("'>"), name, F.lit("</a></p></li>"))
    o = table(spark, sf_dir, "orders")
    lists = o.withColumns({"card": card, "shard": F.floor(F.col("o_orderkey") / 500)}).groupBy("shard").agg(F.concat(F.lit("<main><ul>"), F.concat_ws("", F.collect_list("card")), F.lit("</ul></main>")).alias("html"))  # 500 orders at most
    heads = F.concat(F.lit("<h1>"), F.when(m == 2, "Other").when(m == 6, "Site").otherwise(F.upper(name)), F.lit("</h1><h2>"), F.when(m == 6, name).otherwise("Sub"), F.when(m == 7, "</h2><h2>Second").otherwise(""), F.lit("</h2>"))
    main = F.concat(F.lit("<nav>1 de enero de 1901</nav><main>"), heads, F.when(m == 3, stamp(next_)).otherwise(stamp(day)), F.lit("<footer>1 de enero de 1901</footer></main>"), F.when(m == 4, "<main></main>").otherwise(""))
    found = P.cards(lists.withColumn("url", F.lit("https://s.example/all")), ["shard"], "li.card a.item[href]")
    judged = P.confirm_landings(P.collected(found, ["s.example"], r"^/l/\d+$"), dealt(o).select(F.concat(F.lit("https://s.example/l/"), key).alias("landing"), main.alias("html")))
    return judged.select("landing", "title", "reason", "day_source")


@query("SELECT l_orderkey AS doc, string_agg('p' || l_linenumber || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1")
def paged_texts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = F.when(F.col("l_linenumber") == 3, F.lit("  ")).otherwise(F.concat(F.lit("p"), _STR("l_linenumber"), F.col("l_returnflag")))
    rows = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), text.alias("text"))
    return tables.page_texts(rows, "doc", "page", "text")


_VALUES = "CASE c_custkey % 8 WHEN 0 THEN '10.0.0.' || c_nationkey WHEN 1 THEN 'h' || c_custkey || '.example' WHEN 2 THEN 'http://h.example/' || c_custkey WHEN 3 THEN md5(CAST(c_custkey AS VARCHAR)) WHEN 4 THEN sha1(CAST(c_custkey AS VARCHAR)) WHEN 5 THEN sha256(CAST(c_custkey AS VARCHAR)) WHEN 6 THEN 'u' || c_custkey || '@m.example' ELSE 'not one' END"
_KINDS = "CASE c_custkey % 8 WHEN 0 THEN 'ip' WHEN 1 THEN 'domain' WHEN 2 THEN 'url' WHEN 3 THEN 'hash_md5' WHEN 4 THEN 'hash_sha1' WHEN 5 THEN 'hash_sha256' WHEN 6 THEN 'email' ELSE 'domain' END"


@query(f"""
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN '[ipv4-addr:value = ''' WHEN 1 THEN '[domain-name:value = ''' WHEN 2 THEN '[url:value = ''' WHEN 3 THEN '[file:hashes.MD5 = ''' WHEN 4 THEN '[file:hashes.''SHA-1'' = ''' WHEN 5 THEN '[file:hashes.''SHA-256'' = '''
WHEN 6 THEN '[email-addr:value = ''' END || {_VALUES} || ''']' AS pattern FROM customer""")
def value_patterns(spark, sf_dir):
    """Values of all types, and one without the shape of its type."""
    m, key = F.col("c_custkey") % 8, _STR("c_custkey")
    value = F.element_at(F.array(F.concat(F.lit("10.0.0."), _STR("c_nationkey")), F.concat(F.lit("h"), key, F.lit(".example")), F.concat(F.lit("http://h.example/"), key), F.md5(key), F.sha1(key), F.sha2(key, 256), F.concat(F.lit("u"), key, F.lit("@m.example")), F.lit("not one")), (m + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("ip", "domain", "url", "hash_md5", "hash_sha1", "hash_sha256", "email", "domain"))), (m + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", identifiers.pattern_of(kind, value).alias("pattern"))


_MONTH_SQL = "[" + ", ".join(f"'{m}'" for m in times.MONTHS) + "]"


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS spanish, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def written_dates(spark, sf_dir):
    at = F.col("o_orderdate")
    month = F.element_at(F.array(*map(F.lit, times.MONTHS)), F.month(at))
    spanish = F.concat(F.lit("Lima, "), F.dayofmonth(at).cast("string"), F.lit(" de "), F.initcap(month), F.lit(" de "), F.year(at).cast("string"), F.lit(". Otro 1 de enero de 1999"))
    iso = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(at, "dd/MM/yyyy")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", shown(times.spanish_date(spanish)).alias("spanish"), shown(times.iso_day(iso)).alias("iso"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(to_timestamp(1700000000 + event_id), '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(to_timestamp(1700000000 + event_id), '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN 'yesterday' END AS run,
CASE event_id % 4 WHEN 0 THEN 'run' WHEN 3 THEN 'unreadable state: no json' ELSE 'state without last_run' END AS note FROM events""")
def connector_runs(spark, sf_dir):
    m, at = F.col("event_id") % 4, F.col("event_id") + F.lit(1_700_000_000)
    state = F.when(m == 0, F.to_json(F.struct(at.alias("last_run")))).when(m == 1, F.to_json(F.struct((at * 1000).alias("last_run_timestamp")))).when(m == 2, '{"lastRun": "yesterday"}').otherwise("no json")
    note = manifest.last_run_note(state)
    return table(spark, sf_dir, "events").select("event_id", F.when(m == 2, times.connector_last_run(state)).otherwise(F.substring(times.connector_last_run(state), 1, 19)).alias("run"), F.when(note.rlike(r"^\d{4}-"), "run").otherwise(note).alias("note"))


@query("""
SELECT o_orderkey, o_orderkey % 3 <> 0 AS retried, CASE o_orderkey % 3 WHEN 0 THEN 'Only 10.0.0.1.' WHEN 1 THEN 'Now 10.0.0.1 alone.' ELSE 'Still 10.9.9.9 here.' || chr(10) || chr(10) || '[Unverified identifiers: ipv4:10.9.9.9]' END AS text FROM orders""")
def verified_briefings(spark, sf_dir):
    m = F.col("o_orderkey") % 3
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(m == 0, "Only 10.0.0.1.").otherwise("Both 10.0.0.1 and 10.8.8.8.").alias("text"), F.lit("seen: http://10.0.0.1/x").alias("context"))
    second = runs.where("run_id % 3 <> 0").select("run_id", F.when(F.col("run_id") % 3 == 1, "Now 10.0.0.1 alone.").otherwise("Still 10.9.9.9 here.").alias("text"))
    return briefing.verify(runs, second).select(F.col("run_id").alias("o_orderkey"), "retried", "text")


@query("""
WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 101 END AS score, CASE WHEN c_custkey % 6 = 0 THEN 'Unknown' ELSE c_mktsegment END AS kind FROM customer)
SELECT kind, count(*) AS n, (SELECT max(coalesce(score, 0)) / 100 FROM s) AS top FROM s GROUP BY 1""")
def sample_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 101).alias("score"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("observable_type"))
    return briefing.by_type(rows).select(F.col("observable_type").alias("kind"), "n").crossJoin(briefing.top_confidence(rows).select(F.col("top_confidence").alias("top")))  # a single row


@query("""
WITH e AS (SELECT l_suppkey AS f, l_partkey AS t, 'uses' AS r FROM lineitem WHERE l_returnflag = 'R'), l AS (SELECT l_orderkey * 8 + l_linenumber AS d, l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N'), n AS (SELECT DISTINCT a.l_suppkey AS f, b.l_partkey AS t, 'indicates' AS r FROM l AS a JOIN l AS b USING (d)),
x AS (SELECT * FROM e UNION ALL SELECT DISTINCT * FROM n WHERE (f, t, r) NOT IN (SELECT * FROM e)) SELECT r AS relationship_type, count(*) AS n, count(DISTINCT f) AS sources FROM x GROUP BY 1""")
def merged_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    edges = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.lit("uses").alias("relationship_type"))
    of = li.where("l_returnflag <> 'N'")
    new = graph.indicates(of.select("doc_id", F.col("l_suppkey").alias("id")), of.select("doc_id", F.col("l_partkey").alias("id")))
    return graph.merge_edges(edges, new).groupBy("relationship_type").agg(F.count("*").alias("n"), F.count_distinct("from_id").alias("sources"))


@query("""
SELECT 's' || s_suppkey AS service, CASE s_suppkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' WHEN 2 THEN 'unhealthy' WHEN 3 THEN 'oom' WHEN 4 THEN 'restarting' ELSE 'unhealthy' END AS verdict FROM supplier""")
def service_inventory(spark, sf_dir):
    m, name = F.col("s_suppkey") % 6, F.concat(F.lit("s"), _STR("s_suppkey")).alias("service")
    s = table(spark, sf_dir, "supplier")
    running = s.where("s_suppkey % 6 <> 0").select(name, F.when(m == 5, "exited").otherwise("running").alias("state"), F.when(m == 2, "unhealthy").otherwise("healthy").alias("health"), F.when(m == 4, 3).otherwise(0).alias("restarts"), (m == 3).alias("oom_killed"))
    return views.inventory(s.select(name), running)


@query("""
SELECT feed, reason, count(*) AS n FROM (SELECT 'f' || (s_suppkey % 90) AS feed, CASE WHEN s_suppkey % 90 >= 80 THEN 'unknown feed' WHEN count(*) OVER (PARTITION BY s_suppkey % 90) > 1 THEN 'repeated feed' WHEN s_suppkey % 7 = 0 THEN 'status' WHEN s_suppkey % 11 = 0 THEN 'negative count' END AS reason FROM supplier) WHERE reason IS NOT NULL GROUP BY ALL""")
def broken_contracts(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), (F.col("s_suppkey") % 90).cast("string")).alias("feed"), F.when(F.col("s_suppkey") % 7 == 0, "odd").otherwise("ok").alias("status"), F.when(F.col("s_suppkey") % 11 == 0, -1).otherwise(1).alias("ioc_count"))
    return views.contract_violations(rows, [f"f{k}" for k in range(80)]).groupBy("feed", "reason").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS job_id FROM orders ORDER BY o_orderstatus IN ('F', 'P'), o_orderdate DESC, o_orderkey DESC LIMIT 1000")
def jobs_kept(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "error").otherwise("running")
    return lifecycle.keep_jobs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))).select("job_id")


@query("SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def briefing_states(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return lifecycle.latest(rows, "id", "at", "seq").select("id", "status")


@query("""
SELECT l_orderkey AS doc_id, coalesce(array_to_string(list_sort(list_distinct(list('a' || l_suppkey) FILTER (WHERE l_linenumber % 3 = 0))), '|'), '') AS actors, coalesce(array_to_string(list_sort(list_distinct(list(lower(l_returnflag)) FILTER (WHERE l_linenumber % 3 = 1))), '|'), '') AS sectors,
CAST(coalesce(len(list_distinct(list('10.0.0.' || l_linenumber) FILTER (WHERE l_linenumber % 3 = 2 AND l_linenumber <> 5))), 0) AS BIGINT) AS indicators FROM lineitem GROUP BY 1""")
def flat_entities(spark, sf_dir):
    m = F.col("l_linenumber") % 3
    kind = F.when(m == 0, "threat-actor").when(m == 1, "sector").otherwise("indicator")
    value = F.when(m == 0, F.concat(F.lit("a"), _STR("l_suppkey"))).when(m == 1, F.col("l_returnflag")).otherwise(F.concat(F.lit("10.0.0."), _STR("l_linenumber")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), kind.alias("type"), value.alias("value"), F.when((m == 2) & (F.col("l_linenumber") != 5), "ip").alias("ioc_type"))
    out = extraction.flat(rows)
    return out.select("doc_id", F.array_join("actors", "|").alias("actors"), F.array_join("sectors", "|").alias("sectors"), F.size("indicators").cast("bigint").alias("indicators"))


@query("SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(coalesce(text, '')) END AS old FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def changed_files(spark, sf_dir):
    """A dry run must leave no such row: files that are new or whose content changed."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), _STR("doc_id")).alias("path"), F.coalesce("text", F.lit("")).alias("t"), "doc_id")
    before = lifecycle.snapshot(files.where("doc_id % 7 <> 0").select("path", F.col("t").cast("binary").alias("content")))
    after = lifecycle.snapshot(files.select("path", F.when(F.col("doc_id") % 5 == 0, F.concat("t", F.lit("!"))).otherwise(F.col("t")).cast("binary").alias("content")))
    return lifecycle.changed_files(before, after).select("path", "old")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 's' || p_partkey WHEN 2 THEN 'i|t' ELSE '' END AS ids, CASE WHEN p_partkey % 2 = 0 THEN '{"k":' || p_partkey || '}' END AS last FROM part""")
def payload_nodes(spark, sf_dir):
    m, key = F.col("p_partkey") % 4, _STR("p_partkey")
    payload = F.when(m == 0, '["b", "a", "b"]').when(m == 1, F.concat(F.lit('[{"id": "i", "standard_id": "s'), key, F.lit('"}]'))).when(m == 2, '{"edges": [{"node": {"id": "i"}}, {"node": {"id": "j", "standard_id": "t"}}]}')
    output = F.concat(F.lit('log\n{"first": 1}\n'), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"k":'), key, F.lit("}\n"))).otherwise(F.lit("")), F.lit("{broken\nend"))
    last = manifest.last_object(output)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(manifest.nodes(payload), "|").alias("ids"), F.when(~last.contains("first"), last).alias("last"))


@query("SELECT c_nationkey, arg_min(CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE c_mktsegment || '' END, c_custkey) AS name, min(c_custkey) AS pos FROM customer GROUP BY c_nationkey, lower(c_mktsegment)")
def first_spellings(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", name.alias("name"), F.col("c_custkey").alias("pos"))
    return resolve.first_spelling(rows, ["c_nationkey"], "name", "pos").select("c_nationkey", "name", "pos")


@query(f"""
SELECT count(*) AS total, epoch_us(max(o_orderdate)) AS last_update, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'never_run' END AS status FROM orders WHERE o_orderdate < TIMESTAMP '{AS_OF}'""")
def vulnerability_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(AS_OF).cast("timestamp")).select(F.col("o_orderdate").alias("updated_at"))
    return views.vulnerability_stats(rows).select("total", F.unix_micros("last_update").alias("last_update"), "status")


@query(r"""
SELECT doc_id, doc_id % 2 = 0 AS transient, CASE doc_id % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'blog' ELSE 'unknown' END AS source, 'http://h' || doc_id || '.example/a.b at u@m.example' AS clean, doc_id % 4 = 0 AS pdf, doc_id % 5 <> 0 AS public FROM documents""")
def document_traits(spark, sf_dir):
    """Defanged addresses, errors, kinds of sources, bodies and addresses by document."""
    key, m = _STR("doc_id"), F.col("doc_id")
    message = F.when(m % 2 == 0, F.concat(F.lit("Request "), key, F.lit(" TIMED OUT"))).otherwise("bad input")
    url = F.when(m % 3 == 1, "https://blog.vendor.example/x").otherwise(F.concat(F.lit("https://other.example/"), key))
    raw = F.concat(F.lit("hxxp://h"), key, F.lit("[.]example/a(dot)b at u[at]m{.}example"))
    head = F.when(m % 8 == 0, "%PDF-1.4").otherwise("<html>").cast("binary")
    kind = F.when(m % 8 == 4, "application/pdf; x").otherwise("text/html")
    ip = F.element_at(F.array(F.lit("::ffff:10.0.0.1"), F.lit("2606:4700::1111"), F.lit("8.8.8.8"), F.lit("2a00:1450::8"), F.lit("1.1.1.1")), (m % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", identifiers.is_transient(message).alias("transient"), identifiers.source_type(F.when(m % 3 == 0, "pdf").otherwise("html"), url, ("blog.vendor.example",)).alias("source"),
        T.refang(raw).alias("clean"), network.looks_like_pdf(kind, head, url).alias("pdf"), (~network.is_special(ip)).alias("public"),
    )


@query(r"""
SELECT doc_id, 1 + CAST(doc_id % 3 AS BIGINT) AS hits, CASE WHEN doc_id % 3 = 0 THEN 'first é line needle one' ELSE 'needle needle' || CASE WHEN doc_id % 3 = 2 THEN ' needle' ELSE '' END END AS line, 'e ae n oe' AS folded, 'Title|plain text' AS report FROM documents""")
def text_places(spark, sf_dir):
    """Occurrences with their lines, folding, and report lines."""
    m = F.col("doc_id") % 3
    text = F.when(m == 0, "top\nfirst é line needle one\n\nlast").when(m == 1, "x\n\nneedle needle\ny").otherwise("needle needle needle")
    at = T.occurrences(text, F.lit("needle"))
    lines = F.filter(T.report_lines(F.lit("## **Title**\n\nplain **text**\n")), lambda x: x["line"] != "")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(at).cast("bigint").alias("hits"), T.line_at(text, F.get(at, F.lit(0))).alias("line"), T.fold_accents(F.lit("É ae Ñ oe")).alias("folded"), F.array_join(F.transform(lines, lambda x: x["line"]), "|").alias("report"),
    )


@query("SELECT DISTINCT 'o' || o_orderkey AS url FROM orders WHERE o_orderkey % 4 <> 1 AND o_orderstatus = 'O' UNION SELECT 'l' || o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT 'd' || o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def acknowledged_urls(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), _STR("o_orderkey")
    processed = o.where("o_orderstatus = 'O'").select(F.concat(F.lit("o"), key).alias("url"))
    lost = o.where("o_orderkey % 4 = 1").select(F.lit("error").alias("status"), F.lit(None).cast("string").alias("report_id"), F.lit(None).cast("string").alias("landing_key"), F.concat(F.lit("o"), key).alias("document_key"), F.lit("connection reset").alias("error"))
    done = o.where("o_orderstatus = 'F'").select(F.lit("complete").alias("status"), F.lit("r").alias("report_id"), F.concat(F.lit("l"), key).alias("landing_key"), F.concat(F.lit("d"), key).alias("document_key"), F.lit(None).cast("string").alias("error"))
    return lifecycle.acknowledged(processed, done.unionByName(lost))


@query("SELECT 'T1' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS x_mitre_id, p_name AS name FROM part WHERE p_partkey % 3 = 0 ORDER BY 1 LIMIT 10")
def named_techniques(spark, sf_dir):
    id_ = F.concat(F.when(F.col("p_partkey") % 3 == 1, F.lit("X1")).otherwise(F.lit("T1")), F.lpad(_STR("p_partkey"), 6, "0"))
    rows = table(spark, sf_dir, "part").select(id_.alias("x_mitre_id"), F.when(F.col("p_partkey") % 3 == 2, id_).otherwise(F.col("p_name")).alias("name"))
    return briefing.techniques(rows).select("x_mitre_id", "name")


@query(f"""
WITH v AS (SELECT DISTINCT lower(p_brand) AS value FROM part UNION SELECT 'all' FROM part), h AS (SELECT value, {_URL_SHA.format("value")} AS h FROM v) SELECT 'label--' || {_UUID5.format(h="h")} AS id, value FROM h""")
def label_values(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.array(F.lower("p_brand"), F.lit("all"), F.lit("")).alias("labels"))
    return resolve.labels(rows).select("id", "value")
