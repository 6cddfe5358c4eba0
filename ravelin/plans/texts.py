"""Text queries over documents, pages and conversations: harvests, anchoring, links, sanitising."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers, network
from ..functions import text as T
from ..operators import briefing, extraction
from ..sources import nodes as N
from ..sources import pages as P
from .registry import query, table

_HEX = "unnest(regexp_extract_all(text, '[A-Fa-f0-9]+'))"
_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


@query(f"SELECT doc_id, CASE length(value) WHEN 64 THEN 'hash_sha256' WHEN 40 THEN 'hash_sha1' ELSE 'hash_md5' END AS type, value, count(*) AS n FROM (SELECT doc_id, {_HEX} AS value FROM documents) WHERE length(value) IN (32, 40, 64) GROUP BY ALL")
def harvest_hashes(spark, sf_dir):
    return extraction.harvest(table(spark, sf_dir, "documents")).groupBy("doc_id", "type", "value").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_IP}')) AS value FROM documents)")
def harvest_ipv4(spark, sf_dir):
    found = identifiers.facts(F.col("text"), kinds=("ipv4",))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(found, lambda x: x["value"])).alias("value"))


_TLD_SQL = ", ".join(f"'{t}'" for t in identifiers.GENERIC_TLDS)
_DOMAINS = f"SELECT DISTINCT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, '(?i)https?://[^\\s|)\\]}}>\"''`]+', ' ', 'g')), '\\b[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]{{2,}}\\b')) AS value FROM documents) WHERE len(regexp_extract(value, '[a-z]+$')) = 2 OR regexp_extract(value, '[a-z]+$') IN ({_TLD_SQL})"


@query(_DOMAINS)
def harvest_domains(spark, sf_dir):
    found = identifiers.facts(F.col("text"), kinds=("domain",))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(found, lambda x: x["value"])).alias("value"))


@query(r"SELECT DISTINCT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS value FROM documents)")
def salvaged_emails(spark, sf_dir):
    """Addresses, found again from the domains they end in."""
    docs = table(spark, sf_dir, "documents")
    hosts = F.array_distinct(F.regexp_extract_all("text", F.lit(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"), F.lit(1)))
    rows = docs.select("doc_id", "text", F.explode(hosts).alias("domain"))
    return rows.select("doc_id", F.explode(identifiers.salvage_emails(F.col("domain"), F.col("text"))).alias("value")).distinct()


@query(f"SELECT doc_id, type, count(*) AS n FROM (SELECT DISTINCT doc_id, 'ip' AS type, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_IP}')) AS value FROM documents) UNION ALL SELECT DISTINCT doc_id, CASE length(value) WHEN 64 THEN 'hash_sha256' WHEN 40 THEN 'hash_sha1' ELSE 'hash_md5' END, value FROM (SELECT doc_id, {_HEX} AS value FROM documents) WHERE length(value) IN (32, 40, 64)) GROUP BY ALL")
def ioc_judged(spark, sf_dir):
    """Proposed addresses and harvested hashes through all gates, each once per document."""
    docs = table(spark, sf_dir, "documents")
    ips = identifiers.facts(F.col("text"), kinds=("ipv4",))
    proposed = docs.select("doc_id", F.posexplode(F.flatten(F.array_repeat(ips, 2))).alias("pos", "x")).select("doc_id", F.lit("ip").alias("type"), "x.value", "pos")
    judged = extraction.judge(extraction.unite(proposed, extraction.harvest(docs)), docs.select("doc_id", "text", F.lit("report").alias("source_type")))
    return extraction.indicators(judged).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query(f"SELECT value, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_IP}')) AS value FROM documents) GROUP BY 1")
def cross_document_ips(spark, sf_dir):
    return harvest_ipv4(spark, sf_dir).groupBy("value").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT DISTINCT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_IP}')) AS value FROM documents) WHERE value NOT IN (SELECT unnest(regexp_extract_all(html, '{_IP}')) FROM pages)")
def anchor_unanchored(spark, sf_dir):
    """Addresses in documents that no page supports."""
    said = harvest_ipv4(spark, sf_dir)
    known = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(f"({_IP})"), F.lit(1))).alias("value")).distinct()
    return said.join(known, "value", "left_anti").select("doc_id", "value")


@query(r"""
WITH f AS (SELECT conv_id, turn, regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b') AS v FROM conversations)
SELECT conv_id, turn, CAST(len(list_distinct(v)) AS BIGINT) AS ips FROM f""")
def anchor_counts(spark, sf_dir):
    """Identifiers of each turn and those that the turn's own text doesn't hold (none)."""
    rows = table(spark, sf_dir, "conversations").withColumn("context", F.col("text"))
    rows = briefing.anchor_stats(rows).where(F.size("unanchored") == 0)
    return rows.select("conv_id", "turn", F.size(identifiers.facts(F.col("text"), kinds=("ipv4",))).cast("bigint").alias("ips"))


_A = "regexp_extract_all(html, '<a href=\"[^\"]*\"')"


@query(f"SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, replace(regexp_extract(a[i], 'href=\"([^\"]*)\"', 1), '&amp;', '&') AS href FROM (SELECT page_id, {_A} AS a, unnest(range(1, len({_A}) + 1)) AS i FROM pages)")
def page_links(spark, sf_dir):
    return P.anchors(table(spark, sf_dir, "pages")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href")


@query(f"SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, CAST(i AS BIGINT) AS rank FROM (SELECT page_id, unnest(range(1, least(5, len({_A})) + 1)) AS i FROM pages)")
def page_links_first(spark, sf_dir):
    links = P.anchors(table(spark, sf_dir, "pages"))
    return P.first_per_page(links, "page_id", "url").select("page_id", F.col("pos").cast("bigint").alias("pos"), F.col("rank").cast("bigint").alias("rank"))


_NAV, _ARTICLE = (f"regexp_extract(html, '(?s)<{t}>(.*?)</{t}>', 1)" for t in ("nav", "article"))


@query(f"""
SELECT page_id, CAST(len(regexp_extract_all({_NAV}, '<a href="/')) AS BIGINT) AS menu, CAST(len(regexp_extract_all({_ARTICLE}, '<h1>')) AS BIGINT) AS heads, CAST(len(regexp_extract_all(html, '<div class="ad">')) AS BIGINT) AS adverts,
CAST(len(regexp_extract_all({_ARTICLE}, '<p>')) AS BIGINT) AS parts, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items FROM pages""")
def page_selectors(spark, sf_dir):
    """How many nodes of each page some selectors pick."""
    rows = N.node_rows(table(spark, sf_dir, "pages").select("page_id", "html"))
    shapes = {"menu": "nav > ul li > a[href^='/']", "heads": "article > h1", "adverts": "body > div.ad", "parts": "article p", "items": "nav li, body > ul > li, article li, li"}
    for name, shape in shapes.items():
        rows = N.select(rows, ["page_id"], shape, name)
    return rows.groupBy("page_id").agg(*[F.count_if(name).alias(name) for name in shapes])


_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@query(f"""
SELECT DISTINCT page_id, regexp_extract(url, '^https?://[^/?#]*') || regexp_replace(href, '#.*$', '') AS link FROM
(SELECT page_id, url, replace(regexp_extract(unnest({_A}), 'href="([^"]*)"', 1), '&amp;', '&') AS href FROM pages) WHERE {_HOST} LIKE '%.example.com' AND href LIKE '/%' AND regexp_matches(regexp_extract(href, '^[^?#]*'), '^/[a-z]+$') AND len(href) > 0""")
def page_links_confined(spark, sf_dir):
    """Links that stay on the hosts of one domain, which are a table, not a list."""
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(network.url_part(F.col("url"), "host").alias("host")).where("host like '%.example.com'").distinct()
    return P.links_on_hosts(P.anchors(pages), "page_id", hosts, "^/[a-z]+$").select("page_id", "link")


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS link FROM pages WHERE regexp_replace(url, '[?#].*$', '') NOT IN (SELECT regexp_replace(url, '[?#].*$', '') FROM pages WHERE page_id % 3 = 0)")
def seen_url_anti(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("link"))
    return P.unseen(rows, rows.where("page_id % 3 = 0").select(F.col("link").alias("url"))).select("page_id", "link")


@query(f"""
SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) AS scheme, {_HOST} AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment, true AS admissible FROM pages""")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", *[network.url_part(url, p).alias(p) for p in ("scheme", "host", "path", "query", "fragment")], network.url_is_admissible(url).alias("admissible"))


@query(f"SELECT page_id, n FROM (SELECT page_id, CAST(row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS BIGINT) AS n FROM pages) WHERE n <= 3")
def pages_capped_per_host(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", network.url_part(F.col("url"), "host").alias("host"))
    kept = P.cap_per_source(rows, "host", 3, "page_id")
    from pyspark.sql import Window as W

    return kept.select("page_id", F.row_number().over(W.partitionBy("host").orderBy("page_id")).cast("bigint").alias("n"))


_FOLD = "trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))"


_HIDDEN = f"regexp_replace({_FOLD}, '(?i)\\b(token|password|authorization)\\b(\\s*[:=]\\s*)(?:bearer\\s+)?\\S+', '\\1\\2[redacted]', 'g')"


@query(f"""
SELECT doc_id, CAST(len(string_split({_FOLD}, ' ')) AS BIGINT) AS words, substr({_HIDDEN}, 1, 500) AS one_line, substr(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), 1, 80) AS cleaned,
CASE WHEN len(string_split({_FOLD}, ' ')) > 320 THEN array_to_string(string_split({_FOLD}, ' ')[1:300], ' ') || '...' ELSE text END AS short FROM documents""")
def sanitised_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(T.fold_space(t), " ")).cast("bigint").alias("words"), T.sanitize_error(t).alias("one_line"), T.clean(t).alias("cleaned"), T.truncate_words(t).alias("short"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\n\s*\n+'), lambda s: trim(s) <> '')) AS BIGINT) AS sections, regexp_matches(text, '(?m)^\s*#{1,6}\s|\*\*|^\s*[-*]\s+|^\s*\d+\.\s+') AS markdown FROM documents")
def text_structure(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sections(t)).cast("bigint").alias("sections"), T.has_markdown(t).alias("markdown"))


@query("""
WITH e AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS n, event_id % 33 AS bits FROM events), c AS (SELECT *, n - n % CAST(pow(2, 32 - bits) AS BIGINT) AS b FROM e)
SELECT event_id, (b // 16777216) || '.' || ((b // 65536) % 256) || '.' || ((b // 256) % 256) || '.' || (b % 256) || '/' || bits AS block FROM c""")
def cidr_blocks(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    number = (F.col("event_id") * F.lit(2654435761)) % F.lit(4294967296)
    text = F.concat(network.ip_text(number), F.lit("/"), (F.col("event_id") % 33).cast("string"))
    return ev.select("event_id", network.cidr(text).alias("block"))


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"
_PLAIN = "regexp_matches(lower(string_split(text, ' ')[{}]), '^[a-z]{{5,}}$')"


@query(f"""
WITH c AS (SELECT DISTINCT lower(string_split(text, ' ')[1]) AS name FROM documents WHERE {_PLAIN.format(1)}) SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest({_WORDS}) AS name FROM documents) WHERE name IN (SELECT name FROM c)""")
def catalog_mentions(spark, sf_dir):
    """Every document against a catalog of all first words, in one pass over each text."""
    docs = table(spark, sf_dir, "documents")
    first = F.lower(F.substring_index("text", " ", 1))
    catalog = docs.where(first.rlike("^[a-z]{5,}$")).select(F.lit("word").alias("category"), first.alias("id"), F.initcap(first).alias("name"), F.array(F.upper(first)).alias("aliases")).distinct()
    return extraction.catalog_mentions(docs, catalog).select("doc_id", F.col("id").alias("name"))


@query(f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words, lower(string_split(text, ' ')[1]) AS a, lower(string_split(text, ' ')[-1]) AS b FROM documents),
p AS (SELECT doc_id, words, a AS name FROM d UNION ALL SELECT doc_id, words, b FROM d UNION ALL SELECT doc_id, words, a || 'x' FROM d) SELECT doc_id, name FROM p WHERE regexp_matches(name, '^[a-z]{{5,}}$') AND list_contains(words, name)""")
def grounded_names(spark, sf_dir):
    """Names that were proposed for a document, some of which it doesn't hold."""
    docs = table(spark, sf_dir, "documents")
    words = F.split(F.lower("text"), " ")
    given = F.array(words[0], F.element_at(words, -1), F.concat(words[0], F.lit("x")))
    names = docs.select("doc_id", F.lit("sectors").alias("category"), F.explode(given).alias("name")).where(F.col("name").rlike("^[a-z]{5,}$"))
    return extraction.grounded_names(names, docs).select("doc_id", "name")


_CVE = r"CVE\s*-\s*[0-9]{4}\s*-\s*[0-9]+(?:\r?\n[ \t]*[0-9]+)*"
_BROKEN = "' cve - 2024-' || substr(CAST(10000 + doc_id AS VARCHAR), 1, 2) || chr(10) || '  ' || substr(CAST(10000 + doc_id AS VARCHAR), 3) || ' end' || CASE WHEN doc_id % 2 = 0 THEN '; CVE-2024-' || (10000 + doc_id) ELSE '' END"


@query(rf"""
WITH d AS (SELECT doc_id, text || {_BROKEN} AS t FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?i)(^|[^A-Za-z0-9])({_CVE})', 2)) AS raw FROM d),
n AS (SELECT doc_id, 'CVE-' || regexp_extract(raw, '(?i)CVE\s*-\s*([0-9]{{4}})', 1) || '-' || regexp_replace(regexp_extract(raw, '(?is)CVE\s*-\s*[0-9]{{4}}\s*-\s*(.*)$', 1), '\s+', '', 'g') AS id FROM m)
SELECT doc_id, id, count(*) AS n FROM n WHERE regexp_matches(id, '^CVE-[0-9]{{4}}-[0-9]{{4,10}}$') GROUP BY ALL""")
def cve_candidates(spark, sf_dir):
    """Ids in whole texts, one broken over lines and one not appended to each."""
    docs = table(spark, sf_dir, "documents")
    number = (F.lit(10000) + F.col("doc_id")).cast("string")
    broken = F.concat(F.substring(number, 1, 2), F.lit("\n  "), F.substring(number, 3, 20))
    text = F.concat("text", F.lit(" cve - 2024-"), broken, F.lit(" end"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("; CVE-2024-"), number)).otherwise(""))
    found = extraction.cve_candidates(docs.select("doc_id", text.alias("text")))
    return found.select("doc_id", "id", F.col("occurrence_count").cast("bigint").alias("n"))
