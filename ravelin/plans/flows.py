"""Queries over schedules, poll cycles, bulletins, citations and briefings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions import text as T
from ..operators import briefing, evaluate, extraction, flows, lifecycle, ranked, resolve
from ..session import stored
from .registry import AS_OF, dealt, now, query, table
from .texts import _HEX, _IP

_RUNS = "r AS (SELECT 'u' || user_id AS job, 3600 * (1 + user_id % 300) AS span, max(ts) AS last, count(*) FILTER (WHERE event_type = 'click' AND event_id % 50 = 0) AS open FROM events GROUP BY ALL)"


@query(f"""
WITH {_RUNS}, n AS (SELECT job, open > 0 AS running, epoch_us(to_timestamp(floor(epoch(last)) + span)) AS base FROM r)
SELECT job, running, NOT running AND base + 0 <= epoch_us(TIMESTAMP '{AS_OF}') AS due, base AS next_run FROM n""")
def job_schedule(spark, sf_dir):
    """Jobs by interval and last start, without the fixed delay."""
    ev = table(spark, sf_dir, "events").withColumn("job", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    jobs = ev.select("job", (F.lit(3600) * (1 + F.col("user_id") % 300)).alias("interval_seconds")).distinct()
    runs = ev.select("job", F.col("ts").alias("started_at"), F.when((F.col("event_type") != "click") | (F.col("event_id") % 50 != 0), F.col("ts")).alias("ended_at"))
    return lifecycle.schedule(jobs, runs, now(), jitter=0).select("job", "running", "due", F.unix_micros("next_run").alias("next_run"))


@query(f"""
WITH s AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'view' GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events),
i AS (SELECT user_id, count(DISTINCT event_id // 3) AS polled, count(DISTINCT event_id // 3) FILTER (WHERE (event_id // 3) % 4 <> 0) AS fresh FROM events GROUP BY 1),
d AS (SELECT user_id, last, last IS NULL OR floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(last)) >= 3600 * (1 + user_id % 200) AS due FROM u LEFT JOIN s USING (user_id))
SELECT user_id AS source, due, CASE WHEN due THEN polled ELSE 0 END AS polled, CASE WHEN due THEN fresh ELSE 0 END AS fresh, epoch_us(CASE WHEN due THEN TIMESTAMP '{AS_OF}' ELSE last END) AS last_attempt FROM d JOIN i USING (user_id)""")
def poll_cycle(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    sources = ev.select(F.col("user_id").alias("source"), (1 + F.col("user_id") % 200).alias("interval_hours")).distinct()
    state = ev.where("event_type = 'view'").groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("last_attempt")).withColumn("last_polled", F.lit(None).cast("timestamp"))
    url = F.floor(F.col("event_id") / 3)
    items = ev.select(F.col("user_id").alias("source"), url.alias("url"))
    known = ev.select(url.alias("url")).where("url % 4 = 0")
    out = lifecycle.poll_cycle(sources, state, items, known, now())
    return out.select("source", "due", "polled", "fresh", F.unix_micros("last_attempt").alias("last_attempt"))


@query("""
WITH k AS (SELECT DISTINCT lower(p_type) AS key FROM part UNION SELECT lower(string_split(p_type, ' ')[-1]) FROM part),
q AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'malware' ELSE 'sector' END AS category, p_partkey % 5 <> 0 AS pending, lower(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END) AS key FROM part)
SELECT category, count(*) FILTER (WHERE pending) AS pending, count(*) FILTER (WHERE pending AND category = 'malware' AND key IN (SELECT key FROM k)) AS matched FROM q GROUP BY 1""")
def collector_rematch(spark, sf_dir):
    from .relations import _catalog, _queue

    return lifecycle.collector_cycle(_queue(spark, sf_dir), resolve.catalog_index(_catalog(spark, sf_dir)))


@query(r"""
WITH d AS (SELECT doc_id, 'Advisory' || chr(10) || substr(text, 1, 0) || CASE doc_id % 4 WHEN 0 THEN 'Malicious host 192.0.2.7 was seen.' WHEN 1 THEN 'There is no active exploitation of 192.0.2.7 so far.' WHEN 2 THEN 'Host 192.0.2.7 was seen.' ELSE 'Body.' || chr(10) || 'References' || chr(10) || 'see 192.0.2.7' END AS t FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'bulletin_no_active_exploitation' WHEN 3 THEN 'bulletin_reference_section' END AS reason FROM d""")
def bulletin_reasons(spark, sf_dir):
    """One address in four kinds of bulletins."""
    m = F.col("doc_id") % 4
    text = F.when(m == 0, "Malicious host 192.0.2.7 was seen.").when(m == 1, "There is no active exploitation of 192.0.2.7 so far.").when(m == 2, "Host 192.0.2.7 was seen.").otherwise("Body.\nReferences\nsee 192.0.2.7")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Advisory\n"), text).alias("text"), F.lit("bulletin").alias("source_type"))
    proposed = docs.select("doc_id", F.lit("ip").alias("type"), F.lit("192.0.2[.]7").alias("value"), F.lit(0).alias("pos"), F.lit(0).alias("rank"))
    return extraction.judge(proposed, docs).select("doc_id", "reason")


@query(r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS t FROM documents), e AS (SELECT doc_id, t, CASE doc_id % 3 WHEN 0 THEN substr(t, 5, 40) WHEN 1 THEN 'never said ' || doc_id ELSE '' END AS q FROM d)
SELECT doc_id FROM e WHERE trim(q) <> '' AND contains(t, trim(regexp_replace(q, '[\s\p{Z}]+', ' ', 'g')))""")
def cited_entities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    quote = F.when(F.col("doc_id") % 3 == 0, F.substring(T.fold_space(F.col("text")), 5, 40)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("never said "), F.col("doc_id").cast("string"))).otherwise("")
    entities = docs.select("doc_id", F.lit("x").alias("value"), quote.alias("quote"))
    return extraction.cited(entities, docs).select("doc_id")


@query("""
SELECT o_orderkey, o_custkey % 50 + 20 AS total, o_orderkey % 20 AS fresh, CASE WHEN o_orderkey % 3 = 0 THEN false ELSE true END AS new_ok, true AS total_ok FROM orders""")
def number_claims(spark, sf_dir):
    """Numbers that briefings give, against those of their context; a third give a wrong number of new ones."""
    total, fresh = F.col("o_custkey") % 50 + 20, F.col("o_orderkey") % 20
    said = F.when(F.col("o_orderkey") % 3 == 0, fresh + 1).otherwise(fresh)
    text = F.concat(F.lit("A total of "), total.cast("string"), F.lit(" indicators were observed; "), said.cast("string"), F.lit(" new indicators among them."))
    context = F.concat(F.lit("IOC activity in period: "), total.cast("string"), F.lit(" indicators total ("), fresh.cast("string"), F.lit(" newly created, 1 pre-existing ones re-updated)."))
    runs = dealt(table(spark, sf_dir, "orders")).select("o_orderkey", total.cast("bigint").alias("total"), fresh.cast("bigint").alias("fresh"), text.alias("text"), context.alias("context"))
    return evaluate.measure(runs).select("o_orderkey", "total", "fresh", "new_ok", "total_ok")


@query("""
WITH t AS (SELECT DISTINCT p_type FROM part), k AS (SELECT DISTINCT lower(string_split(p_type, ' ')[1]) AS keyword FROM part UNION SELECT DISTINCT lower(p_brand) FROM part)
SELECT keyword, arg_min(p_type, (lower(p_type) <> keyword, length(p_type), p_type)) AS technique FROM k JOIN t ON contains(lower(p_type), keyword) GROUP BY 1""")
def technique_by_keyword(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    keywords = part.select(F.lower(F.substring_index("p_type", " ", 1)).alias("keyword")).union(part.select(F.lower("p_brand"))).distinct()
    names = part.select(F.col("p_type").alias("id"), F.col("p_type").alias("name")).distinct()
    return resolve.technique_lookup(keywords, names).select("keyword", "technique")


@query(f"""
WITH i AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_IP}')) AS v FROM documents), h AS (SELECT DISTINCT doc_id, v FROM (SELECT doc_id, {_HEX} AS v FROM documents) WHERE length(v) IN (32, 40, 64)),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS words, lower(string_split(text, ' ')[1]) AS name FROM documents)
SELECT 'indicators' AS part, doc_id, v AS value FROM i UNION ALL SELECT 'indicators', doc_id, v FROM h UNION ALL SELECT 'rejected', doc_id, 'absent-' || doc_id || '.example ungrounded' FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT 'rejected', doc_id, 'empty' FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'names', doc_id, name FROM w WHERE regexp_matches(name, '^[a-z]{{5,}}$') AND list_contains(words, name)
UNION ALL SELECT DISTINCT 'vulnerabilities', doc_id, upper(unnest(regexp_extract_all(text, '(?i)\\bCVE-\\d{{4}}-\\d{{4,7}}\\b'))) FROM documents""")
def flow_extract(spark, sf_dir):
    """Documents to indicators, rejections, names and vulnerability ids, with proposed values that no document holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("report").alias("source_type"))
    ips = F.transform(identifiers.facts(F.col("text"), kinds=("ipv4",)), lambda x: F.struct(F.lit("ip").alias("type"), x["value"].alias("value")))
    wrong = F.when(F.col("doc_id") % 5 == 0, F.struct(F.lit("domain").alias("type"), F.concat(F.lit("absent-"), F.col("doc_id").cast("string"), F.lit(".example")).alias("value")))
    blank = F.when(F.col("doc_id") % 7 == 0, F.struct(F.lit("url").alias("type"), F.lit(" ").alias("value")))
    proposed = docs.select("doc_id", F.posexplode(F.concat(ips, F.array_compact(F.array(wrong, blank)))).alias("pos", "x")).select("doc_id", "x.type", "x.value", "pos")
    first = F.lower(F.split("text", " ")[0])
    names = docs.select("doc_id", F.lit("sectors").alias("category"), F.explode(F.array(first, F.concat(first, F.lit("x")))).alias("name")).where(F.col("name").rlike("^[a-z]{5,}$"))
    out = flows.extract(docs, proposed, names)
    part = lambda name, value: out[name].select(F.lit(name).alias("part"), "doc_id", value.alias("value"))
    rejected = F.trim(F.concat_ws(" ", "value", "reason"))
    return part("indicators", F.col("value")).unionByName(part("rejected", rejected)).unionByName(part("names", F.col("name"))).unionByName(part("vulnerabilities", F.col("name")))


@query("""
WITH k AS (SELECT DISTINCT lower(p_name) || ' ' || lower(p_brand) AS keyword FROM part),
w AS (SELECT p_partkey AS id, unnest(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[\\p{L}\\p{N}]+')) AS term FROM part), f AS (SELECT id, term, count(*) AS tf FROM w GROUP BY 1, 2),
n AS (SELECT id, sum(tf) AS n FROM f GROUP BY 1), t AS (SELECT count(*) AS every, sum(n) AS words FROM n), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
p AS (SELECT term, id, CAST(floor(1000 * ln(1 + (every - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n * every / words))) AS BIGINT) AS gain FROM f JOIN n USING (id) JOIN d USING (term), t),
q AS (SELECT DISTINCT keyword, unnest(regexp_extract_all(keyword, '[\\p{L}\\p{N}]+')) AS term FROM k), s AS (SELECT keyword, id, CAST(sum(gain) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, id) AS rank FROM s) SELECT keyword, rank, id, score FROM r WHERE rank <= 5""")
def ranked_entities(spark, sf_dir):
    """The five entities that are most relevant for each keyword of several words."""
    part = table(spark, sf_dir, "part")
    lists = stored(ranked.postings(part, F.concat_ws(" ", "p_name", "p_brand", "p_type"), "p_partkey"), "postings")
    keywords = part.select(F.concat_ws(" ", F.lower("p_name"), F.lower("p_brand")).alias("keyword"))
    return ranked.best(keywords, lists, 5, key="p_partkey").withColumnRenamed("p_partkey", "id")


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment ELSE '' END AS exact, CASE c_custkey % 3 WHEN 1 THEN c_mktsegment ELSE '' END AS corrupt,
CASE c_custkey % 3 WHEN 2 THEN c_mktsegment || ',' ELSE '' END || 'Zq' || c_custkey || 'vx' AS omitted FROM customer""")
def names_given(spark, sf_dir):
    """Names that a text gives as they are, with a letter doubled, or not at all."""
    name, m = F.col("c_mktsegment"), F.col("c_custkey") % 3
    said = F.when(m == 0, name).when(m == 1, F.concat(name, F.substring(name, -1, 1))).otherwise("nobody")
    text = F.concat(F.lit("Reports say that "), said, F.lit(" was seen again."))
    names = F.array(name, F.concat(F.lit("Zq"), F.col("c_custkey").cast("string"), F.lit("vx")))
    rows = evaluate.name_fidelity(dealt(table(spark, sf_dir, "customer")).select("c_custkey", text.alias("text"), names.alias("names")))
    return rows.select("c_custkey", *[F.array_join(c, ",").alias(c) for c in ("exact", "corrupt", "omitted")])


@query("SELECT count(*) AS pairs, count(*) FILTER (WHERE doc_id % 4 = 0) AS retried, count(*) FILTER (WHERE length(text) > 0 AND doc_id % 8 = 0) AS changed FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels)")
def paired_drafts(spark, sf_dir):
    """Drafts before and after a control that cuts each eighth text; those without a label have no second draft."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    again = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    after = again.select("doc_id", F.when(F.col("doc_id") % 8 == 0, F.lit("")).otherwise(F.col("text")).alias("text"), (F.col("doc_id") % 4 == 0).alias("retried"))
    return evaluate.paired(docs, after, "doc_id")


@query("""
WITH c AS (SELECT user_id % 40 AS a, event_id % 25 AS b, event_type, ts, event_id FROM events)
SELECT event_type AS category, 'n' || a AS candidate_name, 'u' || b AS source_url, arg_min(event_id, (ts, event_id)) AS id FROM c WHERE NOT (event_type = 'view' AND a % 2 = 0) GROUP BY ALL""")
def queue_enqueued(spark, sf_dir):
    """Candidates that the queue lacks, each once: the even names of one category are queued already."""
    ev = table(spark, sf_dir, "events")
    name = lambda letter, value: F.concat(F.lit(letter), value.cast("string"))
    rows = ev.select("event_id", F.col("event_type").alias("category"), name("n", F.col("user_id") % 40).alias("candidate_name"), name("u", F.col("event_id") % 25).alias("source_url"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"), (F.col("user_id") % 2 == 0).alias("even"))
    queued = rows.where("category = 'view' and even").select("category", "candidate_name", "source_url").distinct()
    return resolve.enqueue(queued, rows.drop("event_id", "even")).select("category", "candidate_name", "source_url", "id")


@query("SELECT n_name AS name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 3 = 0")
def curated_rows(spark, sf_dir):
    """Rows of the authors on a list, whose ids come from their exact names."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    chosen = [r["name"] for r in nation.where("id % 3 = 0").collect()]  # 25 nations at most
    authors = resolve.resolve_authors(nation, chosen)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("author_id"))
    return briefing.curated(rows, authors).join(authors, F.col("author_id") == authors["id"]).select("name", "s_suppkey")
