"""Relational queries: resolution, targeting graph, look-back windows, state, evaluation, over the star schema and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import briefing, digests, evaluate, graph, lifecycle, resolve, sketches
from ..session import shared_dir
from ..sources import tables
from .registry import query, table


def _catalog(spark, sf_dir):
    """Part types as entities whose aliases are the first two words and the last word of the type."""
    types = table(spark, sf_dir, "part").select("p_type").distinct()
    return types.select(F.lit("malware").alias("category"), F.col("p_type").alias("id"), F.initcap("p_type").alias("name"), F.array(F.concat(F.lit("The  "), F.col("p_type"), F.lit("!")), F.substring_index("p_type", " ", -1)).alias("aliases"))


_INDEX = """
k AS (SELECT lower(p_type) AS key, p_type AS id, 0 AS pos FROM t UNION ALL SELECT lower(p_type), p_type, 1 FROM t UNION ALL SELECT lower(string_split(p_type, ' ')[-1]), p_type, 2 FROM t),
i AS (SELECT key, arg_min(id, id || '|' || pos) AS id FROM k GROUP BY 1)"""
_T = "t AS (SELECT DISTINCT p_type FROM part)"


@query(f"WITH {_T}, {_INDEX} SELECT key, id FROM i")
def catalog_index(spark, sf_dir):
    return resolve.catalog_index(_catalog(spark, sf_dir)).select("key", F.upper("canonical").alias("u"), "canonical").join(table(spark, sf_dir, "part").select(F.upper("p_type").alias("u"), F.col("p_type").alias("id")).distinct(), "u").select("key", "id")


@query(f"WITH {_T}, {_INDEX}, n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'the ' || lower(p_type) WHEN 1 THEN '  ' || upper(p_type) || '.' WHEN 2 THEN string_split(p_type, ' ')[-1] ELSE p_name END AS name, CASE p_partkey % 4 WHEN 3 THEN lower(p_name) WHEN 2 THEN lower(string_split(p_type, ' ')[-1]) ELSE lower(p_type) END AS key FROM part) SELECT p_partkey, lower(i.id) AS canonical FROM n LEFT JOIN i USING (key)")
def closed_world_resolve(spark, sf_dir):
    part, m = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    name = F.when(m == 0, F.concat(F.lit("the "), F.lower("p_type"))).when(m == 1, F.concat(F.lit("  "), F.upper("p_type"), F.lit("."))).when(m == 2, F.substring_index("p_type", " ", -1)).otherwise(F.col("p_name"))
    rows = part.select("p_partkey", F.lit("malware").alias("category"), name.alias("name"))
    return resolve.resolve(rows, resolve.catalog_index(_catalog(spark, sf_dir))).select("p_partkey", F.lower("canonical").alias("canonical"))


_SECTOR_VALUES = ", ".join("('" + k.lower().replace("'", "''") + "', '" + name + "', " + str(n) + ")" for n, (name, others) in enumerate(resolve.SECTORS.items()) for k in (name, *others))


@query(f"""
WITH tax AS (SELECT key, arg_min(canonical, n) AS canonical FROM (VALUES {_SECTOR_VALUES}) AS v(key, canonical, n) GROUP BY 1),
n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Banking' WHEN 1 THEN 'policy research and defense analysis' WHEN 2 THEN 'oil and gas' WHEN 3 THEN 'Energy, ' || p_name ELSE p_name || ' / x' END AS name FROM part),
w AS (SELECT n.*, tax.canonical AS whole FROM n LEFT JOIN tax ON lower(n.name) = tax.key),
p AS (SELECT p_partkey, name, trim(unnest(regexp_split_to_array(name, '(?i)\\s+and\\s+|\\s*,\\s*|\\s*/\\s*'))) AS part FROM w WHERE whole IS NULL),
r AS (SELECT p.*, tax.canonical, bool_or(tax.canonical IS NOT NULL) OVER (PARTITION BY p_partkey) AS hit FROM p LEFT JOIN tax ON lower(p.part) = tax.key)
SELECT p_partkey, name AS part, whole AS canonical FROM w WHERE whole IS NOT NULL UNION ALL SELECT p_partkey, part, canonical FROM r WHERE hit UNION ALL SELECT DISTINCT p_partkey, name, NULL FROM r WHERE NOT hit""")
def compound_split(spark, sf_dir):
    m = F.col("p_partkey") % 5
    name = F.when(m == 0, "Banking").when(m == 1, "policy research and defense analysis").when(m == 2, "oil and gas").when(m == 3, F.concat(F.lit("Energy, "), "p_name")).otherwise(F.concat("p_name", F.lit(" / x")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("sector").alias("category"), name.alias("name"))
    return resolve.resolve_compound(rows, resolve.taxonomy(spark)).select("p_partkey", "part", "canonical")


@query("SELECT l_orderkey, CAST(s AS BIGINT) AS l_suppkey FROM (SELECT l_orderkey, s, row_number() OVER (PARTITION BY l_orderkey ORDER BY s) AS n FROM (SELECT DISTINCT l_orderkey, CAST(l_suppkey AS VARCHAR) AS s FROM lineitem)) WHERE n <= 2")
def capped_members(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("actor").alias("category"), F.col("l_suppkey").cast("string").alias("name"))
    return resolve.capped(rows, {"actor": 2}).select(F.col("doc_id").alias("l_orderkey"), F.col("name").cast("bigint").alias("l_suppkey"))


def _members(spark, sf_dir):
    kinds = {"actor": "l_suppkey", "malware": "l_linenumber", "sector": "l_returnflag", "cve": "l_partkey"}
    each = F.array(*[F.struct(F.lit(k).alias("category"), F.concat(F.lit(k), F.col(c).cast("string")).alias("name")) for k, c in kinds.items()])
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.inline(each))


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS d, 'actor' || l_suppkey AS n FROM lineitem), m AS (SELECT DISTINCT l_orderkey AS d, 'malware' || l_linenumber AS n FROM lineitem),
s AS (SELECT DISTINCT l_orderkey AS d, 'sector' || l_returnflag AS n FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS d, 'cve' || l_partkey AS n FROM lineitem), one AS (SELECT d FROM a GROUP BY 1 HAVING count(*) = 1),
e AS (SELECT d, a.n AS f, s.n AS t, 'actor-sector' AS axis FROM a JOIN s USING (d) UNION ALL SELECT d, m.n, s.n, 'malware-sector' FROM m JOIN s USING (d) UNION ALL SELECT d, a.n, c.n, 'actor-cve' FROM a JOIN c USING (d) JOIN one USING (d))
SELECT axis, d % 100 AS bucket, count(*) AS n, count(DISTINCT f) AS sources, count(DISTINCT t) AS targets FROM e GROUP BY 1, 2""")
def targeting_axes(spark, sf_dir):
    edges = graph.axes(_members(spark, sf_dir))
    return edges.groupBy("axis", (F.col("doc_id") % 100).alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("from_name").alias("sources"), F.count_distinct("to_name").alias("targets"))


@query("SELECT l_partkey AS to_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_used_targets(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "uses").otherwise("related-to")
    return graph.top_targets(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("to_id"), kind.alias("relationship_type")))


@query("""
WITH o AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS c, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY * (o_orderkey % 9) AS u FROM orders)
SELECT count(*) FILTER (WHERE u > TIMESTAMP '1998-06-01' AND u < TIMESTAMP '1998-07-01') AS total_touched, count(*) FILTER (WHERE c > TIMESTAMP '1998-06-01' AND c < TIMESTAMP '1998-07-01') AS total_new,
greatest(count(*) FILTER (WHERE u > TIMESTAMP '1998-06-01' AND u < TIMESTAMP '1998-07-01') - count(*) FILTER (WHERE c > TIMESTAMP '1998-06-01' AND c < TIMESTAMP '1998-07-01'), 0) AS updated_only FROM o""")
def window_totals(spark, sf_dir):
    day = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf_dir, "orders").select(day.alias("created_at"), (day + F.make_interval(days=(F.col("o_orderkey") % 9).cast("int"))).alias("updated_at"))
    return briefing.totals(rows, 720, F.lit("1998-07-01").cast("timestamp"))


@query("SELECT id, score FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 13 END AS score, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) ORDER BY coalesce(score, 0) DESC, o_orderdate DESC, id LIMIT 25")
def two_stage_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 13).alias("score"), F.col("o_orderdate").alias("updated_at"))
    return briefing.sample(rows).select("id", "score")


@query("SELECT coalesce(o_orderpriority, 'TOTAL') AS kind, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority)) ORDER BY o_orderpriority IS NULL DESC, n DESC, 1 LIMIT 31")
def type_histogram_rollup(spark, sf_dir):
    return graph.histogram(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind")), "kind", 30)


def _edges(spark, sf_dir):
    end = lambda c, kind, role: F.struct(F.concat(F.lit(kind), F.col(c).cast("string")).alias("internal_id"), F.array(F.lit(kind), F.lit("Core")).alias("types"), F.lit(role).alias("role"))
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "uses").otherwise("related-to")
    return li.select(F.col("l_orderkey").alias("id"), kind.alias("relationship_type"), F.array(end("l_suppkey", "Malware", "uses_from"), end("l_partkey", "Part", "uses_to")).alias("connections"))


@query("""
WITH e AS (SELECT 'Malware' AS type, 'M' || l_suppkey AS x FROM lineitem UNION ALL SELECT 'Part', 'P' || l_partkey FROM lineitem), b AS (SELECT * FROM e UNION ALL SELECT 'Core', x FROM e)
SELECT type, count(DISTINCT x) AS entities FROM b GROUP BY 1 HAVING count(DISTINCT x) > 20""")
def connectivity_exact(spark, sf_dir):
    return graph.connectivity(_edges(spark, sf_dir), exact=True)


@query()
def connectivity_approximate(spark, sf_dir):
    return graph.connectivity(_edges(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM supplier) AS groups, (SELECT count(*) FROM part) AS techniques, count(*) FILTER (WHERE l_returnflag = 'N') AS uses, count(*) FILTER (WHERE l_returnflag = 'N') AS malware_uses, (SELECT count(*) FROM supplier) >= 100 AND (SELECT count(*) FROM part) >= 1000 AND count(*) FILTER (WHERE l_returnflag = 'N') >= 10000 AS ready FROM lineitem")
def graph_readiness(spark, sf_dir):
    node = lambda name, kind: table(spark, sf_dir, name).select(F.lit(kind).alias("entity_type"))
    return graph.readiness(node("supplier", "Intrusion-Set").unionByName(node("part", "Attack-Pattern")), _edges(spark, sf_dir))


@query("""
WITH r AS (SELECT l_returnflag AS entity_type, CASE WHEN l_linenumber = 1 THEN CAST(o_orderdate AS DATE) WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS a, CAST(o_orderdate AS DATE) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT entity_type, count(*) AS n, count(*) FILTER (WHERE a = c) AS same, count(*) FILTER (WHERE a IS NULL) AS nulls, round(count(*) FILTER (WHERE a = c) / count(*), 6) AS share, CASE WHEN count(*) FILTER (WHERE a = c) / count(*) >= 0.9 THEN 'COLLAPSED' ELSE 'ok' END AS verdict FROM r GROUP BY 1""")
def clock_collapse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = F.when(F.col("l_linenumber") == 1, F.to_date("o_orderdate")).when(F.col("l_linenumber") != 7, F.to_date("l_shipdate"))
    return graph.clock_collapse(rows.select(F.col("l_returnflag").alias("entity_type"), own.alias("created"), "o_orderdate"), "entity_type", "created", "o_orderdate")


@query("SELECT year(o_orderdate)::BIGINT AS year, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY 1, 2")
def nodes_by_year(spark, sf_dir):
    return graph.by_year(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), "o_orderdate"), "kind", "o_orderdate").select(F.col("year").cast("bigint").alias("year"), "kind", "n")


@query("""
SELECT CASE event_type WHEN 'click' THEN 'based-on' ELSE event_type END AS relationship_type, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 0) AS sentinel, round(count(*) FILTER (WHERE user_id % 2 = 0) / count(*), 6) AS share,
event_type <> 'click' AND count(*) FILTER (WHERE user_id % 2 = 0) / count(*) > 0.5 AS alert FROM events GROUP BY event_type""")
def sentinel_share(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    at = F.when(F.col("user_id") % 2 == 0, F.lit("1970-01-01").cast("timestamp")).otherwise(F.col("ts"))
    kind = F.when(F.col("event_type") == "click", "based-on").otherwise(F.col("event_type"))
    return graph.sentinels(ev.select(kind.alias("relationship_type"), at.alias("start_time")))


@query("SELECT user_id, count(*) - 1 AS extra FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_counts(spark, sf_dir):
    return graph.duplicates(table(spark, sf_dir, "events").select("user_id"), "user_id")


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 997 IN (1, 2) THEN 'missing' END AS side FROM orders WHERE o_orderkey % 997 IN (1, 2)
UNION ALL SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 997 = 2 THEN 1 ELSE 0 END, 'unexpected' FROM orders WHERE o_orderkey % 997 IN (2, 3)""")
def digest_differences(spark, sf_dir):
    """Orders that were lost, changed or stored twice, found by the digests of their buckets."""
    o, path = table(spark, sf_dir, "orders"), f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
    m = F.col("o_orderkey") % 997
    other = o.where(m != 1).withColumn("o_custkey", F.when(m == 2, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    kept = [digests.Digested(spark, f"{path}/{k}", 64).write(rows, ["o_orderkey"]) for k, rows in enumerate((o, other.unionByName(other.where(m == 3))))]
    return digests.differences(*kept).select("o_orderkey", "o_custkey", "side")


@query("SELECT l_returnflag AS kind, count(*) AS n, count(DISTINCT l_partkey) AS exact, true AS near FROM lineitem WHERE year(l_shipdate) >= 1994 GROUP BY 1")
def merged_sketches(spark, sf_dir):
    """Distinct parts of each return flag since a year, from the sketches of the years, held against the exact number."""
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("load"), F.col("l_returnflag").alias("kind"), "l_partkey")
    found = sketches.merged(sketches.of_loads(rows, "load", ["kind"], "l_partkey"), ["kind"], F.col("load") >= 1994)
    exact = rows.where("load >= 1994").groupBy("kind").agg(F.count_distinct("l_partkey").alias("exact"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.lit(sketches.error_bound()) * F.col("exact")
    return found.join(exact, "kind").select("kind", F.col("rows").alias("n"), "exact", near.alias("near"))


@query("SELECT o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' ELSE 'unexpected' END AS side, count(*) AS n FROM orders WHERE o_orderkey % 10 IN (0, 1) GROUP BY 1, 2")
def readback_differences(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return graph.differences(o.where("o_orderkey % 10 <> 1"), o.where("o_orderkey % 10 <> 0")).groupBy("o_custkey", "side").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list('p' || l_partkey))), ',') AS refs FROM lineitem GROUP BY 1")
def report_objects(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("object_id"))
    return graph.reports(rows, "l_orderkey").select("l_orderkey", F.array_join("object_refs", ",").alias("refs"))


@query("SELECT count(DISTINCT l_orderkey * 8 + l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def relation_count(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    edges = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.when(F.col("l_returnflag") == "R", "indicates").otherwise("uses").alias("relationship_type"))
    return graph.relation_count(edges, table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id")), table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id")))


@query("""
WITH d AS (SELECT doc_id, lang AS format, n_chars FROM documents), g AS (SELECT DISTINCT d.doc_id, format, 'quality' AS type FROM d JOIN labels USING (doc_id) WHERE quality = 1 UNION ALL SELECT DISTINCT d.doc_id, format, 'toxic' FROM d JOIN labels USING (doc_id) WHERE toxic = 1),
p AS (SELECT d.doc_id, format, 'quality' AS type FROM d JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id) WHERE n_chars > 800 UNION ALL SELECT d.doc_id, format, 'toxic' FROM d JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id) WHERE n_chars % 5 = 0),
o AS (SELECT coalesce(p.format, g.format) AS format, coalesce(p.type, g.type) AS type, CASE WHEN p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN 1 ELSE 0 END AS tp, CASE WHEN g.doc_id IS NULL THEN 1 ELSE 0 END AS fp, CASE WHEN p.doc_id IS NULL THEN 1 ELSE 0 END AS fn FROM p FULL JOIN g USING (doc_id, type)),
s AS (SELECT type, format, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM o GROUP BY GROUPING SETS ((type), (format))),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM s)
SELECT type, format, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r""")
def micro_prf(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("format"), "n_chars"), table(spark, sf_dir, "labels")
    value = F.lit("1").alias("value")
    marked = docs.join(labels, "doc_id")
    gold = marked.select("doc_id", "format", F.explode(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))).alias("type"), value).where("type is not null")
    said = marked.select("doc_id", "format", F.explode(F.array(F.when(F.col("n_chars") > 800, "quality"), F.when(F.col("n_chars") % 5 == 0, "toxic"))).alias("type"), value).where("type is not null")
    return evaluate.micro(evaluate.outcomes(said, gold))


@query("""
SELECT role, count(*) AS runs, round_even(avg(length(text)), 4) AS chars_mean, round_even(stddev_samp(length(text)), 4) AS chars_sd, count(*) FILTER (WHERE turn > 2) || '/' || count(*) AS late,
round_even(sum(turn) / sum(length(text)), 4) AS ratio FROM conversations GROUP BY 1""")
def run_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", F.length("text").alias("chars"), (F.col("turn") > 2).alias("late"), "turn")
    return evaluate.summarize(rows, ["role"], ["chars"], ["late"], ("turn", "chars"))


def _log(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "previewed").when(F.col("event_type") == "view", "ingested").otherwise("failed")
    return ev.select(F.col("user_id").alias("document_key"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("report_id"), F.lit("x").alias("error"), (F.col("event_id") % 11).alias("indicator_count"), (F.col("event_id") % 3 != 0).alias("update_totals"))


_LOG = "l AS (SELECT user_id AS k, CASE event_type WHEN 'click' THEN 'previewed' WHEN 'view' THEN 'ingested' ELSE 'failed' END AS kind, ts AS tm, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'r' || event_id END AS report_id, event_id % 11 AS n, event_id % 3 <> 0 AS upd FROM events)"


@query(f"""
WITH {_LOG}, x AS (SELECT k, arg_max(kind, (tm, seq)) AS last, arg_max(kind, (tm, seq)) FILTER (WHERE kind <> 'previewed') AS last_other, min(tm) FILTER (WHERE kind = 'ingested') AS first, max(tm) FILTER (WHERE kind = 'ingested') AS ing, max(tm) FILTER (WHERE kind = 'failed') AS fail, max(tm) AS upd,
arg_max(report_id, (tm, seq)) FILTER (WHERE kind <> 'previewed' AND report_id IS NOT NULL) AS report_id FROM l GROUP BY 1)
SELECT k AS document_key, CASE WHEN last = 'previewed' AND last_other = 'ingested' THEN 'ingested' ELSE last END AS status, epoch_us(first) AS first_ingested_at, epoch_us(ing) AS ingested_at, epoch_us(fail) AS failed_at, epoch_us(upd) AS updated_at, report_id FROM x""")
def document_fold(spark, sf_dir):
    s = lifecycle.documents(_log(spark, sf_dir))
    return s.select("document_key", "status", *[F.unix_micros(c).alias(c) for c in ("first_ingested_at", "ingested_at", "failed_at", "updated_at")], "report_id")


@query(f"WITH {_LOG}, f AS (SELECT k, arg_min(n, (tm, seq)) AS n, arg_min(upd, (tm, seq)) AS upd, min(tm) AS tm FROM l WHERE kind = 'ingested' GROUP BY 1) SELECT count(*) AS total_docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_iocs, epoch_us(max(tm)) AS last_run FROM f WHERE upd")
def first_ingestion_totals(spark, sf_dir):
    return lifecycle.totals(_log(spark, sf_dir)).select("total_docs", "total_iocs", F.unix_micros("last_run").alias("last_run"))


@query(f"WITH {_LOG} SELECT k AS document_key, epoch_us(max(tm)) AS updated_at FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def recent_documents(spark, sf_dir):
    return lifecycle.recent_documents(lifecycle.documents(_log(spark, sf_dir))).select("document_key", F.unix_micros("updated_at").alias("updated_at"))


@query("SELECT event_type AS source, count(*) FILTER (WHERE user_id % 4 = 0) AS new, count(*) FILTER (WHERE user_id % 4 = 1) AS known, count(*) FILTER (WHERE user_id % 4 = 2) AS processed, count(*) FILTER (WHERE user_id % 4 = 3) AS failed FROM events GROUP BY 1")
def cycle_counts(spark, sf_dir):
    outcome = F.element_at(F.array(*map(F.lit, ("new", "known", "processed", "failed"))), (F.col("user_id") % 4 + 1).cast("int"))
    return lifecycle.cycle_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), outcome.alias("outcome")))


def _queue(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 2 == 0, "malware").otherwise("sector")
    status = F.when(F.col("p_partkey") % 5 == 0, "rejected").otherwise("pending")
    return p.select(F.col("p_partkey").alias("id"), kind.alias("category"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("candidate_name"), status.alias("status"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'rejected' WHEN p_partkey % 2 = 0 AND (p_partkey % 3 <> 0 OR lower(p_name) IN (SELECT lower(p_type) FROM part UNION SELECT lower(string_split(p_type, ' ')[-1]) FROM part)) THEN 'auto_matched' ELSE 'pending' END AS status FROM part")
def queue_rematch(spark, sf_dir):
    return resolve.rematch(_queue(spark, sf_dir), resolve.catalog_index(_catalog(spark, sf_dir))).select("id", "status")


@query("""
WITH q AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'malware' ELSE 'sector' END AS category, CASE WHEN p_partkey % 5 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM part),
d AS (SELECT user_id AS id, CASE event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN 'rejected' ELSE 'ignored' END AS decision, ts FROM events),
f AS (SELECT id, arg_min(decision, ts) AS decision FROM d JOIN q USING (id) WHERE status = 'pending' AND (decision = 'rejected' OR decision = 'approved' AND category = 'malware') GROUP BY 1)
SELECT id, coalesce(decision, status) AS status FROM q LEFT JOIN f USING (id)""")
def queue_decisions(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "approved").when(F.col("event_type") == "view", "rejected").otherwise("ignored")
    decisions = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), kind.alias("decision"), F.col("ts").alias("at"))
    return resolve.fold_decisions(_queue(spark, sf_dir), decisions).select("id", "status")


@query("""
WITH y AS (SELECT y, make_date(y, 1, 1) AS f, least(make_date(y + 1, 1, 1), DATE '2024-08-03') AS l FROM range(2021, 2025) AS r(y))
SELECT CAST(f + CAST(30 * k AS INT) AS VARCHAR) AS window_start, CAST(least(f + CAST(30 * (k + 1) AS INT), l) AS VARCHAR) AS window_end FROM y, range(0, 13) AS s(k) WHERE f + CAST(30 * k AS INT) < l""")
def cve_windows(spark, sf_dir):
    rows = tables.windows(spark, "2021-03-05", "2024-08-03")
    return rows.select(F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '^(the|los|las|el|la)\\s+|^[^\\w]+|[^\\w]+$', '')) AS key, length(c_name) >= 3 AS valid FROM customer")
def name_keys(spark, sf_dir):
    from ..functions import identifiers
    from ..functions.text import name_key

    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", name_key(name).alias("key"), identifiers.is_valid_name(name, F.lit("threat_actors")).alias("valid"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15' ")
def incremental_rows(spark, sf_dir):
    return tables.after_cursor(table(spark, sf_dir, "events"), F.lit("2024-01-15").cast("timestamp"), "ts").select("event_id")
