"""SQL (DuckDB) for the text queries that SQL can express."""

from __future__ import annotations

from . import rules, secrets, urls

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _glob(glob: str) -> str:
    return _quoted("^" + "".join(".*" if c == "*" else c if c.isalnum() or c in "-_/" else "\\" + c for c in glob) + "$")


def op2() -> str:
    fits = lambda r: f"(host = {_quoted(r.host)} OR ends_with(host, {_quoted('.' + r.host)})) AND starts_with(path, {_quoted(r.path)})"
    ordered = sorted(urls.RULES, key=lambda r: -len(r.name))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN {_quoted(r.name)}" for r in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN {_quoted(r.verdict)}" for r in ordered) + " WHEN gl IS NOT NULL THEN 'block' ELSE 'allow' END"
    glob = "CASE " + " ".join(f"WHEN regexp_matches(host || path, {_glob(g)}, 's') THEN {_quoted(g)}" for g in urls.BLOCKED) + " END"
    shape = _quoted(r"(?s)^.*?://([^/?#]*)([^?#]*)")
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, {shape}, 1), ''), '{_UP}', '{_LOW}') AS host, coalesce(regexp_extract(url, {shape}, 2), '') AS path FROM pages),
g AS (SELECT *, {glob} AS gl FROM p), r AS (SELECT *, {rule} AS rule FROM g)
SELECT page_id, host, path, rule, {verdict} AS verdict, CASE WHEN rule IS NULL THEN gl END AS matched FROM r"""


def op3() -> str:
    each = []
    for k, r in enumerate(secrets.RULES):
        p = _quoted(r.pattern)
        each.append(
            f"SELECT rid, {k} AS rank, {_quoted(r.kind)} AS kind, unnest(range(1, len(f) + 1)) AS i, f, g, s FROM "
            f"(SELECT rid, regexp_extract_all(t, {p}, 0) AS f, regexp_extract_all(t, {p}, {r.group}) AS g, regexp_split_to_array(t, {p}) AS s FROM d WHERE regexp_matches(t, {p}))"
        )
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(secrets.RULES))
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    count = lambda kind: f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(each)}),
p AS (SELECT rid, rank, kind, CAST({size('s[1:i]')} + {size('f[1:i-1]')} AS BIGINT) AS a, length(f[i]) AS n FROM m WHERE length(g[i]) >= CASE rank {least} END),
x AS (SELECT *, kind || ':' || a || ':' || (a + n) AS span FROM p),
y AS (SELECT rid, {count('assign')}, {count('access')}, {count('hex')}, coalesce(string_agg(span, ',' ORDER BY a, rank) FILTER (WHERE rank < 3), '') AS base, string_agg(span, ',' ORDER BY a, rank) AS spans FROM x GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN y USING (rid)"""


def op5() -> str:
    space = r"[\x20\x09-\x0D]"
    words = lambda t: f"list_filter(regexp_split_to_array({t}, '{space}+'), lambda x: x <> '')"
    without = lambda t, chars: f"(length({t}) - length(translate({t}, {_quoted(chars)}, '')))"
    fails = (
        f"({without('line', rules.SYMBOLS)} >= n * {rules.HEAVY} OR {without('line', '!')} >= n * {rules.HEAVY} OR {without('line', '|»›•')} >= n * {rules.HEAVY} "
        f"OR (n < {rules.SHORT_LINE} AND NOT regexp_matches(line, {_quoted(rules.ENDS)})) OR regexp_matches(line, {_quoted(rules.BOILERPLATE)}))"
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {words("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
rw AS (SELECT rid, count(DISTINCT i + j) AS n FROM r, range(0, 3) AS s(j) GROUP BY 1),
l AS (SELECT rid, line, len({words('line')}) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
lw AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (WHERE {fails}), 0) AS lost FROM l GROUP BY 1),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars, CAST({without('t', rules.SYMBOLS)} AS BIGINT) AS n_symbols,
CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_words FROM d LEFT JOIN rw USING (rid) LEFT JOIN lw USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND lost_words <= n_words * {rules.MOST_LOST} AS kept FROM b"""


def op8() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{word}')"
    return f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS k, w[i:i + 12] AS ws FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
m AS (SELECT rid, i, bw.n, item, k FROM dw JOIN bw USING (n, k)),
h AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM m), range(0, 13) AS s(j) WHERE j < n GROUP BY 1),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1),
win AS (SELECT DISTINCT n, k, list_distinct(ws) AS u, CAST(ceil(len(list_distinct(ws)) * 0.8) AS INTEGER) AS needed FROM bw),
dt AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
freq AS (SELECT word, count(*) AS c FROM dt GROUP BY 1),
wt AS (SELECT n, k, u, needed, word, row_number() OVER (PARTITION BY k ORDER BY coalesce(c, 0), word) AS r FROM (SELECT n, k, u, needed, unnest(u) AS word FROM win) LEFT JOIN freq USING (word)),
posts AS (SELECT rid, i, n, k, u, needed FROM wt JOIN dt USING (word) WHERE r <= len(u) - needed + 1),
runs AS (SELECT DISTINCT rid, k, u, needed, n, s FROM (SELECT rid, k, u, needed, n, unnest(range(greatest(1, i - n + 1), i + 1)) AS s FROM posts)),
nr AS (SELECT rid, count(DISTINCT k) AS n_near FROM runs JOIN d USING (rid) WHERE len(list_intersect(w[s:s + n - 1], u)) >= needed AND (rid, k) NOT IN (SELECT rid, k FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid) LEFT JOIN nr USING (rid)"""


def op11() -> str:
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor, p.other AS positive, p.score AS ps, s.other AS negative, s.score AS ns, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS r
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(r AS INTEGER) AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3"""


def op12() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT rid, place, line, key IN (SELECT key FROM c) AS gone FROM k),
t AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT d.doc_id, t.n_lines, t.n_dropped, sha256(t.kept) AS kept_sha256 FROM d JOIN t ON d.rid = t.rid"""


def op13() -> str:
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({words("text")}) AS term FROM benchmark),
v AS (SELECT DISTINCT term FROM q),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM v) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n FROM s) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM t GROUP BY term),
i AS (SELECT t.rid, d.doc_id, t.term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * (SELECT n FROM s)) // (SELECT l FROM s)))) AS part FROM t JOIN d ON t.rid = d.rid JOIN f ON t.term = f.term),
r AS (SELECT q.item_id, i.rid, i.doc_id, CAST(sum(i.part) AS BIGINT) AS score FROM q JOIN i ON q.term = i.term GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid) <= 50"""
