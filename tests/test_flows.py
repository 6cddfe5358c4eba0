"""Whole flows on small tables."""

from pyspark.sql import functions as F

from ravelin.operators import extraction, flows, lifecycle, resolve


def test_feeds_to_index(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    rows = [("n", "[p1]", "t", ["l"], "feodo", None, None, 3), ("n", "[p1]", "t", ["l"], "cins", None, None, 11), ("n", "[p2]", "t", [], "cins", None, None, 11), ("n", "", "t", [], "cins", None, None, 11), ("n", None, "t", [], "cins", None, None, 11), ("n", "[p3]", "t", [], "cins", None, None, 11)]
    cands = spark.createDataFrame(rows, "name string, pattern string, observable_type string, labels array<string>, source_name string, valid_from string, description string, feed_rank int")
    seen = spark.createDataFrame([("[p2]", "2026-01-01 12:00:00"), ("[p3]", "2026-01-01 00:00:00")], "pattern string, at string").withColumn("at", F.col("at").cast("timestamp"))
    found = {r["pattern"]: (r["feed"], r["confidence"]) for r in flows.ingest_feeds(cands, seen, now).collect()}
    assert found == {"[p1]": ("feodo", 65), "[p3]": ("cins", 50)}
    assert flows.ingest_feeds(cands, None, now).count() == 3


def test_targeting_flow(spark):
    names = [(1, "actor", "the LAZARUS group", "https://s"), (1, "actor", "Nobody", "https://s"), (1, "sector", "banking and moon", "https://s"), (1, "cve", "cve-2024-1234", "https://s"), (2, "actor", "Lazarus Group", "file:x"), (2, "sector", "banking", "file:x"), (3, "malware", "Zed", "https://t")]
    catalog = resolve.catalog_index(spark.createDataFrame([("actor", "1", "Lazarus Group", [])], "category string, id string, name string, aliases array<string>"))
    edges, queue = flows.targeting(spark.createDataFrame(names, "doc_id int, category string, name string, source_url string"), catalog, resolve.taxonomy(spark))
    assert {(r["doc_id"], r["from_name"], r["to_name"]) for r in edges.collect()} == {(1, "Lazarus Group", "Finance"), (1, "Lazarus Group", "CVE-2024-1234")}
    assert {(r["category"], r["candidate_name"]) for r in queue.collect()} == {("actor", "Nobody"), ("sector", "moon"), ("malware", "Zed")}


def test_extraction_flow(spark):
    docs = spark.createDataFrame([(1, "Emotet used hxxp://bad[.]example/x and " + "a" * 32 + " via CVE-2024-12345", "report", "blog")], "doc_id int, text string, source_type string, format string")
    proposed = spark.createDataFrame([(1, "url", "hxxp://bad[.]example/x", 0), (1, "ip", "9.9.9.9", 1), (1, "hash_md5", "a" * 32, 2)], "doc_id int, type string, value string, pos int")
    names = spark.createDataFrame([(1, "malware_families", "Emotet"), (1, "malware_families", "Emo..."), (1, "threat_actors", "APT1")], "doc_id int, category string, name string")
    out = flows.extract(docs, proposed, names)
    assert {(r["type"], r["value"]) for r in out["indicators"].collect()} == {("url", "http://bad.example/x"), ("hash_md5", "a" * 32)}
    assert [(r["value"], r["reason"]) for r in out["rejected"].collect()] == [("9.9.9.9", "ungrounded")]
    assert [r["name"] for r in out["names"].collect()] == ["Emotet"] and [r["name"] for r in out["vulnerabilities"].collect()] == ["CVE-2024-12345"]
    judged = extraction.judge(extraction.unite(proposed, extraction.harvest(docs)), docs)
    gold = spark.createDataFrame([(1, "blog", "url", "http://bad.example/x"), (1, "blog", "ip", "1.1.1.1")], "doc_id int, format string, type string, value string")
    scores = {(r["type"], r["format"]): (r["tp"], r["fp"], r["fn"]) for r in flows.evaluate_corpus(docs, judged, gold).collect()}
    assert scores == {("url", None): (1, 0, 0), ("ip", None): (0, 0, 1), ("hash_md5", None): (0, 1, 0), (None, "blog"): (1, 1, 1)}


def test_briefing_flow(spark):
    until = F.lit("2026-01-02").cast("timestamp")
    inds = spark.createDataFrame([(k, f"i{k}", "Url", k, ["Finance", "x"], "a" if k % 2 else "b", f"2026-01-01 {k % 24:02d}:30:00", "2025-12-01 00:00:00") for k in range(60)], "id int, name string, observable_type string, score int, labels array<string>, author_id string, updated_at string, created_at string")
    inds = inds.withColumns({c: F.col(c).cast("timestamp") for c in ("updated_at", "created_at")})
    people = spark.createDataFrame([(k, f"g{k}", f"2026-01-0{k % 9 + 1}") for k in range(8)], "id int, name string, modified string")
    tech = spark.createDataFrame([("T1059", "Shell"), ("T1001", "T1001"), ("X1", "other")], "x_mitre_id string, name string")
    out = flows.collect_briefing(inds, people, people, tech, spark.createDataFrame([("a",)], "id string"), 24, until)
    assert out["totals"].first()[:3] == (30, 0, 30) and out["sample"].count() == 25 and out["sectors"].first()[0] == ["finance"]
    assert out["actors"].count() == 10 and [r["name"] for r in out["techniques"].collect()] == ["Shell"] and out["types"].first()["n"] == 25


def test_schedule_starts_the_longest_waiting_on_free_workers(spark):
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    jobs = spark.createDataFrame([(j, 3600) for j in "abcdef"], "job string, interval_seconds int")
    data = [("a", "2026-01-01 08:00:00", "2026-01-01 08:01:00"), ("a", "2026-01-01 09:00:00", "2026-01-01 09:01:00"), ("b", "2026-01-01 10:00:00", None), ("c", "2026-01-01 11:30:00", "2026-01-01 11:31:00"), ("d", "2026-01-01 10:30:00", "2026-01-01 10:31:00"), ("e", "2026-01-01 10:40:00", "2026-01-01 10:41:00")]
    runs = spark.createDataFrame(data, "job string, started_at string, ended_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "ended_at")})
    rows = {r["job"]: r for r in lifecycle.schedule(jobs, runs, now, jitter=60, workers=3).collect()}
    assert {j for j, r in rows.items() if r["due"]} == {"a", "d", "e", "f"} and rows["b"]["running"]
    assert {j for j, r in rows.items() if r["starts"]} == {"a", "d"}  # one of three workers is taken
    assert all(0 <= (r["next_run"] - r["last_start"]).total_seconds() - 3600 <= 60 for r in rows.values() if r["last_start"])


def test_poll_cycle_counts_new_items_of_due_sources(spark):
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    sources = spark.createDataFrame([("a", 1), ("b", 24), ("c", 6)], "source string, interval_hours int")
    state = spark.createDataFrame([("a", "2026-01-01 10:00:00", None), ("b", "2026-01-01 10:00:00", None)], "source string, last_attempt string, last_polled string").withColumns({c: F.col(c).cast("timestamp") for c in ("last_attempt", "last_polled")})
    items = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "z")], "source string, url string")
    rows = {r["source"]: (r["due"], r["polled"], r["fresh"], str(r["last_attempt"])) for r in lifecycle.poll_cycle(sources, state, items, spark.createDataFrame([("x",)], "url string"), now).collect()}
    assert rows == {"a": (True, 2, 1, "2026-01-01 12:00:00"), "b": (False, 0, 0, "2026-01-01 10:00:00"), "c": (True, 0, 0, "2026-01-01 12:00:00")}
