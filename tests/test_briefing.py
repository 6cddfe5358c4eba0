"""Anchoring, the rendered block, fidelity of numbers and names, summaries, sinks and views."""

import pytest
from pyspark.sql import functions as F

from ravelin import sinks
from ravelin.operators import briefing, evaluate, resolve, views
from ravelin.sources import pages, tables


@pytest.mark.parametrize(
    ("text", "total", "new", "old"),
    [
        ("187 indicators were observed, 12 newly created.", {187}, {12}, set()),
        ("A total of 1,071 indicators; 0 new indicators.", {1071}, {0}, set()),
        ("One hundred and eighty-seven indicators. No newly created indicators.", {187}, {0}, set()),
        ("All 187 were pre-existing.", set(), {0}, set()),
        ("175 pre-existing indicators; 12 new indicators.", set(), {12}, {175}),
        ("A sample of 25 indicators is shown.", set(), set(), set()),
        ("0 newly created user accounts", set(), set(), set()),
        ("two thousand three hundred indicators", {2300}, set(), set()),
    ],
)
def test_claims(text, total, new, old):
    said = evaluate.claims(text)
    assert (said["total"], said["new"], said["preexisting"]) == (total, new, old)


@pytest.mark.parametrize(
    ("text", "total", "new", "old"),
    [
        ("Top 5 indicators follow.", set(), set(), set()),
        ("12 indicadores nuevos y 40 indicadores en total.", {40}, {12}, set()),
        ("Newly added: 3; overall 90 IOCs were seen", {90}, set(), set()),
        ("There were 7 previously known artifacts, and no new indicators", set(), {0}, {7}),
        ("Ningún indicador nuevo entre 50 indicadores", {50}, {0}, set()),
        ("twenty-one newly identified IOCs", set(), {21}, set()),
        ("1.2.3.4 was seen", set(), set(), set()),
        ("", set(), set(), set()),
    ],
)
def test_more_claims(text, total, new, old):
    said = evaluate.claims(text)
    assert (said["total"], said["new"], said["preexisting"]) == (total, new, old)


def test_names(spark):
    rows = spark.createDataFrame([("Darkhosel and APT28 were active with PittyPig.", ["Darkhotel", "APT28", "PittyTiger", "Sandworm"]), (None, ["X"]), ("a\\E(b and c", ["a\\E(b", "\\E("]), ("x", None)], "text string, names array<string>")
    out = evaluate.name_fidelity(rows).collect()
    assert out[0]["exact"] == ["APT28"] and "Darkhotel" in out[0]["corrupt"] and "Sandworm" in out[0]["omitted"]
    assert "a\\E(b" in out[2]["exact"] and out[3]["exact"] == []


def test_block_and_measure(spark):
    inds = spark.createDataFrame([("1.2.3.4", "IPv4-Addr", 90, 0), ("bad.example", "Domain-Name", None, 1), (None, "Url", 10, 2)], "name string, observable_type string, score int, pos int")
    names = spark.createDataFrame([("actor", "Alpha\nGroup", 0), ("actor", "Beta", 1), ("malware", "Gamma", 0)], "kind string, name string, pos int")
    counts = spark.createDataFrame([(187, 12, 175)], "total_touched long, total_new long, updated_only long")
    text = briefing.block(inds, names, counts, 24, "2026-01-01T00:00Z").first()[0]
    assert text == (
        "Period: last 24h (ending 2026-01-01T00:00Z).\nIOC activity in period: 187 indicators total (12 newly created, 175 pre-existing ones re-updated). The 3 highest-confidence of them are sampled below: "
        "(1 IPv4-Addr, 1 Domain-Name, 1 Url), top confidence: 0.90.\nHighest-confidence indicator values, verbatim: 1.2.3.4 (IPv4-Addr), bad.example (Domain-Name).\n"
        "Tracked threat actors (knowledge base, most recently updated first): Alpha Group, Beta.\nTracked malware families (knowledge base): Gamma.\nCampaigns tracked in knowledge base: none.\n"
        "ATT&CK techniques tracked (knowledge base): none.\nAffected sectors: none identified.\n"
    )
    runs = spark.createDataFrame([("a", "187 indicators were seen. There were 12 new indicators. Alpha Group and Bita used 1.2.3.4 and 9.9.9.9", text), ("b", "**Nothing**", text)], "run_id string, text string, context string")
    found = {r["run_id"]: r for r in evaluate.measure(runs).collect()}
    a, b = found["a"], found["b"]
    assert (a["identifiers"], a["loose"], a["anchoring_rate"], a["new_ok"], a["names"], a["names_exact"]) == (2, 1, 0.5, True, 3, 1)
    assert b["anchoring_rate"] is None and b["markdown"] and b["names_omitted"] == 3
    loose = briefing.unanchored(runs).collect()
    assert [(r["run_id"], r["kind"], r["value"]) for r in loose] == [("a", "ipv4", "9.9.9.9")]
    second = spark.createDataFrame([("a", "Only 1.2.3.4 and 8.8.8.8")], "run_id string, text string")
    done = {r["run_id"]: r for r in briefing.verify(runs, second).collect()}
    assert done["a"]["text"].endswith("[Unverified identifiers: ipv4:8.8.8.8]") and done["a"]["retried"] and done["b"]["text"] == "**Nothing**"


def test_scores_when_nothing_is_there(spark):
    empty = spark.createDataFrame([], "doc_id int, format string, type string, value string")
    gold = spark.createDataFrame([(1, "blog", "ip", "x")], empty.schema)
    row = evaluate.micro(evaluate.outcomes(empty, gold)).where("type = 'ip'").first()
    assert (row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0)


def test_summary_deviation_is_null_for_one_run(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("b", 1.0, False), ("b", 2.0, None)], "p string, v double, ok boolean")
    found = {r["p"]: r for r in evaluate.summarize(rows, ["p"], ["v"], ["ok"]).collect()}
    assert found["a"]["v_sd"] is None and found["b"]["v_sd"] == 0.7071 and found["b"]["ok"] == "0/1"


def test_landing_pages_are_confirmed(spark):
    html = '<main><h1>Bulletin 1</h1><time datetime="2025-01-02">x</time><a href="/docs/a.pdf">A</a><a href="/docs/b.pdf">B</a></main>'
    cards = spark.createDataFrame([("https://s.example/1", "BULLETIN 1", "2025-01-02"), ("https://s.example/2", "Other", None)], "landing string, title string, day string").withColumn("day", F.to_date("day"))
    landings = spark.createDataFrame([("https://s.example/1", html), ("https://s.example/2", "<main></main><main></main>")], "landing string, html string")
    bodies = spark.createDataFrame([("https://s.example/docs/a.pdf", "text/html", bytearray(b"<html")), ("https://s.example/docs/b.pdf", "application/pdf", bytearray(b"%PDF-"))], "url string, content_type string, head binary")
    found = pages.confirm_documents(cards, landings, bodies, ["s.example"], "^/docs/").collect()
    assert [(r["landing"], r["document"]) for r in found] == [("https://s.example/1", "https://s.example/docs/a.pdf")]  # the path names a PDF


def test_entries_and_advisories(spark):
    rss = "<rss><item><title>One &amp; two</title><link>https://a.example/1</link><pubDate>Mon</pubDate></item><item><title>x</title><link>mailto:x</link></item></rss>"
    found = pages.feed_entries(spark.createDataFrame([("s", rss)], "source string, xml string")).collect()
    assert [(r["link"], r["published"]) for r in found] == [("https://a.example/1", "Mon")]
    listing = spark.createDataFrame([('[{"name":"b.json","download_url":"https://g.example/b"},{"name":"a.json","download_url":"https://g.example/a"},{"name":"c.txt","download_url":"https://g.example/c"},{"name":"d.json","download_url":"https://o.example/d"}]',)], "body string")
    assert [r["name"] for r in pages.advisories(listing, "body", "https://g.example/", 1).collect()] == ["b.json"]


def test_paged_documents(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, " "), (2, 1, "  ")], "doc int, page int, text string")
    assert {r["doc"]: r["text"] for r in tables.page_texts(rows, "doc", "page", "text").collect()} == {1: "a\nb"}


def test_feed_queries(spark):
    now = F.lit("2026-01-02").cast("timestamp")
    rows = spark.createDataFrame([("benign", "2026-01-01 12:00:00"), ("malicious", "2026-01-01 12:00:00"), ("malicious", "2025-01-01 00:00:00")], "c string, t string").withColumn("t", F.col("t").cast("timestamp"))
    n = {k: rows.where(tables.feed_query(k, F.col("c"), F.col("t"), now)).count() for k in tables.FEED_TYPES}
    assert n == {"benign": 1, "malicious": 1, "suspicious": 0, "benign+malicious": 2, "malicious+suspicious": 1, "benign+suspicious+malicious": 2, "all": 2}
    with pytest.raises(ValueError):
        tables.feed_query("none", F.col("c"), F.col("t"), now)


def test_queue(spark):
    queue = spark.createDataFrame([("actor", "X", "u", 1, "2026-01-01")], "category string, candidate_name string, source_url string, id int, created_at string")
    new = spark.createDataFrame([("actor", "X", "u", 2, "b"), ("actor", "Y", "u", 4, "b"), ("actor", "Y", "u", 3, "a")], queue.schema)
    assert [(r["candidate_name"], r["id"]) for r in resolve.enqueue(queue, new).collect()] == [("Y", 3)]


def test_merge_and_exports(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "k string, at int, v int")
    rows.write.parquet(path)
    out = sinks.merge_into(path, spark.createDataFrame([("a", 2, 9), ("c", 1, 3)], rows.schema), "k", "at")
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [("a", 9), ("b", 2), ("c", 3)]
    fresh = sinks.merge_into(str(tmp_path / "none"), rows, "k", "at")
    assert fresh.count() == 2
    sinks.write_csv(rows.withColumn("l", F.array(F.lit("x"), F.lit("y"))), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["l"] == "x|y"


def test_views(spark):
    rows = spark.createDataFrame([("a", "ok"), ("b", "error")], "feed string, status string")
    assert views.fleet(rows).first()[0] == "stale" and views.fleet(rows.where("feed = 'a'")).first()[0] == "ok"
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "service string")
    running = spark.createDataFrame([("a", "running", "healthy", 0, False), ("b", "running", "unhealthy", 0, False)], "service string, state string, health string, restarts int, oom_killed boolean")
    assert {r["service"]: r["verdict"] for r in views.inventory(expected, running).collect()} == {"a": "ok", "b": "unhealthy", "c": "missing"}
    bad = spark.createDataFrame([("a", "ok", 1), ("a", "ok", 1), ("z", "ok", 1), ("b", "odd", 1)], "feed string, status string, ioc_count int")
    assert sorted(r["reason"] for r in views.contract_violations(bad, ["a", "b"]).collect()) == ["repeated feed", "repeated feed", "status", "unknown feed"]
