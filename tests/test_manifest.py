"""Strict ingestion: each gate with a document that only it rejects."""

import json

import pytest
from pyspark.sql import functions as F

from ravelin.functions import ids
from ravelin.operators import manifest as M

SITE = M.Site("www.site.example", "cdn.site.example", r"^/alerts/(\d+)-(\d{4})$", r"^/files/\d+/alert-(\d+)-(\d{4})\.pdf$", r"^Alert N (\d+)-(\d{4})$")
GOOD = dict(
    landing_url="https://www.site.example/alerts/7-2026", document_url="https://CDN.site.example/files/1/alert-7-2026.pdf?x=1", title=" Alert  N 7-2026", title_source="landing_main_h1", publication_date="2026-03-04",
    publication_date_source="landing_main_time", content=bytearray(b" %PDF-1.7"), status="complete", chunk_count=1, chunks=[(0, "complete", 2, 1, None)], accepted=[("ip", "1.2.3.4"), ("ip", "1.2.3.4")], rejected=[("ip", "x", "shape", "shape_validation")], vulnerabilities=["CVE-2026-12345"],
)
SCHEMA = (
    "landing_url string, document_url string, title string, title_source string, publication_date string, publication_date_source string, content binary, status string, chunk_count int, "
    "chunks array<struct<chunk_index int, status string, attempts int, retry_count int, error string>>, accepted array<struct<type string, value string>>, rejected array<struct<type string, value string, reason string, stage string>>, vulnerabilities array<string>"
)
CASES = {
    None: {},
    "title": {"title": " "},
    "title_source": {"title_source": "guess"},
    "publication_date": {"publication_date": "4/3/2026"},
    "publication_date_source": {"publication_date_source": None},
    "url": {"landing_url": ""},
    "body": {"content": bytearray(b"<html>")},
    "missing": {"chunks": []},
    "order": {"chunks": [(1, "complete", 1, 0, None)]},
    "status": {"chunks": [(0, "odd", 1, 0, None)]},
    "retries": {"chunks": [(0, "complete", 1, 1, None)]},
    "error_on_complete": {"chunks": [(0, "complete", 1, 0, "x")]},
    "error_missing": {"chunks": [(0, "error", 1, 0, "")]},
    "vulnerability_as_indicator": {"accepted": [("domain", "cve-2026-1234.example")]},
    "indicator_shape": {"accepted": [("ip", "1.2.3")]},
    "rejection_diagnostics": {"rejected": [("ip", "x", "", "grounding")]},
    "unofficial_url": {"landing_url": "https://www.site.example/alerts/7-2026?page=1"},
    "coordinates": {"title": "Alert N 8-2026"},
    "date_year": {"publication_date": "2025-03-04"},
    "incomplete": {"chunk_count": 2},
    "vulnerabilities": {"vulnerabilities": ["CVE-2026-12345", "CVE-2026-12345"]},
}


def test_gates(spark):
    rows = [tuple((GOOD | change)[c.split()[0]] for c in ["landing_url", "document_url", "title", "title_source", "publication_date", "publication_date_source", "content", "status", "chunk_count", "chunks", "accepted", "rejected", "vulnerabilities"]) for change in CASES.values()]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("n", F.monotonically_increasing_id())
    found = [r for r in M.manifest(docs, SITE).collect()]
    assert [r["reason"] for r in found] == list(CASES)
    good = found[0]
    assert good["document_url"] == "https://cdn.site.example/files/1/alert-7-2026.pdf" and good["title"] == "Alert N 7-2026" and good["bulletin_number"] == "7"
    assert [(o["kind"], o["name"]) for o in good["objects"]] == [("Vulnerability", "CVE-2026-12345"), ("Indicator", "[ipv4-addr:value = '1.2.3.4']")]
    assert good["report_standard_id"] == spark.range(1).select(ids.report_id(F.lit("https://www.site.example/alerts/7-2026"))).first()[0]
    assert M.previews(docs).first()["retry_count"] == 1


def test_order_of_manifests(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "position int, name string")
    b = spark.createDataFrame([(0, "y"), (1, "x"), (2, "z")], a.schema)
    assert sorted(r["position"] for r in M.same_manifest(a, b).collect()) == [0, 1, 2] and M.same_manifest(a, a).count() == 0


@pytest.mark.parametrize(("state", "note"), [('{"last_run": 1785796908}', "2026-08-03T22:41:48"), (None, "no state"), ("", "no state"), ("null", "no state"), ("{}", "state without last_run"), ("no-json", "unreadable state: no-json")])
def test_last_run_notes(spark, state, note):
    assert spark.range(1).select(M.last_run_note(F.lit(state).cast("string"))).first()[0].startswith(note)


@pytest.mark.parametrize(("payload", "found"), [(["a", "b", "a"], ["a", "b"]), ([{"id": "i", "standard_id": "s"}], ["s"]), ({"edges": [{"node": {"id": "i"}}, {"node": {"id": "j", "standard_id": "t"}}]}, ["i", "t"]), (None, []), ({}, [])])
def test_nodes(spark, payload, found):
    assert spark.range(1).select(M.nodes(F.lit(json.dumps(payload)))).first()[0] == found


def test_small_readers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(M.last_object(F.lit('log\n{"a": 1}\n{broken\n{"b": 2}\nend'))) == '{"b": 2}' and one(M.last_object(F.lit("none"))) is None
    body = one(M.bounded_body(F.lit("token: abc\n\n" + "x" * 3000)))
    assert body.startswith("token: [REDACTED] x") and body.endswith("x [truncated]")
    assert one(M.report_text(F.lit(""), F.lit("src"), F.array(F.lit("b"), F.lit("a")))) == "Extracted from src\n\nSystems targeted: a, b"
    rows = spark.createDataFrame([("1", '{"total_facts": 3, "unanchored": ["ipv4:1.2.3.4"]}'), ("2", "old text")], "id string, anchor string")
    out = {r["id"]: r for r in M.briefing_rows(rows).collect()}
    assert out["1"]["anchor_stats"]["total_facts"] == 3 and out["2"]["anchor_raw"] == "old text"
    assert M.recipe_problems({"hosts": ["a.example"], "landing_path": "^/x", "document_path": "^/y", "max_candidates": 3}) == []
    assert len(M.recipe_problems({"hosts": ["A b"], "landing_path": "(", "max_candidates": 500})) == 4
    with pytest.raises(ValueError):
        M.period(0)


def test_sources(spark):
    sources = spark.createDataFrame([("a", 6), ("b", None)], "source string, interval_hours int")
    state = spark.createDataFrame([("a", 1, None, 5, 0)], "source string, last_polled int, last_attempt int, new_found int, errors int")
    urls = spark.createDataFrame([("u",), ("u",), ("v",)], "url string")
    assert {r["source"]: (r["interval_hours"], r["new_found"], r["registry_size"]) for r in M.source_rows(sources, state, urls).collect()} == {"a": (6, 5, 2), "b": (24, 0, 2)}
