"""Text functions, gates, the bulletin policy, citations, resolution and targeting on small cases."""

import pytest
from pyspark.sql import functions as F

from ravelin.functions import identifiers, ids, network, times
from ravelin.functions import text as T
from ravelin.operators import extraction, graph, lifecycle, resolve


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def lit(x):
    return F.lit(x).cast("string") if x is None or isinstance(x, str) else F.lit(x)


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("hxxps://evil[.]example/x", "https://evil.example/x"), ("user[at]mail[dot]example", "user@mail.example"), ("1.2.3[.]4", "1.2.3.4"), ("a(.)b.example", "a.b.example"), ("HXXP://x.example", "http://x.example"), ("https://ok.example/(a)", "https://ok.example/(a)"), ("f" * 40, "f" * 40)],
)
def test_refang(spark, raw, clean):
    assert one(spark, T.refang(lit(raw))) == clean and one(spark, T.refang(T.refang(lit(raw)))) == clean


@pytest.mark.parametrize("value", ["plain", "it's", "back\\slash", "both \\' here", "ends\\"])
def test_escape_round_trip(spark, value):
    pattern = F.concat(F.lit("[url:value = '"), T.escape(lit(value)), F.lit("']"))
    assert one(spark, T.value_of_pattern(pattern)) == value
    assert one(spark, T.value_of_pattern(lit("no literal"))) == "no literal"


@pytest.mark.parametrize(("kind", "value", "good"), [("ip", "1.2.3.4", True), ("ip", "1.2.3", False), ("domain", "*.a.example", True), ("domain", "-a.example", False), ("url", "http://x/'", False), ("hash_md5", "a" * 32, True), ("hash_md5", "a" * 31, False), ("email", "a@b.example", True), ("other", "x", False)])
def test_shapes(spark, kind, value, good):
    assert one(spark, identifiers.has_shape(lit(kind), lit(value))) is good
    assert (one(spark, identifiers.pattern_of(lit(kind), lit(value))) is not None) is good


def test_uuid5(spark):
    import uuid

    for p in ("[ipv4-addr:value = '1.2.3.4']", "é", ""):
        assert one(spark, ids.uuid5(lit(p))) == str(uuid.uuid5(uuid.NAMESPACE_URL, p))
    known = "indicator--" + str(uuid.uuid5(uuid.NAMESPACE_URL, "x"))
    a, b = ids.indicator_id(lit("p"), lit(None), lit("broken"), lit(known))
    assert one(spark, a) == known and one(spark, b) == "platform"


@pytest.mark.parametrize(("base", "href"), [("http://a.com/b/c?x#y", h) for h in ("d", "/d/e", "../d", "./", "?q=1", "#z", "//h.com/x", "https://o.com/", "", "a/../b", "..", "d;p")] + [("http://a.com", "d")])
def test_relative_links(spark, base, href):
    from urllib.parse import urljoin

    want = base if href == "" else urljoin(base, href)
    assert one(spark, network.resolve(lit(base), lit(href))) == (want.split("#")[0] if href == "" else want)


def test_networks(spark):
    assert one(spark, network.cidr(lit("192.0.2.77/24"))) == "192.0.2.0/24" and one(spark, network.cidr(lit("1.2.3.4"))) == "1.2.3.4/32"
    for bad in ("1.2.3.4/33", "x/8", "1.2.3/8", "2001:db8::/32", "1.2.3.4/x"):
        assert one(spark, network.cidr(lit(bad))) is None
    assert [one(spark, network.is_special(lit(x))) for x in ("10.1.2.3", "127.0.0.1", "8.8.8.8", "172.31.0.1", "172.32.0.1", "x")] == [True, True, False, True, False, False]
    assert [one(spark, network.url_is_admissible(lit(u))) for u in ("https://a.example/x", "ftp://a.example", "http://u:p@a.example", "http:///x", "x")] == [True, False, False, False, False]
    assert one(spark, network.looks_like_pdf(lit(None), F.lit(b"%PDF-1.7"), lit("http://a/x"))) and one(spark, network.looks_like_pdf(lit("application/pdf; q"), F.lit(b""), lit("http://a/x"))) and not one(spark, network.looks_like_pdf(lit("text/html"), F.lit(b"<h"), lit("http://a/pdf")))


def test_dates(spark):
    assert str(one(spark, times.spanish_date(lit("el 3 de Setiembre de 2025.")))) == "2025-09-03" and one(spark, times.spanish_date(lit("31 de febrero de 2025"))) is None
    assert str(one(spark, times.iso_day(lit("2025-01-02T23:00:00-05:00")))) == "2025-01-02" and one(spark, times.iso_day(lit("nope"))) is None
    assert one(spark, times.connector_last_run(lit('{"last_run": 1700000000000}'))).startswith("2023-11-14T22:13:20") and one(spark, times.connector_last_run(lit('{"lastRun": "2024-01-01"}'))) == "2024-01-01" and one(spark, times.connector_last_run(lit("{bad"))) is None


@pytest.mark.parametrize(("name", "key"), [("The  Lazarus Group!", "lazarus group"), ("los Pollos", "pollos"), ("Theta", "theta"), ("«X»", "x"), ("", "")])
def test_name_keys(spark, name, key):
    assert one(spark, T.name_key(lit(name))) == key


def test_mentions_and_facts(spark):
    assert one(spark, T.mentions(lit("The Homeland Justice group"), lit("Land Justice"))) is False and one(spark, T.mentions(lit("see APT-29 (Cozy)."), lit("apt-29"))) is True
    text = lit("See https://Evil.Example/Path. and host bad.example, 1.2.3.4 CVE-2024-12345 t1059.001 x.nosuchtld")
    assert [tuple(x) for x in one(spark, identifiers.facts(text))] == [("cve", "CVE-2024-12345"), ("domain", "bad.example"), ("ipv4", "1.2.3.4"), ("technique", "T1059.001"), ("url", "https://evil.example/Path")]
    assert ("domain", "evil.example") in [tuple(x) for x in one(spark, identifiers.context_facts(text))]
    assert one(spark, identifiers.salvage_emails(lit("mail.example"), lit("write a@mail.example or b.c@mail.example"))) == ["a@mail.example", "b.c@mail.example"]
    assert one(spark, identifiers.salvage_emails(lit("mail.example"), lit("a@mail.example and mail.example"))) is None
    assert one(spark, identifiers.salvage_emails(lit("mail.example"), lit("a@mail.example and x.mail.example"))) == ["a@mail.example"]


BULLETIN = """Resumen
Actualizacion del fabricante disponible en https://vendor.example/patch para corregir.

Indicadores de compromiso:
evil.example es un dominio malicioso usado como C2.

Texto
No hay evidencia de explotacion activa de quiet.example en este momento.

Fuentes de informacion:
https://news.example/a
listed.example
"""


def test_bulletin_policy(spark):
    docs = spark.createDataFrame([("b", BULLETIN, "bulletin"), ("r", BULLETIN, "report")], "doc_id string, text string, source_type string")
    values = [("url", "https://vendor.example/patch"), ("domain", "evil.example"), ("domain", "quiet.example"), ("url", "https://news.example/a"), ("domain", "listed.example"), ("domain", "absent.example"), ("domain", "evil[.]example"), ("ip", "not-an-ip")]
    rows = [(d, t, v, k, 0) for d in "br" for k, (t, v) in enumerate(values)]
    judged = extraction.judge(spark.createDataFrame(rows, "doc_id string, type string, value string, pos int, rank int"), docs)
    found = {(r["doc_id"], r["value"]): r["reason"] for r in judged.collect()}
    assert found["b", "https://vendor.example/patch"] == "bulletin_reference_only" and found["b", "evil.example"] is None and found["b", "quiet.example"] == "bulletin_no_active_exploitation"
    assert found["b", "https://news.example/a"] == found["b", "listed.example"] == "bulletin_reference_section"
    assert found["r", "https://vendor.example/patch"] is None and found["r", "absent.example"] == "ungrounded" and found["r", "not-an-ip"] == "ungrounded"
    assert len(found) == 14  # the defanged form is the same value
    assert extraction.indicators(judged).where("doc_id = 'b'").select("pattern").first()[0] == "[domain-name:value = 'evil.example']"


@pytest.mark.parametrize(("raw", "id_"), [("CVE-2024-12345", "CVE-2024-12345"), ("cve - 2024 - 1234", "CVE-2024-1234"), ("CVE-2024-12\n  345", "CVE-2024-12345"), ("CVE-2024-12­ 345", "CVE-2024-12345"), ("CVE-2024-12-\n345", "CVE-2024-12345"), ("CVE-2024-123", None), ("xCVE-2024-12345", None), ("CVE-2024-12345x", None), ("CVE-2024-12345678901", None), ("CVE-24-12345", None)])
def test_cve_forms(spark, raw, id_):
    rows = extraction.cve_candidates(spark.createDataFrame([(1, f"a {raw} b")], "doc_id int, text string")).collect()
    assert [r["id"] for r in rows] == ([id_] if id_ else [])
    if id_:
        assert rows[0]["raw_forms"] == [raw] and rows[0]["offsets"][0]["start"] == 2 and rows[0]["offsets"][0]["end"] == 2 + len(raw)


def test_citations(spark):
    docs = spark.createDataFrame([(1, "Group X\n used   malware Y.")], "doc_id int, text string")
    entities = spark.createDataFrame([(1, "a", "X", "Group X used"), (1, "b", "Y", "malware Y"), (1, "c", "Z", "not there"), (1, "d", " ", "Group X")], "doc_id int, id string, value string, quote string")
    kept = extraction.cited(entities, docs)
    assert {r["id"] for r in kept.collect()} == {"a", "b"}
    relations = spark.createDataFrame([(1, "a", "b", "used malware"), (1, "a", "c", "used malware"), (1, "b", "a", "nope")], "doc_id int, source string, target string, quote string")
    assert [(r["source"], r["target"]) for r in extraction.cited_relations(relations, kept, docs).collect()] == [("a", "b")]


def test_compounds(spark):
    names = spark.createDataFrame([("sector", n) for n in ("Banca", "policy research and defense analysis", "energy, moon bases", "moon / sun", "oil and gas", "the Military")], "category string, name string")
    found = sorted((r["name"], r["part"], r["canonical"]) for r in resolve.resolve_compound(names, resolve.taxonomy(spark)).select("name", "part", F.coalesce("canonical", F.lit("-")).alias("canonical")).collect())
    assert found == [("Banca", "Banca", "Finance"), ("energy, moon bases", "energy", "Energy"), ("energy, moon bases", "moon bases", "-"), ("moon / sun", "moon / sun", "-"), ("oil and gas", "oil and gas", "Energy"), ("policy research and defense analysis", "defense analysis", "Defense"), ("policy research and defense analysis", "policy research", "Research"), ("the Military", "the Military", "Defense")]


def test_first_writer_wins_and_empty_catalog(spark):
    catalog = spark.createDataFrame([("actor", "2", "Beta", ["Shared"]), ("actor", "1", "Alpha", ["shared", None, ""]), ("actor", "3", None, ["x"])], "category string, id string, name string, aliases array<string>")
    index = resolve.catalog_index(catalog)
    assert {(r["key"], r["canonical"]) for r in index.collect()} == {("alpha", "Alpha"), ("beta", "Beta"), ("shared", "Alpha")}
    names = spark.createDataFrame([("actor", "SHARED"), ("malware", "Alpha")], "category string, name string")
    assert {(r["category"], r["canonical"]) for r in resolve.resolve(names, index).collect()} == {("actor", "Alpha"), ("malware", None)}
    assert resolve.resolve(names, index.limit(0)).where("canonical is not null").count() == 0


def test_targeting_needs_a_single_actor_for_vulnerabilities(spark):
    rows = [(1, "actor", "A"), (1, "cve", "C1"), (1, "country", "P"), (2, "actor", "A"), (2, "actor", "B"), (2, "cve", "C1"), (2, "sector", "S"), (3, "malware", "M"), (3, "country", "P"), (3, "cve", "C"), (4, "malware", "M"), (4, "sector", "S")]
    edges = graph.axes(spark.createDataFrame(rows, "doc_id int, category string, name string"))
    assert {(r["doc_id"], r["from_name"], r["to_name"]) for r in edges.collect()} == {(1, "A", "C1"), (1, "A", "P"), (2, "A", "S"), (2, "B", "S"), (4, "M", "S")}


def test_document_states(spark):
    log = [(1, "previewed", 1, None), (1, "ingested", 2, "r1"), (1, "previewed", 3, None), (2, "ingested", 1, "r2"), (2, "failed", 2, None), (2, "ingested", 3, None), (3, "failed", 1, None), (3, "previewed", 2, None)]
    rows = spark.createDataFrame([(k, kind, s, r, "password=hunter2 x") for k, kind, s, r in log], "document_key int, kind string, seq int, report_id string, error string").withColumn("at", F.timestamp_seconds("seq"))
    found = {r["document_key"]: r for r in lifecycle.documents(rows).collect()}
    assert found[1]["status"] == "ingested" and found[1]["report_id"] == "r1"
    assert found[2]["status"] == "ingested" and found[2]["report_id"] == "r2" and found[2]["first_ingested_at"].second == 1 and found[2]["failed_at"].second == 2
    assert found[3]["status"] == "previewed" and found[3]["failed_at"].second == 1 and found[3]["error"] == "password=[redacted] x"


def test_outcomes_of_dispatch(spark):
    processed = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "url string")
    outcomes = spark.createDataFrame([("complete", "r", "l1", "d1", None), ("error", None, "l2", "d2", "Connection refused"), ("error", None, "l3", "d3", "404"), ("complete", None, "l4", "d4", None)], "status string, report_id string, landing_key string, document_key string, error string")
    assert {r["url"] for r in lifecycle.acknowledged(processed, outcomes).collect()} == {"d1", "l1", "d3"}


def test_addresses_of_both_kinds_are_judged_alike(spark):
    import ipaddress
    import random

    rng = random.Random(3)
    given = ["::", "::1", "fe80::1%eth0", "[fc00::5]", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2606:4700:4700::1111", "2001:db8::1", "1::2::3", "12345::", "::ffff:999.1.1.1", "1:2:3:4:5:6:7", "2a00:1450::200e", "ff02::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    given += [str(ipaddress.ip_address(rng.getrandbits(128))) for _ in range(40)] + [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(40)]
    rows = spark.createDataFrame([(g,) for g in given], "ip string")
    found = {r["ip"]: (r["groups"], r["special"]) for r in rows.select("ip", network.ipv6_groups(F.col("ip")).alias("groups"), network.is_special(F.col("ip")).alias("special")).collect()}
    for g in given:
        try:
            ip = ipaddress.ip_address(g.strip("[]").split("%")[0])
        except ValueError:
            assert found[g] == (None, False), g
            continue
        if ip.version == 6:
            assert found[g][0] == [int(ip) >> (112 - 16 * k) & 0xFFFF for k in range(8)], g
        inner = getattr(ip, "ipv4_mapped", None) or ip
        if inner.version == 6:
            assert found[g][1] == (inner.is_private or inner.is_link_local or inner.is_multicast or inner.is_loopback or inner.is_unspecified or inner.is_site_local or inner in ipaddress.ip_network("2002::/16")), g
        else:
            assert found[g][1] == (not inner.is_global or inner.is_multicast or inner in ipaddress.ip_network("192.88.99.0/24")), g


def test_folding_is_that_of_unicode(spark):
    import unicodedata

    texts = ["ÁÉÍ ñandú Über", "ǅungla ﬁn ½ ① ｆｕｌｌ", "Ṩȫ Ǖ ą̈ İstanbul ŉ ĳ", "\u212b \u2126 x\u0301\u0323", "日本 한국", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold_accents(F.col("t")).alias("f")).collect()
    for r in rows:
        plain = None if r["t"] is None else "".join(c for c in unicodedata.normalize("NFKD", r["t"]) if not unicodedata.combining(c)).lower()
        if r["t"] and "한" in r["t"]:
            continue  # syllables stay whole
        assert r["f"] == plain, r["t"]


def test_values_with_pattern_signs_are_literal(spark):
    rows = spark.createDataFrame([("x \\E( y \\E( z", "\\E("), ("a.b a+b", "a+b"), ("\\Q\\E", "\\Q\\E"), ("aaaa", "aa")], "t string, v string")
    found = rows.select(T.occurrences(F.col("t"), F.col("v")).alias("o"), T.mentions(F.col("t"), F.col("v")).alias("m")).collect()
    assert [r["o"] for r in found] == [[2, 8], [4], [0], [0, 2]] and found[1]["m"]


def test_network_failures_are_known_by_their_words(spark):
    rows = spark.createDataFrame([("Read timed out",), ("HTTP 503",), ("Bad Gateway",), ("bad password",), (None,)], "m string")
    assert [r[0] for r in rows.select(identifiers.is_transient(F.col("m"))).collect()] == [True, True, True, False, False]


def test_techniques_by_keyword(spark):
    names = spark.createDataFrame([("t1", "Phishing"), ("t2", "Spearphishing Link"), ("t3", "OS Credential Dumping"), ("t4", "Os")], "id string, name string")
    asked = spark.createDataFrame([("phishing",), ("PHISH",), ("dump",), ("os",), ("zzz",), ("",)], "keyword string")
    from ravelin.operators import resolve

    assert {r["keyword"]: r["technique_id"] for r in resolve.technique_lookup(asked, names).collect()} == {"phishing": "t1", "PHISH": "t1", "dump": "t3", "os": "t4"}
