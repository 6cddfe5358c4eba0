"""Feed bodies: what each reader keeps, and the candidates it makes."""

import json

import pytest
from pyspark.sql import functions as F

from ravelin.functions import times
from ravelin.operators import indicators as I
from ravelin.sources import feeds

BODIES = {
    "urlhaus": '# comment\n"1","2026-06-25 00:00:00","http://bad.example/a\'b","online","","malware_download","Mozi, exe,","https://x","r"\n"2","2026-06-25","","online","","x","y","z","r"\n',
    "malwarebazaar": json.dumps({"query_status": "ok", "data": [{"sha256_hash": "a" * 64, "first_seen": "2026-06-25", "signature": "Emotet", "tags": ["exe", "emotet"], "file_type": "exe", "file_name": "x"}, {"sha256_hash": "", "signature": "", "tags": None}]}),
    "threatfox": json.dumps(
        {"query_status": "ok", "data": [{"ioc": i, "ioc_type": t, "malware": "m", "first_seen": "2026-06-25 00:00:00 UTC", "tags": ["t"]} for i, t in (("192.0.2.1:443", "ip:port"), ("evil.example", "domain"), ("http://e.example", "url"), ("b" * 32, "md5_hash"), ("c" * 64, "sha256_hash"), ("x", "unknown"))]}
    ),
    "feodo": "# c\nfirst_seen_utc,dst_ip,dst_port,c2_status,last_online,malware\n2026-06-25 00:00:00,192.0.2.7,443,online,2026-06-25,Dridex\n2026-06-25,,443,online,x,y\n",
    "sslbl_cert": "# c\n2026-06-25 01:02:03," + "d" * 40 + ",Dridex C&C\n2026-06-25,nothex,x\n",
    "sslbl_ja3": "# c\n" + "e" * 32 + ",2017-01-01,2018-01-01,Adware\nbad,2017,2018,x\n",
    "openphish": "http://phish.example/login\nnot a url\n# c\nftp://x.example\n",
    "et_compromised": "192.0.2.9\n# c\n\n2001:db8::1\n999.1.1.1\n",
    "spamhaus_drop": '{"cidr":"198.51.100.77/24","sblid":"SBL1","rir":"x"}\nnot json\n{"type":"metadata","timestamp":1}\n{"cidr":"2001:db8::/32","sblid":"SBL2"}\n',
    "dshield": "# c\n203.0.113.9\t203.0.113.255\t24\t99\tname\tXX\tmail\nshort\trow\n203.0.113.9\tx\tbad\n",
    "abuseipdb": json.dumps({"meta": {}, "data": [{"ipAddress": "192.0.2.3", "countryCode": "DE"}, {"ipAddress": "2001:db8::5", "countryCode": None}, {"ipAddress": " "}]}),
    "cins": "192.0.2.200\nhost.example\n",
}
PATTERNS = {
    "urlhaus": ["[url:value = 'http://bad.example/a\\'b']"],
    "malwarebazaar": ["[file:hashes.'SHA-256' = '" + "a" * 64 + "']"],
    "threatfox": ["[ipv4-addr:value = '192.0.2.1']", "[domain-name:value = 'evil.example']", "[url:value = 'http://e.example']", "[file:hashes.MD5 = '" + "b" * 32 + "']", "[file:hashes.'SHA-256' = '" + "c" * 64 + "']"],
    "feodo": ["[ipv4-addr:value = '192.0.2.7']"],
    "sslbl_cert": ["[x509-certificate:hashes.'SHA-1' = '" + "d" * 40 + "']"],
    "sslbl_ja3": ["[text:value = '" + "e" * 32 + "']"],
    "openphish": ["[url:value = 'http://phish.example/login']"],
    "et_compromised": ["[ipv4-addr:value = '192.0.2.9']"],
    "spamhaus_drop": ["[ipv4-addr:value = '198.51.100.0/24']"],
    "dshield": ["[ipv4-addr:value = '203.0.113.0/24']"],
    "abuseipdb": ["[ipv4-addr:value = '192.0.2.3']", "[ipv6-addr:value = '2001:db8::5']"],
    "cins": ["[ipv4-addr:value = '192.0.2.200']"],
}


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    folder = tmp_path_factory.mktemp("feeds")
    out = {}
    for name, body in BODIES.items():
        (folder / name).write_text(body)
        out[name] = str(folder / name)
    return out


def test_all_feeds_have_bodies():
    assert set(BODIES) == {f.name for f in feeds.FEEDS} and len(feeds.FEEDS) == 12 and feeds.FEEDS[-1].name == "cins"


@pytest.mark.parametrize("name", sorted(BODIES))
def test_patterns(spark, paths, name):
    feed = feeds.BY_NAME[name]
    rows = feed.project(feed.read(spark, paths[name]))
    assert sorted(r["pattern"] for r in rows.collect()) == sorted(PATTERNS[name])
    assert {r["source_name"] for r in rows.collect()} == {name}


def test_labels_and_dates(spark, paths):
    rows = {(r["source_name"], r["name"]): r for r in feeds.candidates(spark, paths).collect()}
    assert rows["urlhaus", "http://bad.example/a'b"]["labels"] == ["Mozi", "exe"]
    assert rows["malwarebazaar", "a" * 16]["labels"] == ["Emotet", "exe", "emotet"]
    assert rows["sslbl_cert", "d" * 40]["valid_from"] == "2026-06-25T01:02:03+00:00" and rows["sslbl_cert", "d" * 40]["labels"] == ["c2", "Dridex C&C"]
    assert rows["sslbl_ja3", "e" * 32]["labels"] == ["ja3", "c2", "fp-prone", "Adware"]
    assert rows["spamhaus_drop", "198.51.100.0/24"]["labels"] == ["hijacked-netblock", "SBL1"]


def test_bad_status_gives_no_rows(spark, tmp_path):
    (tmp_path / "b").write_text(json.dumps({"query_status": "no_results", "data": [{"ioc": "x", "ioc_type": "domain"}]}))
    assert feeds.read_threatfox(spark, str(tmp_path / "b")).count() == 0
    assert feeds.status_of(feeds.BY_NAME["cins"], 0) == "error" and feeds.status_of(feeds.BY_NAME["cins"], 0, keyed=False) == "disabled" and feeds.status_of(feeds.BY_NAME["urlhaus"], 0) == "ok"


@pytest.mark.parametrize(("feed", "days", "many", "score"), [("feodo", 0, 1, 65), ("sslbl_cert", 7, 1, 53), ("feodo", 0, 3, 100), ("urlhaus", 11, 1, 40), ("unknown", 0, 1, 45), ("feodo", -3, 1, 65)])
def test_scores(spark, feed, days, many, score):
    now = F.lit("2026-07-01 12:00:00").cast("timestamp")
    seen = now - F.make_interval(days=F.lit(days))
    assert spark.range(1).select(I.confidence(F.lit(feed), seen, now, many)).first()[0] == score


@pytest.mark.parametrize(("text", "known"), [("2026-06-25T00:00:00Z", True), ("2026-06-25T00:00:00.5+00:00", True), ("2026-06-25", True), ("2026-06-25 00:00:00", True), ("2026-06-25 00:00:00 UTC", False), ("", False), (None, False), ("soon", False), ("2026-13-45", False)])
def test_feed_times(spark, text, known):
    now = F.lit("2026-07-01 12:00:00").cast("timestamp")
    out = spark.range(1).select((times.feed_time(F.lit(text).cast("string"), now) == now)).first()[0]
    assert out != known


def test_documents_and_bundle(spark, paths):
    now = F.lit("2026-06-26 00:00:00").cast("timestamp")
    docs = I.documents(feeds.candidates(spark, paths), now)
    row = docs.where("feed = 'urlhaus'").first()
    assert row["value"] == "http://bad.example/a'b" and row["confidence"] == 25 + 9 + 15 and row["stix_id"].startswith("indicator--") and row["stix_id_source"] == "derived"
    assert I.alerts(docs, order=("ts", "pattern")).where("confidence < 55").count() == 0
    body = json.loads(I.bundle(docs, order=("ts", "pattern")).first()["bundle"])
    assert body["type"] == "bundle" and len(body["objects"]) == docs.count() and body["objects"][0]["valid_from"] == "2026-06-26T00:00:00Z"


def test_rejected_inserts_do_not_count_as_seen(spark):
    rows = spark.createDataFrame([(1, "k", "2026-01-01 00:00:00", False), (2, "k", "2026-01-01 01:00:00", True), (3, "k", "2026-01-01 02:00:00", True), (4, "k", "2026-01-02 01:00:00", True)], "id int, k string, t string, ok boolean")
    rows = rows.withColumn("t", F.col("t").cast("timestamp"))
    kept = I.accept_first(rows, ["k"], "t", "id", inserted="ok")
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 4]


def test_keys_with_many_rows_take_rounds(spark):
    import random

    rng = random.Random(4)
    data = [(k, rng.choice(["a", "a", "a", "b", None]), rng.randrange(0, 9 * 144) * 600, rng.random() < 0.8) for k in range(600)]
    rows = spark.createDataFrame(data, "id int, k string, s int, ok boolean").withColumn("t", F.timestamp_seconds("s"))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    for inserted in (None, "ok"):
        whole = ids(I.accept_first(rows, ["k"], "t", "id", inserted=inserted))
        assert whole == ids(I.accept_first(rows, ["k"], "t", "id", inserted=inserted, most=200)) == ids(I.accept_first(rows, ["k"], "t", "id", inserted=inserted, most=1))


def greedy(rows, span):
    """ids of (id, key, time, ok) that are accepted, one key after the other in order."""
    kept, last = set(), {}
    for i, k, t, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or t - last[k] >= span:
            kept.add(i)
            if ok:
                last[k] = t
    return kept


@pytest.mark.parametrize(("n", "days", "keys", "share"), [(60_000, 400, ["hot"], 1.0), (40_000, 2, ["hot", "hot", "hot", None, "b"], 0.7), (3_000, 3_000, ["hot", "x"], 0.9), (20_000, 0, ["hot"], 0.5)])
def test_hot_keys_are_accepted_by_doubling(spark, n, days, keys, share):
    import random

    rng = random.Random(n)
    data = [(k, rng.choice(keys), rng.randrange(0, days * 86_400 + 1), rng.random() < share) for k in range(n)]
    rows = spark.createDataFrame(data, "id int, k string, s int, ok boolean").withColumn("t", F.timestamp_seconds("s")).repartition(6)
    got = {r["id"] for r in I.accept_first(rows, ["k"], "t", "id", inserted="ok", most=100).collect()}
    assert got == greedy(data, 86_400)
