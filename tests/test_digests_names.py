"""Digests of buckets against whole comparisons, and names at once against a pattern for each."""

import random

import pytest
from pyspark.sql import functions as F

from ravelin.functions import names
from ravelin.functions import text as T
from ravelin.operators import digests, extraction, graph


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, a string, b string, n int")


def tidy(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("change", ["none", "one", "many", "repeats", "nulls", "empty", "other empty"])
def test_differences_by_digest(spark, tmp_path, change):
    rows = [(k if k % 50 else None, f"a{k % 7}", None if k % 3 else "b", k % 5) for k in range(900)] + [(5, "a", "b", 1)] * 4
    other = list(rows)
    random.Random(1).shuffle(other)
    if change == "one":
        other[17] = (other[17][0], "changed", None, 9)
    elif change == "many":
        other = [(k, a, b, (n or 0) + 1) for k, a, b, n in other[:600]]
    elif change == "repeats":
        other = [r for r in other if r != (5, "a", "b", 1)] + [(5, "a", "b", 1)] * 2 + [rows[3]] * 2
    elif change == "nulls":
        other = [(k, b, a, n) if k and k % 100 == 1 else (k, a, b, n) for k, a, b, n in other]  # swapped values hash apart
    elif change == "empty":
        other = []
    one, two = table(spark, [] if change == "other empty" else rows), table(spark, other)
    kept = [digests.Digested(spark, str(tmp_path / name), 64).write(df, ["k"]) for name, df in (("one", one), ("two", two))]
    assert tidy(digests.differences(*kept)) == tidy(graph.differences(one, two))


def test_only_unlike_buckets_are_read(spark, tmp_path):
    rows = spark.range(50_000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    other = rows.withColumn("v", F.when(F.col("k").isin(7, 20_000, 49_999), "other").otherwise(F.col("v")))
    one, two = (digests.Digested(spark, str(tmp_path / n), 512).write(df, ["k"]) for n, df in (("one", rows), ("two", other)))
    buckets = digests.unlike_buckets(one, two)
    assert 1 <= len(buckets) <= 3
    assert one.rows().where(F.col("_bucket").isin(buckets)).count() < 0.01 * 50_000
    out = digests.differences(one, two)
    assert tidy(out.select("k", "side")) == sorted([(k, s) for k in (7, 20_000, 49_999) for s in ("missing", "unexpected")], key=repr)
    assert "PartitionFilters: [isnotnull(_bucket" in out._jdf.queryExecution().toString() or "PartitionFilters: [_bucket" in out._jdf.queryExecution().toString()


def test_ranges_add_up(spark, tmp_path):
    rows = spark.range(5_000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    t = digests.Digested(spark, str(tmp_path / "t"), 128).write(rows, ["k"])
    whole = digests.digest(rows, ["k", "v"]).first()
    assert tuple(digests.ranges(t.digests(), 1_000).select("rows", "total", "folded").first()) == tuple(whole)
    with pytest.raises(ValueError):
        digests.unlike_buckets(t, digests.Digested(spark, str(tmp_path / "t"), 64))


TEXTS = ["APT28 and apt-28; apt281, xAPT28", "Evil Corp's evil corporation (EVIL CORP)", "ΣΊΣΥΦΟΣ ñandú Ñandú_x ñandúes", "a.b*c a.b*c1 a.b́ _a.b", "", None, "İstanbul ISTANBUL istanbul", "日本 日本語", "apt28" * 30_000, "lazarus\nlazarus group\tlazarus  group"]
NAMES = ["APT28", "apt-28", "Evil Corp", "evil", "Σίσυφος", "ñandú", "a.b", "a.b*c", "", "日本", "istanbul", "Lazarus Group", "lazarus", "absent", "\\E.*\\Q", "28", None]


def test_names_stand_in_texts_as_by_pattern(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    pairs = docs.crossJoin(spark.createDataFrame([(n,) for n in NAMES], "name string"))
    want = {(r["doc_id"], r["name"]) for r in pairs.where(T.mentions(F.col("text"), F.col("name"))).collect()}
    lists = docs.withColumn("names", F.array(*[F.lit(n).cast("string") for n in NAMES]))
    got = {(r["doc_id"], n) for r in lists.select("doc_id", names.stand_in(F.col("text"), F.col("names")).alias("hit")).collect() for n, h in zip(NAMES, r["hit"], strict=True) if h}
    assert got == want
    listed = spark.createDataFrame([(n,) for n in NAMES], "name string")
    lower = {(d, n) for d, n in {(r["doc_id"], r["low"]) for r in pairs.where(T.mentions(F.col("text"), F.col("name"))).withColumn("low", F.lower("name")).collect()}}
    for most in (names.LIST_BYTES, 20):
        assert {tuple(r) for r in names.mentioned(docs, listed, most_bytes=most).collect()} == lower
    assert names.mentioned(docs, listed.where("false")).count() == names.mentioned(docs.where("false"), listed).count() == 0


def test_names_of_one_word_need_no_automaton(spark, monkeypatch):
    """However many they are: they are joined with the words of the texts, whose hashes are sent or, beyond a number, not."""

    def none(listed):
        raise AssertionError("an automaton")

    docs = spark.createDataFrame([*enumerate(TEXTS), (0, TEXTS[0])], "doc_id int, text string")
    single = spark.createDataFrame([(n,) for n in NAMES if n and n.isalnum()] + [(f"word{k}",) for k in range(500)], "name string")
    pairs = docs.crossJoin(single.where("name not like 'word%'")).where(T.mentions(F.col("text"), F.col("name")))
    want = sorted((r["doc_id"], r["low"]) for r in pairs.withColumn("low", F.lower("name")).collect())
    monkeypatch.setattr(names, "automaton", none)
    for most in (names.MOST_HASHES, 3):
        assert sorted(tuple(r) for r in names.mentioned(docs, single, most_hashes=most).collect()) == want != []
    monkeypatch.setattr(names, "PIECE_BYTES", 10)
    assert sorted(tuple(r) for r in names.mentioned(docs, single).collect()) == want


def test_grounded_names_as_by_pattern(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma ray", "delta-4", "é", "Unknown", "x", "cut…", "alphabet"]
    docs = spark.createDataFrame([(k, " ".join(rng.choices([*words, "ALPHA,", "(beta)", "alpha_beta"], k=12))) for k in range(40)], "doc_id int, text string")
    given = spark.createDataFrame([(rng.randrange(45), rng.choice(["threat_actors", "sectors"]), rng.choice([*words, None, ""])) for _ in range(400)], "doc_id int, category string, name string")
    joined = given.join(docs, "doc_id")
    from ravelin.functions import identifiers as I

    want = joined.where(I.is_valid_name(F.col("name"), F.col("category")) & T.mentions(F.col("text"), F.col("name"))).drop("text")
    assert tidy(extraction.grounded_names(given, docs)) == tidy(want) != []


def test_catalog_mentions(spark):
    catalog = spark.createDataFrame([("actor", "1", "APT28", ["Fancy Bear", "apt28"]), ("actor", "2", "Bear", None), ("malware", "3", "apt28", []), ("actor", "4", "", ["zebra"])], "category string, id string, name string, aliases array<string>")
    docs = spark.createDataFrame([(1, "fancy bear"), (2, "APT28!"), (3, "none"), (4, "Zebra"), (5, None)], "doc_id int, text string")
    assert tidy(extraction.catalog_mentions(docs, catalog)) == [(1, "actor", "1", "APT28"), (1, "actor", "2", "Bear"), (2, "actor", "1", "APT28"), (2, "malware", "3", "apt28"), (4, "actor", "4", "")]
