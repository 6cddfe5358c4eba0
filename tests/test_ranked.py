"""Ranked search and similar names against plain loops."""

import difflib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ravelin.operators import evaluate, ranked
from ravelin.session import stored


def _plain(keywords, texts, most):
    """Scores of all pairs, one by one."""
    bags = {k: Counter(re.findall(r"[^\W_]+", t.lower())) for k, t in texts.items()}
    bags = {k: b for k, b in bags.items() if b}
    n, words = len(bags), sum(sum(b.values()) for b in bags.values())
    df = Counter(t for b in bags.values() for t in b)
    out = []
    for q in sorted({k for k in keywords if k is not None}):
        own = set(re.findall(r"[^\W_]+", q.lower()))
        scores = {}
        for k, b in bags.items():
            back = ranked.SATURATION * (1 - ranked.LENGTH + ranked.LENGTH * sum(b.values()) * n / words)
            gains = [math.floor(1000 * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * (ranked.SATURATION + 1) / (b[t] + back)) for t in own if b[t]]
            if gains:
                scores[k] = sum(gains)
        out += [(q, r, k, scores[k]) for r, k in enumerate(sorted(scores, key=lambda k: (-scores[k], k))[:most], 1)]
    return out


def test_best_equals_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.expovariate(0.15))}" for _ in range(300)]
    texts = {k: " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30))) for k in range(150)} | {900: "", 901: "Äther w1-w1 W1", 902: "Äther w1-w1 W1"}
    keywords = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 6))) for _ in range(60)] + ["äther", "nowhere", "", None, "w0 w1 w2", "w0 w1 w2", "W1 w1"]
    entities = spark.createDataFrame([*texts.items(), (903, None), (None, "w1")], "id long, text string")
    lists = stored(ranked.postings(entities, F.col("text")), "postings")
    asked = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    for most in (1, 5):
        found = sorted((r["keyword"], r["rank"], r["id"], r["score"]) for r in ranked.best(asked, lists, most).collect())
        assert found == _plain(keywords, texts, most)


def test_first_hits_skip_misses(spark):
    entities = spark.createDataFrame([("t1", "Spearphishing Link"), ("t2", "Phishing"), ("t3", None)], "id string, name string")
    asked = spark.createDataFrame([("phishing", 1), ("phishing", 2), ("link", 3), ("none", 4), (None, 5)], "keyword string, n int")
    assert sorted((r["n"], r["id"]) for r in ranked.first_hits(asked, entities, F.col("name")).collect()) == [(1, "t2"), (2, "t2"), (3, "t1")]
    assert ranked.first_hits(asked, entities.limit(0), F.col("name")).count() == 0


def test_similar_names_equal_difflib_with_few_comparisons(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop.-", k=rng.randrange(1, 14)))

    def changed(w):
        at = rng.randrange(len(w) + 1)
        return w[:at] + rng.choice("abcxyz") + w[at + rng.randrange(2) :]

    rows = []
    for k in range(150):
        names = [word() for _ in range(6)] + ["", "é"]
        rows.append((k, names, [word() for _ in range(25)] + [changed(rng.choice(names[:6])) for _ in range(3)]))
    table = spark.createDataFrame(rows, "id long, names array<string>, pool array<string>")
    out = evaluate.resembling(table, F.col("names"), F.col("pool"), 0.75, "near").select("id", "near", F.transform(evaluate.candidates(evaluate.lettered(F.col("names")), evaluate.lettered(F.col("pool")), 0.75), F.size).alias("left")).collect()
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {k: [any(ratio(o, n) >= 0.75 for o in pool) for n in names] for k, names, pool in rows}
    assert {r["id"]: r["near"] for r in out} == want
    assert sum(map(sum, want.values())) > 100
    assert sum(sum(r["left"]) for r in out) < 0.1 * sum(len(n) * len(p) for _, n, p in rows)


def test_copies_of_entities_are_scored_once(spark, monkeypatch):
    texts = {k: f"w{k % 6} w{k % 4} common" for k in range(600)}
    keywords = ["w1 common", "w2 w3", "common", "w5 w0 w9"]
    sizes = {}

    def watched(df, label, *partitions):
        out = stored(df, label, *partitions)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(ranked, "stored", watched)
    lists = stored(ranked.postings(spark.createDataFrame([*texts.items()], "id long, text string"), F.col("text")), "postings")
    asked = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    found = sorted((r["keyword"], r["rank"], r["id"], r["score"]) for r in ranked.best(asked, lists, 5).collect())
    assert found == _plain(keywords, texts, 5)
    assert sizes["led"] <= len(keywords) * len(set(texts.values()))
