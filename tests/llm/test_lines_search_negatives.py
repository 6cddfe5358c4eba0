"""Line dedup, ranked search and hard negatives against brute force, on rows of every odd kind."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import lines, negatives, search

WHITE = " \t\n\v\f\r"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def texts(seed=5, n=160):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma's", "délta", "42", "ÑU", "x_y", "日本", "tail"]
    pool = [" ".join(rng.choices(words, k=rng.randrange(0, 5))) for _ in range(30)] + ["", "  ", "\t", "Shared LINE\r", " shared line", "shared line\x0b", "\x1cshared line"]
    data = [(k, "\n".join(rng.choices(pool, k=rng.randrange(0, 9)))) for k in range(n)]
    return data + [(3, data[3][1]), (3, "another row of id 3\nshared line"), (None, "shared line\nown"), (None, None), (9_000, ""), (9_001, "\n\n"), (9_002, "one line\n" * 3000 + "x" * 100_000)]


def without_common(data, least_docs, least_chars):
    key = lambda line: low(line.strip(WHITE))
    n = Counter(k for _, t in data for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, c in n.items() if c >= least_docs and len(k) >= least_chars}
    out = []
    for i, t in data:
        own = (t or "").split("\n")
        kept = [x for x in own if key(x) not in gone]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [lines.SENT, 0])
@pytest.mark.parametrize(("least_docs", "least_chars"), [(10, 1), (3, 6), (10_000, 1)])
def test_common_lines_go(spark, most, least_docs, least_chars):
    data = texts()
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns(dict.fromkeys(("_id", "_text", "h1", "_k1", "place", "n_lines", "_places"), F.lit("clash"))).repartition(5)
    out = lines.drop_common_lines(docs, least_docs=least_docs, least_chars=least_chars, most=most)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == without_common(data, least_docs, least_chars)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "x")], "item_id int, text string")
    assert lines.drop_common_lines(none).count() == lines.drop_common_lines(none, most=-1).count() == 0
    assert search.ranked(none, asked).count() == search.ranked(asked.withColumnRenamed("item_id", "doc_id"), asked.where("false")).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def by_rank(docs, queries, count):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t or ""))
    each = [(i, Counter(terms(t))) for i, t in docs]
    N, L = sum(1 for _, c in each if c), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in queries:
        scores = []
        for i, c in each:
            if not c:
                continue
            m = 50 + (50 * sum(c.values()) * N) // L
            scores.append((sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c), i))
        best = sorted(((s, i) for s, i in scores if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:count]
        out += [(item, k + 1, i, s) for k, (s, i) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("count", "size", "query_bytes"), [(50, 32, search.QUERY_BYTES), (7, 4, 60_000), (500, 1, search.QUERY_BYTES)])
def test_ranks(spark, count, size, query_bytes):
    data = texts(6) + [(20_000 + k, "alpha beta 42") for k in range(60)]  # many equal scores
    asked = [(k, t) for k, (_, t) in enumerate(texts(8, 12))] + [("same", "alpha"), ("same", "alpha"), (None, "BETA Alpha"), (77, None), (78, "?!"), (79, "absent")]
    asked = [(None if i is None else str(i), t) for i, t in asked]
    clash = dict.fromkeys(("_id", "n", "terms", "lead", "q", "score", "rank"), F.lit("clash"))
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns(clash).repartition(3)
    queries = spark.createDataFrame(asked, "item_id string, text string").withColumns(clash)
    out = search.ranked(docs, queries, count=count, size=size, query_bytes=query_bytes)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == by_rank(data, asked, count)


def test_ranks_of_text_ids_and_large_sums(spark):
    data = [(f"d{k % 40}é", " ".join(f"w{(k * j) % 97}" for j in range(1, 3 + k % 9))) for k in range(80)]
    asked = [(1, " ".join(f"w{k}" for k in range(97))), (2, "w3 w4")]
    out = search.ranked(spark.createDataFrame(data, "doc_id string, text string"), spark.createDataFrame(asked, "item_id int, text string"), count=9, size=5)
    found = defaultdict(list)
    for item, rank, doc, score in by_rank([(i, t) for i, t in data], asked, 80):
        found[item].append((-score, doc))
    for item, rows in found.items():
        assert [(-r["score"], r["doc_id"]) for r in sorted(out.where(F.col("item_id") == item).collect(), key=lambda r: r["rank"])] == sorted(rows)[:9]


def test_sums_are_exact_beyond_doubles():
    p = search.Postings.of(np.array([1, 1, 2]), np.array([0, 1, 1]), np.array([999_999, 3, 7]))
    heavy = np.array([2**42 + 1, 2**42 + 3], np.int64)
    assert p.sums(np.array([1, 2]), heavy, 3).tolist() == [999_999 * (2**42 + 1), 3 * (2**42 + 1) + 7 * (2**42 + 3), 0]


def vectors(seed=2, n=260, width=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, width))
    rows = [(int(k), [float(x) for x in base[k % 12] * 0.6 + rng.normal(size=width) * 0.3], int(rng.integers(0, 10))) for k in range(n)]
    rows += [(1_000 + k, rows[50][1], k % 3) for k in range(30)]  # equal vectors
    rows += [(50, rows[7][1], 4), (50, rows[50][1], rows[50][2]), (None, rows[100][1], 1), (None, rows[100][1], 2)]  # repeated and null ids
    bad = list(rows[1][1])
    rows += [(2_000, None, 1), (2_001, bad, None), (2_050, [*bad[:3], None, *bad[4:]], 1), (2_100, [*bad[:3], float("nan"), *bad[4:]], 1), (2_150, [float("inf"), *bad[1:]], 2), (2_200, [], 3), (2_250, bad[:5], 3), (2_251, [1e300, *bad[1:]], 3)]
    return rows


def mined(rows, positives=5, count=3, low_=50, high=95):
    width = max(len(v) for _, v, _ in rows if v)
    own = []
    for k, (i, v, label) in enumerate(rows):
        if v is None or label is None or any(x is None or not math.isfinite(x) or abs(x) > 60_000 for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (width - len(v))
        own.append((k, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, q))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for k, i, label, q in own:
        if i is None or i % 50:
            continue
        scores = [(sum(a * b for a, b in zip(q, r, strict=True)), j, other) for n, j, other, r in own if n != k]
        for ps, p, _ in sorted((x for x in scores if x[2] == label), key=order)[:positives]:
            near = sorted((x for x in scores if x[2] != label and low_ * ps <= 100 * x[0] <= high * ps), key=order)[:count]
            out += [(i, p, r + 1, j, ps, ns) for r, (ns, j, _) in enumerate(near)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("positives", "count", "low_", "high", "chunk"), [(5, 3, 50, 95, negatives.ANCHORS), (2, 1, 0, 100, 5), (7, 9, -20, 99, negatives.ANCHORS)])
def test_hard_negatives(spark, positives, count, low_, high, chunk):
    rows = vectors()
    clash = dict.fromkeys(("_uid", "_id", "_label", "_q", "g", "score", "rank", "anchor_id"), F.lit("clash"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(clash).repartition(4)
    moved = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    out = negatives.hard_negatives(df, positives=positives, count=count, low=low_, high=high, relabel=moved, chunk=chunk)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == mined(rows, positives, count, low_, high)


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(3)
    q = np.floor(rng.normal(size=(400, 32)) * np.geomspace(2_000, 1, 32)).astype(np.int64)
    rotation = negatives.Rotation(q)
    seen = []

    def keep(lowest, highest):
        seen.append((lowest, highest))
        return highest >= 0

    exact = q @ q[:50].T
    r, a = rotation.survivors(rotation.turned(q), rotation.turned(q[:50]), np.ones((400, 50), bool), keep)
    assert (seen[0][0] <= exact).all() and (exact <= seen[0][1]).all()
    assert {(x, y) for x, y in zip(*np.nonzero(exact >= 0), strict=True)} <= set(zip(r.tolist(), a.tolist(), strict=True))
    assert len(r) < 1.1 * (exact >= 0).sum()
