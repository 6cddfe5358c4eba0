"""Near copies by five-word shingles against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from ravelin.llm import similar
from ravelin.llm.common import table
from test_operators import ODD, SF, brute_components

STAGE = corpus_pipeline.STAGES[1][1]


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(texts, least=0.8):
    sets, label = [brute_set(t) for t in texts], list(range(len(texts)))
    root = lambda k: k if label[k] == k else root(label[k])
    for a, b in combinations(range(len(sets)), 2):
        same = len(sets[a] & sets[b])
        if same >= least * (len(sets[a]) + len(sets[b]) - same) - 1e-9:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return [root(k) for k in range(len(texts))]


def edited(rng, words, every, at=0):
    """The words with every so-manyth replaced."""
    return [f"new{rng.randrange(10**9)}" if k % every == at else w for k, w in enumerate(words)]


def some_words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def kept(spark, texts):
    rows = [(k, t, "en", "made", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, table(spark, SF, "documents").schema)
    return sorted(r["doc_id"] for r in STAGE(spark, docs, SF).collect())


def test_stage_drops_copies_from_four_fifths_on(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(10):
        words = some_words(rng, 300)
        texts += [" ".join(x) for x in (words, edited(rng, words, 55), edited(rng, words, 20))]  # 0.82 and 0.6 alike
    assert [brute_groups(texts)[k] for k in range(3)] == [0, 0, 2]
    assert kept(spark, texts) == sorted(set(brute_groups(texts)))


def test_long_lists_find_the_text_that_all_are_copies_of(spark):
    rng = random.Random(2)
    words = some_words(rng, 300)
    texts = []
    for _ in range(50):
        places = set(rng.sample(range(5, 295), 5))
        texts.append(" ".join(f"new{rng.randrange(10**9)}" if k in places else w for k, w in enumerate(words)))
    texts.append(" ".join(words))
    assert len(set(brute_groups(texts[:-1]))) > 10 and set(brute_groups(texts)) == {0}
    assert kept(spark, texts) == [0]


def test_documents_and_odd_texts(spark):
    texts = [r["text"] for r in table(spark, SF, "documents").select("text").collect()] + ODD
    assert kept(spark, texts) == sorted(set(brute_groups(texts)))


def test_band_keys_agree_as_often_as_they_should():
    rng = random.Random(3)
    met = 0
    for _ in range(300):
        words = some_words(rng, 300)
        a, b = (set(similar.bands(similar.shingles(" ".join(x).encode()))) for x in (words, edited(rng, words, 48)))
        met += bool(a & b)
    assert met >= 297


def connected(n, edges):
    label = list(range(n))
    root = lambda k: k if label[k] == k else root(label[k])
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return [root(k) for k in range(n)]


@pytest.mark.parametrize(("chunk", "most"), [(5_000, 20_000), (7, 20_000), (7, 5)])
def test_unconnected_lists_are_worked_through_exactly(spark, chunk, most):
    """A group that is connected already, chains of copies of copies, and strangers, all in one list: every link between groups is kept."""
    rng = random.Random(5)
    base = some_words(rng, 300)
    texts = [base]
    for _ in range(29):  # near the base, far from each other
        places = set(rng.sample(range(5, 295), 5))
        texts.append([f"new{rng.randrange(10**9)}" if k in places else w for k, w in enumerate(base)])
    for _ in range(3):
        chain = some_words(rng, 300)
        for step in range(6):
            texts.append(list(chain))
            for k in range(step * 50 + 2, step * 50 + 50, 12):
                chain[k] = f"new{rng.randrange(10**9)}"
    bridge = list(texts[29])
    bridge[200:206] = some_words(rng, 6)
    texts += [bridge, *(some_words(rng, 300) for _ in range(12))]
    sets = [np.unique(similar.shingles(" ".join(t).encode()).astype(np.uint32)) for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if similar._near(sets[a], sets[b], 0.8)]
    known = connected(len(sets), [(0, k) for k in range(30)])  # what the first links have connected
    rows = spark.createDataFrame([(1, k, 0, known[k]) for k in range(len(sets))], "key bigint, fp bigint, top bigint, label bigint")
    stored = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sets)], "fp bigint, s binary")
    found = [(r["u"], r["v"]) for r in similar.within(rows, stored, 0.8, chunk=chunk, most=most).collect()]
    assert all(similar._near(sets[a], sets[b], 0.8) for a, b in found)
    assert connected(len(sets), found + [(0, k) for k in range(30)]) == connected(len(sets), pairs)
    assert len(set(connected(len(sets), pairs))) < len(set(known))


def test_lists_with_several_components_are_seen(spark):
    lists = spark.createDataFrame([(1, k, 20) for k in range(20)] + [(2, k, 20) for k in range(20)] + [(3, 0, 2), (3, 50, 2)], "key bigint, fp bigint, n bigint")
    stars = spark.createDataFrame([(k, 0) for k in range(19)], "v bigint, label bigint")
    assert similar.unconnected(lists.where("key <> 2 or fp < 19"), stars).select("key").distinct().collect()[0]["key"] == 1
    assert {(r["fp"], r["top"], r["label"]) for r in similar.unconnected(lists, stars).where("key = 2 and fp > 17").collect()} == {(18, 0, 0), (19, 0, 19)}


def test_stage_drops_copies_of_op4_too(spark):
    """Components of links by fingerprint and of links by set together; either kind alone leaves more texts."""
    rng = random.Random(6)
    texts = ["a a a a", "a a a a a", "b b b b b b"]  # one fingerprint for the first two, no shingle of five words in common
    for _ in range(30):
        words = some_words(rng, 300)
        texts += [" ".join(words), " ".join(edited(rng, words, 40)), " ".join(edited(rng, words, 60, 30))]
    sets, bits = brute_groups(texts), [c for _, _, c in sorted(brute_components(list(enumerate(texts))))]
    both = connected(len(texts), list(enumerate(sets)) + list(enumerate(bits)))
    assert len(set(both)) < min(len(set(sets)), len(set(bits)))
    assert kept(spark, texts) == sorted(set(both))
