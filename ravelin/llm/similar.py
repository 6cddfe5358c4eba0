"""Near copies by the Jaccard similarity of their sets of word shingles.

SimHash can't separate a similarity of 0.8: such texts lie about ten of 64 bits apart, where a list that all of them
share holds a large part of all rows. So the links of fingerprints (simhash.py) can be asked for beside those of sets,
but can't stand for them. Candidates for the sets come from lists of band keys (BANDS keys of ROWS minima of the
set under fixed permutations each), and each candidate pair is decided by the sets themselves. A pair of similarity
s shares a list with probability 1 - (1 - s**ROWS)**BANDS: 0.9983 at 0.8, 0.99998 at 0.85.

In lists of up to SMALL sets all pairs are candidates. In longer lists each set first meets two others: the one with
the longest lists (the text that the others are copies of shares most) and one by a hash, another one in each list.
That connects most of a group of copies. Then the long lists whose sets are not all connected yet are worked through
exactly: sets of the largest connected group are dealt out in chunks, all other sets of the list go to each chunk, and
a task looks for links inside its chunk, keeping a spanning forest of them. Pairs inside the group need no look, as
they are connected. Lists with very many sets outside the group are first split by further minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, in_batches, stored
from .simhash import components, fingerprint, labelled
from .simhash import links as linked

BANDS, ROWS, SMALL = 16, 5, 16
#: Further minima by which a long list is split, and how often.
SPLITS, LEVELS = 8, 4
_FACTORS = np.random.default_rng(5).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, size: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 of the word shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    grams = {b" ".join(words[k : k + size]) for k in range(n)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64, count=len(grams)))


def bands(hashes: np.ndarray) -> list[int]:
    """The keys of the lists that a set is in."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, np.multiply.outer(_FACTORS, hashes[k : k + 4096]).min(axis=1))
    return [xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, ROWS))]


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, with_bits: bool = False) -> DataFrame:
    """(id_col, fp, keys, shingles, bits) for each row: a hash of the set of shingles, its list keys, 32 bits of each shingle's hash, and the fingerprint of simhash.py if asked for.

    A task gives the shingles of a set once and null for its further rows, so many copies don't bring many sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in by_bytes(batch, 1):
                texts = part.column(1).to_pylist()
                sets = [shingles(t or b"", size) for t in texts]
                bits = np.array([fingerprint(t or b"") for t in texts] if with_bits else [], np.uint64).view(np.int64)
                fps = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                keys = np.array([bands(s) for s in sets], np.uint64).view(np.int64).reshape(-1)
                cuts = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
                low = []
                for s, fp in zip(sets, fps.tolist(), strict=True):
                    low.append(None if fp in seen else np.unique(s.astype(np.uint32)).tobytes())
                    seen.add(fp)
                if len(seen) > 500_000:
                    seen = set()
                own = pa.array(bits) if with_bits else pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), pa.ListArray.from_arrays(cuts, pa.array(keys)), pa.array(low, pa.binary()), own], names=[id_col, "fp", "keys", "shingles", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(F.col(id_col), F.col(text_col).cast("binary")), run, f"`{id_col}` {kind}, fp bigint, keys array<bigint>, shingles binary, bits bigint")


def fingerprint_links(own: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): each set (fp) with the least set of a component of fingerprints (bits) that one of its rows is in, those of op4."""
    rows = own.select("fp", "bits").distinct()
    stars = components(linked(rows.select(F.col("bits").alias("fp")).distinct(), max_bits))
    classes = rows.join(stars.withColumnRenamed("v", "bits"), "bits", "left").select("fp", F.coalesce("label", "bits").alias("class")).distinct()
    classes = stored(classes, "classes")
    least = classes.groupBy("class").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
    return classes.join(least, "class").where("fp <> u").select("u", F.col("fp").alias("v")).distinct()


def lists_of(distinct: DataFrame) -> DataFrame:
    """(key, fp, n): the lists of two and more distinct sets (fp, keys), with their sizes."""
    posts = distinct.select("fp", F.explode("keys").alias("key"))
    return posts.join(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def candidates(lists: DataFrame) -> DataFrame:
    """(u, v): pairs of sets in a shared list; all of a short list, two for each set of a long one."""
    short = lists.where(F.col("n") <= SMALL).select("key", "fp")
    pairs = short.select("key", F.col("fp").alias("u")).join(short.select("key", F.col("fp").alias("v")), "key").where("u < v").select("u", "v")
    long = lists.where(F.col("n") > SMALL)
    long = long.join(lists.groupBy("fp").agg(F.sum("n").alias("met")), "fp")
    some = long.groupBy("key").agg(F.max(F.struct("met", "fp"))["fp"].alias("most"), F.min(F.struct(F.xxhash64("fp", "key").alias("h"), "fp"))["fp"].alias("any"))
    met = long.select("key", F.col("fp").alias("v")).join(some, "key").select(F.explode(F.array("most", "any")).alias("u"), "v").where("u <> v")
    return pairs.unionByName(met).distinct()


def unconnected(lists: DataFrame, stars: DataFrame) -> DataFrame:
    """(key, fp, top, label): the sets of long lists that hold more than one component, with the label of the largest there and their own."""
    long = lists.where(F.col("n") > SMALL).select("key", "fp").join(stars.withColumnRenamed("v", "fp"), "fp", "left").select("key", "fp", F.coalesce("label", "fp").alias("label"))
    groups = long.groupBy("key", "label").agg(F.count("*").alias("g")).groupBy("key").agg(F.max(F.struct("g", "label")).alias("top"), F.count("*").alias("labels"), F.sum("g").alias("n"))
    return long.join(groups.where("labels > 1").select("key", F.col("top.label").alias("top")), "key")


def _deeper(rows: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """The same rows in lists of SPLITS further minima; a pair at 0.8 is still together in one of them but for one in 400,000."""
    factors = np.random.default_rng(100 + level).integers(0, 2**63, SPLITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [_least(np.frombuffer(x.as_buffer(), np.uint32), factors) for x in batch.column(1)]
            cuts = pa.array(np.arange(len(least) + 1, dtype=np.int32) * SPLITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, pa.array(np.array(least, np.uint64).view(np.int64).reshape(-1)))], names=["fp", "least"])

    wanted = sets.join(rows.select("fp").distinct(), "fp", "left_semi")
    least = in_batches(wanted.select("fp", "s"), run, "fp bigint, least array<bigint>")
    split = rows.join(least, "fp").select("fp", "top", "label", "key", F.posexplode("least").alias("j", "m"))
    return split.select(F.xxhash64("key", "j", "m").alias("key"), "fp", "top", "label")


def _least(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minima of a set under the permutations of the factors."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 4096):
        out = np.minimum(out, np.multiply.outer(factors, values[k : k + 4096].astype(np.uint64)).min(axis=1))
    return out


def _near(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same >= least * (len(x) + len(y) - same) - 1e-9


def _forest(fps: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets. Sets are compared where their minima agree often enough for the
    similarity, less five standard deviations."""
    marks = np.array([_least(x, _FACTORS) for x in sets])
    enough = len(_FACTORS) * least - 5 * np.sqrt(len(_FACTORS) * least * (1 - least))
    edges, rest = [], np.arange(len(sets))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            likely = np.flatnonzero((marks[rest] == marks[at]).sum(axis=1) >= enough)
            hit = np.array([k for k in likely if _near(sets[at], sets[rest[k]], least)], int)
            edges += [(fps[at], fps[rest[k]]) for k in hit]
            frontier += list(rest[hit])
            rest = np.delete(rest, hit)
    return edges


def within(rows: DataFrame, sets: DataFrame, least: float, chunk: int = 5_000, most: int = 20_000) -> DataFrame:
    """(u, v): links among the sets of unconnected lists, enough of them to keep every connection.

    chunk: sets of the largest group of a list that a task looks at with the others; most: others that a list may have
    before it is split."""
    level, ready = 0, None
    while True:
        sizes = rows.groupBy("key").agg(F.count_if(F.col("label") == F.col("top")).alias("g"), F.count_if(F.col("label") != F.col("top")).alias("o")).where("o > 0")
        rows = stored(rows.join(sizes, "key"), "rest")
        small = rows.where((F.col("o") <= most) | F.lit(level >= LEVELS))
        chunks = F.ceil(F.col("g") / chunk)
        own = F.when(F.col("label") == F.col("top"), F.array(F.pmod(F.xxhash64("fp", "key"), chunks))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(chunks - 1, F.lit(0))))
        dealt = small.select("fp", "key", F.explode(own).alias("chunk")).select("fp", F.xxhash64("key", "chunk").alias("part"))
        ready = dealt if ready is None else ready.unionByName(dealt)
        rows = rows.where((F.col("o") > most) & F.lit(level < LEVELS)).select("key", "fp", "top", "label")
        if not rows.limit(1).count():
            break
        rows, level = stored(_deeper(rows, sets, level), "rest"), level + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fps, held = None, [], []

        def found() -> pa.RecordBatch:
            pairs = np.array(_forest(fps, held, least), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            for own, fp, values in zip(*(batch.column(k) for k in range(3)), strict=True):
                if own.as_py() != part:
                    if len(held) > 1:
                        yield found()
                    part, fps, held = own.as_py(), [], []
                fps.append(fp.as_py())
                held.append(np.frombuffer(values.as_buffer(), np.uint32).copy())
        if len(held) > 1:
            yield found()

    rows = ready.distinct().join(sets, "fp").select("part", "fp", "s").repartition("part").sortWithinPartitions("part")
    return in_batches(rows, run, "u bigint, v bigint")


def links(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets (fp, s) have a Jaccard similarity of least or more."""
    both = pairs.join(sets.select(F.col("fp").alias("v"), F.col("s").alias("b")), "v").join(sets.select(F.col("fp").alias("u"), F.col("s").alias("a")), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                near[k] = _near(np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32), least)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in batch.columns[:2]], names=["u", "v"])

    return in_batches(both.select("u", "v", "a", "b"), run, "u bigint, v bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, max_bits: int | None = None) -> DataFrame:
    """id_col, fp, component_id (the least id that links reach) for every row of docs.

    Two rows link if the sets of their word shingles have a Jaccard similarity of least or more, and, with max_bits, if
    their fingerprints differ in so many bits or fewer, as in simhash.near_duplicates; texts without words, null ones
    included, are copies of each other. Rows and ids are treated as simhash.near_duplicates does."""
    own = stored(sketches(docs, id_col, text_col, shingle, max_bits is not None), "sketches")
    distinct = stored(own.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.first("keys").alias("keys")), "distinct")
    lists = stored(lists_of(distinct), "lists")
    sets = stored(own.where("shingles is not null").join(lists.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("s")), "sets")
    found = links(sets, candidates(lists), least)
    if max_bits is not None:
        found = found.unionByName(fingerprint_links(own, max_bits))
    found = stored(found, "links")
    stars = components(found)
    rest = stored(unconnected(lists, stars), "rest")
    if rest.limit(1).count():
        more = stored(within(rest, sets, least), "links")
        stars = components(found.unionByName(more))
    return labelled(own, distinct, stars, id_col)
