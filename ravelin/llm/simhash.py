"""SimHash near-duplicates by an inverted index over the byte positions of the fingerprints.

Fingerprints that differ in at most three bits agree in at least five of their eight bytes. A posting list for
each single byte would hold a 256th of all fingerprints, so the index uses sets of four byte positions: the 14
sets {a, b, c, a^b^c}. Whichever three bytes differ, one of these sets avoids them, so every link meets in some
posting list. In a list, the bytes that two fingerprints share are tallied, pairs with fewer than the guaranteed
number are dropped, and the rest are verified bit by bit. Of the links in a list only a spanning forest leaves
the task; this keeps all connections and stays linear in the size of the list.

Components are found by alternating star contractions, each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, in_batches, stored

#: The 14 sets of four byte positions whose exclusive or is zero.
BLOCKS = sorted({tuple(sorted((a, b, c, a ^ b ^ c))) for a, b, c in combinations(range(8), 3)})
MASKS = np.array([sum(0xFF << (8 * p) for p in block) for block in BLOCKS], dtype=np.uint64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.intp)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=n)
    places = (hashes.view(np.uint8).reshape(n, 8) + _PLACE).ravel()
    counts = np.bincount(places, minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * counts.ravel() > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp) for each row; fp is the fingerprint as a signed long. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(F.col(id_col), F.col(text_col).cast("binary")), run, f"`{id_col}` {kind}, fp bigint")


def _forest(fps: np.ndarray, max_bits: int, wide: int = 16384) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one posting list.

    Each fingerprint that is reached looks once at those not reached yet. Longer lists than `wide` are first
    split by each further byte position, as their links share one more byte."""
    if len(fps) > wide:
        lanes = fps.view(np.uint8).reshape(-1, 8)
        varied = [p for p in range(8) if (lanes[:, p] != lanes[0, p]).any()]
        if len(varied) > max_bits:
            edges = []
            for p in varied:
                order = np.argsort(lanes[:, p], kind="stable")
                for part in np.split(fps[order], np.flatnonzero(np.diff(lanes[order, p])) + 1):
                    edges += _forest(part, max_bits, wide)
            return edges
    edges, rest, least = [], fps, 8 - max_bits
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            apart = rest ^ at
            same = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # the tally of shared positional bytes
            near = same >= least
            near[near] = np.bitwise_count(apart[near]) <= max_bits
            found = rest[near]
            edges += [(int(at), int(x)) for x in found]
            frontier += list(found)
            rest = rest[~near]
    return edges


def _split(posts: DataFrame, most: int) -> DataFrame:
    """(fp, block, shared) with lists of more than `most` entries dealt out by a further byte.

    Fingerprints that link agree in at least one byte beside the four of their list, so each entry goes to one list
    for each of the other four positions, and every link is still in one of them."""
    sizes = stored(posts.groupBy("block", "shared").agg(F.count("*").alias("n")).where(F.col("n") > most).select("block", "shared"), "long")
    if not sizes.limit(1).count():
        return posts
    rows = posts.join(sizes.withColumn("long", F.lit(True)), ["block", "shared"], "left")
    others = F.array(*[F.array(*[F.lit(p) for p in range(8) if p not in b]) for b in BLOCKS])
    more = rows.where("long").select("fp", "block", "shared", F.explode(F.element_at(others, F.col("block") + F.lit(1))).alias("p"))
    byte = F.expr("shiftrightunsigned(fp, 8 * p)").bitwiseAND(F.lit(0xFF))
    # numbers of block beyond the 14 tell the further position; shared tells the list and the further byte
    more = more.select("fp", (F.col("block") + F.lit(len(BLOCKS)) * (F.col("p") + 1)).cast("int").alias("block"), F.xxhash64("shared", byte).alias("shared"))
    return rows.where("long is null").select("fp", F.col("block").cast("int").alias("block"), "shared").unionByName(more)


def links(distinct: DataFrame, max_bits: int = 3, max_list: int = 50_000) -> DataFrame:
    """(u, v): links among distinct fingerprints (column fp), enough of them to keep every connection.

    max_list: entries of a list that one task works on; longer lists are split."""
    if max_bits > 3:
        raise ValueError("four differing bytes can touch every set of positions; max_bits is 3 at most")
    posts = distinct.select("fp", F.explode(F.array(*[F.lit(k).cast("tinyint") for k in range(len(BLOCKS))])).alias("block"))
    masks = F.array(*[F.lit(int(m)) for m in MASKS.view(np.int64)])
    posts = posts.withColumn("shared", F.col("fp").bitwiseAND(F.element_at(masks, F.col("block") + F.lit(1))))
    posts = _split(posts, max_list).repartition("block", "shared").sortWithinPartitions("block", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the list that the next batch may go on with

        def edges_of(rows: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero((np.diff(rows[:, 1]) != 0) | (np.diff(rows[:, 2]) != 0)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(rows)]
            out: list[tuple[int, int]] = []
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                out += _forest(np.unique(rows[s:e, 0]).view(np.uint64), max_bits)
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            if not len(rows):
                continue
            if held and (rows[0, 1:] != held[0][0, 1:]).any():
                yield edges_of(np.concatenate(held))
                held = []
            back = np.flatnonzero((rows[:, 1:] != rows[-1, 1:]).any(axis=1))
            cut = back[-1] + 1 if len(back) else 0
            if cut:
                yield edges_of(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield edges_of(np.concatenate(held))

    return posts.select("fp", "block", "shared").mapInArrow(run, "u bigint, v bigint").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex that has an edge: label is the least vertex of its component.

    Large-star and small-star rounds until nothing changes; a round's edges are a table in the shared folder."""

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = Stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = digest(now.df)
    while state[0]:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = Stored(small.distinct(), "edges")
        now.drop()
        now, before, state = after, state, digest(after.df)
        if state == before:
            break
    return now.df.select(F.col("u").alias("v"), F.col("v").alias("label"))


def labelled(own: DataFrame, distinct: DataFrame, stars: DataFrame, id_col: str) -> DataFrame:
    """id_col, fp, component_id for every row of own; distinct has fp and first_id, stars the labels of linked fps."""
    of_fp = distinct.join(stars.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    least = of_fp.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_fp = of_fp.join(least, "label").select("fp", "component_id")
    return own.join(of_fp, "fp").select(id_col, "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """id_col, fp, component_id (the least id that links reach) for every row of docs.

    Null texts and texts without words have fingerprint 0 and link like others. Repeated rows each come back.
    A null id is never a component's id, unless all ids in the component are null. Extra columns are ignored;
    an empty table gives an empty result."""
    own = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min(id_col).alias("first_id")), "distinct")
    return labelled(own, distinct, components(links(distinct, max_bits)), id_col)
