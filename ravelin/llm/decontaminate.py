"""Benchmark decontamination by a distributed positional inverted index.

The windows of all benchmark items are made and grouped in Spark, equal ones once. A first pass counts the benchmark's
words in the corpus, and each window is looked up by its rarest words: as many as it takes for one of them to remain
in any run of words that is near the window. The second pass stores the index: one posting (word, row, position) for
each occurrence of such a word, with the words around it, so the lists of a window's other words are intersected at
their offsets without reading the texts again. Joining postings with windows gives the exact phrase matches and, where
enough of a window's words stand together around a posting, the proximity matches.

Words travel as 64-bit hashes. Which words matter is told to the tasks by bit maps of fixed size (2 ** BITS bits), so
nothing that is sent or gathered grows with the benchmark; words that a map lets through by chance join with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, in_batches, row_keys, stored

#: Each bit map is 2 MB; a benchmark of many million different words only fills it more.
BITS = 24
#: Look-ups that may be sent to all executors (about 300 bytes each); more are joined by shuffling.
BROADCAST_LOOKUPS = 50_000
#: Words that a task remembers.
MEMORY = 200_000
#: Lower-cases A-Z and turns every other ASCII character that is no digit or letter into a space.
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _marked(bits: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Whether the map has each term."""
    at = terms >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _short(terms: np.ndarray) -> np.ndarray:
    """32 bits of each term; 0 stays 0, and nothing else becomes 0."""
    folded = (terms ^ terms >> np.uint64(32)).astype(np.uint32)
    return np.where((folded == 0) & (terms != 0), np.uint32(1), folded).view(np.int32)


class _Terms(dict):
    """Words to places in `terms`: those that the map has to their own, all others to 0. What is asked again is remembered, about MEMORY words."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits, self.terms, self.n = bits, np.zeros(1024, np.uint64), 1

    def __missing__(self, word: bytes) -> int:
        term, place = xxhash.xxh64_intdigest(word) or 1, 0
        at = term >> (64 - BITS)
        if int(self.bits[at >> 6]) >> (at & 63) & 1:
            if self.n == len(self.terms):
                self.terms = np.concatenate([self.terms, np.zeros_like(self.terms)])
            place = self.n
            self.terms[place], self.n = term, place + 1
        self[word] = place
        return place

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all words of the texts, one after the other, and the number of words of each text."""
        if len(self) >= MEMORY:
            self.clear()
            self.n = 1
        each = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, each), np.int64, count=len(each))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(each)), np.int32, count=int(sizes.sum())), sizes


def _map_of(terms: DataFrame) -> np.ndarray:
    """The bit map of the column term; Spark makes its words."""
    at = F.shiftrightunsigned("term", 64 - BITS)
    found = terms.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    for row in found.toLocalIterator():
        out[row[0]] = row[1]
    return out.view(np.uint64)


def _windows(items: DataFrame, size: int) -> DataFrame:
    """(window, terms, ids, item): the windows of each item; equal ones share the number window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                terms = np.fromiter((xxhash.xxh64_intdigest(w) or 1 for w in words), np.uint64, count=len(words))
                wide = min(size, len(words))
                every = np.lib.stride_tricks.sliding_window_view(terms, wide) if wide else terms.reshape(0, 1)
                for k in range(0, len(every), 1 << 14):
                    part = np.ascontiguousarray(every[k : k + (1 << 14)])
                    cuts = pa.array(np.arange(len(part) + 1, dtype=np.int32) * wide)
                    lists = [pa.ListArray.from_arrays(cuts, pa.array(x.ravel())) for x in (part.view(np.int64), _short(part))]
                    own = np.fromiter((xxhash.xxh64_intdigest(w.tobytes()) for w in part), np.uint64, count=len(part)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), *lists, pa.array([item] * len(part), pa.string())], names=["window", "terms", "ids", "item"])

    return in_batches(items, run, "window bigint, terms array<bigint>, ids array<int>, item string")


def _counts(docs: DataFrame, bits) -> DataFrame:
    """(term, n): how often the corpus has each word of the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(bits.value)
        for batch in (part for b in batches for part in by_bytes(b, 0)):
            places, _ = known.of(batch.column(0).to_pylist())
            n = np.bincount(places, minlength=1)
            n[0] = 0
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(known.terms[some].view(np.int64)), pa.array(n[some])], names=["term", "n"])

    return in_batches(docs.select("_text"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _needed(ids: Column, near: float) -> Column:
    """How many of a window's different words a run must have to be near it."""
    return F.ceil(F.size(F.array_distinct(ids)) * F.lit(near)).cast("int")


def _lookups(windows: DataFrame, counts: DataFrame, near: float) -> DataFrame:
    """(term, off, window, ids): each window by its rarest words that occur at all."""
    each = windows.select("window", F.posexplode("terms").alias("off", "term")).groupBy("window", "term").agg(F.min("off").alias("off"))
    ranked = each.join(counts, "term", "left").groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("by"))
    rows = windows.select("window", "ids").join(ranked, "window")
    most = F.size("by") - _needed(F.col("ids"), near) + 1
    return rows.select("window", "ids", F.explode(F.slice("by", F.lit(1), most)).alias("x")).where("x.n > 0").select("x.term", "x.off", "window", "ids")


def _index(docs: DataFrame, known, wanted, size: int) -> DataFrame:
    """Per row: its keys, the number of its words and the postings of wanted words; ctx holds size-1 words on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, around = _Terms(known.value), np.arange(1 - size, size)
        for batch in (part for b in batches for part in by_bytes(b, 3)):
            places, sizes = of.of(batch.column(3).to_pylist())
            starts = np.cumsum(sizes + size - 1) - sizes  # a gap before each text and one at the end
            flat = np.zeros(len(places) + (len(sizes) + 1) * (size - 1), np.uint64)
            flat[np.arange(len(places)) + np.repeat((np.arange(len(sizes)) + 1) * (size - 1), sizes)] = of.terms[places]
            at = np.flatnonzero(flat)
            at = at[_marked(wanted.value, flat[at])]
            row = np.searchsorted(starts, at, side="right") - 1
            ctx = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(around)), pa.array(_short(flat)[at[:, None] + around].ravel()))
            posts = pa.StructArray.from_arrays([pa.array(flat[at].view(np.int64)), pa.array((at - starts[row]).astype(np.int32)), ctx], names=["term", "pos", "ctx"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)), posts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes), lists], names=["_id", "_k1", "_k2", "n_words", "posts"])

    schema = f"_id {docs.schema['_id'].dataType.simpleString()}, _k1 bigint, _k2 bigint, n_words bigint, posts array<struct<term bigint, pos int, ctx array<int>>>"
    return in_batches(docs.select("_id", "_k1", "_k2", "_text"), run, schema)


def _matches(index: DataFrame, lookups: DataFrame, size: int, near: float) -> DataFrame:
    """(_k1, _k2, window, start, stop, exact): where windows occur, and once for each posting with a run near a window."""
    lookups = stored(lookups.withColumn("needed", _needed(F.col("ids"), near)), "lookups")
    if lookups.limit(BROADCAST_LOOKUPS + 1).count() <= BROADCAST_LOOKUPS:
        lookups = F.broadcast(lookups)
    posts = index.where(F.size("posts") > 0).select("_k1", "_k2", F.explode("posts").alias("p")).select("_k1", "_k2", "p.term", "p.pos", "p.ctx")
    found = posts.join(lookups, "term")
    n = F.size("ids")
    exact = F.slice("ctx", F.lit(size) - F.col("off"), n) == F.col("ids")
    found = found.withColumn("exact", exact).where(F.col("exact") | (F.size(F.array_intersect("ctx", "ids")) >= F.col("needed")))
    # a run of as many words as the window has, the posting among them
    run = lambda first: F.size(F.array_intersect(F.slice("ctx", first, n), F.col("ids"))) >= F.col("needed")
    found = found.where(F.col("exact") | F.exists(F.sequence(F.lit(size + 1) - n, F.lit(size)), run))
    start = F.col("pos") - F.col("off")
    return found.select("_k1", "_k2", "window", start.alias("start"), (start + n).alias("stop"), "exact")


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, near: float = 0.8, with_keys: bool = False
) -> DataFrame:
    """id_col, n_words, n_hit, items (sorted array), n_near for every row of docs.

    A word is hit if an exact occurrence of a window of `size` item words covers it; shorter items are one window,
    items without words none. n_near counts the different windows that the row lacks, but of whose different words it
    has the share `near` in some run of as many words. Nulls have no words; items without an id share the label ''.
    Repeated rows of docs each come back, repeated items count once; other columns are ignored. An empty benchmark
    hits nothing. with_keys adds _k1 and _k2, the row_keys of id and text."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), *row_keys(F.col(id_col), F.col(text_col)), text.alias("_text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("binary").alias("t")).where("t is not null").distinct()
    every = stored(_windows(items, size), "windows")
    windows = stored(every.groupBy("window").agg(F.first("terms").alias("terms"), F.first("ids").alias("ids")), "windows")
    known = spark.sparkContext.broadcast(_map_of(windows.select(F.explode("terms").alias("term")).distinct()))
    counts = stored(_counts(rows, known), "counts")
    lookups = stored(_lookups(windows, counts, near), "lookups")
    wanted = spark.sparkContext.broadcast(_map_of(lookups.select("term").distinct()))
    index = stored(_index(rows, known, wanted, size), "postings")
    matches = stored(_matches(index, lookups, size, near).distinct(), "matches")
    hits = matches.where("exact").select("_k1", "_k2", "window").distinct()
    of_items = hits.join(every.select("window", "item").distinct(), "window").groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_window = matches.groupBy("_k1", "_k2", "window").agg(F.collect_set(F.when(F.col("exact"), F.struct("start", "stop"))).alias("spans"))
    per_doc = by_window.groupBy("_k1", "_k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.count_if(F.size("spans") == 0).alias("n_near"))
    nothing = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("upto"))

    def cover(acc, span):
        return F.struct((acc["covered"] + F.greatest(F.lit(0), span["stop"] - F.greatest(span["start"], acc["upto"]))).alias("covered"), F.greatest(acc["upto"], span["stop"]).alias("upto"))

    per_doc = per_doc.select("_k1", "_k2", "n_near", F.aggregate("spans", nothing, cover, lambda acc: acc["covered"]).cast("bigint").alias("n_hit"))
    none, no_items = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    return index.select("_id", "_k1", "_k2", "n_words").join(per_doc, ["_k1", "_k2"], "left").join(of_items, ["_k1", "_k2"], "left").select(
        F.col("_id").alias(id_col), *(("_k1", "_k2") if with_keys else ()), "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("items", no_items).alias("items"), F.coalesce("n_near", none).alias("n_near")
    )


def contaminated(n_hit, n_words):
    """At least one hit word, and at least a twentieth of all words hit."""
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)
