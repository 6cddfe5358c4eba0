"""Ranked lexical search of a set of queries over all documents, by block-max pruning.

Documents are put in an order that brings alike ones together and cut into blocks. A block keeps its postings by term and
the largest contribution of each term. For a query the sum of these maxima bounds every document of a block; blocks are
scored by falling bound until the bound is under the score that the last place already has."""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, in_batches, stored, table_path

#: Bytes of a word: digits, letters of ASCII (A-Z as a-z), and all beyond ASCII.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Texts of queries that are worked on in one pass: so many bytes, or one longer text.
QUERY_BYTES = 16 << 20
#: Documents of a block.
BLOCK = 32


def words(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(_WORD).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Postings(NamedTuple):
    """Values of places for each term: those of terms[k] are places[cuts[k]:cuts[k + 1]]."""

    terms: np.ndarray
    cuts: np.ndarray
    places: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, terms: np.ndarray, places: np.ndarray, values: np.ndarray) -> Postings:
        order = np.argsort(terms, kind="stable")
        found, starts = np.unique(terms[order], return_index=True)
        return cls(found, np.append(starts, len(terms)), places[order], values[order])

    def sums(self, terms: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
        """For each place the weighted sum of its values; sums of whole numbers stay exact."""
        if not len(self.terms):
            return np.zeros(size, np.int64)
        near = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        held = self.terms[near] == terms
        near, weights = near[held], weights[held]
        begin, count = self.cuts[near], self.cuts[near + 1] - self.cuts[near]
        at = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        parts = self.values[at] * np.repeat(weights, count)
        if float(weights.sum()) * 1e6 < 2**53:  # a value is under 10^6
            return np.bincount(self.places[at], parts, minlength=size).astype(np.int64)
        out = np.zeros(size, np.int64)
        np.add.at(out, self.places[at], parts)
        return out


class Queries(NamedTuple):
    """The queries of one pass: ids, and for each the ascending numbers of its terms in the vocabulary."""

    ids: pa.Array
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, table: pa.Table) -> Queries:
        each = [sorted(set(words(t))) for t in table["_text"].to_pylist()]
        vocabulary = {w: k for k, w in enumerate(sorted(set().union(*each)))}
        return cls(table["_id"].combine_chunks(), [np.array([vocabulary[w] for w in e], np.int64) for e in each], vocabulary)


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n, terms, tfs, lead) of the documents that have a word: all their words counted, and of those in the vocabulary number and occurrences.

    lead is the vocabulary's word that the document has most often; it tells languages and topics apart."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in by_bytes(batch, 1):
                sizes, counts = [], []
                for text in part.column(1).to_pylist():
                    found = words(text)
                    sizes.append(len(found))
                    counts.append(Counter([known[w] for w in found if w in known]))
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32))
                terms, tfs = (pa.array(np.fromiter((x for c in counts for x in get(c)), np.int64)) for get in (Counter.keys, Counter.values))
                lead = pa.array([max(c, key=lambda t: (c[t], -t), default=-1) for c in counts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(cuts, terms), pa.ListArray.from_arrays(cuts, tfs), lead], names=["_id", "n", "terms", "tfs", "lead"])

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return in_batches(own, run, f"_id {kind}, n bigint, terms array<bigint>, tfs array<bigint>, lead bigint").where("n > 0")


def blocks(index: DataFrame, documents: int, length: int, size: int = BLOCK) -> DataFrame:
    """(ids, terms, maxima, cuts, places, parts): a row for each block of at most `size` documents that lie beside each other by lead, number of terms and a hash.

    parts are the contributions of a term to documents before its weight; maxima are their largest."""
    kind = index.schema["_id"].dataType.simpleString()
    near = [F.col("lead"), F.size("terms"), F.xxhash64("_id", "n", "terms")]
    ordered = index.where(F.size("terms") > 0).repartitionByRange(*near).sortWithinPartitions(*near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            terms, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            m = np.array([50 + 50 * n * documents // length for n in batch.column(1).to_pylist()], np.int64)
            part = (1_000_000_000 * tf) // (1_000 * tf + 20 * m[row])
            out: dict[str, list] = {c: [] for c in ("ids", "terms", "maxima", "cuts", "places", "parts")}
            for start in range(0, batch.num_rows, size):
                own = slice(*np.searchsorted(row, [start, start + size]))
                p = Postings.of(terms[own], row[own] - start, part[own])
                for name, value in zip(out, (batch.column(0).slice(start, size).to_pylist(), p.terms, np.maximum.reduceat(p.values, p.cuts[:-1]), p.cuts, p.places, p.values), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(batch.schema.field(0).type if k == "ids" else pa.int64())) for k, v in out.items()], names=list(out))

    return in_batches(ordered.select("_id", "n", "terms", "tfs"), run, f"ids array<{kind}>, " + ", ".join(f"{c} array<bigint>" for c in ("terms", "maxima", "cuts", "places", "parts")))


def _best(table: DataFrame, queries: Queries, weights: np.ndarray, count: int, floor: np.ndarray | None, kind: str, item_kind: str) -> DataFrame:
    """(q, item, doc, score): the best documents of each task for each query; without a floor, those of the best blocks only, from which a floor can be told."""
    sent = table.sparkSession.sparkContext.broadcast((queries.ids, queries.terms, weights, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, weights, floor = sent.value
        least = np.ones(len(terms), np.int64) if floor is None else floor.copy()
        best: list[list[tuple]] = [[] for _ in terms]
        for batch in batches:
            lists = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            numbers = {name: (x.flatten().to_numpy(), np.append(0, np.cumsum(x.value_lengths().to_numpy()))) for name, x in lists.items() if name != "ids"}
            cut = lambda name, k: numbers[name][0][slice(*numbers[name][1][k : k + 2])]  # noqa: B023, E731
            of_terms, term_cuts = numbers["terms"]
            tops = Postings.of(of_terms, np.repeat(np.arange(batch.num_rows), np.diff(term_cuts)), numbers["maxima"][0])
            opened: dict[int, tuple[Postings, list]] = {}
            for q, own in enumerate(terms):
                w = weights[own]
                bounds = tops.sums(own, w, batch.num_rows)
                scored = 0
                for b in np.argsort(-bounds, kind="stable").tolist():
                    if bounds[b] < least[q] or (floor is None and scored >= count):
                        break
                    if b not in opened:
                        opened[b] = Postings(cut("terms", b), cut("cuts", b), cut("places", b), cut("parts", b)), lists["ids"][b].as_py()
                    postings, ids = opened[b]
                    scores = postings.sums(own, w, len(ids))
                    scored += len(ids)
                    for d in np.flatnonzero(scores >= least[q]).tolist():
                        insort(best[q], (-int(scores[d]), ids[d] is None, ids[d] if ids[d] is not None else 0))
                    if len(best[q]) >= count:
                        del best[q][count:]
                        least[q] = max(least[q], -best[q][-1][0])
        flat = [(q, *x) for q, found in enumerate(best) for x in found]
        q = pa.array([x[0] for x in flat], pa.int64())
        ids = pa.array([None if x[2] else x[3] for x in flat], doc_type)
        yield pa.RecordBatch.from_arrays([q, items.take(q), ids, pa.array([-x[1] for x in flat], pa.int64())], names=["q", "item", "doc", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = to_arrow_type(table.schema["ids"].dataType.elementType)
    return in_batches(table, run, f"q bigint, item {item_kind}, doc {kind}, score bigint")


def ranked(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", count: int = 50, query_bytes: int = QUERY_BYTES, size: int = BLOCK) -> DataFrame:
    """item_col, rank, id_col, score: the `count` best documents of each row of queries whose score is above 0 (all, if fewer), equal scores by ascending id, null ids last.

    A document's score is the sum over the query's terms, once each, of weight * ((10^9 * tf) div (1000 * tf + 20 * m)), where
    weight is floor(1000 * ln((2N + 2) / (2 * df + 1))) and m is 50 + (50 * n * N) div L. Null texts have no term: they are in
    no count and no result. Every row is a document or a query of its own, repeated ones too. Other columns are ignored.

    Queries whose texts sum to more than query_bytes are worked through in several passes, so what is sent to the executors
    is bounded; each pass reads the documents once and keeps the postings of its own terms."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), queries.schema[item_col].dataType.simpleString()
    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(item_col).alias("_id"), F.col(query_col).cast("binary").alias("_text"))
    passes = max(1, -(-(asked.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // query_bytes))
    path, schema = table_path(spark, "ranked"), f"{item_col} {item_kind}, rank int, {id_col} {kind}, score bigint"
    for p in range(passes):
        own = Queries.of(asked.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(passes)) == p).toArrow())
        index = stored(forward(docs, own.vocabulary, id_col, text_col), "forward")
        documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
        holding = index.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # the pass's vocabulary at most
        weights = np.zeros(len(own.vocabulary), np.int64)
        weights[holding["term"].to_numpy()] = [weight(documents, n) for n in holding["count"].to_pylist()]
        table = stored(blocks(index, documents, length, size), "blocks")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)  # noqa: B023, E731
        first = best(_best(table, own, weights, count, None, kind, item_kind)).where(F.col("rank") == count).select("q", "score").toArrow()  # a row for each query
        floor = np.ones(len(own.terms), np.int64)
        floor[first["q"].to_numpy()] = first["score"].to_numpy()
        found = best(_best(table, own, weights, count, floor, kind, item_kind))
        found.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
