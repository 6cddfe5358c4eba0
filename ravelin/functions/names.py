"""Names in texts: all names of a list at once, by the words of a text or by an automaton that reads each text one time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What makes up words, as Unicode has it.
_WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]")
_WORDS = regex.compile(_WORD.pattern + "+")
#: Names of one automaton: so many bytes of UTF-8 (some hundred bytes of memory each); longer lists are taken in several passes.
LIST_BYTES = 1 << 20
#: Names of one word whose hashes go to the executors, 8 bytes each; of longer lists all words of the texts meet the names in the join.
MOST_HASHES = 2_000_000
#: Rows of an Arrow batch of texts, and bytes of text that are worked on at once.
BATCH_ROWS, PIECE_BYTES = 500, 1 << 20


def automaton(names: list[str]) -> ahocorasick.Automaton:
    """An automaton of lower-case names; each stands for its place in the list."""
    out = ahocorasick.Automaton()
    for k, name in enumerate(names):
        if name:
            out.add_word(name, (k, len(name)))
    if len(out):
        out.make_automaton()
    return out


def found(machine: ahocorasick.Automaton, text: str) -> set[int]:
    """The names that stand in a lower-case text with no letter, mark or digit before or after them."""
    out: set[int] = set()
    if not len(machine):
        return out
    for end, (k, size) in machine.iter(text):
        if k not in out:
            before, after = text[max(0, end - size) : end - size + 1] if end >= size else "", text[end + 1 : end + 2]
            if not (before and _WORD.match(before)) and not (after and _WORD.match(after)):
                out.add(k)
    return out


def stand_in(text: Column, names: Column) -> Column:
    """For each name of a row's list whether it stands in the row's text, in any case and not inside a word; empty and null names don't."""

    def judge(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            if own is None:
                out.append(None)
                continue
            places: dict[str, list[int]] = {}
            for k, name in enumerate(own):
                places.setdefault(name or "", []).append(k)
            hits = found(automaton(list(places)), t or "")
            good = {k for j, at in enumerate(places.values()) if j in hits for k in at}
            out.append([k in good for k in range(len(own))])
        return pa.array(out, pa.list_(pa.bool_()))

    return F.arrow_udf(judge, "array<boolean>")(F.lower(text), F.transform(names, lambda n: F.lower(n)))


def _by_text(texts: DataFrame, hits_of: Callable[[str], Iterable[str]], kind: str) -> DataFrame:
    """_doc and _name for each of the hits of a text. Texts are read in pieces of PIECE_BYTES, a larger one alone, so memory doesn't grow with the rows of a batch."""
    conf, key = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = total = 0
            for k, size in enumerate([*pc.binary_length(batch.column(1)).to_pylist(), None]):
                if k > start and (size is None or total + size > PIECE_BYTES):
                    piece = batch.slice(start, k - start)
                    hits = [list(hits_of(t.as_py())) for t in piece.column(1)]
                    rows = pa.array([j for j, h in enumerate(hits) for _ in h], pa.int64())
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(rows), pa.array([n for h in hits for n in h], pa.string())], names=["_doc", "_name"])
                    start, total = k, 0
                total += size or 0

    return texts.mapInArrow(run, f"_doc {kind}, _name string")


def _words_found(texts: DataFrame, names: DataFrame, kind: str, most: int) -> DataFrame:
    """_doc and _name for names (_name) of one word: the words of each text whose hash some name has, joined with the names."""
    spark = texts.sparkSession
    hashes = None
    if names.count() <= most:
        hashes = np.sort(names.select(F.xxhash64("_name").alias("h")).toArrow()["h"].to_numpy())
    sent = spark.sparkContext.broadcast(hashes)

    def words(text: str) -> list[str]:
        own, known = sorted(set(_WORDS.findall(text))), sent.value
        if known is None or not own:
            return own
        if not len(known):
            return []
        h = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in own], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return [own[k] for k in np.flatnonzero(known[at] == h)]

    return _by_text(texts, words, kind).join(names, "_name", "left_semi")


def mentioned(docs: DataFrame, names: DataFrame, doc_col: str = "doc_id", text_col: str = "text", name_col: str = "name", most_bytes: int = LIST_BYTES, most_hashes: int = MOST_HASHES) -> DataFrame:
    """doc_col and name_col (in lower case) for each name of the list that stands in a text, each pair once for a row of docs.

    Names of one word are words of the text, and meet these in a join; at most most_hashes of their hashes go to the
    executors, to leave other words behind. The other names go to the executors as one automaton if they have most_bytes or
    less, else in as many parts, each of which reads the texts once. Null texts and names and empty names match nothing."""
    spark = docs.sparkSession
    own = names.select(F.lower(name_col).alias("_name")).where("_name <> ''").distinct()
    single = F.udf(lambda n: bool(_WORDS.fullmatch(n)), "boolean")
    own = own.select("_name", single("_name").alias("_single"))
    sizes = {r[0]: r[1] for r in own.groupBy("_single").agg(F.sum(F.octet_length("_name"))).collect()}
    others = own.where("not _single").select("_name")
    parts, kind = -(-sizes.get(False, 0) // most_bytes), docs.schema[doc_col].dataType.simpleString()
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(doc_col).alias("_doc"), F.lower(text_col).alias("_text"))

    def one(part: int) -> DataFrame:
        listed = [r[0] for r in others.where(F.pmod(F.xxhash64("_name"), F.lit(parts)) == part).toLocalIterator()]  # most_bytes, more or less
        sent = spark.sparkContext.broadcast((listed, automaton(listed)))

        def hits(text: str) -> list[str]:
            listed, machine = sent.value
            return [listed[k] for k in sorted(found(machine, text))]

        return _by_text(texts, hits, kind)

    out = _words_found(texts, own.where("_single").select("_name"), kind, most_hashes)
    for p in range(parts):
        out = out.unionByName(one(p))
    return out.select(F.col("_doc").alias(doc_col), F.col("_name").alias(name_col))
