"""Documents to token ids in five stages: quality, near-duplicates, benchmark overlap, secrets, encoding.

Every stage but the last returns the columns of its documents; each works on all that the stage before kept.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import bpe, decontaminate, quality, secrets, similar, simhash
from ravelin.llm.common import Stored, fresh, row_keys, scratch, stored, table
from ravelin.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Its verdict depends on the text, so the rows that share an id and text share it."""
    judged = quality.classify(_keyed(docs), table(spark, sf_dir, "labels"), text_col="_text", id_col="doc_id", keys=[F.col("_k1"), F.col("_k2")])
    return _kept(docs, judged.where("predicted = 1"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, groups: Callable = simhash.near_duplicates) -> DataFrame:
    """Of each group of near copies (those of op4 unless set) the document with the least id (null ids last); of repeated rows one."""
    keys = row_keys(F.col("doc_id"), F.col("text"))
    own = docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keys).alias("_own"), F.col("text").alias("_text"))
    found = groups(own, id_col="_own", text_col="_text")
    chosen = stored(found.where("_own = component_id").groupBy("_own._k1", "_own._k2").agg(F.count("*").alias("n")), "chosen")
    return _kept(docs, chosen, once=chosen.where("n > 1").limit(1).count() > 0)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same where near copies are also texts of which four fifths or more of all five-word shingles agree, beside those of op4."""
    return keep_one_of_near_copies(spark, docs, sf_dir, functools.partial(similar.near_copies, max_bits=3))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    found = decontaminate.overlaps(_keyed(docs), table(spark, sf_dir, "benchmark"), text_col="_text", with_keys=True)
    return _kept(docs, found.where(~decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """All documents, secrets replaced by their kind in brackets; n_chars follows the text where that changed.

    ledger: the path of a ledger of scans that lasts from run to run; without one every run scans all texts."""
    found = secrets.found_in(docs, path=ledger)
    given, clean = secrets.parted(docs, found)
    (held,) = fresh(docs, "spans")  # with_spans replaces a column of that name
    given = given.withColumnRenamed("spans", held) if held != "spans" else given
    out = secrets.with_spans(given, found)
    changed = F.size("spans") > 0
    out = out.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    out = out.drop("spans").withColumnRenamed(held, "spans").select(docs.columns)
    return out if clean is None else out.unionByName(clean.select(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of every document."""
    return bpe.encode(docs, tokenizer_path())


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").alias("_text"), *row_keys(F.col("doc_id"), F.col("text")))


def _kept(docs: DataFrame, chosen: DataFrame, once: bool = False) -> DataFrame:
    """The rows of docs whose id and text have keys in chosen, null ids and texts included; with `once` one row for each pair of keys."""
    names = fresh(docs, "key1", "key2")
    rows = docs.withColumns(dict(zip(names, row_keys(F.col("doc_id"), F.col("text")), strict=True)))
    kept = rows.join(chosen.select(*[F.col(k).alias(n) for k, n in zip(("_k1", "_k2"), names, strict=True)]).distinct(), names, "left_semi")
    return (kept.dropDuplicates(names) if once else kept).select(docs.columns)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-dedup", keep_one_of_similar),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result is stored before the next stage reads it, and what a stage stored on its way is dropped."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch():
            found = stage(spark, docs, sf_dir)
            with scratch(keep=True):
                after = Stored(found, "stage")
        if before:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, components and token ids are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None
