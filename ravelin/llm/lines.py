"""Line dedup: lines that many documents share are dropped from all of them.

A line counts by its key: white space at both ends removed, A-Z in lower case. Keys are compared by 128 bits of their
hash, so two of a trillion different keys agree with a chance of about one in 10^15."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, in_batches, row_keys, stored

_WHITE = b" \t\n\v\f\r"
#: So many common lines (16 bytes each) are sent to the executors; more are joined.
SENT = 1_000_000
_HASH = np.dtype([("h1", "<i8"), ("h2", "<i8")])


def _hashed(text: str | bytes | None, least: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The lines of a text, the positions of those that have a key of at least `least` code points, and their hashes."""
    data = text.encode() if isinstance(text, str) else text or b""
    keys = [line.strip(_WHITE) for line in data.lower().split(b"\n")]
    at = [k for k, key in enumerate(keys) if key and (least <= 1 or len(key.decode("utf-8", "replace")) >= least)]
    return data.split(b"\n"), np.array(at, np.int32), np.frombuffer(b"".join([xxhash.xxh3_128_digest(keys[k]) for k in at]), _HASH)


def _without(lines: list[bytes], dropped: np.ndarray) -> bytes:
    gone = set(dropped.tolist())
    return b"\n".join([line for k, line in enumerate(lines) if k not in gone])


def common_lines(docs: DataFrame, text_col: str = "text", least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """(h1, h2, n): the hashes of the keys that at least so many documents hold, and how many do. A row is a document; null texts have no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 0):
                own = [np.unique(_hashed(t, least_chars)[2]) for t in part.column(0).to_pylist()]
                found = np.concatenate([np.zeros(0, _HASH), *own])
                yield pa.RecordBatch.from_arrays([pa.array(found["h1"].copy()), pa.array(found["h2"].copy())], names=["h1", "h2"])

    each = in_batches(docs.select(F.col(text_col).cast("binary").alias("_text")), run, "h1 bigint, h2 bigint")
    return each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 10, least_chars: int = 1, most: int = SENT) -> DataFrame:
    """id_col, n_lines (before dropping), n_dropped and text (what stays, joined by \\n) for every row of docs.

    A key found in at least least_docs documents loses all its lines everywhere, repeats inside a document included.
    Every row is a document of its own, repeated rows and null ids too. A null or empty text is one empty line, and lines
    of white space alone (keys under least_chars) always stay. Other columns are ignored. Up to `most` common keys are
    sent to the executors; beyond that lines meet them in a join. The result is the same either way."""
    common = stored(common_lines(docs, text_col, least_docs, least_chars), "common")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_lines bigint, n_dropped bigint, text string"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    if common.count() <= most:
        held = common.select("h1", "h2").toArrow()
        table = np.zeros(len(held), _HASH)
        table["h1"], table["h2"] = held["h1"].to_numpy(), held["h2"].to_numpy()
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(table))

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_bytes(batch, 1):
                    found = [_hashed(t, least_chars) for t in part.column(1).to_pylist()]
                    hashes = np.concatenate([np.zeros(0, _HASH), *[h for _, _, h in found]])
                    known = sent.value
                    near = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                    hit = known[near] == hashes if len(known) else np.zeros(len(hashes), bool)
                    cuts = np.cumsum([len(h) for _, _, h in found])[:-1]
                    yield _judged(part.column(0), [lines for lines, _, _ in found], [at[h] for (_, at, _), h in zip(found, np.split(hit, cuts) if found else [], strict=True)])

        out = in_batches(rows, drop, schema)
    else:
        keyed = rows.select("_id", "_text", *row_keys(F.col("_id"), F.col("_text")))

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_bytes(batch, 2):
                    found = [_hashed(t, least_chars) for t in part.column(2).to_pylist()]
                    sizes = [len(at) for _, at, _ in found]
                    hashes = np.concatenate([np.zeros(0, _HASH), *[h for _, _, h in found]])
                    keys = [pa.array(np.repeat(part.column(k).to_numpy(), sizes)) for k in (0, 1)]
                    places = np.concatenate([np.zeros(0, np.int32), *[at for _, at, _ in found]])
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(places), pa.array(hashes["h1"].copy()), pa.array(hashes["h2"].copy())], names=["_k1", "_k2", "place", "h1", "h2"])

        lines = in_batches(keyed.select("_k1", "_k2", "_text"), explode, "_k1 bigint, _k2 bigint, place int, h1 bigint, h2 bigint")
        dropped = lines.join(common, ["h1", "h2"], "left_semi").groupBy("_k1", "_k2").agg(F.collect_set("place").alias("_places"))
        together = keyed.join(dropped, ["_k1", "_k2"], "left").select("_id", "_text", "_places")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_bytes(batch, 1):
                    yield _judged(part.column(0), [(t or b"").split(b"\n") for t in part.column(1).to_pylist()], [np.array(p or [], np.int32) for p in part.column(2).to_pylist()])

        out = in_batches(together, cut, schema)
    return out.withColumnRenamed("_id", id_col)


def _judged(ids: pa.Array, lines: list[list[bytes]], dropped: list[np.ndarray]) -> pa.RecordBatch:
    texts = [_without(x, d) for x, d in zip(lines, dropped, strict=True)]
    columns = [ids, pa.array([len(x) for x in lines], pa.int64()), pa.array([len(d) for d in dropped], pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["_id", "n_lines", "n_dropped", "text"])
