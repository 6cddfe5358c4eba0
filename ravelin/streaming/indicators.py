"""Streams of candidates: exact first-accepted deduplication, merges by micro-batch, windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indicators import TTL_SECONDS, upsert
from ..sinks import merge_buckets
from . import machines


def accept_first(stream: DataFrame, key: str, at: str, seconds: int = TTL_SECONDS, lateness: str = "2 hours", inserted: str | None = None) -> DataFrame:
    """Rows of a stream that are the first of their key for so long, by event time.

    An accepted row opens the time and duplicates don't prolong it; rows whose column `inserted` is false are given
    but open nothing, so the next one is tried again. State is the times that were opened and that the watermark has
    not yet passed by more than their length: a late row is a duplicate only if it lies within one of them, and else
    is accepted, as in the batch fold, unless a later row had already been given in its place (that can't be taken
    back). Rows of a micro-batch are taken in the order of their time."""
    return machines.accept_first(stream, key, at, seconds, lateness, inserted)


def into_table(stream: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], key: str, at: str, checkpoint: str):
    """Starts a query that merges each micro-batch into a keyed table; a batch that is run again gives the same table."""

    def merge(batch: DataFrame, number: int) -> None:
        old = read()
        write(upsert(batch if old is None else old.unionByName(batch), key, at), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_buckets(stream: DataFrame, path: str, key: str, at: str, checkpoint: str, *ties: str, buckets: int = 256):
    """Starts a query that merges each micro-batch into a table by buckets of its key, so a batch rewrites only those it touches."""

    def merge(batch: DataFrame, _: int) -> None:
        merge_buckets(path, batch, key, at, *ties, buckets=buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def volumes(stream: DataFrame, at: str = "ts", by: str = "feed", length: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Extension: rows per window and feed; rows later than the watermark allows are left out."""
    rows = stream.withWatermark(at, lateness).groupBy(by, F.window(at, length).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
