"""Digests of tables in buckets: what differs between two large tables is found by reading the buckets that differ.

A table is kept in buckets of its key, with a digest of each: the number of its rows, and a sum and an exclusive or of
their hashes, so the order of rows doesn't matter and repeated rows count. Digests of buckets add up to those of ranges of
buckets, which are compared first; of two tables that agree but for a few rows only the buckets of these are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table, and how many of them make a range.
BUCKETS, FAN = 1_024, 32
_SUMS = ("rows", "total", "folded")


def row_hash(columns: list[str], seed: int) -> Column:
    """64 bits of a row's values and of which of them are null."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def digest(rows: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(by, rows, total, folded) with partial aggregation, so what is shuffled is a row for each group and task."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(row_hash(columns, 1).cast("decimal(20,0)")).alias("total"), F.bit_xor(row_hash(columns, 2)).alias("folded"))


def ranges(digests: DataFrame, fan: int = FAN) -> DataFrame:
    """The digests of ranges of buckets, from those of the buckets."""
    return digests.groupBy(F.floor(F.col("_bucket") / fan).alias("_range")).agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.bit_xor("folded").alias("folded"))


@dataclass(frozen=True)
class Digested:
    """A table kept in buckets of a key at a path, with its digests beside it."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def write(self, rows: DataFrame, key: list[str]) -> Digested:
        """Replaces the table. Null keys have a bucket like others; a hot key is in one bucket, whose files are written by several tasks if it is large."""
        columns = rows.columns
        kept = rows.withColumn("_bucket", F.pmod(row_hash(key, 3), F.lit(self.buckets)).cast("int"))
        kept.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")  # an empty table has columns too
        kept.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/rows")
        digest(self.rows(), columns, "_bucket").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/digests")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/rows")

    def digests(self) -> DataFrame:
        """A row for each bucket."""
        return self.spark.read.parquet(f"{self.path}/digests")


def _unlike(one: DataFrame, other: DataFrame, by: str) -> list[int]:
    names = {c: f"_o_{c}" for c in (by, *_SUMS)}
    both = one.join(other.select(*[F.col(c).alias(n) for c, n in names.items()]), F.col(by) == F.col(names[by]), "full")
    same = [F.col(c).eqNullSafe(F.col(names[c])) for c in _SUMS]
    return sorted(r[0] for r in both.where(~(same[0] & same[1] & same[2])).select(F.coalesce(by, names[by])).collect())  # buckets or ranges at most


def unlike_buckets(one: Digested, other: Digested, fan: int = FAN) -> list[int]:
    """The buckets whose rows differ: ranges are compared first, then the buckets of those that differ."""
    if one.buckets != other.buckets:
        raise ValueError("tables are compared by buckets of the same number")
    off = _unlike(ranges(one.digests(), fan), ranges(other.digests(), fan), "_range")
    of = F.floor(F.col("_bucket") / fan).isin(off)
    return _unlike(one.digests().where(of), other.digests().where(of), "_bucket") if off else []


def differences(expected: Digested, stored: Digested) -> DataFrame:
    """Rows that are missing from what was stored, and rows that are there beyond what was expected, repeated ones as often as they are too few or too many."""
    columns = [c for c in expected.rows().columns if c != "_bucket"]
    buckets = unlike_buckets(expected, stored)
    one, other = (t.rows().where(F.col("_bucket").isin(buckets) if buckets else F.lit(False)).select(*columns) for t in (expected, stored))
    return one.exceptAll(other).withColumn("side", F.lit("missing")).unionByName(other.exceptAll(one).withColumn("side", F.lit("unexpected")))
