"""A registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The clock of all queries.
AS_OF = "2024-01-31 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives its rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Tables of texts, whose rows cost more than dealing them out; up to so many bytes they are often one row group, so one task.
TEXTS, SMALL_BYTES = ("documents", "pages", "conversations"), 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; clocks without a zone are read as UTC. Small tables of texts are dealt out over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXTS and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def dealt(df: DataFrame, rows_each: int = 200_000) -> DataFrame:
    """Rows that cost more than dealing them out, over all cores and in parts of so many: a table's file may be one row group, so one task whatever its size."""
    return df.repartition(max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_each)))


def now():
    return F.lit(AS_OF).cast("timestamp")


def micros(column):
    return F.unix_micros(column).alias(column if isinstance(column, str) else "at")
