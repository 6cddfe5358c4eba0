"""Writers: keyed overwrites, reports and bundles as lines, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_into(path: str, new: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """A keyed table after an upsert, written beside the old one and returned; the caller swaps the paths.

    Without a table format that can merge, a rewrite is the only atomic change; old and new rows meet in one
    aggregate by key."""
    from .operators.indicators import upsert

    spark = new.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = None
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    target = f"{path.rstrip('/')}-next"
    upsert(rows, key, at, *ties).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


BUCKET = "key_bucket"


def merge_buckets(path: str, new: DataFrame, key: str, at: str, *ties: str, buckets: int = 256) -> int:
    """Upserts rows into a table that is partitioned by a hash of its key, and rewrites only the buckets that rows fall in.

    The new buckets are written beside the table first and then take the place of the old ones (dynamic partition
    overwrite); gives how many were rewritten. Rows that were merged before change nothing, so a batch may run again."""
    from .operators.indicators import upsert
    from .session import stored

    spark = new.sparkSession
    rows = stored(new.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "merge")
    touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # `buckets` numbers at most
    if not touched:
        return 0
    try:
        old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = None
    both = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
    ready = stored(upsert(both, key, at, *ties), "merged")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return len(touched)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_text(rows: DataFrame, path: str, column: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def merge_urls(known: DataFrame, new: DataFrame) -> DataFrame:
    return known.select("url").unionByName(new.select("url")).distinct()
