"""Streams from files: exact deduplication with state, merges by micro-batch."""

from pyspark.sql import functions as F

from ravelin import sinks
from ravelin.operators.indicators import accept_first as batch_accept
from ravelin.streaming import indicators as S


def _rows(spark):
    times = ["2026-01-01 00:00:00", "2026-01-01 10:00:00", "2026-01-02 00:00:00", "2026-01-02 06:00:00", "2026-01-03 02:00:00"]
    data = [(k * 10 + j, f"p{k}", t) for k in range(3) for j, t in enumerate(times[: 5 - k])]
    return spark.createDataFrame(data, "id long, pattern string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_stream_accepts_the_same_rows_as_the_batch(spark, tmp_path):
    rows = _rows(spark)
    rows.where("id % 10 < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where("id % 10 >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = S.accept_first(stream, "pattern", "ts", lateness="72 hours")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    found = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == sorted(r["id"] for r in batch_accept(rows, ["pattern"], "ts", "id").collect())


def test_late_and_failed_rows_count_as_in_the_batch(spark, tmp_path):
    """A row from before all accepted ones is no duplicate of them, and a failed insert leaves its key open."""
    data = [(1, "a", "2026-01-05 00:00:00", True), (2, "a", "2026-01-02 00:00:00", True), (3, "a", "2026-01-02 03:00:00", True), (4, "b", "2026-01-05 00:00:00", False), (5, "b", "2026-01-05 01:00:00", True), (6, "b", "2026-01-05 02:00:00", True)]
    rows = spark.createDataFrame(data, "id long, pattern string, ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in ("id in (1, 4)", "id in (2, 5)", "id in (3, 6)"):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = S.accept_first(stream, "pattern", "ts", lateness="10 days", inserted="ok")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    found = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [1, 2, 4, 5] == sorted(r["id"] for r in batch_accept(rows, ["pattern"], "ts", "id", inserted="ok").collect())


def test_merge_into_buckets_rewrites_what_it_touches(spark, tmp_path):
    rows, path = _rows(spark), str(tmp_path / "table")
    rows.where("id % 10 < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where("id % 10 >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert S.into_buckets(stream, path, "pattern", "ts", str(tmp_path / "cp"), buckets=8).awaitTermination(120)
    assert {r["pattern"]: r["id"] for r in spark.read.parquet(path).collect()} == {"p0": 4, "p1": 13, "p2": 22}
    before = {r[0]: r[1] for r in spark.read.parquet(path).select("pattern", F.input_file_name()).collect()}
    assert sinks.merge_buckets(path, rows.where("pattern = 'p1'").withColumn("id", F.col("id") + 100).withColumn("ts", F.col("ts") + F.expr("interval 9 days")), "pattern", "ts", "id", buckets=8) == 1
    after = {r[0]: (r[1], r[2]) for r in spark.read.parquet(path).select("pattern", "id", F.input_file_name()).collect()}
    assert after["p1"][0] == 113 and [p for p in before if before[p] != after[p][1]] == [p for p in before if after[p][1] == after["p1"][1] or p == "p1"]


def test_merge_by_batches(spark, tmp_path):
    rows = _rows(spark)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    versions = []

    def read():
        return spark.read.parquet(versions[-1]) if versions else None

    def write(df, number):
        path = str(tmp_path / f"v{number}")
        df.write.mode("overwrite").parquet(path)
        versions.append(path)

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert S.into_table(stream, read, write, "pattern", "ts", str(tmp_path / "cp")).awaitTermination(120)
    assert {r["pattern"]: r["id"] for r in read().collect()} == {"p0": 4, "p1": 13, "p2": 22}


def test_volumes(spark, tmp_path):
    _rows(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(_rows(spark).schema).parquet(str(tmp_path / "in"))
    query = S.volumes(stream, by="pattern").writeStream.format("memory").queryName("volumes").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("volumes").agg(F.sum("n")).first()[0] == 12
