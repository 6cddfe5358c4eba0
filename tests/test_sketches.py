"""Merged sketches against exact counts."""

from pyspark.sql import functions as F

from ravelin.operators import sketches


def test_merged_is_whole_and_near(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 6).alias("load"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), F.when(F.col("id") % 11 != 0, F.col("id") % 20_011).alias("value"))
    path = str(tmp_path / "loads")
    for k in range(6):  # each load is written as it comes
        sketches.of_loads(rows.where(F.col("load") == k), "load", ["kind"], "value").write.mode("append").parquet(path)
    kept = spark.read.parquet(path)
    found = {r["kind"]: (r["rows"], r["distinct"]) for r in sketches.merged(kept, ["kind"]).collect()}
    whole = {r["kind"]: (r["rows"], r["distinct"]) for r in sketches.merged(sketches.of_loads(rows.withColumn("load", F.lit(0)), "load", ["kind"], "value"), ["kind"]).collect()}
    exact = {r["kind"]: (r["n"], r["d"]) for r in rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("d")).collect()}
    assert found == whole
    assert all(found[k][0] == n and abs(found[k][1] - d) <= sketches.error_bound() * d for k, (n, d) in exact.items())
    part = sketches.merged(kept, ["kind"], F.col("load") < 2)
    assert {r["kind"]: r["rows"] for r in part.collect()} == {r["kind"]: r["count"] for r in rows.where("load < 2").groupBy("kind").count().collect()}
    assert sketches.merged(kept.where("false"), ["kind"]).count() == 0


def test_tops_add_up(spark):
    rows = spark.range(5_000).select((F.col("id") % 7).alias("load"), F.concat(F.lit("v"), F.floor(F.sqrt(F.col("id"))).cast("string")).alias("value"))
    loads = sketches.tops_of_loads(rows, "load", "value", 500)
    exact = sorted(((r["count"], r["value"]) for r in rows.groupBy("value").count().collect()), reverse=True)[:5]
    assert sorted(((r["count"], r["item"]) for r in sketches.top(loads, 5, 500).collect()), reverse=True) == exact
