"""What the text operators share."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from ravelin.llm import common
from test_operators import SF


def _path(table):
    return table.path.removeprefix("file://").removeprefix("file:")


def test_scratch_drops_what_was_stored(spark):
    with common.scratch():
        one = common.Stored(spark.range(3).select("id"), "one")
        with common.scratch(keep=True):
            two = common.Stored(one.df.where("id > 0"), "two")
        assert os.path.exists(_path(one))
    assert not os.path.exists(_path(one)) and sorted(r[0] for r in two.df.collect()) == [1, 2]
    two.drop()
    assert not os.path.exists(_path(two))


def test_run_leaves_one_table(spark):
    folder = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [name.split("-")[0] for name in set(os.listdir(folder)) - before] == ["stage"]


def test_fresh_names_differ_in_more_than_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Key` int, `key_` int, b int")
    assert common.fresh(df, "key", "b", "key", "c") == ["key__", "b_", "key___", "c"]


def test_shares_of_any_size(spark):
    rows = spark.range(20_000)
    n = lambda share: rows.where(common.share_of(share, F.col("id"), F.lit("x"))).count()
    assert n(1.0) == n(7.5) == 20_000 and n(1e-30) == 0 and abs(n(0.25) - 5_000) < 300
    few = {r[0] for r in rows.where(common.share_of(0.1, F.col("id"))).collect()}
    assert few < {r[0] for r in rows.where(common.share_of(0.3, F.col("id"))).collect()}


def test_small_files_are_dealt_out(spark):
    assert common.table(spark, SF, "documents").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    own = spark.range(0, 100, 1, 64)
    assert common.spread(own).rdd.getNumPartitions() == 64
