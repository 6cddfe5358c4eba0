"""Every engine query against its SQL on the smallest tables."""

import duckdb
import pytest

from ravelin.plans.headline import FLAGSHIP, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert df.count() > 0
        return
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert tidy(df.select(*columns).collect()) == tidy(result.fetchall())


def test_flagship_is_a_query():
    assert FLAGSHIP in QUERIES


def test_a_table_of_one_row_group_is_dealt_out(spark, tmp_path):
    from ravelin.plans.registry import dealt

    spark.range(5_000, numPartitions=1).write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    out = dealt(df, rows_each=10)
    assert df.rdd.getNumPartitions() == 1 and out.rdd.getNumPartitions() == 500
    assert dealt(df).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism and out.agg({"id": "sum"}).first()[0] == 12_497_500
