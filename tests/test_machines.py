"""State machines of streams against the batch folds, over shuffled micro-batches."""

import datetime
import random
import time

import numpy as np
from pyspark.sql import functions as F

from ravelin.operators import lifecycle, resolve
from ravelin.streaming import machines

EVENTS = "document_key string, kind string, at timestamp, seq bigint, report_id string, error string"


def _run(spark, rows, schema, fold, path, batches=3):
    """The last row of each key after micro-batches of the rows, and the rows as a table."""
    table = spark.createDataFrame(rows, schema)
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    last, sizes = {}, []

    def keep(batch, number):
        found = batch.collect()
        sizes.append(len(found))
        last.update({r[0]: r for r in found})

    query = fold(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert len([s for s in sizes if s]) == batches
    return last, table


def test_documents_equal_the_batch_fold(spark, tmp_path):
    rng, start = random.Random(5), datetime.datetime(2026, 1, 1)
    kinds = ["previewed", "ingested", "failed", None]
    rows = [(f"d{rng.randrange(12)}", rng.choice(kinds), None if rng.random() < 0.05 else start + datetime.timedelta(hours=rng.randrange(40)), rng.randrange(3), rng.choice([None, "r1", "r2"]), rng.choice([None, "lost", "late"])) for _ in range(240)]
    rows += [("quiet", "previewed", start, 1, "r9", None), ("quiet", "previewed", start, 1, "r9", None)]
    rng.shuffle(rows)
    last, table = _run(spark, rows, EVENTS, machines.documents, tmp_path)
    assert sorted(map(tuple, last.values())) == sorted(map(tuple, lifecycle.documents(table).collect()))


def test_queue_equals_the_batch_fold(spark, tmp_path):
    rng, start = random.Random(6), datetime.datetime(2026, 1, 1)
    entries = [(k, start, None, rng.choice(["actor", "malware", "sector", None]), rng.choice(["pending", "pending", "rejected"])) for k in range(30)]
    made = [(rng.randrange(33), start + datetime.timedelta(minutes=rng.randrange(20)), rng.choice(["approved", "rejected", "auto_matched", "ignored"]), None, None) for _ in range(60)]
    rows = entries + made
    rng.shuffle(rows)
    last, table = _run(spark, rows, "id bigint, at timestamp, decision string, category string, status string", machines.queue, tmp_path)
    batch = resolve.fold_decisions(table.where("decision is null").select("id", "category", "status"), table.where("decision is not null").select("id", "decision", "at"))
    assert sorted(map(tuple, last.values())) == sorted(map(tuple, batch.select("id", "category", "status", "resolved_at").collect()))


def test_a_time_to_live_that_has_not_passed_changes_nothing(spark, tmp_path):
    """A query with one goes on without new rows, so it is stopped here."""
    at = datetime.datetime(2026, 1, 1)
    table = spark.createDataFrame([("a", "ingested", at, 1, "r1", None), ("a", "previewed", at, 2, None, None), ("b", "failed", at, 1, None, "lost")], EVENTS)
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    fold = machines.documents(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), forget=datetime.timedelta(days=30))
    last = {}
    query = fold.writeStream.outputMode("update").foreachBatch(lambda batch, _: last.update({r[0]: r for r in batch.collect()})).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        end = time.monotonic() + 60
        while len(last) < 2 and time.monotonic() < end and query.isActive:
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted(map(tuple, last.values())) == sorted(map(tuple, lifecycle.documents(table).collect()))


def test_accepted_is_the_loop_row_by_row():
    rng = random.Random(7)
    for _ in range(300):
        opened = sorted(rng.sample(range(0, 400, 5), rng.randrange(4)))
        moments = np.sort(np.array([rng.randrange(400) for _ in range(rng.randrange(40))], dtype=np.int64))
        opens = np.array([rng.random() < 0.7 for _ in moments], dtype=bool)
        times, want = list(opened), []
        for moment, counts in zip(moments.tolist(), opens.tolist(), strict=True):
            fresh = not any(t <= moment < t + 24 for t in times)
            want.append(fresh)
            if fresh and counts:
                times.append(moment)
        keep, after = machines.accepted(moments, opens, opened, 24)
        assert keep.tolist() == want and after == sorted(times)


def test_state_store_of_ones_own_stays(spark):
    machines.keyed_state(spark)
    assert spark.conf.get(machines._PROVIDER).endswith("RocksDBStateStoreProvider")
    assert spark.range(1).select(F.lit(1)).count() == 1
