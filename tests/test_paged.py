"""Sources in pages: every row once, whatever page a reader stops after."""

import json

import pytest
from pyspark.sql import functions as F

from ravelin.sources import paged


def write(folder, rows, name="a"):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def rows_of(n, day=1):
    return [{"ip": f"10.{day}.0.{k}", "last_seen": f"2026-01-{day + k % 9:02d} {k % 24:02d}:00:00"} for k in range(n)]


ODD = [{"ip": "x", "last_seen": "yesterday"}, {"ip": "y"}, {"ip": "z", "last_seen": None}, {"ip": "old", "last_seen": "2020-01-01 00:00:00"}]


@pytest.mark.parametrize(("size", "hours"), [(7, 24), (1_000, 5), (1, 240)])
def test_windows_give_each_row_once(spark, tmp_path, size, hours):
    rows = rows_of(60)
    write(tmp_path / "s", rows + ODD)
    df = paged.of_windows(spark, "ravelin.sources.paged:folder_pages", "2026-01-01 00:00:00", "2026-01-08 12:00:00", hours, folder=str(tmp_path / "s"), size=str(size))
    found = df.select(F.get_json_object("body", "$.ip").alias("ip"), "since", "page", "place")
    want = sorted(r["ip"] for r in rows if "2026-01-01 00:00:00" < r["last_seen"] <= "2026-01-08 12:00:00")
    assert sorted(r["ip"] for r in found.collect()) == want
    assert df.rdd.getNumPartitions() == -(-180 // hours) and found.agg(F.max("place")).first()[0] < size


def test_windows_cover_the_time_between():
    w = paged.windows("2026-01-01 00:00:00", "2026-01-03 01:00:00", 24)
    assert w == [("2026-01-01 00:00:00", "2026-01-02 00:00:00"), ("2026-01-02 00:00:00", "2026-01-03 00:00:00"), ("2026-01-03 00:00:00", "2026-01-03 01:00:00")]
    assert paged.windows("2026-01-01 00:00:00", "2026-01-01 00:00:00", 24) == []


def run(spark, tmp_path, source, **options):
    stream = spark.readStream.format(source).options(pages="ravelin.sources.paged:folder_pages", folder=str(tmp_path / "s"), **options).load()
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    out = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    return sorted(json.loads(r["body"])["ip"] for r in out.collect())


def test_a_scroll_goes_on_after_each_restart(spark, tmp_path):
    paged.register(spark)
    first, later = rows_of(10), [{"ip": f"late{k}", "last_seen": f"2026-02-0{k + 1} 00:00:00"} for k in range(3)]
    write(tmp_path / "s", first + ODD)
    seen = [run(spark, tmp_path, "scrolled_pages", since="2025-12-31 00:00:00", size="4") for _ in range(4)]  # a page for each start, then nothing new
    assert [len(x) for x in seen] == [4, 8, 10, 10] and seen[-1] == sorted(r["ip"] for r in first)
    write(tmp_path / "s", later, "b")
    assert run(spark, tmp_path, "scrolled_pages", since="2025-12-31 00:00:00", size="4") == sorted(r["ip"] for r in first + later)


def test_a_scroll_reads_a_batch_again_as_it_was(tmp_path):
    write(tmp_path / "s", rows_of(10))
    reader = paged.ScrollReader({"pages": "ravelin.sources.paged:folder_pages", "folder": str(tmp_path / "s"), "size": "3", "since": "2025-12-31 00:00:00"})
    at, every = reader.initialOffset(), []
    for _ in range(4):
        rows, end = reader.read(at)
        assert list(reader.readBetweenOffsets(at, end)) == (own := list(rows))
        every += own
        at = json.loads(json.dumps(end))
    assert len(every) == 10 and reader.read(at)[1] == at and list(reader.readBetweenOffsets(reader.initialOffset(), at)) == every


def test_a_cursor_goes_on_after_a_restart(spark, tmp_path):
    paged.register(spark)
    options = {"since": "2025-12-31 00:00:00", "hours": "36", "size": "4", "latest": "ravelin.sources.paged:folder_latest"}
    write(tmp_path / "s", rows_of(10) + ODD)
    assert run(spark, tmp_path, "windowed_pages", **options) == sorted(r["ip"] for r in rows_of(10))
    assert len(run(spark, tmp_path, "windowed_pages", **options)) == 10
    write(tmp_path / "s", [{"ip": "late", "last_seen": "2026-02-01 00:00:00"}, {"ip": "before the cursor", "last_seen": "2026-01-02 00:00:00"}], "b")
    assert run(spark, tmp_path, "windowed_pages", **options) == sorted([*(r["ip"] for r in rows_of(10)), "late"])


def test_pages_go_on_where_the_last_one_ended(tmp_path, monkeypatch):
    """A window reads each line of its hours once or twice, however many pages it takes, and no other hour."""
    write(tmp_path / "s", rows_of(9) + ODD)
    for hour in ("2026-01-01 00", "2026-01-01 01", "2026-01-02 00", "2026-01-05 07"):
        write(tmp_path / "s" / f"hour={hour}", [{"ip": f"{hour}-{k}", "last_seen": f"{hour}:00:{k % 60:02d}"} for k in range(300)])
    read, loads = [], json.loads
    monkeypatch.setattr(paged.json, "loads", lambda x: read.append(1) or loads(x))
    source = paged.Pages({"pages": "ravelin.sources.paged:folder_pages", "folder": str(tmp_path / "s"), "size": "7"})
    found = [loads(b)["ip"] for batch in source.walk("2026-01-01 00:00:00", "2026-01-02 00:00:00") for b in batch.column(3).to_pylist()]
    want = [r["ip"] for r in rows_of(9) if "2026-01-01 00:00:00" < r["last_seen"] <= "2026-01-02 00:00:00"]
    want += [f"2026-01-01 0{h}-{k}" for h in (0, 1) for k in range(300) if h or k % 60] + [f"2026-01-02 00-{k}" for k in range(0, 300, 60)]
    assert sorted(found) == sorted(want)
    assert len(read) < 2 * (13 + 900)
