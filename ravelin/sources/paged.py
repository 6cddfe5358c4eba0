"""Sources that answer in pages: windows of time read side by side, and scrolls that a stream follows from token to token.

How a page is fetched is a function named by the option `pages` ("module:function"): pages(query, token, size) gives
{"rows": [...], "token": the next page's or None}. query holds `since` and `until` where a reader has them: rows are asked
for that were seen after since and not after until. Rows come as JSON text, which from_json reads in the JVM."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from importlib import import_module
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "since string, page int, place int, body string"
_ARROW = pa.schema([("since", pa.string()), ("page", pa.int32()), ("place", pa.int32()), ("body", pa.string())])
STAMP = "%Y-%m-%d %H:%M:%S"
_FULL = re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", re.ASCII)
#: Folders of a source that is kept by the hour, which hold the rows of one hour each.
HOUR = "hour="


def when(text: object) -> datetime | None:
    """A time as sources write it, or None."""
    try:
        return datetime.fromisoformat(str(text)) if _FULL.fullmatch(str(text)) else datetime.strptime(str(text), STAMP)
    except ValueError:
        return None


def seen_within(row: dict, field: str, since: str | None, until: str | None = None) -> bool:
    """Whether a row's time can be read and lies after since and not after until."""
    at = when(row.get(field))
    return at is not None and (not since or at > when(since)) and (not until or at <= when(until))


def windows(since: str, until: str, hours: int) -> list[tuple[str, str]]:
    """Half-open windows (since, until] of so many hours that cover the time between; none is empty."""
    at, end, out = when(since), when(until), []
    while at < end:
        to = min(at + timedelta(hours=hours), end)
        out.append((at.strftime(STAMP), to.strftime(STAMP)))
        at = to
    return out


@dataclass
class Pages:
    """The options of a source: pages, size, seen (the field that holds a row's time), and what fetches one page."""

    options: dict

    @property
    def field(self) -> str:
        return self.options.get("seen", "last_seen")

    def of(self, option: str) -> Callable:
        module, _, name = self.options[option].partition(":")
        return getattr(import_module(module), name)

    def fetch(self, since: str | None, until: str | None, token: str | None) -> dict:
        query = {k: v for k, v in {**self.options, "since": since, "until": until}.items() if v}
        return self.of("pages")(query, token, int(self.options.get("size", 5_000)))

    def batch(self, answer: dict, page: int, since: str | None, until: str | None) -> pa.RecordBatch:
        rows = [(k, json.dumps(r)) for k, r in enumerate(answer["rows"]) if seen_within(r, self.field, since, until)]
        return pa.RecordBatch.from_arrays([pa.array([since] * len(rows), pa.string()), pa.array([page] * len(rows), pa.int32()), pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.string())], schema=_ARROW)

    def walk(self, since: str | None, until: str | None) -> Iterator[pa.RecordBatch]:
        """All pages of one query, one in memory at a time."""
        token, page = None, 0
        while page == 0 or token:
            answer = self.fetch(since, until, token)
            yield self.batch(answer, page, since, until)
            token, page = answer.get("token"), page + 1


@dataclass
class Window(InputPartition):
    since: str
    until: str


class WindowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = Pages(options)

    def partitions(self) -> list[Window]:
        o = self.pages.options
        return [Window(*w) for w in windows(o["since"], o["until"], int(o.get("hours", 24)))]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        return self.pages.walk(partition.since, partition.until)


class CursorReader(DataSourceStreamReader):
    """A stream whose offset is a time: what was seen between two of them is read by windows, so a batch that is run again reads the same rows."""

    def __init__(self, options: dict):
        self.pages = Pages(options)

    def initialOffset(self) -> dict:
        return {"cursor": self.pages.options["since"]}

    def latestOffset(self) -> dict:
        return {"cursor": self.pages.of("latest")(dict(self.pages.options))}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        return [Window(*w) for w in windows(start["cursor"], end["cursor"], int(self.pages.options.get("hours", 24)))]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        return self.pages.walk(partition.since, partition.until)


class ScrollReader(SimpleDataSourceStreamReader):
    """A stream whose offset is a scroll token: a page for each batch. When a scroll ends, the next asks for what was seen after the latest row so far."""

    def __init__(self, options: dict):
        self.pages = Pages(options)

    def initialOffset(self) -> dict:
        since = self.pages.options.get("since", "")
        return {"cursor": since, "token": "", "page": 0, "latest": since}

    def _page(self, start: dict) -> tuple[list[tuple], dict]:
        answer = self.pages.fetch(start["cursor"], None, start["token"] or None)
        batch = self.pages.batch(answer, start["page"], start["cursor"] or None, None)
        own = [when(r.get(self.pages.field)) for r in answer["rows"]]
        latest = max([x.strftime(STAMP) for x in own if x] + [start["latest"]])
        rows = [tuple(r.values()) for r in batch.to_pylist()]
        if answer.get("token"):
            return rows, {**start, "token": answer["token"], "page": start["page"] + 1, "latest": latest}
        if not rows and not start["page"]:
            return [], start  # nothing new
        return rows, {"cursor": latest, "token": "", "page": 0, "latest": latest}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._page(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start != end:
            rows, after = self._page(start)
            yield from rows
            if after == start:
                return
            start = after


class WindowedPages(DataSource):
    """Batch: since, until and hours make the partitions. Stream: since, and `latest` ("module:function") gives the time up to which there are rows."""

    @classmethod
    def name(cls) -> str:
        return "windowed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WindowReader:
        return WindowReader(dict(self.options))

    def streamReader(self, schema) -> CursorReader:
        return CursorReader(dict(self.options))


class ScrolledPages(DataSource):
    """Stream of a source that knows no windows. Rows of one page pass through the driver at a time."""

    @classmethod
    def name(cls) -> str:
        return "scrolled_pages"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> ScrollReader:
        return ScrollReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WindowedPages)
    spark.dataSource.register(ScrolledPages)


def of_windows(spark: SparkSession, pages: str, since: str, until: str, hours: int = 24, **options: str) -> DataFrame:
    """since (of the window), page, place and body of all rows that were seen after since and not after until."""
    register(spark)
    return spark.read.format("windowed_pages").options(pages=pages, since=since, until=until, hours=str(hours), **options).load()


def _folder_files(path: str, since: str | None, until: str | None) -> list[str]:
    """The JSON files of a folder by name, those of its hours among them (`hour=YYYY-MM-DD HH`) that a window touches."""
    out = []
    for name in sorted(os.listdir(path)):
        if name.endswith(".json"):
            out.append(os.path.join(path, name))
        elif name.startswith(HOUR):
            hour = when(f"{unquote(name.removeprefix(HOUR))}:00:00")
            if hour is None or (not since or hour + timedelta(hours=1) > when(since)) and (not until or hour <= when(until)):
                out += _folder_files(os.path.join(path, name), None, None)
    return out


def _folder_lines(path: str, field: str, since: str | None, until: str | None, file: str = "", at: int = 0) -> Iterator[tuple[dict, str, int]]:
    """The rows of a window from a place on, each with its file and where the next line begins there."""
    path = path.removeprefix("file://")
    for name in sorted(os.path.relpath(full, path) for full in _folder_files(path, since, until)):
        if name < file:
            continue
        with open(os.path.join(path, name), "rb") as lines:
            place = at if name == file else 0
            lines.seek(place)
            for line in lines:
                place += len(line)
                row = json.loads(line)
                if seen_within(row, field, since, until):
                    yield row, name, place


def folder_pages(query: dict, token: str | None, size: int) -> dict:
    """A source kept as JSON lines in a folder (option `folder`) that all tasks see, by the hour or not.

    A token is the place behind the last row of a page, so the next goes on from there: a line is read once, or twice where a page ends."""
    place, file = token.split(":", 1) if token else ("0", "")
    out: list[dict] = []
    end = None
    for row, name, after in _folder_lines(query["folder"], query.get("seen", "last_seen"), query.get("since"), query.get("until"), file, int(place)):
        if len(out) == size:
            return {"rows": out, "token": end}
        out.append(row)
        end = f"{after}:{name}"
    return {"rows": out, "token": None}


def folder_latest(query: dict) -> str:
    """The latest time in such a folder, or since."""
    field = query.get("seen", "last_seen")
    return max((row[field] for row, _, _ in _folder_lines(query["folder"], field, query.get("since"), None)), default=query["since"])
