"""State machines of streams: typed state of each key with timers and a time to live, equal to the batch folds whatever the order of rows.

A key's state is bounded: what decides its row, never its history. The machines need a state store that keeps columns
apart (RocksDB); `keyed_state` sets it where the session still has the default one."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STATE = "org.apache.spark.sql.execution.streaming.state."


def keyed_state(spark: SparkSession) -> None:
    """Sets the state store that the machines need, unless the session names one of its own."""
    if spark.conf.get(_PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _STATE + "RocksDBStateStoreProvider")


def accepted(moments: np.ndarray, opens: np.ndarray, opened: list[int], span: int) -> tuple[np.ndarray, list[int]]:
    """Which of the ordered moments are accepted, and the times that are open then.

    A moment within span of an opened time is a duplicate. An accepted one opens the time from there if `opens` says so;
    else the next one is tried. One step for each time that is opened, not for each moment."""
    times = np.array(opened, dtype=np.int64)
    before = np.searchsorted(times, moments, "right") - 1
    free = np.flatnonzero((before < 0) | (moments - times[np.maximum(before, 0)] >= span) if len(times) else np.ones(len(moments), bool))
    able, keep, at, new = np.flatnonzero(opens[free]), np.zeros(len(moments), bool), 0, []
    while at < len(free):
        k = np.searchsorted(able, at)
        if k == len(able):
            keep[free[at:]] = True
            break
        keep[free[at : able[k] + 1]] = True
        new.append(int(moments[free[able[k]]]))
        at = max(int(able[k]) + 1, int(np.searchsorted(moments[free], new[-1] + span)))
    return keep, sorted([*opened, *new])


class FirstAccepted(StatefulProcessor):
    """Rows of a key that are the first for so long. State: the times that were opened and can still meet a row."""

    def __init__(self, span: int, names: list[str], order: list[str], inserted: str | None):
        self.span, self.names, self.order, self.inserted = span, names, order, inserted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.opened = handle, handle.getValueState("opened", "at array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame.columns = self.names  # what Spark hands over has other names for columns such as _1 or class
        frame = frame.sort_values(self.order, kind="stable", ignore_index=True)
        mark, known = timerValues.getCurrentWatermarkInMs() * 1000, self.opened.exists()
        opened = [t for t in self.opened.get()[0] if t + self.span > mark] if known else []
        opens = frame[self.inserted].fillna(False).to_numpy(bool) if self.inserted else np.ones(len(frame), bool)
        keep, opened = accepted(frame["_us"].to_numpy(np.int64), opens, opened, self.span)
        if opened:
            self.opened.update((opened,))
            if not known:
                self.handle.registerTimer(self._end(opened, mark))
        yield frame[keep]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        opened = [t for t in (self.opened.get()[0] if self.opened.exists() else []) if t + self.span > mark]
        if opened:
            self.opened.update((opened,))
            self.handle.registerTimer(self._end(opened, mark))
        else:
            self.opened.clear()
        return iter([])

    def _end(self, opened: list[int], mark: int) -> int:
        return max(opened[-1] + self.span, mark) // 1000 + 1


def accept_first(stream: DataFrame, key: str, at: str, seconds: int, lateness: str, inserted: str | None = None) -> DataFrame:
    """See streaming.indicators.accept_first. A micro-batch's rows of one key are held in one task, so bound the micro-batch at the source."""
    keyed_state(stream.sparkSession)
    order = ["_us", *[c for c, kind in stream.dtypes if c != at and not kind.startswith(("array", "map", "struct", "variant"))]]
    rows = stream.withColumn("_us", F.unix_micros(at)).withWatermark(at, lateness)
    out = rows.groupBy(key).transformWithStateInPandas(FirstAccepted(seconds * 1_000_000, rows.columns, order, inserted), rows.schema, "append", "eventTime")
    return out.drop("_us")


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    """The frame as Python values: whole numbers that a null had made floats, and None for null."""
    values = frame.astype({c: "Int64" for c in ("us", "seq") if c in frame}).astype(object)
    return values.where(values.notna(), None)


class Machine(StatefulProcessor):
    """Folds the rows of a key into the few that decide its row, and gives that row after each micro-batch."""

    schema: str

    def __init__(self, forget: datetime.timedelta | None = None):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.columns = [part.split()[0] for part in self.schema.split(", ")]
        self.kept = handle.getListState("kept", self.schema, *([int(self.forget.total_seconds() * 1000)] if self.forget else []))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = _plain(pd.DataFrame(list(self.kept.get()), columns=self.columns))
        for frame in rows:
            kept = self.deciding(pd.concat([kept, _plain(frame[self.columns])], ignore_index=True))
        if not len(kept):
            return  # nothing that decides: a list without values can't be put
        self.kept.put([tuple(row) for row in kept.itertuples(index=False)])
        row = self.row(kept)
        if row is not None:
            yield pd.DataFrame([[key[0], *row]], dtype=object)

    def deciding(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def row(self, rows: pd.DataFrame) -> list | None:
        raise NotImplementedError

    def over(self, rows: DataFrame, key: str, out: str) -> DataFrame:
        keyed_state(rows.sparkSession)
        kind = dict(rows.dtypes)[key]
        return rows.groupBy(key).transformWithStateInPandas(self, f"`{key}` {kind}, {out}", "update", "processingTime" if self.forget else "none")


class Documents(Machine):
    """The events that decide a document's row: the last of all, of each kind, of those with a report, and the first ingestion."""

    schema = "us bigint, seq bigint, kind string, report_id string, error string"

    def deciding(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(self.columns, na_position="first", kind="stable", ignore_index=True)
        kind = rows["kind"]
        main = kind.notna() & (kind != "previewed")
        ends = [rows.index[test][-1:] for test in (rows.index >= 0, main, main & rows["report_id"].notna(), kind == "ingested", kind == "failed", kind == "previewed")]
        return rows.loc[sorted({*np.concatenate(ends).tolist(), *rows.index[(kind == "ingested") & rows["us"].notna()][:1]})].reset_index(drop=True)

    def row(self, rows: pd.DataFrame) -> list:
        main = rows[rows["kind"].notna() & (rows["kind"] != "previewed")]
        last, told = rows.iloc[-1], main[main["report_id"].notna()]
        of = lambda kind: rows.loc[(rows["kind"] == kind) & rows["us"].notna(), "us"].tolist()
        inside, decided = of("ingested"), main["kind"].iloc[-1] if len(main) else None
        status = "ingested" if decided == "ingested" else last["kind"]
        error = main["error"].iloc[-1] if decided == "failed" else None
        end = lambda values: values[-1] if values else None
        return [status, inside[0] if inside else None, end(inside), end(of("failed")), end(of("previewed")), end(told["report_id"].tolist()), error, end(rows["us"].dropna().tolist())]


def documents(events: DataFrame, key: str = "document_key", forget: datetime.timedelta | None = None) -> DataFrame:
    """lifecycle.documents of a stream, in update mode: a row for each document that a micro-batch touches.

    The last row of a document is that of the batch fold over all its events, whatever their order (times of null
    come first). forget: documents without an event for so long lose their state."""
    rows = events.select(key, F.unix_micros("at").alias("us"), F.col("seq").cast("bigint").alias("seq"), "kind", "report_id", "error")
    out = "status string, first_ingested_at bigint, ingested_at bigint, failed_at bigint, previewed_at bigint, report_id string, error string, updated_at bigint"
    state = Documents(forget).over(rows, key, out)
    return state.withColumns({c: F.timestamp_micros(c) for c in state.columns if c.endswith("_at")} | {"error": T.sanitize_error(F.col("error"))})


class Queue(Machine):
    """The entry of an id (its first one) and the earliest decision of each kind, which may come before the entry does."""

    schema = "us bigint, decision string, category string, status string"

    def deciding(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(self.columns, na_position="first", kind="stable", ignore_index=True)
        rows = rows[rows["decision"].isna() | rows["decision"].isin(("rejected", "auto_matched", "approved"))]
        return rows.drop_duplicates("decision", ignore_index=True)

    def row(self, rows: pd.DataFrame) -> list | None:
        entry, made = rows[rows["decision"].isna()], rows[rows["decision"].notna()]
        if not len(entry):
            return None
        category, status = entry.iloc[0][["category", "status"]]
        valid = made[(made["decision"] != "approved") | (category in ("actor", "malware"))] if status == "pending" else made[:0]
        return [category, valid["decision"].iloc[0], valid["us"].iloc[0]] if len(valid) else [category, status, None]


def queue(rows: DataFrame, forget: datetime.timedelta | None = None) -> DataFrame:
    """resolve.fold_decisions of a stream (id, at, decision, category, status), in update mode.

    An entry's row has no decision; a decision's row has no category and status. The last row of an id is that of the
    batch fold, whatever came first; decisions on ids without an entry wait for it and give no row."""
    own = rows.select("id", F.unix_micros("at").alias("us"), "decision", "category", "status")
    state = Queue(forget).over(own, "id", "category string, status string, resolved_at bigint")
    return state.withColumn("resolved_at", F.timestamp_micros("resolved_at"))
