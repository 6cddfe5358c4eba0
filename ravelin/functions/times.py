"""Clocks: feed dates, ages, look-back windows, due times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spanish month names.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def feed_time(text: Column, now: Column) -> Column:
    """A feed's date: ISO with Z or an offset, with a blank for the T, or a bare day. Anything else counts as now.

    A trailing ` UTC` is no ISO date, so such rows are as new as those without a date."""
    t = F.replace(F.trim(text), F.lit("Z"), F.lit("+00:00"))
    iso = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:[+-]\d{2}:\d{2})?)?$"
    return F.coalesce(F.when(t.rlike(iso), F.try_to_timestamp(t)), now)


def days_old(at: Column, now: Column) -> Column:
    """Whole days since, never negative."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)).cast("int")


_SPANISH = rf"(?i)(?<!\d)([0-9]{{1,2}})\s+de\s+({'|'.join((*MONTHS, 'setiembre'))})\s+de\s+([0-9]{{4}})(?!\d)"


def _day(year: Column, month: Column, day: Column) -> Column:
    month = F.replace(F.lower(month), F.lit("setiembre"), F.lit("septiembre"))
    number = F.array_position(F.array(*map(F.lit, MONTHS)), month)
    parts = F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.to_date(F.try_to_timestamp(parts, F.lit("yyyy-MM-dd")))


def spanish_date(text: Column) -> Column:
    """The first `D de mes de YYYY` of a text, or null."""
    return F.when(text.rlike(_SPANISH), _day(*[F.regexp_extract(text, _SPANISH, k) for k in (3, 2, 1)]))


def spanish_dates(text: Column) -> Column:
    """All `D de mes de YYYY` of a text in order, null where the calendar has no such day."""
    days, months, years = (F.regexp_extract_all(text, F.lit(_SPANISH), F.lit(k)) for k in (1, 2, 3))
    return F.transform(F.arrays_zip(days.alias("d"), months.alias("m"), years.alias("y")), lambda x: _day(x["y"], x["m"], x["d"]))


_CLOCK = r"[T ](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d{1,6})?)?)?(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?"


def iso_day(text: Column) -> Column:
    """The calendar day of an ISO date or time as written (with or without separators), or null."""
    t = F.trim(text)
    digits = F.replace(F.regexp_extract(t, r"^\d{4}-?\d{2}-?\d{2}", 0), F.lit("-"), F.lit(""))
    return F.when(t.rlike(rf"^(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{8}})(?:{_CLOCK})?$"), F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd"))))


def window(hours: int, until: Column) -> tuple[Column, Column]:
    """Start and end of a look-back window."""
    return until - F.expr(f"interval {int(hours)} hours"), until


def in_window(at: Column, hours: int, until: Column, closed: bool = True) -> Column:
    """Strictly after the start and, for a closed window, strictly before the end."""
    start, end = window(hours, until)
    return (at > start) & (at < end) if closed else at > start


def connector_last_run(state: Column) -> Column:
    """The first of last_run, last_run_timestamp and lastRun in a JSON state: ISO text as it is, numbers as epoch seconds or milliseconds; bad JSON gives null."""
    values = [F.get_json_object(state, f"$.{k}") for k in ("last_run", "last_run_timestamp", "lastRun")]
    v = F.coalesce(*values)
    number = v.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    return F.when(number.isNull(), v).otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def run_is_due(last: Column, now: Column, period_seconds: int) -> Column:
    """Due without a readable state, with one in the future, or after half a period."""
    passed = F.unix_timestamp(now) - F.unix_timestamp(last)
    return last.isNull() | (passed < 0) | (passed >= period_seconds * 0.5)


def source_is_due(attempted: Column, polled: Column, now: Column, hours: Column) -> Column:
    """Due when never tried, or tried at least the interval ago; polling time counts where no attempt is known."""
    last = F.coalesce(attempted, polled)
    return last.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last) >= hours * 3600)
