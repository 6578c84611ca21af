"""Derived columns as built-in expressions: none raises under ANSI mode, and none runs Python on rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds of end less those of start, in minutes."""
    return ((F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(60.0)).cast("double")


def month_key(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_bucket(ts: Column | str) -> Column:
    return F.to_date(ts)


def hour_bucket(ts: Column | str) -> Column:
    return F.date_trunc("hour", ts)


def zone_to_utc(ts: Column | str, zone: str) -> Column:
    """A wall-clock time in a zone as UTC. A time that the clocks skip moves on by the gap; of one that they repeat, the
    first is meant."""
    return F.to_utc_timestamp(ts, zone)


def total(predicate: Column | str) -> Column:
    """A predicate for which null is false, so that it and its negation share out all rows."""
    return F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(False))


def below(value: Column | str, limit: float) -> Column:
    return total(F.col(value) < limit if isinstance(value, str) else value < limit)


def above(value: Column | str, limit: float) -> Column:
    return total(F.col(value) > limit if isinstance(value, str) else value > limit)


def outside_month(ts: Column | str, month: str) -> Column:
    """Whether a time is null or not in the month `yyyy-MM`: from its first instant up to the next month's."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    start = F.to_date(F.lit(f"{month}-01"))
    return ts.isNull() | ~total((ts >= start) & (ts < F.add_months(start, 1)))


def timestamp_from_parts(year, month, day, hour, minute=None, second=None) -> Column:
    """The time of calendar parts, or null if any is null or there is no such time."""
    part = lambda x: F.lit(0) if x is None else (F.col(x) if isinstance(x, str) else x).try_cast("int")
    return F.try_make_timestamp(*map(part, (year, month, day, hour, minute, second)))


def timestamp_from_text(*parts: Column | str) -> Column:
    """The time that the parts spell, joined by blanks; null if it is none, or any part is null."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(" ", *columns)
    missing = F.lit(False)
    for x in columns:
        missing = missing | x.isNull()
    return F.when(~missing, F.try_to_timestamp(text))


def composite_key(*parts: Column | str, separator: str = "/") -> Column:
    """Parts joined; null parts are left out."""
    return F.concat_ws(separator, *parts)


def row_fingerprint(*columns: Column | str) -> Column:
    """SHA-256 of the values as JSON, so that a null and an empty text differ and values can't run together."""
    named = [(F.col(x) if isinstance(x, str) else x).alias(f"c{i}") for i, x in enumerate(columns)]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def plain_fingerprint(*columns: Column | str) -> Column:
    """SHA-256 of the values as text joined by |, nulls left out: for comparison with such fingerprints made elsewhere."""
    return F.sha2(F.concat_ws("|", *((F.col(x) if isinstance(x, str) else x).cast("string") for x in columns)), 256)


def flags(named: Sequence[tuple[str, Column]]) -> Column:
    """The names whose predicate is true, as an array in the given order."""
    return F.array_compact(F.array(*(F.when(total(p), F.lit(n)) for n, p in named))) if named else F.array().cast("array<string>")


def flag_text(names: Column) -> Column:
    """An array of names joined by commas; null if there is none."""
    return F.when(F.size(names) > 0, F.array_join(names, ","))


def match_status(hit: Column) -> Column:
    return F.when(total(hit), F.lit("matched")).otherwise(F.lit("missing"))
