"""Dates of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column) -> Column:
    """Timestamp of a text, or null."""
    return F.try_to_timestamp(c)


def from_number(c: Column) -> Column:
    """Timestamp of a number: seconds below 1e10, else milliseconds."""
    return F.when(c < 1e10, F.timestamp_micros((c * 1_000_000).cast("long"))).otherwise(F.timestamp_micros((c * 1000).cast("long")))


def coerce(text: Column) -> Column:
    """Timestamp of a text that is a number or a date."""
    number = text.try_cast("double")
    return F.when(number.isNotNull(), from_number(number)).otherwise(F.try_to_timestamp(text))


def format_since(c: Column, form: str) -> Column:
    """A cutoff as a source's parameter: unix, unix_ms or iso8601."""
    if form == "unix":
        return F.unix_seconds(c).cast("string")
    if form == "unix_ms":
        return F.unix_millis(c).cast("string")
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, in words."""
    s = F.unix_seconds(now) - F.unix_seconds(then)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    minutes, hours, days = (F.floor(s / k) for k in (60, 3600, 86400))
    return F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "minute")).when(hours < 24, said(hours, "hour")).otherwise(said(days, "day"))


def half_up(c: Column) -> Column:
    """Round half up, as JavaScript does."""
    return F.floor(c + 0.5)
