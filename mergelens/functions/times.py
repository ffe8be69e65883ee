"""Instants, durations and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UTC_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def parse_iso(text: Column) -> Column:
    """ISO-8601 text (``Z`` or an offset, up to microseconds) to an instant, null if malformed."""
    return F.try_to_timestamp(text)


def offset_seconds(text: Column) -> Column:
    """Seconds by which an ISO-8601 text's clock is ahead of UTC; 0 for ``Z`` or no offset, null for null."""
    pattern = r"T.*([+-]\d{2})(?::?(\d{2}))?$"
    # A failing cast costs an exception per row, so what did not match is null before it.
    hours, minutes = (F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in (1, 2))
    size = F.abs(hours.try_cast("int")) * 3600 + F.coalesce(minutes.try_cast("int"), F.lit(0)) * 60
    signed = F.when(F.startswith(hours, F.lit("-")), -size).otherwise(size)
    # Most texts end with Z, and need no search.
    return F.when(F.endswith(text, F.lit("Z")), F.lit(0)).when(text.isNotNull(), F.coalesce(signed, F.lit(0)))


def iso_text(instant: Column) -> Column:
    return F.date_format(instant, _UTC_FORMAT)


def micros_to_hours(micros: Column) -> Column:
    """Hours of a whole number of microseconds, by way of seconds."""
    return micros / F.lit(1e6) / F.lit(3600.0)


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def hours_between(start: Column, end: Column) -> Column:
    return micros_to_hours(micros_between(start, end))


def merge_micros(prs: str = "") -> Column:
    """Microseconds from creation to merge; null unless merged with a merge time."""
    p = f"{prs}." if prs else ""
    merged = F.col(f"{p}merged") & F.col(f"{p}merged_at").isNotNull()
    return F.when(merged, micros_between(F.col(f"{p}created_at"), F.col(f"{p}merged_at")))


def in_period(instant: Column, start: Column, end: Column) -> Column:
    """Inclusive on both ends; a null bound does not limit."""
    return (
        instant.isNotNull()
        & (start.isNull() | (instant >= start))
        & (end.isNull() | (instant <= end))
    )
