"""Fields read out of raw payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergelens.functions import fixed


def nonempty(text: Column) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(text, F.lit(""))


def linked(key: Column) -> Column:
    """A link counts only when it is neither null nor zero."""
    return key.isNotNull() & (key != 0)


def _whole_number(segment: Column) -> Column:
    # A failing cast costs an exception per row, so words do not reach it.
    trimmed = F.trim(segment)
    return F.when(trimmed.rlike("^[^A-Za-z]"), trimmed.try_cast("long"))


def number_from_url(url: Column) -> Column:
    """Number in the last path segment; null if there is none."""
    return _whole_number(F.substring_index(url, "/", -1))


def number_from_timeline_url(url: Column) -> Column:
    """Number in the second-to-last path segment, trailing slashes aside."""
    parts = F.split(F.rtrim(url, F.lit("/")), "/")
    return _whole_number(F.try_element_at(parts, F.lit(-2)))


def repo_from_url(url: Column) -> Column:
    """``owner/name`` of an API URL, empty if the URL names none."""
    return F.regexp_extract(url, r"/repos/([^/]+/[^/]+)/", 1)


def review_state(raw: Column) -> Column:
    lowered = F.lower(raw)
    return F.when(lowered.isin(*fixed.REVIEW_STATES), lowered).otherwise(F.lit(fixed.COMMENTED))


def user_type(raw: Column, default: str | Column = "User") -> Column:
    return F.coalesce(nonempty(raw), F.lit(default))


def valid_user(user: str, default: str | Column = "User") -> Column:
    """True when a payload user has an id, a login and a known type."""
    kind = user_type(F.col(f"{user}.type"), default)
    return (
        F.col(f"{user}.id").isNotNull()
        & F.col(f"{user}.login").isNotNull()
        & kind.isin(*fixed.USER_TYPES)
    )


def split_list(text: Column) -> Column:
    """Comma-separated text to an array of trimmed, non-empty items."""
    items = F.transform(F.split(text, ","), lambda item: F.trim(item))
    return F.filter(items, lambda item: item != "")
