"""Subjects: the users a report is about, their periods and their rows."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.functions import fixed
from mergelens.functions.times import in_period
from mergelens.operators.tables import MONTH, PR_KEY, month_of

SUBJECT = ["dump_id", "user_login", "start_date", "end_date"]


def with_default_period(subjects: DataFrame, now: datetime) -> DataFrame:
    """Fill missing bounds: the last 365 days up to ``now``."""
    end = F.lit(now).cast("timestamp")
    start = end - F.expr(f"interval {fixed.DEFAULT_PERIOD_DAYS} days")
    return subjects.withColumns(
        {
            "start_date": F.coalesce(F.col("start_date"), start),
            "end_date": F.coalesce(F.col("end_date"), end),
        }
    )


def of_subjects(rows: DataFrame, subjects: DataFrame, login: str) -> DataFrame:
    """Rows of each subject by login. A busy login is split by the skew join."""
    who = subjects.select(*SUBJECT).distinct().withColumnRenamed("dump_id", "_dump").withColumnRenamed("user_login", "_login")
    matched = rows.join(who, (F.col("dump_id") == F.col("_dump")) & (F.col(login) == F.col("_login")))
    renamed = matched.drop("_dump")
    return renamed.drop("user_login").withColumnRenamed("_login", "user_login")


def within(instant: str):
    return in_period(F.col(instant), F.col("start_date"), F.col("end_date"))


def naive_bounds(subjects: DataFrame) -> list[str]:
    """Bounds given without a time zone."""
    return [name for name, kind in subjects.dtypes if name in ("start_date", "end_date") and kind == "timestamp_ntz"]


def resolved(subjects: DataFrame, rows: DataFrame | None = None, login: str = "", instant: str = "") -> DataFrame:
    """Bounds without a time zone as instants, by the clock of the subject's first row.

    The first row is the earliest, then the first in input order. Without rows, or where
    they do not know their offset from UTC, bounds are taken as UTC.
    """
    naive = naive_bounds(subjects)
    if not naive:
        return subjects
    offset = F.lit(0)
    if rows is not None and "utc_offset" in rows.columns:
        first = F.min_by("utc_offset", F.struct(instant, "line_ord")).alias("_offset")
        known = rows.groupBy(F.col("dump_id").alias("_dump"), F.col(login).alias("_login")).agg(first)
        same = (F.col("dump_id") == F.col("_dump")) & (F.col("user_login") == F.col("_login"))
        subjects = subjects.join(known, same, "left")
        offset = F.coalesce("_offset", F.lit(0))
    ahead = F.make_dt_interval(secs=offset.cast("decimal(18, 6)"))
    return subjects.withColumns({name: F.col(name).cast("timestamp") - ahead for name in naive}).drop(
        "_dump", "_login", "_offset"
    )


def in_months(rows: DataFrame, subjects: DataFrame, from_start: bool = True) -> DataFrame:
    """Of a landed table only the months that the subjects' periods touch, as literals, so other folders are not listed.

    ``from_start`` is false where rows of earlier months can matter. Tables
    without months are left as they are, and an open bound of any subject does not limit.
    """
    if MONTH not in rows.columns:
        return rows
    bounds = subjects.agg(
        F.min(month_of(F.col("start_date"))).alias("low"),
        F.max(month_of(F.col("end_date"))).alias("high"),
        F.count_if(F.col("start_date").isNull()).alias("no_start"),
        F.count_if(F.col("end_date").isNull()).alias("no_end"),
    ).first()
    if from_start and bounds["low"] is not None and not bounds["no_start"]:
        rows = rows.filter(F.col(MONTH) >= bounds["low"])
    if bounds["high"] is not None and not bounds["no_end"]:
        rows = rows.filter(F.col(MONTH) <= bounds["high"])
    return rows


def user_prs(prs: DataFrame, subjects: DataFrame) -> DataFrame:
    """Pull requests a subject opened in the period."""
    subjects = resolved(subjects, prs, "user_login", "created_at")
    prs = in_months(prs, subjects)
    return of_subjects(prs, subjects, "user_login").filter(within("created_at"))


def user_merged_prs(prs: DataFrame, subjects: DataFrame) -> DataFrame:
    """A subject's pull requests merged in the period, whenever they were opened."""
    subjects = resolved(subjects, prs, "user_login", "created_at")
    prs = in_months(prs, subjects, from_start=False)
    merged = prs.filter(F.col("merged") & F.col("merged_at").isNotNull())
    return of_subjects(merged, subjects, "user_login").filter(within("merged_at"))


def user_reviews(reviews: DataFrame, subjects: DataFrame) -> DataFrame:
    """Reviews a subject submitted in the period."""
    subjects = resolved(subjects, reviews, "user_login", "submitted_at")
    return of_subjects(in_months(reviews, subjects), subjects, "user_login").filter(within("submitted_at"))


def user_commits(commits: DataFrame, subjects: DataFrame) -> DataFrame:
    """Commits a subject authored in the period."""
    subjects = resolved(subjects, commits, "author_login", "date")
    return of_subjects(in_months(commits, subjects), subjects, "author_login").filter(within("date"))


def acted_prs(
    prs: DataFrame, reviews: DataFrame, commits: DataFrame, comments: DataFrame, timeline: DataFrame,
    raw_author: str = "user_login",
) -> DataFrame:
    """Distinct (user_login, pull request): authored it, or did anything on it.

    The author is matched by the login of the pull request's own payload,
    everyone else by the login of their first record.
    """
    parts = [
        (prs, raw_author),
        (reviews, "user_login"),
        (commits, "author_login"),
        (comments, "user_login"),
        (timeline, "actor_login"),
    ]
    pairs = [rows.select(*PR_KEY, F.col(login).alias("user_login")) for rows, login in parts]
    return reduce(DataFrame.unionByName, pairs).distinct()


def kept_keys(acted: DataFrame, subjects: DataFrame) -> DataFrame:
    """Keys of pull requests at least one subject of the dump acted on."""
    who = subjects.select("dump_id", "user_login").distinct()
    return acted.join(who, ["dump_id", "user_login"], "left_semi").select(*PR_KEY).distinct()


def keep(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys, PR_KEY, "left_semi")


def per_subject(rows: DataFrame, acted: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows of each subject's pull requests, once per subject (export form)."""
    who = subjects.select("dump_id", F.col("user_login").alias("subject_login")).distinct()
    pairs = acted.withColumnRenamed("user_login", "subject_login").join(who, ["dump_id", "subject_login"], "left_semi")
    return rows.join(pairs, PR_KEY)
