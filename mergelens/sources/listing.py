"""Raw pull-request listings: which pull requests a fetch job has to visit."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.functions.times import in_period, parse_iso


def updated_between(
    listing: DataFrame, since: datetime | None = None, until: datetime | None = None
) -> DataFrame:
    """Listing rows last updated in the window; both bounds are inclusive and optional."""
    start = F.lit(since).cast("timestamp")
    end = F.lit(until).cast("timestamp")
    return listing.filter(in_period(parse_iso(F.col("updated_at")), start, end))


def candidates(listing: DataFrame, users: DataFrame) -> DataFrame:
    """(user_login, listing row) pairs where the user is author, requested reviewer or assignee.

    Roles become rows and meet the users in an equi-join, so any number of
    users is served in one pass; a user with several roles yields one row.
    """
    roles = F.array_distinct(
        F.concat(
            F.array(F.col("user.login")),
            F.coalesce(F.col("requested_reviewers.login"), F.array()),
            F.coalesce(F.col("assignees.login"), F.array()),
        )
    )
    return listing.withColumn("user_login", F.explode(roles)).join(
        users.select("user_login").distinct(), "user_login"
    )
