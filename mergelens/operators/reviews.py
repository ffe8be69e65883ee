"""What a review asked for and what followed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.functions import fixed
from mergelens.functions.parsing import linked, nonempty
from mergelens.operators.skew import with_next
from mergelens.operators.tables import PR_KEY, Tables
from mergelens.sources.staging import Staging

_RESPONSE_MICROS = fixed.RESPONSE_HOURS * 3600 * 1_000_000
REVIEW_COLUMNS = [*PR_KEY, "id", "user_login", "state", "submitted_at"]


def comment_marks(comments: DataFrame) -> DataFrame:
    """One row per review that has comments: (dump_id, review_id, has_paths)."""
    return (
        comments.filter(linked(F.col("review_id")))
        .groupBy("dump_id", "review_id")
        .agg(F.bool_or(nonempty(F.col("path")).isNotNull()).alias("has_paths"))
    )


def path_matches(comments: DataFrame, reviews: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of reviews with a comment on a file of their pull request, one row each."""
    paths = (
        comments.filter(linked(F.col("review_id")) & nonempty(F.col("path")).isNotNull())
        .select("dump_id", F.col("review_id"), "path")
        .distinct()
    )
    keyed = paths.join(reviews.select(*PR_KEY, F.col("id").alias("review_id")), ["dump_id", "review_id"])
    changed = files.select(*PR_KEY, F.col("filename").alias("path"))
    return keyed.join(changed, [*PR_KEY, "path"], "left_semi").select("dump_id", "review_id").distinct()


def with_marks(reviews: DataFrame, marks: DataFrame) -> DataFrame:
    """Left-join rows keyed by (dump_id, review_id) to reviews."""
    return reviews.join(
        marks.withColumnRenamed("review_id", "id"), ["dump_id", "id"], "left"
    )


def with_change_request(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """Add ``is_change_request``: asked formally, or by any inline comment."""
    marked = with_marks(reviews, comment_marks(comments))
    formal = F.col("state") == fixed.CHANGES_REQUESTED
    return marked.withColumn("is_change_request", formal | F.col("has_paths").isNotNull())


def last_events(timeline: DataFrame, event_type: str | None = None) -> DataFrame:
    """Latest timeline event of each pull request, and its latest merge event."""
    events = timeline if event_type is None else timeline.filter(F.col("event") == event_type)
    merged = F.when(F.col("event") == fixed.MERGED_EVENT, F.col("created_at"))
    return events.groupBy(*PR_KEY).agg(
        F.max("created_at").alias("last_event_at"), F.max(merged).alias("last_merge_event_at")
    )


def updated_after() -> Column:
    """Some timeline event is later than the review."""
    return F.coalesce(F.col("last_event_at") > F.col("submitted_at"), F.lit(False))


def merged_after() -> Column:
    """The pull request is merged, at or after the review by its own time or by an event."""
    own = F.col("merged_at") >= F.col("submitted_at")
    event = F.col("last_merge_event_at") >= F.col("submitted_at")
    late = F.coalesce(own, F.lit(False)) | F.coalesce(event, F.lit(False))
    return F.coalesce(F.col("merged"), F.lit(False)) & late


def with_pr(rows: DataFrame, prs: DataFrame, *columns: str) -> DataFrame:
    """Left-join columns of the pull request; the author is ``pr_author``."""
    return rows.join(prs.select(*PR_KEY, F.col("user_login").alias("pr_author"), *columns), PR_KEY, "left")


def _with_commits(
    reviews: DataFrame, tables: Tables, prs: DataFrame, columns: list[str], extra: tuple[str, ...] = ()
) -> DataFrame:
    """Reviews, with ``extra`` columns of theirs, and their authors' commits, each with columns of its pull request.

    A commit's time stands where a review has its own.
    """
    asks = reviews.select(*REVIEW_COLUMNS, *extra, F.lit(True).alias("is_review"))
    commits = tables.commits.filter(linked(F.col("number"))).select(
        *PR_KEY,
        F.lit(None).cast("long").alias("id"),
        F.col("author_login").alias("user_login"),
        F.col("date").alias("submitted_at"),
        F.lit(False).alias("is_review"),
    )
    joined = with_pr(asks.unionByName(commits, allowMissingColumns=True), prs, *columns)
    mine = joined.filter(F.col("is_review") | (F.col("user_login") == F.col("pr_author")))
    return mine.withColumn("at_micros", F.unix_micros("submitted_at"))


def _followed(events: DataFrame, next_review: bool, staging: Staging | None) -> DataFrame:
    """The reviews among the events, with when what follows came: one scan of all."""
    wanted = {"next_commit": ~F.col("is_review")}
    if next_review:
        wanted["next_review"] = F.col("is_review")
    return with_next(events, PR_KEY, "at_micros", wanted, staging).filter("is_review").drop("is_review")


def with_followups(
    reviews: DataFrame, tables: Tables, next_review: bool = True, staging: Staging | None = None
) -> DataFrame:
    """Add to reviews when the author's next commit and the next review came.

    ``next_commit`` and ``next_review`` are strictly later than the review.
    Reviews and commits meet their pull request in one join, and each other in
    one scan of both. Commits of others than the author are left out before it.
    """
    columns = ["merged", "created_at", "merged_at", "closed_at"]
    return _followed(_with_commits(reviews, tables, tables.pull_requests, columns), next_review, staging)


def answer_limit() -> Column:
    """Until when an answer counts, in microseconds: 72 hours after the review, or the merge or close if earlier.

    Null if none counts, as the pull request is not merged or no comment is on its files.
    """
    closing = F.unix_micros(F.coalesce("merged_at", "closed_at"))
    return F.when(F.col("merged") & F.col("on_path"), F.least(closing, F.col("at_micros") + _RESPONSE_MICROS))


def answered_in_time() -> Column:
    """An author commit came before the next review and no later than ``answer_limit``."""
    alone = F.col("next_review").isNull() | (F.col("next_commit") < F.col("next_review"))
    return F.coalesce((F.col("next_commit") <= F.col("answer_limit")) & alone, F.lit(False))


def review_facts(tables: Tables, staging: Staging | None = None) -> DataFrame:
    """Every review with what followed it.

    Columns: key, id, user_login, state, submitted_at, is_change_request,
    effective, updated_after_review, merged_after_review; and for response times
    pr_author, merged, created_at of the pull request, at_micros, next_commit.

    What needs no scan is worked out before it, so that the scan takes narrow rows,
    and the result is a selection of the scan's written table: it can be read often.
    """
    matches = path_matches(tables.comments, tables.reviews, tables.files).withColumn("path_matched", F.lit(True))
    marked = with_marks(with_change_request(tables.reviews.select(*REVIEW_COLUMNS), tables.comments), matches)
    on_path = ~F.coalesce("has_paths", F.lit(False)) | F.coalesce("path_matched", F.lit(False))
    marked = marked.withColumn("on_path", on_path)
    prs = tables.pull_requests.join(last_events(tables.timeline), PR_KEY, "left")
    columns = ["merged", "created_at", "merged_at", "closed_at", "last_event_at", "last_merge_event_at"]
    marks = ("is_change_request", "on_path")
    events = _with_commits(marked, tables, prs, columns, marks)

    # A commit brings its key and time alone.
    def own(value: Column | str, name: str) -> Column:
        return F.when(F.col("is_review"), F.col(value) if isinstance(value, str) else value).alias(name)

    names = ["user_login", "state", "is_change_request", "pr_author", "merged", "created_at"]
    events = events.select(
        *PR_KEY,
        "id",
        "is_review",
        "at_micros",
        *[own(name, name) for name in names],
        own(answer_limit(), "answer_limit"),
        own(updated_after(), "updated_after_review"),
        own(merged_after(), "merged_after_review"),
    )
    return _followed(events, True, staging).select(
        *PR_KEY,
        "id",
        "user_login",
        "state",
        F.timestamp_micros("at_micros").alias("submitted_at"),
        "is_change_request",
        (F.col("is_change_request") & answered_in_time()).alias("effective"),
        "updated_after_review",
        "merged_after_review",
        "pr_author",
        "merged",
        "created_at",
        "at_micros",
        "next_commit",
    )


def first_external_reviews(prs: DataFrame, reviews: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Time of the first review by someone other than the author (bots count)."""
    others = reviews.select(*PR_KEY, F.col("user_login").alias("_reviewer"), "submitted_at")
    return (
        others.join(prs.select(*PR_KEY, "created_at", F.col("user_login").alias("_author"), *carry), PR_KEY)
        .filter(F.col("_reviewer") != F.col("_author"))
        .groupBy(*PR_KEY, "created_at", *carry)
        .agg(F.min("submitted_at").alias("first_review_at"))
    )
