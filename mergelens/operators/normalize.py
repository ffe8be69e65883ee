"""Raw payloads to canonical tables: fields, windows, links, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.functions import fixed, parsing
from mergelens.functions.times import offset_seconds, parse_iso
from mergelens.operators.checks import Checks
from mergelens.operators.tables import PR_KEY
from mergelens.sources.dump import CORRUPT
from mergelens.sources.manifest import Manifest

Windows = Manifest | DataFrame


def clip(rows: DataFrame, instant: str, windows: Windows) -> DataFrame:
    """Rows inside the window of their dump, inclusive on both ends.

    One dump's window is a pair of literals, which reach the scan; windows of
    many dumps are joined by ``dump_id``.
    """
    if isinstance(windows, Manifest):
        start = parse_iso(F.lit(windows.fields["from"]))
        end = parse_iso(F.lit(windows.fields["to"]))
        return rows.filter(F.col(instant).between(start, end))
    bounds = windows.select("dump_id", F.col("start_date").alias("_from"), F.col("end_date").alias("_to"))
    inside = F.col(instant).between(F.col("_from"), F.col("_to"))
    return rows.join(bounds, "dump_id").filter(inside).drop("_from", "_to")


def of_known_prs(rows: DataFrame, prs: DataFrame) -> DataFrame:
    """Rows whose pull request is present (``prs`` has one row per key)."""
    known = prs.select(*[F.col(name).alias(f"_{name}") for name in PR_KEY])
    match = [F.col(name) == F.col(f"_{name}") for name in PR_KEY]
    return rows.join(known, match)


def without_link(rows: DataFrame) -> DataFrame:
    return rows.drop(*[f"_{name}" for name in PR_KEY])


class Normalizer:
    """Typed, windowed and linked rows of each raw table.

    ``key="number"`` identifies pull requests by number within a dump;
    ``key="repo"`` also by repository, where the payload names one.
    """

    def __init__(self, windows: Windows, key: str = "number", on_error: str = "fail"):
        if key not in ("number", "repo"):
            raise ValueError(f"unknown key mode: {key}")
        self.windows = windows
        self.by_repo = key == "repo"
        self.checks = Checks(on_error)

    def _repo(self, repo: Column) -> Column:
        return (F.coalesce(repo, F.lit("")) if self.by_repo else F.lit("")).alias("repo_key")

    def _lines(self, raw: DataFrame, source: str) -> DataFrame:
        if self.checks.quarantines and CORRUPT in raw.columns:
            raw = self.checks.require(raw, source, "not JSON", F.col(CORRUPT).isNull())
        return raw.drop(CORRUPT)

    def _complete(self, rows: DataFrame, source: str, *names: str, **given: str) -> DataFrame:
        """Rows with a readable value in each of the named columns.

        A column of ``given`` was read from that text, which earlier steps require: the
        check passes over rows without it, wherever it is placed.
        """
        for name in names:
            reason = f"no usable {name}"
            value = self.checks.value(F.col(name), source, reason)
            rows = rows.withColumn(name, F.when(F.col(given[name]).isNotNull(), value) if name in given else value)
            if self.checks.quarantines:
                rows = self.checks.require(rows, source, reason, F.col(name).isNotNull())
        return rows

    def _linked_child(self, rows: DataFrame, source: str, prs: DataFrame, user: str) -> DataFrame:
        """Children of known pull requests, each with a valid user."""
        linked = of_known_prs(rows, prs)
        # Naming the other side's key keeps this check above the join.
        usable = F.col("_number").isNotNull() & parsing.valid_user(user)
        return without_link(self.checks.require(linked, source, "no valid user", usable))

    def pull_requests(self, raw: DataFrame) -> DataFrame:
        """Windowed pull requests, one row per key: the last line wins.

        ``first_ord`` is the position of the first line of that key.
        """
        lines = self._lines(raw, "pull_requests").withColumn("utc_offset", offset_seconds(F.col("created_at"))).withColumns(
            {name: parse_iso(F.col(name)) for name in ("created_at", "updated_at", "closed_at", "merged_at")}
        )
        lines = self._complete(lines, "pull_requests", "number", "created_at")
        lines = clip(lines, "created_at", self.windows)
        usable = parsing.valid_user("user") & F.col("state").isin(*fixed.PR_STATES)
        lines = self.checks.require(lines, "pull_requests", "no valid user or state", usable)
        sides = parsing.valid_user("base.user") & parsing.valid_user("head.user")
        sides = sides & parsing.valid_user("base.repo.owner", "Organization")
        lines = self.checks.require(lines, "pull_requests", "no valid user of a branch, or owner", sides)
        return last_line_per_pr(
            lines.select("dump_id", self._repo(F.col("base.repo.full_name")), "number", "line_ord", "utc_offset", *_pr_fields())
        )

    def reviews(self, raw: DataFrame, prs: DataFrame) -> DataFrame:
        lines = self._lines(raw, "reviews")
        rows = lines.select(
            "dump_id",
            self._repo(parsing.repo_from_url(F.col("pull_request_url"))),
            parsing.number_from_url(F.col("pull_request_url")).alias("number"),
            "line_ord",
            "id",
            "user",
            "body",
            F.col("state").alias("raw_state"),
            parse_iso(F.col("submitted_at")).alias("submitted_at"),
            offset_seconds(F.col("submitted_at")).alias("utc_offset"),
        )
        rows = self._complete(rows, "reviews", "submitted_at", "number", "raw_state", "id")
        rows = clip(rows, "submitted_at", self.windows)
        rows = self._linked_child(rows, "reviews", prs, "user")
        return rows.withColumn("state", parsing.review_state(F.col("raw_state"))).drop("raw_state")

    def commits(self, raw: DataFrame, prs: DataFrame) -> DataFrame:
        """Commits with a date in the window, a known pull request and both users named.

        Rows without a message or with an invalid user are still here, because
        their author already counts as seen; ``usable_commits`` drops them.
        """
        date = parsing.nonempty(F.col("commit.author.date"))
        lines = self._lines(raw, "commits").filter(date.isNotNull())
        rows = lines.select(
            "dump_id",
            self._repo(F.col("repository")),
            F.col("pull_request_number").alias("number"),
            "line_ord",
            "sha",
            "author",
            F.coalesce(_named("committer"), F.col("author")).alias("committer"),
            F.col("commit.message").alias("message"),
            date.alias("date_text"),
            parse_iso(date).alias("date"),
            offset_seconds(date).alias("utc_offset"),
            "idx",
        )
        rows = self._complete(rows, "commits", "date", date="date_text").drop("date_text")
        rows = clip(rows, "date", self.windows)
        return without_link(of_known_prs(rows, prs)).filter(F.col("author").isNotNull())

    def usable_commits(self, commits: DataFrame) -> DataFrame:
        return commits.filter(
            parsing.valid_user("author")
            & parsing.valid_user("committer")
            & parsing.nonempty(F.col("message")).isNotNull()
        )

    def comments(self, review_raw: DataFrame, issue_raw: DataFrame, prs: DataFrame) -> DataFrame:
        """Review and issue comments in one table."""
        none = F.lit(None)
        review = self._comment_rows(
            review_raw,
            "review_comments",
            "pull_request_url",
            type=F.lit("review"),
            review_id=F.col("pull_request_review_id"),
            in_reply_to_id=F.col("in_reply_to_id"),
            path=F.col("path"),
            position=F.col("position"),
        )
        issue = self._comment_rows(
            issue_raw,
            "issue_comments",
            "issue_url",
            type=F.lit("issue"),
            review_id=none.cast("long"),
            in_reply_to_id=none.cast("long"),
            path=none.cast("string"),
            position=none.cast("long"),
        )
        return self._linked_child(review.unionByName(issue), "comments", prs, "user")

    def _comment_rows(self, raw: DataFrame, source: str, url: str, **kind: Column) -> DataFrame:
        lines = self._lines(raw, source)
        rows = lines.select(
            "dump_id",
            self._repo(parsing.repo_from_url(F.col(url))),
            parsing.number_from_url(F.col(url)).alias("number"),
            "line_ord",
            "id",
            "user",
            "body",
            parse_iso(F.col("created_at")).alias("created_at"),
            parse_iso(F.col("updated_at")).alias("updated_at"),
            *[value.alias(name) for name, value in kind.items()],
        )
        rows = self._complete(rows, source, "number", "created_at")
        rows = clip(rows, "created_at", self.windows)
        whole = F.col("id").isNotNull() & F.col("body").isNotNull()
        return self.checks.require(rows, source, "no id or body", whole)

    def timeline(self, raw: DataFrame, prs: DataFrame) -> DataFrame:
        """Events of known pull requests; rows without number, time or actor are skipped."""
        lines = self._lines(raw, "timeline")
        has_number = "pull_request_number" in lines.columns
        explicit = F.col("pull_request_number") if has_number else F.lit(None).cast("long")
        repo = F.col("repository") if "repository" in lines.columns else F.lit(None).cast("string")
        rows = lines.select(
            "dump_id",
            self._repo(F.coalesce(repo, parsing.repo_from_url(F.col("url")))),
            F.coalesce(explicit, parsing.number_from_timeline_url(F.col("url"))).alias("number"),
            "line_ord",
            "id",
            "node_id",
            "url",
            "event",
            "actor",
            parsing.nonempty(F.col("created_at")).alias("created_text"),
            "commit_id",
            "commit_url",
            "comment_id",
            "state",
            "html_url",
        ).filter(F.col("number").isNotNull() & F.col("created_text").isNotNull())
        rows = rows.withColumn("created_at", parse_iso(F.col("created_text")))
        rows = self._complete(rows, "timeline", "created_at", created_at="created_text").drop("created_text")
        rows = clip(rows, "created_at", self.windows)
        rows = without_link(of_known_prs(rows, prs)).filter(parsing.valid_user("actor"))
        whole = F.col("id").isNotNull() & F.col("event").isNotNull()
        return self.checks.require(rows, "timeline", "no id or event", whole)

    def files(self, raw: DataFrame, prs: DataFrame) -> DataFrame:
        lines = self._lines(raw, "files")
        rows = lines.select(
            "dump_id",
            self._repo(F.col("repository")),
            F.col("pull_request_number").alias("number"),
            "line_ord",
            "sha",
            "filename",
            "additions",
            "deletions",
            "changes",
            "status",
        )
        return without_link(of_known_prs(rows, prs))


def _pr_fields() -> list[Column]:
    zero = F.lit(0).cast("long")
    counters = ("commits", "additions", "deletions", "changed_files", "comments", "review_comments")
    return [
        F.col("id"),
        F.col("title"),
        F.col("body"),
        F.col("state"),
        F.col("user"),
        F.col("created_at"),
        F.col("updated_at"),
        F.col("closed_at"),
        F.col("merged_at"),
        F.coalesce("merged", F.lit(False)).alias("merged"),
        F.col("merge_commit_sha"),
        F.col("base"),
        # The head branch takes the base repository.
        F.col("head").withField("repo", F.col("base.repo")).alias("head"),
        *[F.coalesce(name, zero).alias(name) for name in counters],
        _named("merged_by").alias("merged_by"),
    ]


def _named(user: str) -> Column:
    """A payload user, or null if it is an object without id and login."""
    side = F.col(user)
    return F.when(side["id"].isNotNull() | side["login"].isNotNull(), side)


def last_line_per_pr(lines: DataFrame) -> DataFrame:
    """One row per pull-request key: the last line wins.

    Both aggregates combine before the exchange, so a key with very many
    copies ships one row per task.
    """
    payload = [name for name in lines.columns if name not in PR_KEY]
    last = F.max_by(F.struct(*payload), F.col("line_ord")).alias("last")
    return (
        lines.groupBy(*PR_KEY)
        .agg(last, F.min("line_ord").alias("first_ord"))
        .select(*PR_KEY, "last.*", "first_ord")
    )
