"""Registered queries: every operator over whole star tables, results in plain columns.

Numbers are rounded to six decimals and instants given as whole hours or
microseconds, so that results can be compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.functions import parsing
from mergelens.functions.times import hours_between, iso_text, merge_micros, micros_to_hours, parse_iso
from mergelens.operators import interning, reviews as rv, subjects as sj
from mergelens.operators.interactions import interactions, kind_counts
from mergelens.operators.normalize import clip, last_line_per_pr
from mergelens.operators.percentiles import percentile_hours as exact_percentile_hours
from mergelens.operators.skew import with_next, with_position
from mergelens.operators.summaries import Summaries, summarise
from mergelens.operators.tables import PR_KEY, Tables
from mergelens.plans import star
from mergelens.plans.metrics import measured_from, metrics
from mergelens.plans.report import dataset_summary, report, report_header, report_items
from mergelens.sources import dump, listing, load, schemas, sinks
from mergelens.sources.landing import Landing
from mergelens.sources.staging import Staging

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _hour(column: str) -> Column:
    return F.floor(F.unix_micros(column) / 3_600_000_000).cast("long")


def _round(column: Column) -> Column:
    return F.round(column, 6)


# --- scans of a written dump ---------------------------------------------------


def _scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of a table of a dump on shared storage, which holds its raw payloads as JSON lines."""

    def land(staging: Staging) -> str:
        root = f"{staging.path}/{star.DUMP}"
        raw = star.raw_table(spark, sf_dir, name).drop("dump_id", "line_ord")
        sinks.append_tables({name: raw}, root, compression="gzip")
        return root

    return dump.scan(spark, star.landed_once(spark, f"dump {name}", sf_dir, land), name)


@_query
def scan_pull_requests(spark, sf_dir):
    rows = _scan(spark, sf_dir, "pull_requests")
    return rows.select(
        "id", "number", "title", "state", F.col("user.login").alias("login"), "created_at", "merged_at", "merged",
        F.col("base.repo.full_name").alias("repo"), F.col("head.ref").alias("head_ref"), "additions",
    )


@_query
def scan_reviews(spark, sf_dir):
    rows = _scan(spark, sf_dir, "reviews")
    return rows.select(
        "id", F.col("user.id").alias("user_id"), F.col("user.login").alias("login"), "state", "submitted_at",
        "pull_request_url",
    )


@_query
def scan_commits(spark, sf_dir):
    rows = _scan(spark, sf_dir, "commits")
    return rows.select(
        "sha", F.col("commit.message").alias("message"), F.col("commit.author.date").alias("date"),
        F.col("author.login").alias("author"), F.col("committer.login").alias("committer"),
        "pull_request_number", "idx",
    )


@_query
def scan_review_comments(spark, sf_dir):
    rows = _scan(spark, sf_dir, "review_comments")
    return rows.select(
        "id", F.col("user.login").alias("login"), "body", "created_at", "updated_at", "pull_request_url",
        "pull_request_review_id", "path", "position",
    )


@_query
def scan_issue_comments(spark, sf_dir):
    rows = _scan(spark, sf_dir, "issue_comments")
    return rows.select("id", F.col("user.login").alias("login"), "body", "created_at", "issue_url")


@_query
def scan_timeline(spark, sf_dir):
    rows = _scan(spark, sf_dir, "timeline")
    return rows.select("id", "url", "event", F.col("actor.login").alias("actor"), "created_at")


@_query
def scan_files(spark, sf_dir):
    rows = _scan(spark, sf_dir, "files")
    return rows.select("sha", "filename", "additions", "deletions", "changes", "status", "pull_request_number")


@_query
def explode_bundle(spark, sf_dir):
    """Rows of nested records: one line per table row, with what the sink adds."""
    bundles = star.bundles(spark, sf_dir)
    prs = sinks.explode_bundles(bundles, "pull_requests")
    commits = sinks.explode_bundles(bundles, "commits")
    files = sinks.explode_bundles(bundles, "files")
    none = F.lit(None).cast("long")

    def rows(df: DataFrame, name: str, item: Column, number: Column, position: Column = none) -> DataFrame:
        return df.select(
            F.lit(name).alias("table"), item.cast("string").alias("item"), number.alias("number"),
            position.alias("idx"),
        )

    number = F.col("pull_request_number")
    parts = [
        rows(prs, "pull_requests", F.col("id"), F.col("number")),
        rows(commits, "commits", F.col("sha"), number, F.col("idx")),
        rows(files, "files", F.col("filename"), number),
    ]
    for name in ("reviews", "review_comments", "issue_comments", "timeline"):
        parts.append(rows(sinks.explode_bundles(bundles, name), name, F.col("id"), none))
    return reduce(DataFrame.unionByName, parts)


@_query
def listing_window(spark, sf_dir):
    rows = listing.updated_between(
        star.listing(spark, sf_dir), parse_time(star.START), parse_time(star.END)
    )
    return rows.select("number", _hour_of_text("updated_at").alias("updated_h"))


def parse_time(text: str):
    from datetime import datetime

    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def _hour_of_text(column: str) -> Column:
    return F.floor(F.unix_micros(parse_iso(F.col(column))) / 3_600_000_000).cast("long")


@_query
def candidate_prs(spark, sf_dir):
    rows = star.listing(spark, sf_dir)
    users = star.activity(spark, sf_dir).select(star.login(F.col("actor_id")).alias("user_login"))
    return listing.candidates(rows, users).select("user_login", "number")


# --- fields ----------------------------------------------------------------------


@_query
def parse_iso_ts(spark, sf_dir):
    rows = star.raw_table(spark, sf_dir, "reviews")
    parsed = parse_iso(F.col("submitted_at"))
    return rows.select(
        "id", F.unix_micros(parsed).alias("micros"), iso_text(parsed).alias("text"),
        parse_iso(F.concat("submitted_at", F.lit("?"))).isNull().alias("malformed_is_null"),
    )


@_query
def pr_number_from_url(spark, sf_dir):
    parts = [
        star.raw_table(spark, sf_dir, name).select(
            "id", parsing.number_from_url(F.col(url)).alias("number"), parsing.repo_from_url(F.col(url)).alias("repo")
        )
        for name, url in (("reviews", "pull_request_url"), ("review_comments", "pull_request_url"), ("issue_comments", "issue_url"))
    ]
    return reduce(DataFrame.unionByName, parts)


@_query
def timeline_pr_number(spark, sf_dir):
    rows = star.raw_table(spark, sf_dir, "timeline")
    number = parsing.number_from_timeline_url(F.col("url"))
    return rows.select("id", number.alias("number")).filter(F.col("number").isNotNull())


@_query
def review_state_norm(spark, sf_dir):
    rows = star.raw_table(spark, sf_dir, "reviews")
    return rows.select("id", parsing.review_state(F.col("state")).alias("state"))


@_query
def user_type_default(spark, sf_dir):
    reviews, prs = (star.raw_table(spark, sf_dir, name) for name in ("reviews", "pull_requests"))
    reviewers = reviews.select("id", parsing.user_type(F.col("user.type")).alias("type"))
    owners = prs.select("id", parsing.user_type(F.col("base.repo.owner.type"), "Organization").alias("type"))
    return reviewers.unionByName(owners)


def _normal(spark: SparkSession, sf_dir: str, prune: bool = False) -> Tables:
    """Canonical tables loaded from the raw layer; landed once per session."""

    def land(staging: Staging) -> Tables:
        raw = star.raw_tables(spark, sf_dir)
        return load.canonical(raw, star.MANIFEST, star.MANIFEST.frame(spark), prune=prune, staging=staging)

    return star.landed_once(spark, f"normal {prune}", sf_dir, land)


def _normal_prs(spark: SparkSession, sf_dir: str) -> tuple[load.Normalizer, DataFrame]:
    norm = load.Normalizer(star.MANIFEST)
    return norm, norm.pull_requests(star.raw_table(spark, sf_dir, "pull_requests"))


@_query
def commit_committer(spark, sf_dir):
    norm, prs = _normal_prs(spark, sf_dir)
    rows = norm.commits(star.raw_table(spark, sf_dir, "commits"), prs)
    return rows.select("sha", F.col("author.login").alias("author"), F.col("committer.login").alias("committer"))


@_query
def commit_required_fields(spark, sf_dir):
    norm, prs = _normal_prs(spark, sf_dir)
    rows = norm.usable_commits(norm.commits(star.raw_table(spark, sf_dir, "commits"), prs))
    return rows.select("sha", "number", "message", _hour("date").alias("date_h"), "idx")


_COUNTERS = ("commits", "additions", "deletions", "changed_files", "comments", "review_comments")


@_query
def pr_defaults(spark, sf_dir):
    _, prs = _normal_prs(spark, sf_dir)
    return prs.select("number", "merged", *_COUNTERS)


@_query
def pr_branches(spark, sf_dir):
    prs = load.flat_prs(_normal_prs(spark, sf_dir)[1])
    sides = [F.col(f"{side}.{field}").alias(f"{side}_{field}") for side in ("base", "head") for field in ("label", "ref", "sha", "user_id", "repo_id")]
    return prs.select("number", *sides)


@_query
def comments_union(spark, sf_dir):
    norm, prs = _normal_prs(spark, sf_dir)
    raw = [star.raw_table(spark, sf_dir, name) for name in ("review_comments", "issue_comments")]
    rows = norm.comments(*raw, prs)
    return rows.select("id", "number", "type", "review_id", "in_reply_to_id", "path", "position", "body", _hour("created_at").alias("created_h"))


@_query
def split_repo_list(spark, sf_dir):
    """Lists with blanks and empty items, one per pull request."""
    rows = star.raw_pull_requests(spark, sf_dir)
    text = F.concat(F.lit(" "), F.col("base.repo.full_name"), F.lit(" ,, "), F.col("head.ref"), F.lit(","))
    return rows.select("id", "title", F.explode(parsing.split_list(text)).alias("item"))


# --- windows and links -------------------------------------------------------------


@_query
def dump_window(spark, sf_dir):
    every = star.all_tables(spark, sf_dir)
    times = {"pull_requests": "created_at", "reviews": "submitted_at", "commits": "date", "comments": "created_at", "timeline": "created_at"}
    parts = [
        clip(getattr(every, name), instant, star.MANIFEST).select(
            F.lit(name).alias("table"), F.col("line_ord").alias("row_id"), _hour(instant).alias("at_h")
        )
        for name, instant in times.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@_query
def children_in_window(spark, sf_dir):
    tables = _normal(spark, sf_dir)
    ids = {"reviews": "id", "commits": "sha", "comments": "id", "timeline": "id", "files": "sha"}
    parts = [
        getattr(tables, name).select(F.lit(name).alias("table"), F.col(ident).cast("string").alias("item"), "number")
        for name, ident in ids.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@_query
def dedup_prs(spark, sf_dir):
    raw = star.raw_pull_requests(spark, sf_dir).withColumn("repo_key", F.lit(""))
    return last_line_per_pr(raw).select("number", "title", "line_ord", "first_ord")


@_query
def users_first_seen(spark, sf_dir):
    return _normal(spark, sf_dir).users.select("id", "login", "type")


@_query
def repositories_first_seen(spark, sf_dir):
    repositories = interning.first_seen_repositories(_normal_prs(spark, sf_dir)[1])
    return repositories.select("id", "name", "full_name", "owner_id")


@_query
def acted_prs(spark, sf_dir):
    tables = star.whole_tables(spark, sf_dir)
    return sj.acted_prs(
        tables.pull_requests, tables.reviews, tables.commits, tables.comments, tables.timeline
    ).select("user_login", "number")


@_query
def subject_prs(spark, sf_dir):
    """Pull requests the manifest's user acted on, from raw payloads."""
    prs = _normal(spark, sf_dir, prune=True).pull_requests
    return prs.select("number", "title", "user_login", _hour("created_at").alias("created_h"))


@_query
def subject_children(spark, sf_dir):
    """Children of every subject's pull requests, once per subject."""
    tables = star.whole_tables(spark, sf_dir)
    subjects = star.subjects(tables)
    acted = sj.acted_prs(tables.pull_requests, tables.reviews, tables.commits, tables.comments, tables.timeline)
    parts = []
    for name in ("reviews", "commits", "comments", "timeline"):
        rows = sj.per_subject(getattr(tables, name).select(*PR_KEY, "line_ord"), acted, subjects)
        parts.append(
            rows.groupBy("subject_login").agg(F.count("*").alias("n"), F.sum("line_ord").alias("sum_of_ids"))
            .select(F.lit(name).alias("table"), "subject_login", "n", "sum_of_ids")
        )
    return reduce(DataFrame.unionByName, parts)


@_query
def dump_summary(spark, sf_dir):
    return dataset_summary(_normal(spark, sf_dir, prune=True)).select("table", "rows")


@_query
def multi_dump_load(spark, sf_dir):
    """Two dump folders of JSON lines, written by the sinks, to canonical tables in one plan."""

    def land(staging: Staging) -> str:
        raw = {name: star.landed_raw(spark, sf_dir, name).drop("dump_id", "line_ord") for name in schemas.RAW}
        for folder in ("a", "b"):
            root = f"{staging.path}/dumps/{folder}"
            sinks.append_tables(raw, root, compression="gzip")
            sinks.write_manifest(spark, root, star.MANIFEST.fields)
        return f"{staging.path}/dumps"

    tables = load.read_dumps(spark, star.landed_once(spark, "dumps", sf_dir, land) + "/*")
    return dataset_summary(tables).select(F.substring_index("dump_id", "/", -1).alias("dump"), "table", "rows")


def _reloaded(spark: SparkSession, sf_dir: str) -> Landing:
    """Tables landed by two batches, of which the second brings changed pull requests."""

    def land(staging: Staging) -> Landing:
        landing = Landing(spark, f"{staging.path}/landed", slots=4)
        for raw in star.raw_batches(spark, sf_dir):
            landing.append(raw, star.MANIFEST, star.MANIFEST.frame(spark))
        return landing

    return star.landed_once(spark, "reloaded", sf_dir, land)


@_query
def reload_changed_prs(spark, sf_dir):
    """Two batches give the tables of one load of both: rows of each table, with present names."""
    tables = _reloaded(spark, sf_dir).tables()
    named = {
        "pull_requests": (F.concat_ws(" ", "title", "user_login"), F.col("number")),
        "reviews": (F.concat_ws(" ", "id", "user_login"), F.col("number")),
        "commits": (F.concat_ws(" ", "sha", "author_login"), F.col("number")),
        "comments": (F.concat_ws(" ", "id", "user_login"), F.col("number")),
        "timeline": (F.concat_ws(" ", "id", "actor_login"), F.col("number")),
        "files": (F.col("sha"), F.col("number")),
        "users": (F.concat_ws(" ", "login", "type"), F.col("id")),
        "repositories": (F.col("full_name"), F.col("owner_id")),
    }
    parts = [
        getattr(tables, name).select(F.lit(name).alias("table"), item.alias("item"), number.alias("number"))
        for name, (item, number) in named.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@_query
def landed_period_reviews(spark, sf_dir):
    """Reviews of one user in one half-year, read from the months it touches."""
    tables = _reloaded(spark, sf_dir).tables()
    start, end = parse_time("1997-03-01T00:00:00Z"), parse_time("1997-08-31T23:00:00Z")
    period = [F.lit(t).cast("timestamp").alias(n) for t, n in ((start, "start_date"), (end, "end_date"))]
    subjects = tables.users.select("dump_id", F.col("login").alias("user_login"), *period)
    return sj.user_reviews(tables.reviews, subjects).select("user_login", "id", "number")


def dump_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Canonical tables of one dump of JSON lines, pruned to its user, read once per session."""

    def land(staging: Staging) -> Tables:
        root = f"{staging.path}/{star.DUMP}"
        raw = {name: rows.drop("dump_id", "line_ord") for name, rows in star.raw_tables(spark, sf_dir).items()}
        sinks.append_tables(raw, root, compression="gzip")
        sinks.write_manifest(spark, root, star.MANIFEST.fields)
        return load.read_dump(spark, root, staging=Staging(spark))

    return star.landed_once(spark, "dump tables", sf_dir, land)


@_query
def report_header_counts(spark, sf_dir):
    """User, period and row counts of a dump of JSON lines."""
    return report_header(dump_tables(spark, sf_dir)).select(
        "user_login", _hour("start_date").alias("start_h"), _hour("end_date").alias("end_h"), "table", "rows"
    )


@_query
def dump_to_report(spark, sf_dir):
    """From JSON lines to the report of the dump's own user, over its period."""
    tables = dump_tables(spark, sf_dir)
    subjects = tables.manifests.select(*sj.SUBJECT)
    rows = report(tables, subjects, staging=Staging(spark))[0]
    opened = F.get_json_object("details", "$.opened_count").cast("long")
    merged = F.coalesce(F.get_json_object("details", "$.merged_count"), F.get_json_object("details", "$.merged_pr_count"))
    return rows.filter(F.col("metric_slug").isin("pr_throughput", "cycle_time", "pr_merge_effectiveness")).select(
        "user_login", "metric_slug", opened.alias("opened"), merged.cast("long").alias("merged")
    )


# --- a user's rows -------------------------------------------------------------------


def _of_users(spark: SparkSession, sf_dir: str, *names: str) -> tuple[Tables, DataFrame]:
    """Tables, all or those that subjects and the named ones take, and subjects."""
    tables = star.canonical_tables(spark, sf_dir, *(("pull_requests", "reviews", *names) if names else ()))
    return tables, star.subjects(tables)


@_query
def user_prs(spark, sf_dir):
    tables, subjects = _of_users(spark, sf_dir, "pull_requests")
    return sj.user_prs(tables.pull_requests, subjects).select("user_login", "number")


@_query
def user_merged_prs(spark, sf_dir):
    """On unwindowed tables: opened before the period, merged inside it, counts."""
    tables, subjects = _of_users(spark, sf_dir, "pull_requests")
    every = star.all_tables(spark, sf_dir)
    return sj.user_merged_prs(every.pull_requests, subjects).select("user_login", "number")


@_query
def user_reviews(spark, sf_dir):
    tables, subjects = _of_users(spark, sf_dir, "reviews")
    return sj.user_reviews(tables.reviews, subjects).select("user_login", "id", "number")


@_query
def user_commits(spark, sf_dir):
    tables, subjects = _of_users(spark, sf_dir, "commits")
    return sj.user_commits(tables.commits, subjects).select("user_login", "sha", "number")


def _naive_subjects(tables: Tables) -> DataFrame:
    """Every user, with the same period on the clock, whatever the zone."""
    bounds = [F.lit(text).cast("timestamp_ntz").alias(name) for name, text in (("start_date", "1997-01-01"), ("end_date", "1998-07-01"))]
    return tables.users.select("dump_id", F.col("login").alias("user_login"), *bounds)


@_query
def user_prs_naive_bound(spark, sf_dir):
    tables = _normal(spark, sf_dir)
    return sj.user_prs(tables.pull_requests, _naive_subjects(tables)).select("user_login", "number")


@_query
def user_reviews_naive_bound(spark, sf_dir):
    """Half of the reviews are written two hours ahead of UTC."""
    tables = _normal(spark, sf_dir)
    rows = sj.user_reviews(tables.reviews, _naive_subjects(tables))
    return rows.select("user_login", "id", _hour("start_date").alias("start_h"))


@_query
def subject_defaults(spark, sf_dir):
    """Every second subject lacks a start, every third an end."""
    tables, subjects = _of_users(spark, sf_dir, "pull_requests")
    user = F.substring_index("user_login", "_", -1).cast("long")
    gaps = subjects.withColumns(
        {
            "start_date": F.when(user % 2 == 0, F.to_timestamp(F.lit(star.START))),
            "end_date": F.when(user % 3 == 0, F.to_timestamp(F.lit(star.END))),
        }
    )
    filled = sj.with_default_period(gaps, star.NOW)
    opened = sj.user_prs(tables.pull_requests, filled).groupBy(*sj.SUBJECT).agg(F.count("*").alias("opened"))
    return opened.select("user_login", _hour("start_date").alias("start_h"), _hour("end_date").alias("end_h"), "opened")


# --- lookups ---------------------------------------------------------------------------


@_query
def pr_children(spark, sf_dir):
    """Number of children of each kind for every pull request, zero included."""
    tables = star.whole_tables(spark, sf_dir)
    result = tables.pull_requests.select(*PR_KEY)
    for name in ("reviews", "commits", "comments", "files", "timeline"):
        rows = getattr(tables, name)
        if name in ("commits", "comments"):
            rows = rows.filter(parsing.linked(F.col("number")))
        counts = rows.groupBy(*PR_KEY).agg(F.count("*").alias(name))
        result = result.join(counts, PR_KEY, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return result.select("number", "reviews", "commits", "comments", "files", "timeline")


@_query
def review_comments_by_review(spark, sf_dir):
    tables = star.whole_tables(spark, sf_dir, "reviews", "comments")
    linked = tables.comments.filter(parsing.linked(F.col("review_id")))
    comments = linked.select("dump_id", F.col("review_id").alias("id"), F.col("id").alias("comment_id"), "path")
    return tables.reviews.select("dump_id", "id").join(comments, ["dump_id", "id"], "left").select("id", "comment_id", "path")


@_query
def review_with_pr(spark, sf_dir):
    tables = star.whole_tables(spark, sf_dir, "pull_requests", "reviews")
    rows = rv.with_pr(tables.reviews, tables.pull_requests, "merged", "merged_at")
    return rows.select("id", "number", "pr_author", "merged", _hour("merged_at").alias("merged_h"))


@_query
def is_change_request(spark, sf_dir):
    tables = star.whole_tables(spark, sf_dir, "reviews", "comments")
    return rv.with_change_request(tables.reviews, tables.comments).select("id", "is_change_request")


@_query
def event_after_review(spark, sf_dir):
    tables = star.whole_tables(spark, sf_dir, "reviews", "timeline")
    rows = tables.reviews.join(rv.last_events(tables.timeline), PR_KEY, "left")
    labeled = rv.last_events(tables.timeline, "labeled").select(*PR_KEY, F.col("last_event_at").alias("last_label_at"))
    later_label = F.coalesce(F.col("last_label_at") > F.col("submitted_at"), F.lit(False))
    return rows.join(labeled, PR_KEY, "left").select(
        "id", rv.updated_after().alias("any_event_after"), later_label.alias("label_after")
    )


@_query
def merged_after_review(spark, sf_dir):
    tables = star.whole_tables(spark, sf_dir, "pull_requests", "reviews", "timeline")
    rows = rv.with_pr(tables.reviews, tables.pull_requests, "merged", "merged_at")
    rows = rows.join(rv.last_events(tables.timeline), PR_KEY, "left")
    return rows.select("id", rv.merged_after().alias("merged_after"))


@_query
def next_author_commit(spark, sf_dir):
    tables = star.whole_tables(spark, sf_dir, "pull_requests", "reviews", "commits")
    rows = rv.with_followups(tables.reviews, tables, next_review=False)
    hours = micros_to_hours(F.col("next_commit") - F.col("at_micros"))
    return rows.select("id", "number", _round(hours).alias("hours"))


@_query
def next_review(spark, sf_dir):
    tables = star.whole_tables(spark, sf_dir, "reviews")
    rows = tables.reviews.select(*PR_KEY, "id", F.unix_micros("submitted_at").alias("at_micros"))
    followed = with_next(rows, PR_KEY, "at_micros", {"next_micros": F.lit(True)})
    return followed.select("id", "number", "next_micros")


@_query
def effective_change_request(spark, sf_dir):
    facts = rv.review_facts(star.whole_tables(spark, sf_dir))
    return facts.select("id", "user_login", "is_change_request", "effective")


@_query
def review_path_overlap(spark, sf_dir):
    tables = star.whole_tables(spark, sf_dir, "reviews", "comments", "files")
    matches = rv.path_matches(tables.comments, tables.reviews, tables.files).withColumn("matched", F.lit(True))
    rows = rv.with_marks(rv.with_change_request(tables.reviews, tables.comments), matches)
    has_paths = F.coalesce("has_paths", F.lit(False))
    return rows.select("id", has_paths.alias("has_paths"), (~has_paths | F.coalesce("matched", F.lit(False))).alias("passes"))


@_query
def first_external_review(spark, sf_dir):
    tables = star.whole_tables(spark, sf_dir, "pull_requests", "reviews")
    rows = rv.first_external_reviews(tables.pull_requests, tables.reviews)
    return rows.select("number", _hour("first_review_at").alias("first_h"))


# --- interactions and order --------------------------------------------------------------


@_query
def pr_interactions(spark, sf_dir):
    """Interactions before the merge, or at any time on unmerged pull requests."""
    tables = star.whole_tables(spark, sf_dir)
    rows = interactions(tables, tables.pull_requests, "merged_at")
    return rows.select("number", "actor", "kind", _hour("at").alias("at_h"))


@_query
def interaction_breakdown(spark, sf_dir):
    tables = star.whole_tables(spark, sf_dir)
    merged = tables.pull_requests.filter("merged")
    counts = kind_counts(interactions(tables, merged, "merged_at"), PR_KEY)
    return counts.drop("dump_id", "repo_key")


@_query
def pr_activity_seq(spark, sf_dir):
    """Position of every activity in its pull request, by time."""
    tables = star.whole_tables(spark, sf_dir)
    sources = {"review": ("reviews", "submitted_at"), "commit": ("commits", "date"), "comment": ("comments", "created_at"), "timeline": ("timeline", "created_at")}
    parts = [
        getattr(tables, table).select(*PR_KEY, F.lit(kind).alias("kind"), "line_ord", F.unix_micros(at).alias("at_micros"))
        for kind, (table, at) in sources.items()
    ]
    rows = with_position(reduce(DataFrame.unionByName, parts), PR_KEY, "at_micros", ["kind", "line_ord"], name="seq")
    return rows.select("number", "kind", F.col("line_ord").alias("row_id"), "seq")


@_query
def ordered_pr_numbers(spark, sf_dir):
    """Opened pull requests of each subject, in order of creation."""
    tables, subjects = _of_users(spark, sf_dir, "pull_requests")
    opened = sj.user_prs(tables.pull_requests, subjects)
    rows = opened.select(*sj.SUBJECT, "number", "line_ord", F.unix_micros("created_at").alias("at_micros"))
    return with_position(rows, sj.SUBJECT, "at_micros", ["line_ord"]).select("user_login", "number", "position")


@_query
def ordered_pr_numbers_open_period(spark, sf_dir):
    """All pull requests of each author, in order of creation: periods without bounds, tables without a window."""
    prs = star.whole_tables(spark, sf_dir, "pull_requests").pull_requests
    none = F.lit(None).cast("timestamp")
    subjects = prs.select("dump_id", "user_login", none.alias("start_date"), none.alias("end_date")).distinct()
    rows = sj.user_prs(prs, subjects).select(*sj.SUBJECT, "number", "line_ord", F.unix_micros("created_at").alias("at_micros"))
    return with_position(rows, sj.SUBJECT, "at_micros", ["line_ord"]).select("user_login", "number", "position")


@_query
def merge_time_hours(spark, sf_dir):
    prs = star.all_tables(spark, sf_dir).pull_requests
    open_time = hours_between(F.col("created_at"), F.col("closed_at"))
    return prs.select(
        "number", _round(micros_to_hours(merge_micros())).alias("merge_hours"), _round(open_time).alias("open_hours")
    )


@_query
def percentile_hours(spark, sf_dir):
    """Percentiles of merge times per repository and status."""
    prs = star.all_tables(spark, sf_dir).pull_requests.withColumn("micros", merge_micros())
    found = exact_percentile_hours(
        prs, ["repo_id"], "micros", {"p10": 0.1, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}
    )
    return found.select("repo_id", "n", *[_round(F.col(p)).alias(p) for p in ("p10", "p50", "p75", "p99", "p100")])


@_query
def review_iterations_per_pr(spark, sf_dir):
    metric = metrics()["review_iterations"]
    tables, subjects = _of_users(spark, sf_dir, *metric.reads)
    rows = metric.items(tables, subjects)
    return rows.select("user_login", "number", "iterations")


# --- metrics -------------------------------------------------------------------------------


def _metric(slug: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        metric = metrics()[slug]
        tables, subjects = _of_users(spark, sf_dir, *metric.reads)
        measured = metric.measure(tables, subjects)
        kinds = dict(measured.dtypes)
        return measured.select(
            "user_login",
            *[_round(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in metric.columns],
        )

    QUERIES[slug] = run


for _slug in metrics():
    _metric(_slug)


def _from_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of two batches, added and landed; then only these are read."""
    tables, subjects = _of_users(spark, sf_dir, "pull_requests")
    prs = tables.pull_requests

    def land(staging: Staging) -> str:
        root = f"{staging.path}/summaries"
        odd = F.pmod(F.xxhash64("number"), F.lit(2)) == 1
        summarise(prs.filter(~odd)).plus(summarise(prs.filter(odd))).write(root)
        return root

    held = Summaries.read(spark, star.landed_once(spark, "daily summaries", sf_dir, land))
    return measured_from(held, subjects)


@_query
def cycle_time_from_summaries(spark, sf_dir):
    return _from_summaries(spark, sf_dir).select(
        "user_login", F.col("timed_count").alias("merged_count"), *[_round(F.col(c)).alias(c) for c in ("median_hours", "p75_hours")]
    )


@_query
def pr_throughput_from_summaries(spark, sf_dir):
    return _from_summaries(spark, sf_dir).select(
        "user_login", "opened_count", "merged_count", _round(F.col("merge_ratio")).alias("merge_ratio")
    )


@_query
def metric_ratings(spark, sf_dir):
    return _report(spark, sf_dir).select("user_login", "metric_slug", "rating")


@_query
def metric_summaries(spark, sf_dir):
    return _report(spark, sf_dir).select("user_login", "metric_slug", "summary")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, subjects = _of_users(spark, sf_dir)
    return report(tables, subjects, staging=Staging(spark))[0]


@_query
def metric_results(spark, sf_dir):
    """The whole report; the rated value is read back from the details."""
    rows = _report(spark, sf_dir)
    field = {
        "pr_throughput": "merge_ratio",
        "cycle_time": "median_hours",
        "pr_merge_effectiveness": "average_back_and_forth",
        "review_leverage": "effectiveness_percentage",
        "review_iterations": "average_iterations",
        "time_to_first_review": "median_hours",
        "slow_review_response": "median_hours",
    }
    value = reduce(
        lambda rest, pair: F.when(F.col("metric_slug") == pair[0], F.get_json_object("details", f"$.{pair[1]}")).otherwise(rest),
        field.items(),
        F.lit(None).cast("string"),
    )
    return rows.select("user_login", "metric_slug", "metric_name", "rating", _round(value.cast("double")).alias("value"))


@_query
def metric_items(spark, sf_dir):
    """Item rows behind the report, counted and summed per subject and list."""
    tables, subjects = _of_users(spark, sf_dir)
    fields = "hours double, merge_time_hours double, number long, pr long, pr_number long, effective boolean, iterations long"
    rows = report_items(tables, subjects, staging=Staging(spark)).withColumn("item", F.from_json("item", fields))

    def of_item(name: str) -> Column:
        return F.col(f"item.{name}")

    hours = F.coalesce(of_item("hours"), of_item("merge_time_hours"))
    numbers = F.coalesce(of_item("number"), of_item("pr"), of_item("pr_number"))
    return rows.groupBy("user_login", "metric_slug", "list").agg(
        F.count("*").alias("n"),
        F.sum(numbers).alias("sum_of_numbers"),
        _round(F.coalesce(F.sum(hours), F.lit(0.0))).alias("sum_of_hours"),
        F.count_if(of_item("effective")).alias("effective"),
        F.sum(of_item("iterations")).alias("iterations"),
        F.max("position").alias("last_position"),
    )
