"""The metrics: one row per subject, and one row per item behind it.

A metric names contributions over (tables, subjects): rows of a subject and
numbers, from each source. All contributions of all chosen metrics, the
percentiles of their durations, and a row of nothing per subject and metric meet
in one aggregate by metric and subject. Subjects without activity keep their row,
and as partial sums are taken before the exchange, a subject with a large share
of all rows costs no more than others.

Lists behind a metric are item rows, not arrays: the list of one subject has no
size limit and must not have to fit one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.functions import fixed
from mergelens.functions.text import decimals_sql
from mergelens.functions.times import hours_between, merge_micros, micros_between, micros_to_hours
from mergelens.operators.interactions import breakdown, interactions, kind_counts
from mergelens.operators.percentiles import percentile_hours
from mergelens.operators.reviews import (
    first_external_reviews,
    review_facts,
    with_change_request,
    with_followups,
)
from mergelens.operators.subjects import SUBJECT, of_subjects, resolved, user_merged_prs, user_prs, user_reviews, within
from mergelens.operators.summaries import MERGED, OPENED, Summaries, in_periods
from mergelens.operators.tables import PR_KEY, Tables

_PERIOD = tuple(SUBJECT[1:])
_HALVES = {"median_hours": 0.5, "p75_hours": 0.75}


@dataclass(frozen=True)
class Metric:
    """A metric of one's pull requests or reviews.

    ``contributions`` are frames with the subject's columns and any of ``sums``.
    ``durations`` has the subject's columns and ``micros``; its count, median and
    p75 are then available as ``n``, ``median_hours`` and ``p75_hours``.
    ``values`` are the details as SQL over sums and percentiles, ``summary`` is a
    text as SQL over the details, and ``has_details`` tells whether there are any.
    """

    slug: str
    name: str
    values: dict[str, str]
    summary: str
    sums: tuple[str, ...] = ()
    contributions: Callable[[Tables, DataFrame], list[DataFrame]] = lambda tables, subjects: []
    durations: Callable[[Tables, DataFrame], DataFrame] | None = None
    items: Callable[[Tables, DataFrame], DataFrame] | None = None
    has_details: str = "true"
    # Whether it reads ``review_facts``, which a report then works out once.
    uses_facts: bool = False
    # Tables it reads; of none named, all.
    reads: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.values)

    def measure(self, tables: Tables, subjects: DataFrame) -> DataFrame:
        """One row per subject with the metric's details."""
        return measured([self], tables, subjects).drop("metric_slug")


def measured(chosen: list[Metric], tables: Tables, subjects: DataFrame) -> DataFrame:
    """Details of the chosen metrics, one row per metric and subject.

    Details of other metrics are null in a row.
    """
    keys = ["metric_slug", *SUBJECT]
    slugs = F.array(*[F.lit(metric.slug) for metric in chosen])
    # A report has one period per subject, so bounds without a time zone are UTC here.
    subjects = resolved(subjects.select(*SUBJECT).distinct())
    parts = [subjects.select(F.explode(slugs).alias("metric_slug"), *SUBJECT)]
    durations = []
    for metric in chosen:
        slug = F.lit(metric.slug).alias("metric_slug")
        for part in metric.contributions(tables, subjects):
            parts.append(part.select(slug, *SUBJECT, *[name for name in metric.sums if name in part.columns]))
        if metric.durations is not None:
            durations.append(metric.durations(tables, subjects).select(slug, *SUBJECT, "micros"))
    sums = list(dict.fromkeys(name for metric in chosen for name in metric.sums))
    if durations:
        spans = reduce(DataFrame.unionByName, durations)
        parts.append(percentile_hours(spans, keys, "micros", _HALVES, "n"))
        sums += ["n", *_HALVES]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    totals = rows.groupBy(*keys).agg(*[F.expr(f"coalesce(sum({name}), 0)").alias(name) for name in sums])
    details = {}
    for metric in chosen:
        for name, value in metric.values.items():
            details.setdefault(name, []).append(f"WHEN '{metric.slug}' THEN {value}")
    return totals.selectExpr(
        *keys, *[f"CASE metric_slug {' '.join(cases)} END AS {name}" for name, cases in details.items()]
    )


def _one() -> Column:
    return F.lit(1).cast("long")


def _ratio(part: str, whole: str) -> str:
    return f"coalesce(try_divide({part}, {whole}), 0D)"


# --- pull-request throughput -------------------------------------------------


def _throughput(tables: Tables, subjects: DataFrame) -> list[DataFrame]:
    rows = of_subjects(tables.pull_requests, subjects, "user_login")
    merged = F.col("merged") & F.col("merged_at").isNotNull() & within("merged_at")
    flags = {"opened_count": within("created_at"), "merged_count": merged}
    return [rows.select(*SUBJECT, *[F.coalesce(flag, F.lit(False)).cast("long").alias(n) for n, flag in flags.items()])]


def _throughput_items(tables: Tables, subjects: DataFrame) -> DataFrame:
    opened = user_prs(tables.pull_requests, subjects).withColumn("list", F.lit("opened_pr_numbers"))
    merged = user_merged_prs(tables.pull_requests, subjects).withColumn("list", F.lit("merged_pr_numbers"))
    return opened.unionByName(merged).select(*SUBJECT, "list", "repo_key", "number", "created_at", "line_ord")


# --- cycle time --------------------------------------------------------------


def _merged_durations(tables: Tables, subjects: DataFrame) -> DataFrame:
    return user_merged_prs(tables.pull_requests, subjects).withColumn("micros", merge_micros())


def _cycle_time_items(tables: Tables, subjects: DataFrame) -> DataFrame:
    rows = _merged_durations(tables, subjects).withColumn("hours", micros_to_hours(F.col("micros")))
    return rows.select(*SUBJECT, "repo_key", "number", "hours", "created_at", "line_ord")


def measured_from(summaries: Summaries, subjects: DataFrame) -> DataFrame:
    """Throughput and cycle time of every subject from daily counts: equal to what the facts give."""
    found = in_periods(summaries, subjects)
    idle = resolved(subjects.select(*SUBJECT).distinct())
    counts = {"opened_count": OPENED, "merged_count": MERGED}
    parts = [idle, found.select(*SUBJECT, *[F.when(F.col("kind") == k, F.col("n")).alias(c) for c, k in counts.items()])]
    parts.append(percentile_hours(found.filter(F.col("kind") == MERGED), SUBJECT, "micros", _HALVES, "n", weight="n"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sums = [*counts, "n", *_HALVES]
    totals = rows.groupBy(*SUBJECT).agg(*[F.expr(f"coalesce(sum({name}), 0)").alias(name) for name in sums])
    values = {"opened_count": "opened_count", "merged_count": "merged_count", "timed_count": "n", **_HOURS}
    values["merge_ratio"] = _ratio("merged_count", "opened_count")
    return totals.selectExpr(*SUBJECT, *[f"{value} AS {name}" for name, value in values.items()])


# --- merge effectiveness -----------------------------------------------------


def _merge_effectiveness(tables: Tables, subjects: DataFrame) -> list[DataFrame]:
    merged = _merged_durations(tables, subjects)
    # Whole microseconds, so the sum does not depend on the order of rows.
    own = merged.select(*SUBJECT, _one().alias("merged_pr_count"), F.col("micros").cast("decimal(28,0)").alias("merge_micros"))
    return [own, _merged_interactions(tables, merged).withColumn("interactions", _one())]


def _merged_interactions(tables: Tables, merged: DataFrame) -> DataFrame:
    """Interactions before the merge, for every subject who owns the pull request."""
    sides = merged.withColumn("subject_login", F.col("user_login"))
    found = interactions(tables, sides, "merged_at", ("subject_login", "start_date", "end_date"))
    return found.withColumnRenamed("subject_login", "user_login")


def _merge_effectiveness_items(tables: Tables, subjects: DataFrame) -> DataFrame:
    merged = _merged_durations(tables, subjects)
    keys = [*PR_KEY, *_PERIOD]
    counts = kind_counts(_merged_interactions(tables, merged), keys)
    right = counts.select(*[F.col(name).alias(f"_{name}") for name in keys], "back_and_forth", *fixed.INTERACTION_KINDS)
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in keys]
    return merged.join(right, same, "left").select(
        *SUBJECT,
        "repo_key",
        "number",
        micros_to_hours(F.col("micros")).alias("merge_time_hours"),
        F.coalesce("back_and_forth", F.lit(0)).alias("back_and_forth"),
        breakdown().alias("breakdown"),
        "created_at",
        "line_ord",
    )


# --- review leverage ---------------------------------------------------------


def _facts(tables: Tables) -> DataFrame:
    return review_facts(tables) if tables.review_facts is None else tables.review_facts


def _leverage(tables: Tables, subjects: DataFrame) -> list[DataFrame]:
    facts = user_reviews(_facts(tables), subjects)
    flags = {
        "total_reviews": F.lit(True),
        "change_requests": F.col("is_change_request"),
        "effective_changes": F.col("effective"),
        "updated_after_review": F.col("updated_after_review"),
        "merged_after_review": F.col("merged_after_review"),
    }
    return [facts.select(*SUBJECT, *[flag.cast("long").alias(name) for name, flag in flags.items()])]


def _leverage_items(tables: Tables, subjects: DataFrame) -> DataFrame:
    facts = user_reviews(_facts(tables), subjects).filter("is_change_request")
    return facts.select(
        *SUBJECT, "repo_key", F.col("number").alias("pr_number"), F.col("id").alias("review_id"), "effective",
        F.col("submitted_at").alias("at"),
    )


# --- review iterations -------------------------------------------------------


def _change_requests_on(tables: Tables, prs: DataFrame) -> DataFrame:
    asks = tables.review_facts
    if asks is None:
        asks = with_change_request(tables.reviews.select(*PR_KEY, "id", "state"), tables.comments)
    return asks.filter("is_change_request").select(*PR_KEY).join(prs.select(*PR_KEY, *_PERIOD), PR_KEY)


def _iterations(tables: Tables, subjects: DataFrame) -> list[DataFrame]:
    prs = user_prs(tables.pull_requests.filter("merged"), subjects)
    return [prs.withColumn("merged_prs", _one()), _change_requests_on(tables, prs).withColumn("asks", _one())]


def _iterations_items(tables: Tables, subjects: DataFrame) -> DataFrame:
    prs = user_prs(tables.pull_requests.filter("merged"), subjects)
    keys = [*PR_KEY, *_PERIOD]
    counts = _change_requests_on(tables, prs).groupBy(*keys).agg(F.count("*").alias("asks"))
    right = counts.select(*[F.col(name).alias(f"_{name}") for name in keys], "asks")
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in keys]
    return prs.join(right, same, "left").select(
        *SUBJECT, "repo_key", "number", F.coalesce("asks", F.lit(0)).alias("iterations"), "created_at", "line_ord"
    )


# --- time to first review ----------------------------------------------------


def _first_reviews(tables: Tables, subjects: DataFrame) -> tuple[DataFrame, DataFrame]:
    prs = user_prs(tables.pull_requests, subjects)
    sides = prs.withColumn("subject_login", F.col("user_login"))
    carry = ("subject_login", "start_date", "end_date")
    found = first_external_reviews(sides, tables.reviews, carry).withColumnRenamed("subject_login", "user_login")
    return prs, found


def _first_review_times(tables: Tables, subjects: DataFrame) -> DataFrame:
    _, found = _first_reviews(tables, subjects)
    return found.withColumn("micros", micros_between(F.col("created_at"), F.col("first_review_at")))


def _first_review_items(tables: Tables, subjects: DataFrame) -> DataFrame:
    prs, found = _first_reviews(tables, subjects)
    keys = [*PR_KEY, *_PERIOD]
    right = found.select(*[F.col(name).alias(f"_{name}") for name in keys], "first_review_at")
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in keys]
    return prs.join(right, same, "left").select(
        *SUBJECT,
        "repo_key",
        "number",
        hours_between(F.col("created_at"), F.col("first_review_at")).alias("hours"),
        "created_at",
        "line_ord",
    )


# --- response to change requests ---------------------------------------------


def _responses(tables: Tables, subjects: DataFrame) -> DataFrame:
    formal = F.col("state") == fixed.CHANGES_REQUESTED
    followed = tables.review_facts
    if followed is None:
        followed = with_followups(tables.reviews.filter(formal), tables, next_review=False)
    followed = followed.filter(formal & F.coalesce("merged", F.lit(False)))
    owned = followed.drop("user_login").withColumnRenamed("pr_author", "user_login")
    within = of_subjects(owned, subjects, "user_login").filter(
        (F.col("start_date").isNull() | (F.col("created_at") >= F.col("start_date")))
        & (F.col("end_date").isNull() | (F.col("created_at") <= F.col("end_date")))
    )
    return within.withColumn("micros", F.col("next_commit") - F.col("at_micros"))


def _response_items(tables: Tables, subjects: DataFrame) -> DataFrame:
    return _responses(tables, subjects).select(
        *SUBJECT,
        "repo_key",
        F.col("number").alias("pr"),
        F.col("id").alias("review_id"),
        micros_to_hours(F.col("micros")).alias("hours"),
        "created_at",
        F.col("submitted_at").alias("at"),
    )


# --- summaries ---------------------------------------------------------------


def _sentence(template: str, places: int = 2, otherwise: str | None = None) -> str:
    """SQL text of a template: ``{name}`` is a count, ``{name!r}`` a number with decimals.

    Where a number is null the text is ``otherwise``.
    """
    parts = []
    for literal, name, _, conversion in Formatter().parse(template):
        if literal:
            parts.append("'" + literal + "'")
        if name:
            parts.append(decimals_sql(name, places) if conversion else f"cast({name} AS string)")
    text = "concat(" + ", ".join(parts) + ")"
    return f"coalesce({text}, '{otherwise}')" if otherwise else text


def _if_asked(name: str) -> str:
    return f"CASE WHEN change_requests > 0 THEN {name} END"


_HOURS = {"median_hours": "median_hours", "p75_hours": "p75_hours"}

# Names of the details and wording of the summaries.
_ALL = (
    Metric(
        "pr_merge_effectiveness",
        fixed.METRIC_NAMES["pr_merge_effectiveness"],
        {
            "merged_pr_count": "nullif(merged_pr_count, 0)",
            "average_merge_time_hours": "try_divide(cast(merge_micros AS double) / 1e6D / 3600D, merged_pr_count)",
            "average_back_and_forth": "try_divide(interactions, merged_pr_count)",
        },
        _sentence(
            "{merged_pr_count} PRs merged, average merge time: {average_merge_time_hours!r} hours, "
            "average back-and-forth: {average_back_and_forth!r}",
            places=1,
            otherwise=fixed.NO_MERGED_PRS,
        ),
        ("merged_pr_count", "merge_micros", "interactions"),
        _merge_effectiveness,
        items=_merge_effectiveness_items,
        has_details="merged_pr_count IS NOT NULL",
        reads=("pull_requests", "reviews", "comments", "timeline"),
    ),
    Metric(
        "review_leverage",
        fixed.METRIC_NAMES["review_leverage"],
        {
            "total_reviews": _if_asked("total_reviews"),
            "change_requests": _if_asked("change_requests"),
            "effective_changes": _if_asked("effective_changes"),
            "effectiveness_percentage": "try_divide(effective_changes, change_requests) * 100",
            "updated_after_review": _if_asked("updated_after_review"),
            "merged_after_review": _if_asked("merged_after_review"),
        },
        _sentence(
            "{total_reviews} PRs reviewed, {effective_changes} effective change requests out of {change_requests} "
            "({effectiveness_percentage!r}%). Updated after review: {updated_after_review}, "
            "merged after review: {merged_after_review}",
            places=1,
            otherwise=fixed.NO_CHANGE_REQUESTS,
        ),
        ("total_reviews", "change_requests", "effective_changes", "updated_after_review", "merged_after_review"),
        _leverage,
        items=_leverage_items,
        has_details="change_requests IS NOT NULL",
        uses_facts=True,
    ),
    Metric(
        "pr_throughput",
        fixed.METRIC_NAMES["pr_throughput"],
        {
            "opened_count": "opened_count",
            "merged_count": "merged_count",
            "merge_ratio": _ratio("merged_count", "opened_count"),
        },
        _sentence("{opened_count} PRs opened, {merged_count} merged in window. Merge ratio: {merge_ratio!r}"),
        ("opened_count", "merged_count"),
        _throughput,
        items=_throughput_items,
        reads=("pull_requests",),
    ),
    Metric(
        "cycle_time",
        fixed.METRIC_NAMES["cycle_time"],
        {"merged_count": "n", **_HOURS},
        _sentence("{merged_count} merged PRs. Median: {median_hours!r}h, p75: {p75_hours!r}h."),
        durations=_merged_durations,
        items=_cycle_time_items,
        reads=("pull_requests",),
    ),
    Metric(
        "review_iterations",
        fixed.METRIC_NAMES["review_iterations"],
        {"merged_prs": "merged_prs", "average_iterations": _ratio("asks", "merged_prs")},
        _sentence("{merged_prs} merged PRs; avg iterations: {average_iterations!r}"),
        ("merged_prs", "asks"),
        _iterations,
        items=_iterations_items,
        uses_facts=True,
        reads=("pull_requests", "reviews", "comments"),
    ),
    Metric(
        "time_to_first_review",
        fixed.METRIC_NAMES["time_to_first_review"],
        {"reviewed_prs": "n", **_HOURS},
        _sentence("{reviewed_prs} PRs reviewed; median: {median_hours!r}h, p75: {p75_hours!r}h"),
        durations=_first_review_times,
        items=_first_review_items,
        reads=("pull_requests", "reviews"),
    ),
    Metric(
        "slow_review_response",
        fixed.METRIC_NAMES["slow_review_response"],
        {"samples": "n", **_HOURS},
        _sentence("{samples} responses measured; median: {median_hours!r}h, p75: {p75_hours!r}h"),
        durations=_responses,
        items=_response_items,
        uses_facts=True,
        reads=("pull_requests", "reviews", "commits"),
    ),
)


def metrics() -> dict[str, Metric]:
    """The built-in metrics by slug; add an entry to a copy to run your own."""
    return {metric.slug: metric for metric in _ALL}
