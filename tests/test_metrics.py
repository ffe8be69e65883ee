"""Metrics on hand-made activity: the known small cases and each rule's edges."""

import json

import pytest
from conftest import make_subjects, make_tables

from mergelens.operators.reviews import review_facts
from mergelens.plans.metrics import metrics
from mergelens.sources.staging import Staging


def run(spark, slug, tables, login="alice", **period):
    rows = metrics()[slug].measure(tables, make_subjects(spark, login, **period)).collect()
    assert len(rows) == 1
    return rows[0].asDict()


def items(spark, slug, tables, login="alice", **period):
    return metrics()[slug].items(tables, make_subjects(spark, login, **period))


CYCLE = [(1, "alice", 0, 10), (2, "alice", 1, 20), (3, "alice", 2, None)]


def test_cycle_time(spark):
    tables = make_tables(spark, prs=CYCLE)
    row = run(spark, "cycle_time", tables)
    assert (row["merged_count"], row["median_hours"], row["p75_hours"]) == (2, 14.5, 16.75)
    hours = {r.number: r.hours for r in items(spark, "cycle_time", tables).collect()}
    assert hours == {1: 10.0, 2: 19.0}


def test_throughput(spark):
    tables = make_tables(spark, prs=[(1, "alice", 0, 48), (2, "alice", 120, None), (3, "alice", -120, None)])
    row = run(spark, "pr_throughput", tables)
    assert (row["opened_count"], row["merged_count"], row["merge_ratio"]) == (2, 1, 0.5)
    rows = items(spark, "pr_throughput", tables).collect()
    assert [r.number for r in rows if r.list == "merged_pr_numbers"] == [1]
    assert sorted(r.number for r in rows if r.list == "opened_pr_numbers") == [1, 2]


def test_throughput_merged_in_period_but_opened_before(spark):
    row = run(spark, "pr_throughput", make_tables(spark, prs=[(1, "alice", -5, 3), (2, "alice", 240, 240)]))
    # Both bounds are inclusive; the ratio may exceed one.
    assert (row["opened_count"], row["merged_count"], row["merge_ratio"]) == (1, 2, 2.0)


def test_merge_effectiveness(spark):
    tables = make_tables(
        spark,
        prs=CYCLE,
        reviews=[(101, 1, "bob", 2, "approved"), (102, 1, "bob", 5, "commented")],
        comments=[(201, 1, "bob", 3, "issue", None, None), (202, 1, "bob", 4, "review", 102, None)],
    )
    row = run(spark, "pr_merge_effectiveness", tables)
    assert (row["merged_pr_count"], row["average_merge_time_hours"], row["average_back_and_forth"]) == (2, 14.5, 2.0)
    found = {r.number: r for r in items(spark, "pr_merge_effectiveness", tables).collect()}
    assert found[1].breakdown == {"review": 2, "comment_issue": 1, "comment_review": 1}
    assert (found[2].back_and_forth, found[2].breakdown) == (0, {})


def test_interactions_leave_out_author_bots_and_merge_time(spark):
    tables = make_tables(
        spark,
        prs=[(1, "alice", 0, 10)],
        reviews=[(1, 1, "alice", 1, "commented"), (2, 1, "robot", 2, "approved"), (3, 1, "bob", 10, "approved")],
        comments=[(9, 1, "bob", 9.5, "issue", None, None)],
        timeline=[
            (1, 1, "bob", 4, "reviewed"),
            (2, 1, "bob", 4, "commented"),  # same actor and time: counts once
            (3, 1, "bob", 5, "labeled"),
            (4, 1, "helperbot", 6, "reviewed"),
            (5, 1, "bob", 9.5, "commented"),  # a comment at the same time counts as well
        ],
    )
    row = run(spark, "pr_merge_effectiveness", tables)
    # "robot" ends in "bot", so it is one here
    assert row["average_back_and_forth"] == 3.0


def test_review_quality(spark):
    tables = make_tables(
        spark,
        prs=[(1, "alice", 0, 24), (2, "alice", 1, 48)],
        reviews=[
            (101, 1, "bob", 5, "changes_requested"),
            (102, 1, "bob", 6, "approved"),
            (103, 2, "bob", 3, "commented"),
        ],
        commits=[(1, "alice", 7)],
    )
    assert run(spark, "review_iterations", tables, end=120)["average_iterations"] == 0.5
    counts = {r.number: r.iterations for r in items(spark, "review_iterations", tables).collect()}
    assert counts == {1: 1, 2: 0}
    first = run(spark, "time_to_first_review", tables, end=120)
    assert (first["reviewed_prs"], first["median_hours"], first["p75_hours"]) == (2, 3.5, 4.25)
    slow = run(spark, "slow_review_response", tables, end=120)
    assert (slow["samples"], slow["median_hours"]) == (1, 2.0)
    response = items(spark, "slow_review_response", tables).collect()
    assert [(r.pr, r.review_id, r.hours) for r in response] == [(1, 101, 2.0)]


def test_first_review_ignores_author_but_not_bots(spark):
    tables = make_tables(
        spark,
        prs=[(1, "alice", 0, None), (2, "alice", 0, None)],
        reviews=[(1, 1, "alice", 1, "commented"), (2, 1, "checkbot", 2, "commented"), (3, 1, "bob", 3, "approved")],
    )
    row = run(spark, "time_to_first_review", tables)
    assert (row["reviewed_prs"], row["median_hours"]) == (1, 2.0)
    hours = {r.number: r.hours for r in items(spark, "time_to_first_review", tables).collect()}
    assert hours == {1: 2.0, 2: None}


def test_leverage_without_answer(spark):
    tables = make_tables(spark, prs=[(1, "alice", 0, 24)], reviews=[(1, 1, "bob", 0, "changes_requested")])
    row = run(spark, "review_leverage", tables, "bob")
    assert (row["total_reviews"], row["change_requests"], row["effective_changes"]) == (1, 1, 0)
    assert (row["updated_after_review"], row["merged_after_review"]) == (0, 1)


LEVERAGE_CASES = {
    # name: (overrides, effective)
    "answered": ({}, True),
    "commit at the time of the review": ({"commits": [(1, "alice", 5)]}, False),
    "commit by someone else": ({"commits": [(1, "carol", 6)]}, False),
    "another review in between": ({"more": [(2, 1, "carol", 5.5, "commented")]}, False),
    "another review at the commit": ({"more": [(2, 1, "carol", 6, "commented")]}, False),
    "another review at the same time": ({"more": [(2, 1, "carol", 5, "commented")]}, True),
    "another review after the commit": ({"more": [(2, 1, "carol", 7, "commented")]}, True),
    "later than 72 hours": ({"commits": [(1, "alice", 77.5)]}, False),
    "exactly 72 hours": ({"commits": [(1, "alice", 77)]}, True),
    "exactly at the merge": ({"merged": 6}, True),
    "after the merge": ({"merged": 5.5}, False),
    "not merged": ({"merged": None}, False),
    "comment on a changed file": ({"path": "a.py"}, True),
    "comment on another file": ({"path": "b.py"}, False),
    "comment without a path": ({"path": ""}, True),
    "only a comment, state commented": ({"state": "commented", "path": "a.py"}, True),
    "no request at all": ({"state": "commented"}, False),
}


@pytest.mark.parametrize("name", LEVERAGE_CASES)
def test_effective_change_request(spark, name):
    case, expected = LEVERAGE_CASES[name]
    path = case.get("path")
    tables = make_tables(
        spark,
        prs=[(1, "alice", 0, case.get("merged", 200))],
        reviews=[(1, 1, "bob", 5, case.get("state", "changes_requested")), *case.get("more", [])],
        commits=case.get("commits", [(1, "alice", 6)]),
        comments=[] if path is None else [(9, 1, "bob", 5, "review", 1, path)],
        files=[(1, "a.py")],
    )
    facts = {r.id: r for r in review_facts(tables).collect()}
    assert facts[1].effective is expected


def test_merged_without_times_uses_72_hours(spark):
    from pyspark.sql import functions as F

    tables = make_tables(spark, prs=[(1, "alice", 0, 9)], reviews=[(1, 1, "bob", 5, "changes_requested")], commits=[(1, "alice", 50)])
    none = F.lit(None).cast("timestamp")
    prs = tables.pull_requests.withColumns({"merged_at": none, "closed_at": none})
    tables = type(tables)(**{**tables.__dict__, "pull_requests": prs})
    assert review_facts(tables).first().effective is True


def test_events_after_review(spark):
    tables = make_tables(
        spark,
        prs=[(1, "alice", 0, 5), (2, "alice", 0, 4), (3, "alice", 0, None)],
        reviews=[(1, 1, "bob", 5, "approved"), (2, 2, "bob", 5, "approved"), (3, 3, "bob", 5, "approved")],
        timeline=[(1, 1, "x", 5, "labeled"), (2, 2, "x", 5, "merged"), (3, 3, "x", 6, "merged")],
    )
    facts = {r.id: r for r in review_facts(tables).collect()}
    # An event at the very time of the review is not after it, a merge is.
    assert (facts[1].updated_after_review, facts[1].merged_after_review) == (False, True)
    # Merged before the review by its own time, but a merge event follows.
    assert (facts[2].updated_after_review, facts[2].merged_after_review) == (False, True)
    # Not merged: the event alone does not do.
    assert (facts[3].updated_after_review, facts[3].merged_after_review) == (True, False)


def test_number_zero_does_not_link_commits_and_comments(spark):
    tables = make_tables(
        spark,
        prs=[(0, "alice", 0, 50)],
        reviews=[(7, 0, "bob", 5, "changes_requested")],
        commits=[(0, "alice", 6)],
        comments=[(1, 0, "bob", 6, "issue", None, None), (2, 0, "bob", 6, "review", 7, "a.py")],
        files=[(0, "a.py")],
    )
    row = run(spark, "pr_merge_effectiveness", tables)
    assert row["average_back_and_forth"] == 1.0  # the review only
    facts = review_facts(tables).first()
    assert (facts.is_change_request, facts.effective) == (True, False)


def test_review_of_an_absent_pull_request(spark):
    tables = make_tables(spark, prs=[(1, "alice", 0, 5)], reviews=[(1, 3, "bob", 5, "changes_requested")])
    row = run(spark, "review_leverage", tables, "bob")
    assert (row["total_reviews"], row["change_requests"], row["effective_changes"]) == (1, 1, 0)
    assert row["merged_after_review"] == 0


@pytest.mark.parametrize("slug", list(metrics()))
def test_subject_without_activity_keeps_a_row(spark, slug):
    tables = make_tables(spark, prs=CYCLE)
    row = run(spark, slug, tables, "nobody")
    values = [row[name] for name in metrics()[slug].columns]
    if slug in ("pr_merge_effectiveness", "review_leverage"):
        assert values == [None] * len(values)
    else:
        assert all(value == 0 for value in values)


@pytest.mark.parametrize("slug", list(metrics()))
def test_open_period_counts_everything(spark, slug):
    tables = make_tables(spark, prs=CYCLE, reviews=[(1, 1, "bob", 2, "changes_requested")], commits=[(1, "alice", 3)])
    open_rows = spark.createDataFrame(
        [("d", "alice", None, None), ("d", "bob", None, None)],
        "dump_id string, user_login string, start_date timestamp, end_date timestamp",
    )
    wide = make_subjects(spark, "alice", "bob", start=-1000, end=1000)
    columns = ["user_login", *metrics()[slug].columns]
    left = metrics()[slug].measure(tables, open_rows).select(columns)
    right = metrics()[slug].measure(tables, wide).select(columns)
    assert sorted(left.collect()) == sorted(right.collect())
    assert metrics()[slug].items(tables, open_rows).count() == metrics()[slug].items(tables, wide).count()


def test_one_login_with_two_periods(spark):
    tables = make_tables(spark, prs=CYCLE)
    subjects = make_subjects(spark, "alice", start=0, end=0).unionByName(make_subjects(spark, "alice", start=0, end=2))
    rows = metrics()["pr_throughput"].measure(tables, subjects).collect()
    assert sorted(r.opened_count for r in rows) == [1, 3]


def test_results_do_not_depend_on_partitioning(spark):
    from conftest import SMALL

    from mergelens.plans import star

    tables = star.canonical_tables(spark, SMALL)
    subjects = star.subjects(tables)
    shuffled = type(tables)(
        **{n: (v.repartition(7) if v is not None else None) for n, v in tables.__dict__.items()}
    )
    for slug, metric in metrics().items():
        kinds = dict(metric.measure(tables, subjects).dtypes)

        def rounded(t):
            rows = metric.measure(t, subjects).collect()
            return sorted(
                (r.user_login, *[round(r[c], 6) if kinds[c] == "double" and r[c] is not None else r[c] for c in metric.columns])
                for r in rows
            )

        assert json.dumps(rounded(tables)) == json.dumps(rounded(shuffled)), slug


def test_facts_are_read_from_their_one_scan(spark, tmp_path):
    """Flags are worked out before the scan, which deals rows without a column for ties; a commit brings no columns."""
    reviews = [(1, 1, "bob", 2, "changes_requested"), (2, 1, "bob", 6, "changes_requested")]
    tables = make_tables(
        spark, prs=[(1, "alice", 1, 9)], reviews=reviews, commits=[(1, "alice", 3)], timeline=[(1, 1, "bob", 5, "commented")]
    )
    staging = Staging(spark, str(tmp_path / "s"))
    facts = review_facts(tables, staging)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    (scan,) = (tmp_path / "s").iterdir()
    written = spark.read.parquet(str(scan))
    assert not {"_tie", "merged_at", "closed_at", "last_event_at", "submitted_at"} & set(written.columns)
    commit = written.filter("NOT is_review").first()
    assert commit.at_micros is not None and commit.pr_author is None and commit.user_login is None
    found = {r.id: (r.effective, r.updated_after_review, r.merged_after_review) for r in facts.collect()}
    assert found == {1: (True, True, True), 2: (False, False, True)}
