"""Ratings, summaries, the report and its items; number text."""

import json
import random
from dataclasses import replace

import pytest
from conftest import make_subjects, make_tables
from pyspark.sql import functions as F

from mergelens.functions import fixed
from mergelens.functions.text import decimals
from mergelens.operators.subjects import SUBJECT, user_prs
from mergelens.plans.metrics import Metric, metrics
from mergelens.plans.report import rating, report, report_items, write_report
from mergelens.sources.staging import Staging
from mergelens.sources.listing import candidates, updated_between

PRS = [(1, "alice", 0, 10), (2, "alice", 1, 20), (3, "alice", 2, None)]


def test_number_text_rounds_like_exact_values(spark):
    rng = random.Random(3)
    values = [0.125, 0.375, 0.265, 0.275, 0.285, 1.005, 2.675, 0.5, 0.0, -0.125, -1.5, 14.5, 1e9 + 0.005, 99.995, 100.0]
    values += [rng.randrange(0, 10**6) / rng.randrange(1, 500) for _ in range(3000)]
    values += [rng.randrange(0, 10**5) / 1000 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (1, 2, 3):
        rows = df.select("v", decimals("v", places).alias("t")).collect()
        assert [r.t for r in rows] == [f"{r.v:.{places}f}" for r in rows]


EDGES = [
    ("pr_throughput", [(0.9, "excellent"), (0.8999, "good"), (0.7, "good"), (0.5, "neutral"), (0.49, "bad"), (2.0, "excellent")]),
    ("cycle_time", [(0.0, "excellent"), (1.0, "excellent"), (1.01, "good"), (3.0, "good"), (7.0, "neutral"), (7.1, "bad")]),
    ("pr_merge_effectiveness", [(1.0, "excellent"), (2.0, "good"), (4.0, "neutral"), (4.1, "bad"), (None, "unknown")]),
    ("review_leverage", [(80.0, "excellent"), (79.9, "good"), (60.0, "good"), (30.0, "neutral"), (29.9, "bad"), (None, "unknown")]),
    ("review_iterations", [(1.0, "excellent"), (2.0, "good"), (4.0, "neutral"), (5.0, "bad")]),
    ("time_to_first_review", [(1.0, "excellent"), (6.0, "good"), (24.0, "neutral"), (24.5, "bad")]),
    ("slow_review_response", [(2.0, "excellent"), (12.0, "good"), (48.0, "neutral"), (49.0, "bad")]),
    ("something_else", [(1.0, "unknown")]),
]


@pytest.mark.parametrize("slug, cases", EDGES)
def test_rating_edges(spark, slug, cases):
    df = spark.createDataFrame([(value,) for value, _ in cases], "v double")
    assert [r.r for r in df.selectExpr(rating(slug, "v") + " AS r").collect()] == [r for _, r in cases]


def test_report_rows(spark):
    tables = make_tables(spark, prs=PRS, reviews=[(1, 1, "bob", 2, "changes_requested")], commits=[(1, "alice", 3)])
    rows, unknown = report(tables, make_subjects(spark, "alice", "bob"), ["cycle_time", "nothing", "review_leverage"])
    assert unknown == ["nothing"]
    found = {(r.user_login, r.metric_slug): r for r in rows.collect()}
    assert len(found) == 4
    cycle = found["alice", "cycle_time"]
    assert cycle.summary == "2 merged PRs. Median: 14.50h, p75: 16.75h."
    assert json.loads(cycle.details) == {"merged_count": 2, "median_hours": 14.5, "p75_hours": 16.75}
    assert (cycle.metric_name, cycle.rating) == ("Cycle Time", "bad")
    leverage = found["bob", "review_leverage"]
    assert leverage.summary == (
        "1 PRs reviewed, 1 effective change requests out of 1 (100.0%). "
        "Updated after review: 0, merged after review: 1"
    )
    empty = found["alice", "review_leverage"]
    assert (empty.summary, empty.details, empty.rating) == (fixed.NO_CHANGE_REQUESTS, "{}", "unknown")
    # No data rates like the best data, as a median of nothing is zero.
    assert found["bob", "cycle_time"].rating == "excellent"


def test_report_without_any_known_metric(spark):
    with pytest.raises(ValueError):
        report(make_tables(spark, prs=PRS), make_subjects(spark, "alice"), ["nothing"])


def test_own_metric(spark):
    def opened(tables, subjects):
        return [user_prs(tables.pull_requests, subjects).withColumn("mine", F.lit(1))]

    own = Metric("own", "Own", {"n": "mine"}, "concat('n is ', n)", ("mine",), opened)
    tables, subjects = make_tables(spark, prs=PRS), make_subjects(spark, "alice")
    rows, _ = report(tables, subjects, ["own", "cycle_time"], {**metrics(), "own": own})
    row = rows.filter("metric_slug = 'own'").first()
    assert (row.metric_name, row.rating, row.summary, row.details) == ("Own", "unknown", "n is 3", '{"n":3}')


def test_report_files(spark, tmp_path):
    tables = make_tables(spark, prs=PRS, reviews=[(1, 1, "bob", 2, "commented")])
    unknown = write_report(tables, make_subjects(spark, "alice"), str(tmp_path / "r"), ["time_to_first_review", "x"])
    assert unknown == ["x"]
    assert spark.read.parquet(str(tmp_path / "r" / "metrics")).count() == 1
    items = spark.read.parquet(str(tmp_path / "r" / "items")).collect()
    assert sorted(json.loads(r.item)["number"] for r in items) == [1, 2, 3]
    # Unreviewed pull requests are listed with a null.
    assert {json.loads(r.item)["number"]: json.loads(r.item)["hours"] for r in items} == {1: 2.0, 2: None, 3: None}


def test_report_files_of_all_metrics(spark, tmp_path):
    tables = make_tables(spark, prs=PRS, reviews=[(1, 1, "bob", 2, "changes_requested")], commits=[(1, "alice", 3)])
    subjects = make_subjects(spark, "alice", "bob")
    assert write_report(tables, subjects, str(tmp_path / "r")) == []
    landed = spark.read.parquet(str(tmp_path / "r" / "metrics"))
    plain = report(tables, subjects)[0]
    assert sorted(landed.drop("start_date", "end_date").collect()) == sorted(plain.drop("start_date", "end_date").collect())
    assert landed.count() == 14


def test_items_of_all_metrics(spark):
    tables = make_tables(spark, prs=PRS, reviews=[(1, 1, "bob", 2, "changes_requested")], commits=[(1, "alice", 3)])
    rows = report_items(tables, make_subjects(spark, "alice", "bob")).collect()
    counts = {}
    for r in rows:
        counts[r.metric_slug, r.list] = counts.get((r.metric_slug, r.list), 0) + 1
    assert counts == {
        ("pr_throughput", "opened_pr_numbers"): 3,
        ("pr_throughput", "merged_pr_numbers"): 2,
        ("cycle_time", "per_pr_hours"): 2,
        ("pr_merge_effectiveness", "pr_details"): 2,
        ("review_iterations", "per_pr"): 2,
        ("time_to_first_review", "per_pr"): 3,
        ("slow_review_response", "per_review"): 1,
        ("review_leverage", "change_request_details"): 1,
    }


def test_listing(spark):
    def people(*logins):
        return [{"login": name} for name in logins]

    rows = [
        (1, "2026-01-01T00:00:00Z", {"login": "alice"}, people("bob"), None),
        (2, "2026-01-02T00:00:00Z", {"login": "carol"}, None, people("alice", "bob")),
        (3, "2026-01-03T00:00:00Z", {"login": "carol"}, people("alice"), people("alice")),
        (4, "2026-01-04T00:00:00Z", {"login": "carol"}, None, None),
    ]
    schema = (
        "number long, updated_at string, user struct<login:string>, requested_reviewers array<struct<login:string>>, "
        "assignees array<struct<login:string>>"
    )
    df = spark.createDataFrame(rows, schema)
    from datetime import datetime, timezone

    def day(n):
        return datetime(2026, 1, n, tzinfo=timezone.utc)

    def numbers(rows):
        return sorted(r.number for r in rows.collect())

    assert numbers(updated_between(df, day(2), day(3))) == [2, 3]
    assert numbers(updated_between(df, day(2))) == [2, 3, 4]
    assert numbers(updated_between(df, None, day(1))) == [1]
    assert numbers(updated_between(df)) == [1, 2, 3, 4]
    users = spark.createDataFrame([("alice",), ("alice",), ("bob",)], "user_login string")
    pairs = sorted((r.user_login, r.number) for r in candidates(df, users).collect())
    assert pairs == [("alice", 1), ("alice", 2), ("alice", 3), ("bob", 1), ("bob", 2)]


def test_own_metric_without_items_is_written(spark, tmp_path):
    tables = replace_with_header(spark, make_tables(spark, prs=[(1, "alice", 1, 5), (2, "alice", 3, None)]))
    own = Metric("open_share", "Open share", {"share": "try_divide(n_open, n_all)"}, "cast(share AS string)", ("n_open", "n_all"),
                 lambda t, s: [user_prs(t.pull_requests, s).selectExpr(*SUBJECT, "1L AS n_all", "cast(NOT merged AS long) AS n_open")])
    available = {**metrics(), "open_share": own}
    subjects = make_subjects(spark, "alice", "alice")
    chosen = ["open_share", "pr_throughput", "pr_throughput", "nothing"]
    assert write_report(tables, subjects, str(tmp_path / "r"), chosen, available) == ["nothing"]
    rows = {r.metric_slug: json.loads(r.details) for r in spark.read.parquet(str(tmp_path / "r" / "metrics")).collect()}
    assert rows["open_share"] == {"share": 0.5} and rows["pr_throughput"]["opened_count"] == 2
    items = spark.read.parquet(str(tmp_path / "r" / "items")).collect()
    assert sorted((r.list, r.position, json.loads(r.item)["number"]) for r in items) == [
        ("merged_pr_numbers", 1, 1), ("opened_pr_numbers", 1, 1), ("opened_pr_numbers", 2, 2)
    ]
    header = spark.read.parquet(str(tmp_path / "r" / "header")).collect()
    assert {(r.user_login, r.table): r.rows for r in header}["alice", "pull_requests"] == 2
    assert report_items(tables, subjects, ["open_share"], available).count() == 0


def replace_with_header(spark, tables):
    users = spark.createDataFrame([("d", 1)], "dump_id string, id long")
    manifests = make_subjects(spark, "alice")
    return replace(tables, users=users, repositories=users, manifests=manifests)


def test_items_are_placed_in_one_scan(spark, tmp_path):
    """With staging: one scan for the facts and one for the lists of all metrics; equal to those without."""
    reviews = [(1, 1, "bob", 2, "changes_requested"), (2, 1, "bob", 2, "changes_requested")]
    tables = make_tables(spark, prs=PRS, reviews=reviews, commits=[(1, "alice", 3)])
    subjects = make_subjects(spark, "alice", "bob")
    rows = report_items(tables, subjects, staging=Staging(spark, str(tmp_path / "s")))
    assert len(list((tmp_path / "s").iterdir())) == 2
    items = sorted(tuple(map(str, r)) for r in rows.collect())
    assert items == sorted(tuple(map(str, r)) for r in report_items(tables, subjects).collect())
    places = {}
    for r in rows.collect():
        places.setdefault((r.user_login, r.metric_slug, r.list), []).append(r.position)
    assert all(sorted(found) == list(range(1, len(found) + 1)) for found in places.values())
    assert len(places["bob", "review_leverage", "change_request_details"]) == 2


def test_report_writes_facts_once(spark, tmp_path):
    tables = make_tables(spark, prs=PRS, reviews=[(1, 1, "bob", 2, "changes_requested")], commits=[(1, "alice", 3)])
    report(tables, make_subjects(spark, "alice"), staging=Staging(spark, str(tmp_path / "s")))
    names = sorted(path.name.split("-")[0] for path in (tmp_path / "s").iterdir())
    assert names == ["scan", "subjects"]
