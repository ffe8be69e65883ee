"""Daily summaries: periods that cut days, batches, re-fetched pull requests, plans."""

import random

import pytest
from conftest import BASE, hour, make_subjects, make_tables
from pyspark.sql import functions as F

from mergelens.operators.summaries import Summaries, in_periods, summarise
from mergelens.plans.metrics import measured_from, metrics
from mergelens.sources.staging import Staging


def from_facts(tables, subjects):
    cycle = metrics()["cycle_time"].measure(tables, subjects)
    flow = metrics()["pr_throughput"].measure(tables, subjects)
    found = {}
    for row in cycle.collect():
        found[row.user_login, row.start_date, row.end_date] = [row.merged_count, row.median_hours, row.p75_hours]
    for row in flow.collect():
        found[row.user_login, row.start_date, row.end_date] += [row.opened_count, row.merged_count]
    return found


def from_summaries(held, subjects):
    names = ("timed_count", "median_hours", "p75_hours", "opened_count", "merged_count")
    return {
        (r.user_login, r.start_date, r.end_date): [r[name] for name in names]
        for r in measured_from(held, subjects).collect()
    }


def some_prs(n, seed=3):
    pick = random.Random(seed)
    rows = []
    for number in range(n):
        opened = pick.randrange(-2400, 7200) / 10
        merged = None if pick.random() < 0.3 else opened + pick.choice([0, 5, 24, pick.random() * 90])
        rows.append((number, pick.choice(["alice", "alice", "bob"]), opened, merged))
    return rows


# Bounds in hours: whole days, parts of days, one instant, within one day, back to front, open.
PERIODS = [(0, 240), (0, 24), (5.5, 100.25), (24, 48 - 1e-9), (30, 31), (48, 48), (100, 50), (None, 70), (70, None), (None, None)]


def make_periods(spark, logins=("alice", "bob", "idle")):
    rows = [("d", login, hour(a), hour(b)) for login in logins for a, b in PERIODS]
    return spark.createDataFrame(rows, "dump_id string, user_login string, start_date timestamp, end_date timestamp")


def test_any_period_equals_the_facts(spark):
    tables, subjects = make_tables(spark, prs=some_prs(400)), make_periods(spark)
    facts = from_facts(tables, subjects)
    assert len(facts) == 3 * len(PERIODS) and any(f[0] for f in facts.values())
    assert from_summaries(summarise(tables.pull_requests), subjects) == facts


def test_day_bounds_are_inclusive_to_the_microsecond(spark):
    prs = [(1, "alice", 0, 24), (2, "alice", 0, 47.999999), (3, "alice", 0, 48)]
    tables = make_tables(spark, prs=prs)
    for start, end, n in ((24, 48, 3), (24, 47.9999995, 2), (24.0000005, 48, 2), (48, 48, 1)):
        subjects = make_subjects(spark, "alice", start=start, end=end)
        (found,) = from_summaries(summarise(tables.pull_requests), subjects).values()
        assert found[0] == n
        assert {tuple(v) for v in from_facts(tables, subjects).values()} == {tuple(found)}


def test_batches_add_up_and_a_refetch_replaces(spark):
    rows, subjects = some_prs(120), make_periods(spark)
    now = [(n, login, opened, 300.0 if n % 9 == 0 else merged) for n, login, opened, merged in rows]
    before, after = (make_tables(spark, prs=r).pull_requests for r in (rows, now))
    stage = Staging(spark)
    summarise(before.filter("number < 50")).plus(summarise(before.filter("number >= 50"))).write(f"{stage.path}/held")
    held = Summaries.read(spark, f"{stage.path}/held")
    whole = summarise(before)
    for name in ("days", "instants"):
        assert sorted(map(str, getattr(held, name).collect())) == sorted(
            map(str, getattr(whole, name).select(*getattr(held, name).columns).collect())
        )
    changed = F.col("number") % 9 == 0
    renewed = held.plus(summarise(before.filter(changed)), -1).plus(summarise(after.filter(changed)))
    assert from_summaries(renewed, subjects) == from_facts(make_tables(spark, prs=now), subjects)
    # What was taken away leaves no rows behind.
    assert held.plus(held, -1).days.count() == 0 and held.plus(held, -1).instants.count() == 0
    stage.close()


def test_rows_that_nobody_can_ask_for(spark):
    tables = make_tables(spark, prs=[(1, "alice", 0, 10), (2, "alice", None, 20), (3, "alice", 5, None)])
    prs = tables.pull_requests.withColumn("user_login", F.when(F.col("number") < 9, F.col("user_login")))
    prs = prs.unionByName(prs.withColumn("user_login", F.lit(None).cast("string"))).withColumn("day", F.lit("clash"))
    subjects = make_subjects(spark, "alice")
    assert from_summaries(summarise(prs), subjects) == from_facts(tables, subjects)
    empty = summarise(prs.filter("false"))
    (found,) = from_summaries(empty, subjects).values()
    assert found == [0, 0.0, 0.0, 0, 0]


def test_the_day_does_not_depend_on_the_session_zone(spark):
    tables, subjects = make_tables(spark, prs=some_prs(60)), make_periods(spark)
    facts, zone = from_facts(tables, subjects), spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
        assert from_summaries(summarise(tables.pull_requests), subjects) == facts
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("bound", ["start_date", "end_date"])
def test_bounds_without_a_zone_are_utc(spark, bound):
    tables = make_tables(spark, prs=some_prs(60))
    subjects = make_subjects(spark, "alice", start=7, end=100)
    naive = subjects.withColumn(bound, F.lit(hour(50).replace(tzinfo=None)))
    assert BASE.tzinfo is not None
    assert [v for _, v in sorted(from_summaries(summarise(tables.pull_requests), naive).items())] == [
        v for _, v in sorted(from_facts(tables, naive).items())
    ]


def test_summaries_are_not_broadcast_for_their_small_files(spark):
    """Sorted counts of few values take few bytes in files and many in memory."""
    many = spark.range(300_000).selectExpr(
        "'merged' AS kind", "'d' AS dump_id", "concat('user_', id div 10000) AS user_login", "id div 100 % 100 AS day",
        "id % 100 AS micros", "1L AS n",
    )
    staging = Staging(spark)
    Summaries(many, many.withColumn("at", F.timestamp_seconds(F.col("day") * 86400))).write(staging.path)
    logins = spark.range(100_000_000).selectExpr("'d' AS dump_id", "concat('user_', id % 30) AS user_login").distinct()
    none = F.lit(None).cast("timestamp")
    found = in_periods(Summaries.read(spark, staging.path), logins.withColumns({"start_date": none, "end_date": none}))
    plan = found._jdf.queryExecution().executedPlan().toString()
    staging.close()
    assert "Join" in plan and "Broadcast" not in plan
