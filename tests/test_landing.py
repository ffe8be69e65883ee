"""Batches taken up by landed tables: equal to one load, repeatable, and read by month."""

import re

import pytest
from pyspark.sql import functions as F

from mergelens.operators import subjects as sj
from mergelens.operators.tables import MONTH
from mergelens.sources import schemas
from mergelens.sources.landing import FACTS, Landing
from mergelens.sources.load import canonical
from mergelens.sources.manifest import Manifest

WINDOW = Manifest(
    "d", "github",
    {"provider": "github", "user": "ann", "from": "2026-01-01T00:00:00Z", "to": "2026-12-31T00:00:00Z", "repositories": []},
)
URL = "https://api.example.org/repos/org/repo/pulls/"
REPO = {"id": 9, "name": "repo", "full_name": "org/repo", "owner": {"id": 90, "login": "org"}}


def user(login, ident=None):
    return {"id": ident or sum(map(ord, login)), "login": login}


def pr(number, author, created, title="t", **more):
    side = {"label": "x", "ref": "r", "sha": "s", "user": user("base")}
    return {
        "id": number, "number": number, "title": title, "state": "open", "user": author, "created_at": created,
        "base": side | {"repo": REPO}, "head": side,
    } | more


def review(ident, number, who, at):
    return {"id": ident, "user": who, "body": "b", "state": "APPROVED", "submitted_at": at, "pull_request_url": f"{URL}{number}"}


def raw(spark, first_line, **tables):
    """Raw tables of one dump from plain payloads, lines counted from ``first_line``."""
    out = {}
    for name, schema in schemas.RAW.items():
        rows = [(*[row.get(f) for f in schema.fieldNames()], "d", first_line + i) for i, row in enumerate(tables.get(name, []))]
        whole = schema.__class__(list(schema.fields)).add("dump_id", "string").add("line_ord", "long")
        out[name] = spark.createDataFrame(rows, whole)
    return out


def batches(spark):
    ann, bob, old_bob = user("ann"), user("bob", 7), user("bobby", 7)
    first = raw(
        spark, 0,
        pull_requests=[pr(1, ann, "2026-01-05T00:00:00Z"), pr(2, bob, "2026-02-05T00:00:00Z"), pr(3, ann, "2026-03-01T00:00:00Z")],
        reviews=[review(11, 1, ann, "2026-01-06T00:00:00Z"), review(12, 3, user("cid"), "2026-03-02T00:00:00Z")],
        files=[{"filename": "a", "pull_request_number": 1}, {"filename": "a", "pull_request_number": 2}],
    )
    # The second fetch names user 7 otherwise in a review, which counts before pull requests.
    second = raw(
        spark, 100,
        pull_requests=[pr(1, ann, "2026-01-05T00:00:00Z", "again", closed_at="2026-04-01T00:00:00Z"), pr(4, bob, "2026-05-05T00:00:00Z")],
        reviews=[review(13, 1, old_bob, "2026-05-07T00:00:00Z"), review(12, 3, user("cid"), "2026-04-02T00:00:00Z")],
        files=[{"filename": "b", "pull_request_number": 4}],
    )
    return first, second


def plain(tables, name):
    rows = getattr(tables, name)
    columns = sorted(c for c in rows.columns if c != MONTH)
    return sorted(map(str, rows.select(*columns).collect()))


@pytest.mark.parametrize("dedup", [False, True])
def test_batches_equal_one_load(spark, tmp_path, dedup):
    first, second = batches(spark)
    landing = Landing(spark, str(tmp_path), dedup_children=dedup, slots=2)
    landing.append(first, WINDOW, WINDOW.frame(spark))
    assert set(landing.tables().reviews.toPandas()["user_login"]) == {"ann", "cid"}
    landing.append(second, WINDOW, WINDOW.frame(spark))
    both = {name: first[name].unionByName(second[name]) for name in first}
    whole = canonical(both, WINDOW, WINDOW.frame(spark), dedup_children=dedup)
    for name in (*FACTS, "users", "repositories"):
        assert plain(landing.tables(), name) == plain(whole, name), name
    found = {r.number: (r.title, r.user_login) for r in landing.tables().pull_requests.collect()}
    # Pull request 2 was not fetched again, but its author's first mention has changed.
    assert found == {1: ("again", "ann"), 2: ("t", "bobby"), 3: ("t", "ann"), 4: ("t", "bobby")}
    if dedup:
        # The only review of March has moved to April, and its folder is gone.
        months = {r.month for r in landing.tables().reviews.select(MONTH).distinct().collect()}
        assert months == {202601, 202604, 202605}
        return
    # Taking up a batch again changes nothing.
    before = {name: plain(landing.tables(), name) for name in (*FACTS, "users", "repositories")}
    landing.append(second, WINDOW, WINDOW.frame(spark))
    assert {name: plain(landing.tables(), name) for name in before} == before


def partition_filters(spark, df):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    return re.findall(r"PartitionFilters: \[(.*?)\]", plan)


def test_periods_prune_months(spark, tmp_path):
    first, second = batches(spark)
    landing = Landing(spark, str(tmp_path), slots=2)
    landing.append({name: first[name].unionByName(second[name]) for name in first}, WINDOW, WINDOW.frame(spark))
    tables = landing.tables()
    make = "SELECT 'd' AS dump_id, '{}' AS user_login, {} AS start_date, {} AS end_date"
    march = spark.sql(make.format("ann", "timestamp'2026-03-01 00:00:00Z'", "timestamp'2026-03-31 00:00:00Z'"))
    opened = sj.user_prs(tables.pull_requests, march)
    assert any("month" in f for f in partition_filters(spark, opened))
    assert [r.number for r in opened.collect()] == [3]
    files = sj.in_months(tables.pull_requests, march).select(F.input_file_name()).distinct().collect()
    assert len(files) == 1
    # Pull requests opened earlier may be merged in the period; an open bound does not limit.
    assert all(">=" not in f for f in partition_filters(spark, sj.user_merged_prs(tables.pull_requests, march)))
    open_end = march.unionByName(spark.sql(make.format("bobby", "cast(null AS timestamp)", "cast(null AS timestamp)")))
    assert sorted(r.number for r in sj.user_prs(tables.pull_requests, open_end).collect()) == [2, 3, 4]


def test_an_empty_batch_lands_empty_tables(spark, tmp_path):
    none = raw(spark, 0)
    landing = Landing(spark, str(tmp_path), slots=2)
    landing.append(none, WINDOW, WINDOW.frame(spark))
    assert landing.tables().timeline.isEmpty()
    first, _ = batches(spark)
    landing.append(first, WINDOW, WINDOW.frame(spark))
    assert landing.tables().pull_requests.count() == 3


def part_files(tmp_path, name, month):
    return sorted(path.name for path in tmp_path.glob(f"{name}/dump_id=d/month={month}/part-*"))


def test_a_cut_off_run_is_repeated_and_rows_that_stay_are_not_written_again(spark, tmp_path, monkeypatch):
    first, second = batches(spark)
    landing = Landing(spark, str(tmp_path), slots=2)
    landing.append(first, WINDOW, WINDOW.frame(spark))
    january, march = (part_files(tmp_path, "reviews", month) for month in (202601, 202603))
    assert january and march

    def cut_off(*args):
        raise RuntimeError("cut off")

    monkeypatch.setattr(Landing, "_write_facts", cut_off)
    with pytest.raises(RuntimeError):
        landing.append(second, WINDOW, WINDOW.frame(spark))
    monkeypatch.undo()
    landing.append(second, WINDOW, WINDOW.frame(spark))
    # Names of users that the first run had merged reach pull requests which only landed before it.
    found = {r.number: (r.title, r.user_login) for r in landing.tables().pull_requests.collect()}
    assert found == {1: ("again", "ann"), 2: ("t", "bobby"), 3: ("t", "ann"), 4: ("t", "bobby")}
    # Their pull requests were fetched again, but these reviews are as they were.
    assert part_files(tmp_path, "reviews", 202601) == january
    assert part_files(tmp_path, "reviews", 202603) == march
