"""Period bounds without a time zone, read by the clock of a subject's first record."""

from datetime import datetime

from pyspark.sql import functions as F

from mergelens.functions.times import offset_seconds
from mergelens.operators import subjects as sj
from mergelens.plans.metrics import metrics
from conftest import make_subjects, make_tables


def test_offset_of_iso_text(spark):
    cases = {
        "2026-01-05T00:00:00Z": 0, "2026-01-05T00:00:00": 0, "2026-01-05": 0, "2026-01-05T00:00:00+02:00": 7200,
        "2026-01-05T00:00:00.123-0530": -19800, "2026-01-05T00:00:00-00:30": -1800, "2026-01-05T00:00:00+09": 32400,
        "T": 0, "": 0, None: None,
    }
    df = spark.createDataFrame([(text,) for text in cases], "text string")
    assert {r.text: r.o for r in df.select("text", offset_seconds(F.col("text")).alias("o")).collect()} == cases


def naive(subjects):
    return subjects.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_date", "end_date")})


def test_first_record_sets_the_clock(spark):
    prs = make_tables(spark, prs=[(1, "ann", 5, 6), (2, "ann", 9, 10), (3, "ann", 21, 22), (4, "bob", 9, 10)]).pull_requests
    # ann's first record is two hours ahead of UTC; the later one is not asked.
    prs = prs.withColumn("utc_offset", F.when(F.col("number") == 1, 7200).otherwise(-7200))
    subjects = naive(make_subjects(spark, "ann", "bob", "cid", start=10, end=22))
    found = {(r.user_login, r.number, r.start_date) for r in sj.user_prs(prs, subjects).collect()}
    # ann: 08:00 to 20:00 UTC; bob, two hours behind: 12:00 to 24:00.
    assert found == {("ann", 2, datetime(2026, 1, 1, 8))}
    assert sj.resolved(subjects, prs, "user_login", "created_at").count() == 3
    # Without offsets, UTC; typed bounds stay as they are.
    plain = sj.user_prs(prs.drop("utc_offset"), subjects)
    assert {(r.user_login, r.number) for r in plain.collect()} == {("ann", 3)}
    typed = make_subjects(spark, "ann", start=10, end=22)
    assert sj.resolved(typed, prs, "user_login", "created_at") is typed


def test_metrics_take_them_as_utc(spark):
    tables = make_tables(spark, prs=[(1, "ann", 5, 6), (2, "ann", 15, 16)])
    typed = make_subjects(spark, "ann", start=10, end=22)
    measure = metrics()["pr_throughput"].measure
    assert measure(tables, naive(typed)).collect() == measure(tables, typed).collect()
