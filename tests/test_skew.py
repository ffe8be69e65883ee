"""Running values over very large groups, in any number of stretches and batches, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergelens.operators.percentiles import percentile_hours
from mergelens.operators.skew import merged_instants, with_next, with_position

HOUR = 3_600_000_000


def events(spark, seed=1, n=3000):
    """A third of all rows in one group; times repeat and spread over many hours."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = 0 if rng.random() < 0.34 else rng.randrange(1, 60)
        rows.append((group, rng.randrange(0, 400) * HOUR // 4, rng.choice("abc"), i))
    return rows, spark.createDataFrame(rows, "g long, t long, kind string, id long").repartition(5)


def odd_events(spark):
    """Null groups, 2,500 groups of a few rows, one instant with many rows, and a third of the rows without a time."""
    rows, _ = events(spark, 3, 600)
    rows = [(None if g == 0 else g, t, kind, i) for g, t, kind, i in rows]
    rows += [(1000 + i % 2500, i // 2500, "a", 10_000 + i) for i in range(5000)]
    rows += [(7, 12345, "b", 20_000 + i) for i in range(300)]
    rows += [(8, None, "ab"[i % 2], 30_000 + i) for i in range(2500)]
    return rows, spark.createDataFrame(rows, "g long, t long, kind string, id long").repartition(5)


def one_instant(spark):
    """A third of all rows at one instant of one group, between earlier and later ones."""
    rows = [(0, 500, "abc"[i % 3], i) for i in range(1000)]
    rows += [(0, t, "abc"[t % 3], 2000 + t) for t in (100, 101, 102, 499, 501, 502, 800)]
    rows += [(g, t, "abc"[(g + t) % 3], 10_000 + 20 * g + t) for g in range(1, 101) for t in range(20)]
    return rows, spark.createDataFrame(rows, "g long, t long, kind string, id long").repartition(5)


@pytest.fixture(params=[(1, 50), (6, 10_000), (40, 7)], ids=str)
def partitions(spark, request):
    """Number of stretches; with each another number of rows that a Python task gets at once."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, request.param[1])
    yield request.param[0]
    spark.conf.unset(setting)


def null_first(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("make", [events, odd_events, one_instant])
def test_with_next(spark, partitions, make):
    rows, df = make(spark)
    wanted = {"next_a": F.col("kind") == "a", "next_b": (F.col("kind") == "b") & (F.col("id") % 7 == 0)}
    out = with_next(df, ["g"], "t", wanted, partitions=partitions)
    assert out.columns == ["g", "t", "kind", "id", "next_a", "next_b"]
    found = {r.id: (r.next_a, r.next_b) for r in out.collect()}
    assert len(found) == len(rows)
    instants = {}
    for g, t, kind, i in rows:
        if t is not None and (kind == "a" or kind == "b" and i % 7 == 0):
            instants.setdefault((g, kind), set()).add(t)
    for g, t, _, i in rows:
        expected = tuple(
            None if t is None else min((t2 for t2 in instants.get((g, kind), ()) if t2 > t), default=None) for kind in "ab"
        )
        assert found[i] == expected


@pytest.mark.parametrize("make", [events, odd_events, one_instant])
def test_with_position(spark, partitions, make):
    rows, df = make(spark)
    out = with_position(df, ["g"], "t", ["kind", "id"], partitions=partitions)
    assert out.columns == ["g", "t", "kind", "id", "position"]
    found = {r.id: r.position for r in out.collect()}
    groups = {}
    for g, t, kind, i in rows:
        groups.setdefault(g, []).append((t, kind, i))
    expected = {
        row[2]: n for members in groups.values() for n, row in enumerate(sorted(members, key=null_first), 1)
    }
    assert found == expected


def test_several_keys(spark):
    rows = [("a", None, 5, 1), ("a", None, 6, 2), ("a", "x", 5, 3), (None, "x", 5, 4), (None, "x", 9, 5)]
    df = spark.createDataFrame(rows, "g string, h string, t long, id long")
    found = {r.id: r.n for r in with_next(df, ["g", "h"], "t", {"n": F.lit(True)}, partitions=3).collect()}
    assert found == {1: 6, 2: None, 3: None, 4: 9, 5: None}
    placed = with_position(df, ["g", "h"], "t", ["id"], partitions=3)
    assert {r.id: r.position for r in placed.collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 2}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g long, t long, id long")
    assert with_next(df, ["g"], "t", {"n": F.lit(True)}).isEmpty()
    assert with_position(df, ["g"], "t", ["id"]).isEmpty()


@pytest.mark.parametrize("make", [one_instant, odd_events])
def test_one_instant_of_a_group_spreads_over_tasks(spark, make):
    """A third of all rows at one instant, or without a time, lie in eight tasks or more."""
    rows, df = make(spark)
    hot = "g = 0 and t = 500" if make is one_instant else "g = 8 and t is null"
    share = df.filter(hot).count() / len(rows)
    assert share > 0.29
    for out in (
        with_next(df, ["g"], "t", {"n": F.lit(True)}, partitions=40),
        with_position(df, ["g"], "t", ["id"], partitions=40),
    ):
        files = out.filter(hot).groupBy(F.input_file_name()).count()
        sizes = [r["count"] for r in files.collect()]
        assert len(sizes) >= 8 and max(sizes) < 0.1 * len(rows)


@pytest.mark.parametrize(
    "earlier, later, expected",
    [
        ((5, 9), (None, None), (5, 9)),
        ((5, 9), (3, 4), (3, 4)),
        ((5, 9), (3, None), (3, 5)),
        ((5, 9), (5, None), (5, 9)),
        ((5, None), (5, None), (5, None)),
        ((None, None), (3, None), (3, None)),
    ],
)
def test_merged_instants(earlier, later, expected):
    assert merged_instants(earlier, later) == expected


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_match_interpolation(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(2500):
        group = 0 if rng.random() < 0.34 else rng.randrange(1, 30)
        value = rng.choice([rng.randrange(0, 10**12), rng.randrange(-(10**8), 10**8), 3_600_000_000])
        rows.append((group, value))
    rows += [(100, 7), (101, None), (102, 5), (102, 5)]
    df = spark.createDataFrame(rows, "g long, v long")
    fractions = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    found = {r.g: r for r in percentile_hours(df, ["g"], "v", fractions).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v / 1e6 / 3600)
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert found[g].n == len(values)
        for name, p in fractions.items():
            assert found[g][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_percentiles_group_by_null_keys(spark):
    df = spark.createDataFrame([(None, 3_600_000_000), (None, 7_200_000_000), (1, 0)], "g long, v long")
    found = {r.g: r.p for r in percentile_hours(df, ["g"], "v", {"p": 0.5}).collect()}
    assert found == {None: 1.5, 1: 0.0}
