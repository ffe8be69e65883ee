"""Mergeable daily counts, from which any period is answered without the facts.

``days`` counts the pull requests that a login opened or got merged on a day (of UTC),
merged ones by their exact time to merge. ``instants`` holds the same counts by instant;
a period reads it only for its first and last day, where these lie partly inside. Both
are sums, so summaries of batches add up, and a re-fetched pull request is one batch
taken away and another added. Logins and times that are null are not counted: no
subject can ask for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.functions.times import in_period, merge_micros
from mergelens.operators.subjects import SUBJECT, resolved

OPENED, MERGED = "opened", "merged"
_DAY = 86_400_000_000
_BY_DAY = ["kind", "dump_id", "user_login", "day", "micros"]
_BY_INSTANT = [*_BY_DAY, "at"]


def day_of(instant: Column) -> Column:
    """Days since 1970 in UTC, whatever the session's zone."""
    micros = F.unix_micros(instant)
    return ((micros - F.pmod(micros, F.lit(_DAY))) / F.lit(_DAY)).cast("long")


def _added(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")


@dataclass(frozen=True)
class Summaries:
    """Counts ``n`` by ``kind``, login, day and time to merge (``micros``, null for opened ones)."""

    days: DataFrame
    instants: DataFrame

    def plus(self, other: Summaries, times: int = 1) -> Summaries:
        """The sum with a batch; ``times=-1`` takes away what was counted before."""
        one = F.col("n") * F.lit(times)
        return Summaries(
            _added(self.days.unionByName(other.days.withColumn("n", one)), _BY_DAY),
            _added(self.instants.unionByName(other.instants.withColumn("n", one)), _BY_INSTANT),
        )

    def write(self, path: str) -> None:
        for name in ("days", "instants"):
            rows = getattr(self, name).repartitionByRange("dump_id", "user_login", "day")
            rows.sortWithinPartitions("dump_id", "user_login", "day").write.parquet(f"{path.rstrip('/')}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Summaries:
        return cls(*[spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("days", "instants")])


def summarise(prs: DataFrame) -> Summaries:
    """Counts of canonical pull requests; one pass, with partial sums before the exchange."""
    merged = F.when(F.col("merged"), F.col("merged_at"))
    events = F.array(
        F.struct(F.lit(OPENED).alias("kind"), F.col("created_at").alias("at"), F.lit(None).cast("long").alias("micros")),
        F.struct(F.lit(MERGED).alias("kind"), merged.alias("at"), merge_micros().alias("micros")),
    )
    rows = prs.filter("user_login IS NOT NULL").select("dump_id", "user_login", F.inline(events)).filter("at IS NOT NULL")
    instants = _added(rows.withColumns({"day": day_of(F.col("at")), "n": F.lit(1).cast("long")}), _BY_INSTANT)
    return Summaries(_added(instants, _BY_DAY), instants)


def in_periods(summaries: Summaries, subjects: DataFrame) -> DataFrame:
    """``SUBJECT``, ``kind``, ``micros`` and ``n`` of what lies in each subject's period (bounds inclusive, null open).

    Bounds without a time zone are UTC.
    """
    who = resolved(subjects.select(*SUBJECT).distinct())
    start, end = F.unix_micros("start_date"), F.unix_micros("end_date")

    def whole(day: Column) -> Column:
        after = start.isNull() | (day * _DAY >= start)
        return after & (end.isNull() | ((day + 1) * _DAY - 1 <= end))

    # Counts are many rows in small files, which planning by size would send to the driver and broadcast.
    # Hashed are always the subjects, a part in each task.
    inside = summaries.days.join(who.hint("shuffle_hash"), ["dump_id", "user_login"]).filter(whole(F.col("day")))
    # Days that lie partly inside are at most the first and the last, so this is an equi-join on the day.
    ends = F.array_distinct(F.array(day_of(F.col("start_date")), day_of(F.col("end_date"))))
    edges = who.withColumn("day", F.explode(F.filter(ends, lambda day: day.isNotNull() & ~whole(day))))
    partly = summaries.instants.join(edges.hint("shuffle_hash"), ["dump_id", "user_login", "day"])
    partly = partly.filter(in_period(F.col("at"), F.col("start_date"), F.col("end_date")))
    columns = [*SUBJECT, "kind", "micros", "n"]
    return inside.select(*columns).unionByName(partly.select(*columns))
