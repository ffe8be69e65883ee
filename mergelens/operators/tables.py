"""The canonical tables of one or many dumps."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A pull request is identified within a dump by its number, as its children
# know no more; ``repo_key`` is empty unless repositories are kept apart.
PR_KEY = ["dump_id", "repo_key", "number"]

# Folder column of landed tables: year and month of a row's own time as one number, 0 without one.
MONTH = "month"


def month_of(instant: Column) -> Column:
    return F.year(instant) * 100 + F.month(instant)


CHILDREN = ("reviews", "commits", "comments", "files", "timeline")


@dataclass(frozen=True)
class Tables:
    """Canonical tables; every fact table carries ``PR_KEY`` and ``line_ord``."""

    pull_requests: DataFrame
    reviews: DataFrame
    commits: DataFrame
    comments: DataFrame
    files: DataFrame
    timeline: DataFrame
    users: DataFrame | None = None
    repositories: DataFrame | None = None
    manifests: DataFrame | None = None
    quarantine: DataFrame | None = None
    # What followed each review, if already worked out and landed.
    review_facts: DataFrame | None = None

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Land the tables as parquet below ``path``, one folder per table.

        Rows of a pull request are clustered, so that later joins on the key
        read compact runs and row-group statistics prune.
        """
        for table in fields(self):
            rows = getattr(self, table.name)
            if rows is None:
                continue
            if "number" in rows.columns:
                rows = rows.sortWithinPartitions(*PR_KEY)
            rows.write.mode(mode).option("compression", "zstd").parquet(f"{path.rstrip('/')}/{table.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, names: Collection[str] | None = None) -> Tables:
        """Tables landed by ``write``: the named ones, or all that are present."""
        found = {}
        for name in names or [table.name for table in fields(cls)]:
            try:
                found[name] = spark.read.parquet(f"{path.rstrip('/')}/{name}")
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        return cls(**found)
