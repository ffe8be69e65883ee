"""What happens to rows that break a table's contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUARANTINE_COLUMNS = ["dump_id", "source", "reason", "record"]


class Checks:
    """Applies row checks by one policy and gathers the rows set aside.

    ``fail`` raises at execution on the first bad row; ``quarantine`` drops bad
    rows and keeps them, as JSON with a reason, in ``set_aside``.
    """

    def __init__(self, on_error: str = "fail"):
        if on_error not in ("fail", "quarantine"):
            raise ValueError(f"unknown error policy: {on_error}")
        self.quarantines = on_error == "quarantine"
        self._set_aside: list[DataFrame] = []

    def require(self, rows: DataFrame, source: str, reason: str, good: Column) -> DataFrame:
        """Rows for which ``good`` is true; null counts as false."""
        passed = F.coalesce(good, F.lit(False))
        if not self.quarantines:
            failure = F.raise_error(F.lit(f"{source}: {reason}")).cast("boolean")
            return rows.filter(F.when(passed, F.lit(True)).otherwise(failure))
        bad = rows.filter(~passed)
        record = F.to_json(F.struct(*[c for c in rows.columns if c != "line_ord"]))
        self._set_aside.append(
            bad.select("dump_id", F.lit(source).alias("source"), F.lit(reason).alias("reason"), record.alias("record"))
        )
        return rows.filter(passed)

    def value(self, column: Column, source: str, reason: str) -> Column:
        """The column, failing where it is null unless bad rows are set aside.

        The failure sits in the value and not only in a filter, as a filter could
        be placed behind one that drops nulls.
        """
        if self.quarantines:
            return column
        return F.coalesce(column, F.raise_error(F.lit(f"{source}: {reason}")))

    @property
    def set_aside(self) -> DataFrame | None:
        if not self._set_aside:
            return None
        return reduce(DataFrame.unionByName, self._set_aside)
