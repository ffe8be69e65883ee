"""Exact interpolated percentiles per group, also for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Values are counted per minute first. A group has at most as many minutes as
# its durations span, and a minute at most 60 million distinct microseconds, so
# no window below sees more rows than that, whatever the group holds.
_BUCKET_MICROS = 60_000_000


def percentile_hours(
    rows: DataFrame, keys: Sequence[str], micros: str, fractions: dict[str, float], count: str = "n", weight: str = "1L"
) -> DataFrame:
    """Percentiles in hours of the whole-microsecond durations in ``micros``.

    One row per group that has a duration: ``keys``, ``count`` and a column per
    entry of ``fractions``. A row stands for ``weight`` durations, an expression. The built-in ``percentile`` keeps all distinct
    values of a group in one buffer; here equal values are counted before the
    exchange, the minutes holding the wanted ranks are found, and only their
    values are ordered.
    """
    group = ", ".join(f"`{key}`" for key in keys)
    # The join below filters null buckets; doing so here as well keeps both uses of
    # the counts equal, so that they share one exchange.
    counts = (
        rows.selectExpr(*[f"`{key}`" for key in keys], f"`{micros}` div {_BUCKET_MICROS} AS _bucket", f"`{micros}` AS _value", f"{weight} AS _weight")
        .filter("_value IS NOT NULL AND _bucket IS NOT NULL")
        .groupBy(*keys, "_bucket", "_value")
        .agg(F.sum("_weight").alias("_n"))
    )
    # 0-based ranks on both sides of the position (n - 1) * p of each fraction.
    names = list(fractions)
    position = {name: f"((_total - 1) * {float(fractions[name])!r}D)" for name in names}
    low = {name: f"floor({position[name]})" for name in names}
    high = {name: f"least({low[name]} + 1, _total - 1)" for name in names}
    ranks = [rank for name in names for rank in (low[name], high[name])]

    buckets = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
    placed = buckets.selectExpr(
        "*",
        f"coalesce(sum(_size) OVER (PARTITION BY {group} ORDER BY _bucket "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
        f"sum(_size) OVER (PARTITION BY {group}) AS _total",
    )
    # At most two buckets per fraction remain of each group.
    needed = placed.filter(" OR ".join(f"({rank} >= _before AND {rank} < _before + _size)" for rank in ranks))
    needed = needed.selectExpr(
        *[f"`{key}` AS _k{i}" for i, key in enumerate(keys)], "_bucket AS _kb", "_before", "_total"
    )
    same = " AND ".join([f"`{key}` <=> _k{i}" for i, key in enumerate(keys)] + ["_bucket = _kb"])
    ranked = counts.join(needed, F.expr(same)).selectExpr(
        *[f"`{key}`" for key in keys],
        "_value",
        "_n",
        "_total",
        f"_before + sum(_n) OVER (PARTITION BY {group}, _bucket ORDER BY _value "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _end",
    )

    def value_at(rank: str) -> str:
        return f"max(CASE WHEN {rank} < _end AND {rank} >= _end - _n THEN _value END) / 1e6D / 3600"

    picks = []
    for i, name in enumerate(names):
        picks += [F.expr(value_at(low[name])).alias(f"_low{i}"), F.expr(value_at(high[name])).alias(f"_high{i}")]
    found = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    results = [
        f"CASE WHEN {low[name]} = {high[name]} THEN _low{i} ELSE "
        f"_low{i} * ({high[name]} - {position[name]}) + _high{i} * ({position[name]} - {low[name]}) END AS `{name}`"
        for i, name in enumerate(names)
    ]
    return found.selectExpr(*[f"`{key}`" for key in keys], f"_total AS `{count}`", *results)
