"""Number text that rounds the exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 2**27 + 1


def decimals_sql(name: str, places: int) -> str:
    """SQL text of ``name`` with a fixed number of decimals (1 to 3), below 1e12.

    ``format_string`` rounds the shortest decimal text half up, so 0.125 would
    become 0.13. Here the product with the power of ten is kept exact as a sum
    ``high + low`` of doubles and its fraction is compared with one half.
    """
    step = 10**places
    size = f"abs({name})"
    upper = f"({size} * {_SPLITTER}D - ({size} * {_SPLITTER}D - {size}))"
    high = f"({size} * {step}D)"
    low = f"(({upper} * {step}D - {high}) + ({size} - {upper}) * {step}D)"
    whole = f"floor({high})"
    beyond_half = f"(({high} - {whole} - 0.5D) + {low})"
    up = f"({beyond_half} > 0 OR ({beyond_half} = 0 AND {whole} % 2 = 1))"
    units = f"({whole} + CASE WHEN {up} THEN 1 ELSE 0 END)"
    return (
        f"concat(CASE WHEN {name} < 0 THEN '-' ELSE '' END, {units} div {step}, '.', "
        f"lpad(cast({units} % {step} AS string), {places}, '0'))"
    )


def decimals(name: str, places: int) -> Column:
    """The column ``name`` as text, see ``decimals_sql``."""
    return F.expr(decimals_sql(name, places))
