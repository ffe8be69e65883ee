"""Helpers the operators share: columns, sizes and staged tables."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.sources.staging import Staging

# What one task should hold, in bytes of text. Counts of groups follow from it, so
# a group's size does not grow with the input.
TASK_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staging(spark: SparkSession) -> Staging:
    """A fresh folder below ``spark.checkpoint.dir``."""
    return Staging(spark)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, null counting 0."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def groups_for(total: int, per_group: int) -> int:
    return max(1, -(-int(total) // per_group))


def crc_remainder(id_column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text modulo ``modulus``; of a null id, of the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def row_struct(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``row``, whatever their names."""
    return F.struct(*[F.col(f"`{name.replace('`', '``')}`") for name in docs.columns]).alias("row")


def numbered(docs: DataFrame, stage: Staging) -> DataFrame:
    """Every row as one struct ``row``, with a number ``key`` of its own and a hash ``content`` of all it holds.

    The table is written, so the numbers stay what they are when executors are lost.
    """
    rows = docs.select(row_struct(docs)).withColumns({
        "key": F.monotonically_increasing_id(), "content": F.xxhash64("row")
    })
    return stage.table("numbered", rows)


def release() -> None:
    """Hand this Python worker's freed memory back: workers live on, idle, while later stages need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
