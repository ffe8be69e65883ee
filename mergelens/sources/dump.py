"""Scans of raw dumps: JSON lines under ``<dump>/canonical``, declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelens.functions import fixed
from mergelens.sources import schemas

CORRUPT = "_corrupt_record"

LINE = "_line"  # number of a line in its table, which the sink writes into part files

_ORDER_TYPE = T.StructType(
    [
        T.StructField("line", T.LongType()),
        T.StructField("written", T.TimestampType()),
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("row", T.LongType()),
    ]
)


def line_order(file: str) -> Column:
    """Position of a line of the table ``file``.

    In part files it is the number in the line. In a plain file it is the place of the
    line: within a file split the row number of the scan task grows with the line
    number. Neither depends on names or times of files, so a copy of a dump has the
    same order. Part files of other writers, without numbers, come first, by time.
    """
    plain = F.col("_metadata.file_path").endswith(f"/{file}")
    line = F.when(~plain, F.col(LINE))
    parts = ~plain & line.isNull()
    return F.struct(
        line.alias("line"),
        F.when(parts, F.col("_metadata.file_modification_time")).alias("written"),
        F.when(parts, F.col("_metadata.file_name")).alias("file"),
        F.when(line.isNull(), F.col("_metadata.file_block_start")).alias("block"),
        F.when(line.isNull(), F.monotonically_increasing_id()).alias("row"),
    )


def dump_root(part: str) -> Column:
    """Full path of the dump whose ``part`` a file is, or lies in; it identifies the dump."""
    # Told from the end of the path, without a search by pattern in each row.
    path, part = F.col("_metadata.file_path"), f"/{part}"
    tail = F.substring_index(path, part, -1)
    return F.substring(path, F.lit(1), F.length(path) - F.length(tail) - F.lit(len(part)))


def scan(spark: SparkSession, root: str, table: str, on_error: str = "fail") -> DataFrame:
    """One raw table of the dump at ``root``, or of all dumps matching a pattern.

    Adds ``dump_id`` and ``line_ord``. An absent table is empty. A line that is
    not JSON fails the query, or with ``on_error="quarantine"`` is kept in
    ``_corrupt_record``.
    """
    schema = T.StructType(schemas.RAW[table].fields + [T.StructField(CORRUPT, T.StringType())])
    mode = "PERMISSIVE" if on_error == "quarantine" else "FAILFAST"
    path = f"{root.rstrip('/')}/{fixed.CANONICAL_DIR}/{fixed.TABLE_FILES[table]}"
    numbered = T.StructType([*schema.fields, T.StructField(LINE, T.LongType())])
    reader = spark.read.schema(numbered).option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT)
    folder = dump_root(f"{fixed.CANONICAL_DIR}/{fixed.TABLE_FILES[table]}")
    try:
        lines = reader.json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = T.StructType(
            schema.fields
            + [T.StructField("dump_id", T.StringType()), T.StructField("line_ord", _ORDER_TYPE)]
        )
        return spark.createDataFrame([], empty)
    return lines.select(*schema.fieldNames(), folder.alias("dump_id"), line_order(fixed.TABLE_FILES[table]).alias("line_ord"))


def scan_all(spark: SparkSession, root: str, on_error: str = "fail") -> dict[str, DataFrame]:
    return {table: scan(spark, root, table, on_error) for table in schemas.RAW}
