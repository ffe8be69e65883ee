"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_SETTINGS = {
    # Instants are compared and rendered in UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Runtime re-planning; hot join keys are split even when the split costs
    # one more exchange, because an aggregate on the same key often follows.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sorted columns of few values take little room in files, so a side of a join
    # that looks small by its files can be too large for the driver. What is small by
    # its measured size is still broadcast at runtime.
    "spark.sql.sources.fileCompressionFactor": "100",
    # The JVM never compiles a method beyond 8,000 bytes of code. Wide payloads make such
    # methods when a stage is generated as one; cut into its operators it runs compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A common part of conditions, which may raise an error, is not worked out before
    # the conditions that come first.
    "spark.sql.subexpressionElimination.skipForShortcutExpr": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings above to a running session."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "mergelens") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MERGELENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables written between stages.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary folder, which is then recorded in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="mergelens-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path
