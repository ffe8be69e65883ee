"""Tables written once on shared storage and read by all later steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mergelens.session import shared_dir


class Staging:
    """A fresh folder for intermediate tables of one load.

    A step used by several later ones is written there, so it runs once, its
    lineage ends, and a lost executor costs no more than re-reading files. The
    folder lies below ``spark.checkpoint.dir`` and may be removed once the tables
    of the load are no longer read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/mergelens-staging/{uuid.uuid4().hex}"

    def table(self, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/{name}"
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def close(self) -> None:
        """Delete this folder and nothing else; its tables can no longer be read."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
