"""The manifest of a dump: who it is about, which window, which provider."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.functions import fixed
from mergelens.functions.times import parse_iso
from mergelens.sources import schemas
from mergelens.sources.dump import dump_root

_REQUIRED = ("user", "from", "to")


class ManifestError(Exception):
    """The manifest is missing, not JSON, or names no provider."""

    def __init__(self, message: str, path: str | None = None):
        super().__init__(message)
        self.path = path


@dataclass(frozen=True)
class Manifest:
    """Manifest of one dump, read as parameters of its load."""

    dump_id: str
    provider: str
    fields: dict

    def frame(self, spark: SparkSession) -> DataFrame:
        """The manifest as a one-row table, typed like ``read_manifests``."""
        record = json.dumps(self.fields)
        parsed = spark.range(1).select(
            F.lit(self.dump_id).alias("dump_id"),
            F.from_json(F.lit(record), schemas.MANIFEST).alias("m"),
        )
        return _typed(parsed.select("dump_id", "m.*"))


def _typed(raw: DataFrame) -> DataFrame:
    return raw.select(
        "dump_id",
        "provider",
        "api_version",
        F.col("user").alias("user_login"),
        parse_iso(F.col("from")).alias("start_date"),
        parse_iso(F.col("to")).alias("end_date"),
        "repositories",
        parse_iso(F.col("generated_at")).alias("generated_at"),
        "notes",
    )


def read_manifest(spark: SparkSession, root: str) -> Manifest:
    """Manifest of the dump at ``root``; one small file, read as a whole."""
    path = f"{root.rstrip('/')}/{fixed.MANIFEST_FILE}"
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ManifestError(f"no manifest at {path}", path) from None
    try:
        fields = json.loads(text.value if text else "")
    except json.JSONDecodeError as error:
        raise ManifestError(f"manifest is not JSON: {error}", path) from error
    if not isinstance(fields, dict):
        raise ManifestError("manifest is not a JSON object", path)
    if not fields.get("provider"):
        raise ManifestError("manifest names no provider", path)
    if fields["provider"] not in fixed.PROVIDERS:
        raise ValueError(f"Unsupported provider: {fields['provider']}")
    for name in _REQUIRED:
        if name not in fields:
            raise KeyError(name)
    for name in ("from", "to"):
        try:
            datetime.fromisoformat(str(fields[name]))
        except ValueError as error:
            raise ManifestError(f"manifest has no readable window: {error}", path) from error
    return Manifest(root.rstrip("/"), fields["provider"], fields)


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """Manifests of all dumps matching a path pattern, one row each.

    The full path of a dump is its ``dump_id``. A manifest that lacks a required
    field, names an unknown provider or has no readable window fails the query
    that reads it.
    """
    raw = (
        spark.read.schema(schemas.MANIFEST)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(f"{pattern.rstrip('/')}/{fixed.MANIFEST_FILE}")
    )
    usable = F.col("provider").isin(*fixed.PROVIDERS)
    for name in _REQUIRED:
        usable = usable & F.col(name).isNotNull()
    usable = usable & parse_iso(F.col("from")).isNotNull() & parse_iso(F.col("to")).isNotNull()
    message = F.concat(F.lit("unusable manifest: "), F.col("_metadata.file_path"))
    checked = raw.filter(
        F.when(F.coalesce(usable, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean"))
    )
    return _typed(checked.withColumn("dump_id", dump_root(fixed.MANIFEST_FILE)))
