"""Execution records as JSON files, and their scan."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUN_SCHEMA = "success boolean, stdout string, stderr string, returncode int, duration_seconds double, error_message string, script_path string"


def write_record(record: dict, path: str | Path) -> None:
    """One record, indented, characters not escaped; folders are made."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(record, indent=2, ensure_ascii=False), encoding="utf-8")


def append_record(spark: SparkSession, record: dict, folder: str) -> None:
    """One record as one more file of a folder in storage that all machines see."""
    names = [field.split()[0] for field in RUN_SCHEMA.split(", ")]
    spark.createDataFrame([tuple(record.get(n) for n in names)], RUN_SCHEMA).coalesce(1).write.mode("append").json(folder)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path, multiLine=True)
