"""Session settings that the engine's results depend on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "sievework", **conf: str) -> SparkSession:
    """A session with UTC, ANSI mode and adaptive execution; conf overrides, with dots written as in Spark."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def healthy(spark: SparkSession) -> dict[str, str]:
    """{"status": "ok"} if the session answers."""
    return {"status": "ok" if spark.range(1).count() == 1 else "failed"}


def work_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder that the driver and all executors see: under spark.checkpoint.dir, or a local one where all is one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="sievework-")
    return f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever storage its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
