"""Session defaults and the shared folder for checkpoints and written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "opinara", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may fall back to a
    temporary folder; elsewhere a missing setting is an error, because a machine-local folder would
    lose data with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="opinara-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created or removed here."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder (or to ``path``), packed, and read it back; the shuffles behind it go with it.

    Words and terms repeat, so as Parquet they take a small part of the space of a checkpoint's rows.
    """
    path = path or scratch_path(df.sparkSession, label)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove what ``stored`` wrote to a scratch path, once nothing reads it any more."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files; otherwise these wait for the driver's garbage collection."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor cannot change the result."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
