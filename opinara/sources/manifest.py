"""Manifests of runs and batches: what a folder holds, without opening the data.

Each write publishes one small entry beside the folder (``<folder>.manifest``): its name, files, schema, number of rows and time.  An
entry shows by one rename after its data are complete, so a reader sees a whole write or none of it.  Readers take the names of
files and columns from entries alone: they neither list the folder nor open a footer before the scan, and a file
of a failed write, or one that came by another way, is not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "name string, files array<string>, rows long, schema string, published timestamp"


def _location(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def _data_files(spark: SparkSession, path: str) -> set[str]:
    """Data files directly in ``path``."""
    location, files = _location(spark, path)
    if not files.exists(location):
        return set()
    paths = [s.getPath() for s in files.listStatus(location) if s.isFile()]
    return {p.toString() for p in paths if not p.getName().startswith(("_", "."))}


def publish(spark: SparkSession, folder: str, name: str, files: Sequence[str], rows: int, schema: T.StructType) -> None:
    """Make an entry visible; of several entries of one name all count, the last published being the newest."""
    entry = spark.createDataFrame([(name, sorted(files), rows, schema.json())], ENTRY.rpartition(",")[0])
    building = f"{folder}.manifest.building/{uuid.uuid4().hex}"
    entry.withColumn("published", F.current_timestamp()).coalesce(1).write.parquet(building)
    manifest, there = _location(spark, f"{folder}.manifest")
    there.mkdirs(manifest)
    source, _ = _location(spark, building)
    target, _ = _location(spark, f"{folder}.manifest/entry-{uuid.uuid4().hex}")
    if not there.rename(source, target):
        raise OSError(f"the entry of {name} could not be published")


def write_listed(df: DataFrame, folder: str, path: str, name: str) -> None:
    """Append ``df`` as files in ``path`` and publish them under ``name`` in the manifest of ``folder``; rows are counted as they pass."""
    spark = df.sparkSession
    before = _data_files(spark, path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    publish(spark, folder, name, sorted(_data_files(spark, path) - before), seen.get["rows"], df.schema)


def entries(spark: SparkSession, folder: str) -> DataFrame | None:
    """The manifest of ``folder``, a row for each write; ``None`` if it has none."""
    location, files = _location(spark, f"{folder}.manifest")
    if not files.exists(location):
        return None
    return spark.read.schema(ENTRY).parquet(f"{folder}.manifest/*")


def merged_schema(schemas: Sequence[T.StructType]) -> T.StructType:
    """All columns of the given schemas, by first appearance; a column of two types is an error."""
    fields: dict[str, T.StructField] = {}
    for schema in schemas:
        for field in schema.fields:
            known = fields.setdefault(field.name, T.StructField(field.name, field.dataType, True))
            if known.dataType != field.dataType:
                raise ValueError(f"{field.name} is {known.dataType.simpleString()} and {field.dataType.simpleString()}")
    return T.StructType(list(fields.values()))


def scan(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """All rows of the given entries; a column that a file lacks is NULL there.

    The driver holds the entries: one row for each write, with the names of its files.
    """
    rows = listed.select("files", "schema").collect()
    schema = merged_schema([T.StructType.fromJson(json.loads(r["schema"])) for r in rows])
    files = [f for r in rows for f in r["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)

