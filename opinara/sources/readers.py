"""Scans of raw places, review batches, analysed runs and query lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import schemas
from opinara.functions.text import not_blank, strip
from opinara.sources import manifest


def typed_places(raw: DataFrame) -> DataFrame:
    """Declared types from text columns; a number that is none becomes NULL."""
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schemas.RAW_PLACES.fields))


def array_files(spark: SparkSession, path: str) -> list[str]:
    """Files below ``path`` whose text begins with ``[``, as the first non-blank line says."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.monotonically_increasing_id().alias("line")).filter(not_blank(F.col("value")))
    heads = lines.groupBy("file").agg(F.min(F.struct("line", F.substring(strip(F.col("value")), 1, 1).alias("head")))["head"]
                                      .alias("head"))
    return [row.file for row in heads.filter(F.col("head") == "[").select("file").collect()]


def read_places(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """Raw places from JSON lines or from JSON arrays on one line or many, told apart file by file.

    Telling them apart reads the text once more and lists the files; a caller who knows that all files are ``lines`` or
    ``arrays`` names the ``form``, and nothing is read but the places.
    A malformed line or file is an error, as the loss of its places would go unseen.  ``place_seq`` keeps the read order
    within a file.
    """
    if form not in (None, "lines", "arrays"):
        raise ValueError(f"unknown form {form!r}; use 'lines' or 'arrays'")
    arrays = array_files(spark, path) if form is None else []
    reader = spark.read.schema(schemas.RAW_PLACES_TEXT).option("mode", "FAILFAST")
    if not arrays:
        places = reader.option("multiLine", form == "arrays").json(path)
    else:
        listed = spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).distinct().collect()
        lines = [row.file for row in listed if row.file not in set(arrays)]
        places = reader.option("multiLine", True).json(arrays)
        if lines:
            places = places.unionByName(reader.option("multiLine", False).json(lines))
    return typed_places(places).withColumn("place_seq", F.monotonically_increasing_id())


def review_identity() -> Column:
    """A stable number for a review: a digest of its place and text."""
    return F.xxhash64("place_id", "review_text")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Flat reviews with their declared schema and a ``review_id``; a missing path is an error.

    The id is a digest of place and text, the identity by which reviews are merged, so it is the same in every run.
    """
    return spark.read.schema(schemas.REVIEWS).parquet(path).withColumn("review_id", review_identity())


def _batch_scan(spark: SparkSession, path: str, skip_corrupt: bool) -> DataFrame:
    return spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", skip_corrupt).parquet(path)


def read_batches(spark: SparkSession, path: str, *, skip_corrupt: bool = False) -> DataFrame:
    """All review batches of a glob in one scan.

    Columns are merged over the files, and the batch number comes from the file path, so that a later dedupe has an
    explicit order.  An unreadable file is an error unless ``skip_corrupt``; ``skipped_files`` then names it.
    """
    raw = _batch_scan(spark, path, skip_corrupt).select("*", F.col("_metadata.file_path").alias("_path"))
    number = F.regexp_extract("_path", r"batch_(\d+)_", 1)
    return raw.withColumn("batch", number.cast("int")).drop("_path")


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the files that give no row when unreadable files are skipped."""
    there = spark.read.format("binaryFile").load(path).select("path")
    read = _batch_scan(spark, path, True).select(F.col("_metadata.file_path").alias("path")).distinct()
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    return there.withColumn("key", plain).join(read.select(plain.alias("key")), "key", "left_anti").select("path")


def read_coordinates(spark: SparkSession, path: str, *, skip_corrupt: bool = False) -> DataFrame:
    """The place columns that exist over all parsed batches, one schema."""
    raw = _batch_scan(spark, path, skip_corrupt)
    present = [c for c in schemas.PLACE_COLUMNS if c in raw.columns]
    return raw.select(*present)


def read_listed_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All batches that ``writers.write_batch`` listed below ``folder``, with their number; see ``read_batches``.

    Columns and files are those of the manifest: no footer is opened to find them.
    """
    listed = manifest.entries(spark, folder)
    if listed is None:
        raise FileNotFoundError(f"no manifest of {folder}")
    raw = manifest.scan(spark, listed).select("*", F.col("_metadata.file_path").alias("_path"))
    return raw.withColumn("batch", F.regexp_extract("_path", r"batch_(\d+)_", 1).cast("int")).drop("_path")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Only the rows of the most recently published run below ``path``, with its ``run_id``.

    The manifest names the run's files, so nothing of other runs is listed or opened.  A folder without a manifest is
    searched for its most recently modified run instead, by file metadata.
    """
    listed = manifest.entries(spark, path)
    if listed is not None:
        name = listed.orderBy(F.desc("published"), F.desc("name")).first()["name"]
        return manifest.scan(spark, listed.filter(F.col("name") == name)).withColumn("run_id", F.lit(name))
    runs = spark.read.parquet(path)
    newest = runs.select("run_id", F.col("_metadata.file_modification_time").alias("modified")).agg(
        F.max(F.struct("modified", "run_id"))["run_id"].alias("run_id")
    )
    return runs.filter(F.col("run_id") == newest.scalar())


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Search queries, one per line: stripped of white space, without blank lines and lines that start with ``#``."""
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("#")))
    stripped = lines.select(strip(F.col("value")).alias("query"), F.monotonically_increasing_id().alias("position"))
    return stripped.filter(F.col("query") != "")


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that Spark's file system can see."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        location = jvm.org.apache.hadoop.fs.Path(path)
        if location.getFileSystem(conf).exists(location):
            return path
    return None
