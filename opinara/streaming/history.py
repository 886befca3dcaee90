"""The deduplicated review history: a table that grows by micro-batches and reads a bounded share of itself for each.

Reviews lie in buckets by a hash of their place.  All buckets of the table are of one generation, a folder named by its number and
depth (``2 ** depth`` buckets).  A micro-batch lists and reads only the buckets of its own places, and there only the
digest column.  When the mean bucket holds more than ``target_rows`` reviews, or files have piled up, ``compact`` rewrites the
table as the next generation: deeper where it has grown, one file a bucket (a large one is cut), sorted by digest.  A generation
shows by one rename, after it is complete; a crash before that leaves the old one in use.
"""

from __future__ import annotations

import re
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions.text import not_blank
from opinara.operators.ranking import keep_first

#: Mean reviews of a bucket before the buckets are cut in two.
TARGET_ROWS = 1_000_000
#: Mean files of a bucket before they are joined.
MOST_FILES = 16
#: Reviews that one task writes.
FILE_ROWS = 131_072
_NAME = re.compile(r"generation=(\d{8})-(\d{2})")


class Generation(NamedTuple):
    """A generation's number, the power of two of its buckets, and its folder."""

    number: int
    depth: int
    path: str


def _files(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, sink: str) -> Generation | None:
    """The newest complete generation below ``sink``; a handful of folders is listed."""
    location, files = _files(spark, sink)
    if not files.exists(location):
        return None
    found = [(m, s) for s in files.listStatus(location) if (m := _NAME.fullmatch(s.getPath().getName()))]
    generations = [Generation(int(m[1]), int(m[2]), s.getPath().toString()) for m, s in found]
    return max(generations, default=None)


def with_identity(reviews: DataFrame, depth: int = 0) -> DataFrame:
    """Add the digest that identifies a review, and the bucket of its place among ``2 ** depth``."""
    return reviews.withColumn(
        "identity", F.sha2(F.to_json(F.struct("place_id", "review_text")), 256)
    ).withColumn("bucket", F.pmod(F.xxhash64("place_id"), F.lit(1 << depth)).cast("long"))


def read_history(spark: SparkSession, sink: str) -> DataFrame:
    """The reviews of the current generation (an error if there is none)."""
    generation = current(spark, sink)
    if generation is None:
        raise FileNotFoundError(f"no history at {sink}")
    return spark.read.parquet(generation.path).drop("identity", "bucket")


def held_digests(spark: SparkSession, generation: Generation, buckets: list[int]) -> DataFrame | None:
    """Digests of the given buckets; other buckets are neither listed nor read.  ``None`` if they hold nothing yet."""
    paths = []
    for bucket in buckets:
        path = f"{generation.path}/bucket={bucket}"
        location, files = _files(spark, path)
        if files.exists(location):
            paths.append(path)
    return spark.read.parquet(*paths).select("identity") if paths else None


def _dealt(reviews: DataFrame, rows: int) -> DataFrame:
    """Reviews in order of bucket and digest, at most about ``FILE_ROWS`` a task, however many a bucket or place has."""
    return reviews.repartitionByRange(max(1, -(-rows // FILE_ROWS)), "bucket", "identity")


def merge_batch(batch: DataFrame, sink: str, order_by: list[str], depth: int = 0) -> None:
    """Append the reviews of a micro-batch that the history does not hold yet.

    Blank texts go (a NULL text stays).  Of copies within a batch the first by ``order_by`` is kept; a copy that came in an
    earlier batch stays.  The digest decides, so replaying a batch adds nothing.  The driver holds one number for each
    bucket of the batch's places.  The join is by digest, so a place with much of the history does not slow one task.
    ``depth`` is that of a new history.
    """
    spark = batch.sparkSession
    generation = current(spark, sink) or Generation(0, depth, f"{sink}/generation=00000000-{depth:02d}")
    kept = with_identity(batch.filter(F.coalesce(not_blank(F.col("review_text")), F.lit(True))), generation.depth)
    fresh = keep_first(kept, ["identity"], order_by)
    counted = {row.bucket: row["count"] for row in kept.groupBy("bucket").count().collect()}
    if not counted:
        return
    held = held_digests(spark, generation, sorted(counted))
    if held is not None:
        fresh = fresh.join(held, "identity", "left_anti")
    # A micro-batch adds one file to each touched bucket, or more where that would be more than a task should hold.
    _dealt(fresh, sum(counted.values())).write.mode("append").partitionBy("bucket").parquet(generation.path)


def compact(spark: SparkSession, sink: str, target_rows: int = TARGET_ROWS, most_files: int = MOST_FILES,
            force: bool = False) -> bool:
    """Rewrite the history as its next generation if it has outgrown this one; whether it did.

    Each rewrite for growth at least doubles the buckets, so a review is moved a logarithmic number of times.  Of equal
    digests (none, unless two writers ran at once) one stays.  The generation before last is removed; the last stays for its
    readers.  Not to be run while a batch is being merged.
    """
    generation = current(spark, sink)
    if generation is None:
        return False
    table = spark.read.parquet(generation.path)
    buckets = 1 << generation.depth
    rows = table.count()
    location, files = _files(spark, generation.path)
    n_files = files.getContentSummary(location).getFileCount()
    if not force and rows <= target_rows * buckets and n_files <= most_files * buckets:
        return False
    depth = generation.depth
    while rows > target_rows << depth:
        depth += 1
    number = generation.number + 1
    building = f"{sink}/building-{uuid.uuid4().hex}"
    moved = with_identity(table.drop("identity", "bucket"), depth).dropDuplicates(["identity"])
    _dealt(moved, rows).sortWithinPartitions("bucket", "identity").write.partitionBy("bucket").parquet(building)
    source, files = _files(spark, building)
    target, _ = _files(spark, f"{sink}/generation={number:08d}-{depth:02d}")
    if not files.rename(source, target):
        raise OSError(f"{target} could not be published")
    for status in files.listStatus(_files(spark, sink)[0]):
        old = _NAME.fullmatch(status.getPath().getName())
        if old and int(old[1]) < generation.number:
            files.delete(status.getPath(), True)
    return True
