"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opinara import schemas
from opinara.operators.extract import dedupe_by_prefix, explode_reviews
from opinara.sources.readers import typed_places
from opinara.streaming import attempts, history

#: Micro-batches between two looks at the size of the history.
COMPACT_EVERY = 16


def place_stream(spark: SparkSession, landing: str, *, files_per_batch: int | None = None) -> DataFrame:
    """Raw place records as they land (JSON lines, or arrays on one line); a malformed line is an error."""
    reader = spark.readStream.schema(schemas.RAW_PLACES_TEXT).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return typed_places(reader.json(landing))


def extract_stream(places: DataFrame) -> DataFrame:
    """Flat reviews of a place stream (stateless; deduplication happens at the sink)."""
    # A row counter does not exist in a stream, so a place's own id orders it.
    return explode_reviews(places, [F.lit(0).cast("long")]).drop("place_seq")


def start_extract(places: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Write the extracted reviews of everything that has landed, then stop."""
    return (
        extract_stream(places).writeStream.format("parquet").outputMode("append")
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _run(stream: DataFrame, checkpoint: str, step) -> StreamingQuery:
    """Hand every micro-batch to ``step``, kept for as long as it is read, until nothing is left to read."""
    def process(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            step(batch, epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_merge(reviews: DataFrame, sink: str, checkpoint: str, order_by: list[str],
                target_rows: int = history.TARGET_ROWS, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Merge a review stream into the deduplicated history at ``sink`` until nothing is left to read.

    Every ``compact_every`` micro-batches the history is looked over and, if it has outgrown its buckets, rewritten.
    """
    def merge(batch: DataFrame, epoch: int) -> None:
        history.merge_batch(batch, sink, order_by)
        if epoch % compact_every == compact_every - 1:
            history.compact(batch.sparkSession, sink, target_rows)

    return _run(reviews, checkpoint, merge)


def start_ingest(places: DataFrame, sink: str, log: str, checkpoint: str, run: str, queries: Sequence[str],
                 target_rows: int = history.TARGET_ROWS, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Places in, deduplicated reviews and attempts out: extraction, merge and state in one stream.

    A micro-batch is one attempt at ``queries``: its reviews are flattened, deduplicated by prefix and merged into the history
    at ``sink``, then its outcome, places and reviews are recorded in ``log`` under the run and the epoch of the merge.  A batch
    that fails half-way is replayed: reviews already merged are not added again and its record is replaced.  A batch
    without places is an error, one without reviews is empty.  ``run`` names the checkpoint's run.
    """
    columns = [c for c in schemas.REVIEW_COLUMNS]

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = explode_reviews(batch, [F.lit(0).cast("long")])
        reviews = dedupe_by_prefix(rows, ["pos", "review_text", "reviewer_name"]).select(*columns, "pos").persist()
        try:
            n_places = batch.agg(F.countDistinct("title")).first()[0]
            n_reviews = reviews.count()
            if n_reviews:
                history.merge_batch(reviews, sink, ["pos", "review_text", "reviewer_name"])
            outcome = "completed" if n_reviews else "empty" if n_places else "error"
            attempts.record_attempt(
                spark, log, f"{run}-{epoch:08d}", epoch, queries, outcome, batch=epoch, places=n_places, reviews=n_reviews,
                error=None if n_places else "No results returned")
        finally:
            reviews.unpersist()
        if epoch % compact_every == compact_every - 1:
            history.compact(spark, sink, target_rows)

    return _run(places, checkpoint, step)


def start_status(reviews: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Record per micro-batch how many places and reviews arrived, next to the stream's own progress.

    Every epoch writes its own folder, so a replayed epoch replaces its record.
    """
    def record(batch: DataFrame, epoch: int) -> None:
        counts = batch.groupBy("batch").agg(
            F.countDistinct("place_name").alias("places"), F.count(F.lit(1)).alias("reviews")
        )
        counts.withColumn("status", F.lit("completed")).write.mode("overwrite").parquet(f"{output}/epoch={epoch}")

    return (
        reviews.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def running_batch_totals(reviews: DataFrame) -> DataFrame:
    """Running review count per batch of a review stream (update mode)."""
    return reviews.groupBy("batch").agg(F.count(F.lit(1)).alias("reviews"))
