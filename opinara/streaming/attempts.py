"""Durable state of a collection: an append-only log of attempts, folded to one row per query.

Every attempt (a batch of queries with one outcome) is a folder of its own, named by the caller; writing it again replaces
it, so a replayed attempt counts once.  Nothing is ever edited: a reset is one more record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ``completed``: reviews came; ``error``: the run failed or found no places; ``empty``: places without any review.
OUTCOMES = ("completed", "error", "empty", "reset")
RECORD = "seq long, query string, outcome string, batch int, places long, reviews long, error string, at timestamp"


def record_attempt(spark: SparkSession, log: str, name: str, seq: int, queries: Sequence[str], outcome: str,
                   batch: int | None = None, places: int | None = None, reviews: int | None = None,
                   error: str | None = None) -> None:
    """Write the attempt ``name``; ``seq`` orders attempts.  Counts are those of the whole batch, as no place tells its query."""
    if outcome not in OUTCOMES:
        raise ValueError(f"outcome must be one of {OUTCOMES}")
    rows = [(seq, q, outcome, batch, places, reviews, error) for q in queries]
    table = spark.createDataFrame(rows, RECORD.rpartition(",")[0]).withColumn("at", F.current_timestamp())
    table.coalesce(1).write.mode("overwrite").parquet(f"{log}/attempt={name}")


def record_reset(spark: SparkSession, log: str, name: str, seq: int) -> None:
    """Forget all attempts before ``seq``: the start of a new cycle."""
    record_attempt(spark, log, name, seq, [""], "reset")


def read_attempts(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(f"{RECORD}, attempt string").parquet(log)


def fold_attempts(attempts: DataFrame, every_failure: bool = False) -> DataFrame:
    """``query``, ``status``, ``attempts``, ``error``, ``batch``, ``places``, ``reviews`` of each query attempted since the last reset.

    A success clears the failures before it; a query that ever succeeded is ``completed``, with the batch, places and reviews of its
    last success, whatever came later.  Otherwise it is ``failed`` with its number of attempts and its last error.  An
    ``error`` counts as the first attempt, however many came before, and an ``empty`` one adds to the count, as the collector's
    own state does; with ``every_failure`` each failure adds one.  Attempts of one ``seq`` go by outcome.
    One shuffle by query; the last reset is a scalar.
    """
    last_reset = attempts.filter("outcome = 'reset'").agg(F.coalesce(F.max("seq"), F.lit(-(1 << 62)))).scalar()
    since = attempts.filter((F.col("seq") > last_reset) & (F.col("outcome") != "reset"))
    same = Window.partitionBy("query")
    order = F.struct("seq", "outcome")
    success = F.max(F.when(F.col("outcome") == "completed", order)).over(same)
    failure = F.max(F.when((F.col("outcome") == "error") & (success.isNull() | (order > success)), order)).over(same)
    marked = since.withColumns({"_success": success, "_failure": failure, "_order": order})
    open_ = F.col("_success").isNull() | (F.col("_order") > F.col("_success"))
    first = F.lit(every_failure) | F.col("_failure").isNull() | (F.col("_order") >= F.col("_failure"))
    counted = F.count(F.when((F.col("outcome") != "completed") & open_ & first, 1))
    done = F.max(F.when(F.col("outcome") == "completed", F.struct("seq", "batch", "places", "reviews")))
    error = F.max(F.when((F.col("_order") == F.col("_failure")), F.struct("seq", "error")))["error"]
    folded = marked.groupBy("query").agg(done.alias("done"), counted.cast("int").alias("attempts"), error.alias("error"))
    completed = F.col("done").isNotNull()
    return folded.select(
        "query", F.when(completed, "completed").otherwise("failed").alias("status"),
        F.when(~completed, F.col("attempts")).alias("attempts"), F.when(~completed, F.col("error")).alias("error"),
        "done.batch", "done.places", "done.reviews",
    )


def totals(attempts: DataFrame) -> DataFrame:
    """One row: places and reviews of all successes, each attempt once, resets notwithstanding."""
    batches = attempts.filter("outcome = 'completed'").groupBy("seq", "batch").agg(
        F.max("places").alias("places"), F.max("reviews").alias("reviews"))
    return batches.agg(F.coalesce(F.sum("places"), F.lit(0)).alias("total_places"),
                       F.coalesce(F.sum("reviews"), F.lit(0)).alias("total_reviews"))
