"""Collection growth, coverage and trends (measures that documents describe; the definitions are ours)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara.functions.numbers import exact_mean, half_even, percent, share_of
from opinara.operators.ranking import running_total


def batch_yield(reviews: DataFrame) -> DataFrame:
    """Per batch: delivered and first-seen reviews, and the running total of the latter.

    A review's identity is a SHA-256 digest of place and text, so the shuffle carries no texts.
    """
    identity = F.sha2(F.to_json(F.struct("place_id", "review_text")), 256)
    first_seen = reviews.select("batch", identity.alias("identity")).groupBy("identity").agg(
        F.min("batch").alias("batch")
    )
    fresh = first_seen.groupBy("batch").agg(F.count(F.lit(1)).alias("new_reviews"))
    delivered = reviews.groupBy("batch").agg(F.count(F.lit(1)).alias("delivered"))
    per_batch = delivered.join(fresh, "batch", "left").select(
        "batch", "delivered", F.coalesce("new_reviews", F.lit(0)).alias("new_reviews")
    )
    return running_total(
        per_batch, F.coalesce("batch", F.lit(float("-inf"))), [F.col("batch")], F.col("new_reviews"), "cumulative_reviews")


def capture_per_place(places: DataFrame, reviews: DataFrame) -> DataFrame:
    """Collected over claimed reviews per place, in percent (NULL when nothing is claimed)."""
    collected = reviews.groupBy("place_name").agg(F.count(F.lit(1)).alias("collected"))
    claimed = places.select(F.col("title").alias("place_name"), F.col("review_count").alias("claimed"))
    joined = claimed.join(collected, "place_name", "left").withColumn(
        "collected", F.coalesce("collected", F.lit(0))
    )
    return joined.withColumn("capture_pct", percent(F.col("collected"), F.col("claimed")))


def capture_rate(places: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: mean capture over the places that claim any review."""
    return capture_per_place(places, reviews).agg(
        F.count("capture_pct").alias("places"),
        half_even(exact_mean(F.col("capture_pct")), 2).alias("avg_capture_pct"),
    )


def thin_places(places: DataFrame, reviews: DataFrame, fewer_than: int = 10) -> DataFrame:
    """Places with fewer than ``fewer_than`` collected reviews."""
    per_place = capture_per_place(places, reviews)
    return per_place.filter(F.col("collected") < fewer_than).select(
        "place_name", "collected", F.when(F.col("collected") == 0, "none").otherwise("few").alias("coverage")
    )


def with_empty_months(monthly: DataFrame, key: str = "place_name") -> DataFrame:
    """One row for each month from a place's first to its last; months without rows have nulls in the other columns.

    Every month carries the gap behind it, so a place is neither collected nor joined with a calendar.
    """
    following = F.lead("month").over(W.partitionBy(key).orderBy("month"))
    gap = F.when(F.col("_next").isNull(), F.array("month")).otherwise(
        F.expr("sequence(month, add_months(_next, -1), interval 1 month)"))
    spread = monthly.withColumn("_next", following).withColumn("_month", F.explode(gap))
    given = F.col("_month") == F.col("month")
    return spread.select(*(
        F.col("_month").alias(c) if c == "month" else F.col(c) if c == key else F.when(given, F.col(c)).alias(c)
        for c in monthly.columns))


def sentiment_trend(df: DataFrame) -> DataFrame:
    """Per place and month: shares and score, and the change of the positive share to the month before.

    The calendar has no gaps: a month without reviews is a row of 0 reviews without shares, so the change is always that
    to the calendar month before, and NULL where either month has no rated review.  Reviews without a date are in no
    month and go.  The windows run over one row per place and month.
    """
    monthly = df.filter(F.col("place_name").isNotNull() & F.col("review_ts").isNotNull()).groupBy(
        "place_name", F.date_trunc("month", "review_ts").cast("date").alias("month")
    ).agg(
        F.count("sentiment").alias("reviews"),
        half_even(share_of(F.col("sentiment") == "positive"), 2).alias("positive_pct"),
        half_even(share_of(F.col("sentiment") == "negative"), 2).alias("negative_pct"),
        half_even(exact_mean(F.col("sentiment_score")), 3).alias("avg_sentiment_score"),
    )
    filled = with_empty_months(monthly).withColumn("reviews", F.coalesce("reviews", F.lit(0)))
    before = F.lag("positive_pct").over(W.partitionBy("place_name").orderBy("month"))
    return filled.withColumn("positive_change", half_even(F.col("positive_pct") - before, 2))


def area_rollup(df: DataFrame) -> DataFrame:
    """Reviews and places per area, with a grand total row."""
    return df.rollup("area").agg(
        F.grouping("area").cast("int").alias("is_total"),
        F.count(F.lit(1)).alias("reviews"), F.countDistinct("place_name").alias("places"),
    )
