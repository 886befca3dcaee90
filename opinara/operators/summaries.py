"""Global and per-place aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import labels
from opinara.functions.numbers import exact_mean, from_micro, half_even, micro_sum, percent, share_of, whole_mean
from opinara.lexicons import SENTIMENTS
from opinara.operators.ranking import exact_median


def _is(sentiment: str) -> Column:
    return F.col("sentiment") == sentiment


def _by_place(df: DataFrame):
    """Group by place; rows without a place belong to none."""
    return df.filter(F.col("place_name").isNotNull()).groupBy("place_name")


def review_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.countDistinct("place_name").alias("total_places"),
        half_even(exact_mean(F.col("review_rating")), 2).alias("avg_rating"),
        half_even(whole_mean(F.col("word_count")), 1).alias("avg_word_count"),
    )


def rating_distribution(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("review_rating").isNotNull()).groupBy("review_rating")
        .agg(F.count(F.lit(1)).alias("reviews")).orderBy("review_rating")
    )


def places_ranked(df: DataFrame) -> DataFrame:
    return _by_place(df).agg(
        F.count("review_text").alias("reviews"), exact_mean(F.col("review_rating")).alias("avg_rating")
    ).orderBy(F.desc("reviews"), "place_name")


def _sentiment_measures() -> list[Column]:
    return [
        F.count("sentiment").alias("total_reviews"),
        *[half_even(share_of(_is(s)), 2).alias(f"{s}_pct") for s in SENTIMENTS],
        half_even(exact_mean(F.col("sentiment_score")), 2).alias("avg_sentiment_score"),
        half_even(exact_mean(F.col("review_rating")), 2).alias("avg_review_rating"),
    ]


def sentiment_summary(df: DataFrame) -> DataFrame:
    """Per place: review count, sentiment shares, mean score and rating; best first."""
    return _by_place(df).agg(*_sentiment_measures()).orderBy(F.desc("positive_pct"), "place_name")


def compare_sentiment(df: DataFrame) -> DataFrame:
    """``sentiment_summary`` plus the label mean and the health score of the rounded shares."""
    base = _by_place(df).agg(
        *_sentiment_measures(),
        half_even(whole_mean(F.col("sentiment_label_num")), 2).alias("sentiment_label_avg"),
    )
    health = F.col("positive_pct") * 0.6 + (100 - F.col("negative_pct")) * 0.4
    return base.withColumn("sentiment_health_score", half_even(health, 1)).orderBy(
        F.desc("sentiment_health_score"), "place_name"
    )


def sentiment_share(df: DataFrame) -> DataFrame:
    """Share of each label among labelled reviews (at most one row per label)."""
    counts = df.agg(
        F.count("sentiment").alias("_all"),
        F.array(*[
            F.struct(F.lit(s).alias("sentiment"), F.count(F.when(_is(s), 1)).alias("reviews")) for s in SENTIMENTS
        ]).alias("_labels"),
    )
    rows = counts.select("_all", F.inline("_labels")).filter("reviews > 0")
    return rows.select("sentiment", "reviews", half_even(percent(F.col("reviews"), F.col("_all")), 4).alias("pct"))


def _label_shares(df: DataFrame, key: str) -> DataFrame:
    """Row percentages of the three fixed labels; keys without a labelled review are absent."""
    grouped = df.filter(F.col(key).isNotNull() & F.col("sentiment").isNotNull()).groupBy(key)
    return grouped.agg(*[half_even(share_of(_is(s)), 4).alias(s) for s in SENTIMENTS])


def rating_sentiment(df: DataFrame) -> DataFrame:
    return _label_shares(df, "review_rating").orderBy("review_rating")


def place_sentiment(df: DataFrame) -> DataFrame:
    return _label_shares(df, "place_name")


def place_sentiment_top(df: DataFrame, n: int = 20) -> DataFrame:
    return place_sentiment(df).orderBy(F.desc("positive"), "place_name").limit(n)


def rating_by_place(df: DataFrame) -> DataFrame:
    return _by_place(df).agg(
        half_even(exact_mean(F.col("review_rating")), 2).alias("mean"),
        F.count("review_rating").alias("count"),
    )


def net_health(df: DataFrame) -> DataFrame:
    """Positive minus negative share per place."""
    net = share_of(_is("positive")) - share_of(_is("negative"))
    return _by_place(df).agg(half_even(net, 1).alias("health_score")).orderBy(F.desc("health_score"), "place_name")


def overall_health(df: DataFrame) -> DataFrame:
    """One row: overall shares, net health and its label."""
    shares = df.agg(
        share_of(_is("positive")).alias("positive_pct"), share_of(_is("negative")).alias("negative_pct")
    )
    net = F.col("positive_pct") - F.col("negative_pct")
    return shares.select(
        half_even(F.col("positive_pct"), 1).alias("positive_pct"),
        half_even(F.col("negative_pct"), 1).alias("negative_pct"),
        half_even(net, 1).alias("health"),
        labels.health_label(net).alias("health_label"),
    )


def alert_level(df: DataFrame, benchmark: float = 60.0) -> DataFrame:
    """One row: alert level of the labelled negative share, and whether positives pass the benchmark."""
    positive = percent(F.count(F.when(_is("positive"), 1)), F.count("sentiment"))
    negative = percent(F.count(F.when(_is("negative"), 1)), F.count("sentiment"))
    shares = df.agg(positive.alias("p"), negative.alias("n"))
    return shares.select(
        half_even(F.col("p"), 1).alias("positive_pct"),
        half_even(F.col("n"), 1).alias("negative_pct"),
        labels.alert_level(F.col("n")).alias("alert_level"),
        (F.col("p") > benchmark).alias("above_benchmark"),
    )


def dataset_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.countDistinct("place_name").alias("places"),
        half_even(exact_mean(F.col("review_rating")), 2).alias("avg_rating"),
    )


def top_places(df: DataFrame, n: int = 10) -> DataFrame:
    counts = _by_place(df).agg(F.count(F.lit(1)).alias("reviews"))
    return counts.orderBy(F.desc("reviews"), "place_name").limit(n)


def top_places_by_volume(df: DataFrame, n: int = 15) -> DataFrame:
    volume = _by_place(df).agg(
        F.count("review_text").alias("reviews"), half_even(exact_mean(F.col("review_rating")), 2).alias("rating")
    )
    return volume.orderBy(F.desc("reviews"), "place_name").limit(n)


def batch_stats(df: DataFrame) -> DataFrame:
    """Raw counters per batch (reviews delivered twice count twice)."""
    return df.groupBy("batch").agg(
        F.countDistinct("place_name").alias("places"), F.count(F.lit(1)).alias("reviews")
    )


def query_progress(status: DataFrame) -> DataFrame:
    """Counts of distinct queries per status."""
    return status.groupBy("status").agg(F.countDistinct("query").alias("queries"))


def places_summary(df: DataFrame, order_by: str = "review_id") -> DataFrame:
    """Per place: count, mean rating, and the first non-null category and address.

    Rows first collapse to the few (place, category, address) combinations with hashed partial
    aggregates; only those are searched for the earliest value.
    """
    combos = df.filter(F.col("place_name").isNotNull()).groupBy("place_name", "place_category", "place_address").agg(
        F.count("review_text").alias("_reviews"),
        micro_sum(F.col("review_rating")).alias("_rating_sum"),
        F.count("review_rating").alias("_rated"),
        F.min(order_by).alias("_first"),
    )

    def first_present(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("_first")))

    mean = F.try_divide(from_micro(F.sum("_rating_sum")), F.sum("_rated").cast("double"))
    return combos.groupBy("place_name").agg(
        F.sum("_reviews").alias("total_reviews"),
        half_even(mean, 2).alias("avg_rating"),
        first_present("place_category").alias("category"),
        first_present("place_address").alias("address"),
    ).orderBy(F.desc("total_reviews"), "place_name")


def map_places(places: DataFrame, df: DataFrame) -> DataFrame:
    """Place coordinates with per-place sentiment; both review counts keep their own name."""
    per_place = _by_place(df).agg(
        exact_mean(F.col("review_rating")).alias("avg_rating"),
        share_of(_is("positive")).alias("positive_pct"),
        F.count("review_text").alias("collected_review_count"),
    )
    located = places.withColumnsRenamed({"title": "place_name", "review_count": "claimed_review_count"})
    return located.join(per_place, "place_name", "left")


def map_centre(places: DataFrame) -> DataFrame:
    """Median latitude and longitude (each over its own non-null values)."""
    latitude, longitude = exact_median(places, "latitude"), exact_median(places, "longitude")
    # Two one-row tables become one row.
    both = latitude.withColumn("longitude", F.lit(None).cast("double")).unionByName(
        longitude.withColumn("latitude", F.lit(None).cast("double"))
    )
    return both.agg(F.max("latitude").alias("latitude"), F.max("longitude").alias("longitude"))
