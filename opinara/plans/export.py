"""Column projections of the exported result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.summaries import places_summary
from opinara.sources.writers import write_csv


def sentiment_by_place(summary: DataFrame) -> DataFrame:
    return summary.select(
        "place_name", "total_reviews", "positive_pct", "neutral_pct", "negative_pct",
        "avg_sentiment_score", "avg_review_rating",
    ).orderBy(F.desc("positive_pct"), "place_name")


def recommendations(recs: DataFrame) -> DataFrame:
    """One row per action."""
    return recs.select(
        "severity", "category", "title", F.explode("actions").alias("action"), "negative_review_count"
    )


def aspect_summary(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col("total_mentions") > 0).select(
        "aspect", "total_mentions", F.col("mention_rate").alias("mention_rate_pct"), "positive_pct",
        "negative_pct", F.col("avg_sentiment_score").alias("avg_sentiment"),
    ).orderBy(F.desc("total_mentions"), "aspect")


def comparison_ranking(ranking: DataFrame) -> DataFrame:
    return ranking.select(
        "place_name", "rank", "sentiment_health_score", "positive_pct", "negative_pct", "avg_rating", "total_reviews"
    ).orderBy("rank")


def export_csv(reviews: DataFrame, results: Mapping[str, DataFrame], folder: str) -> None:
    """Write the six CSV tables (those whose result exists)."""
    write_csv(reviews, f"{folder}/all_reviews.csv")
    write_csv(places_summary(reviews), f"{folder}/places_summary.csv")
    projections = {
        "sentiment_by_place": ("sentiment_summary", sentiment_by_place),
        "recommendations": ("recommendations", recommendations),
        "aspect_summary": ("aspect_summary", aspect_summary),
        "comparison_ranking": ("comparison_ranking", comparison_ranking),
    }
    for name, (result, project) in projections.items():
        if result in results:
            write_csv(project(results[result]), f"{folder}/{name}.csv")
