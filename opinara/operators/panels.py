"""Filters and small result tables behind dashboards and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import labels
from opinara.functions.labels import title_case
from opinara.functions.numbers import exact_mean, half_even, percent
from opinara.operators.preprocess import fetch_texts
from opinara.operators.ranking import top_per_group


def apply_filters(
    df: DataFrame, *, rating_min: float = 1, rating_max: float = 5, sentiments: Sequence[str] = (),
    places: Sequence[str] = (), categories: Sequence[str] = (),
) -> DataFrame:
    """Conjunction of the global filters; an empty list filters nothing, an absent column is skipped."""
    filtered = df
    if "review_rating" in df.columns:
        filtered = filtered.filter(F.col("review_rating").between(rating_min, rating_max))
    for column, wanted in (("sentiment", sentiments), ("place_name", places), ("place_category", categories)):
        if wanted and column in df.columns:
            filtered = filtered.filter(F.col(column).isin(list(wanted)))
    return filtered


def filter_options(df: DataFrame) -> DataFrame:
    """(kind, value): the sorted distinct choices of the filter bar."""
    kinds = {"sentiment": "sentiment", "category": "place_category", "place": "place_name"}
    pairs = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value")) for kind, column in kinds.items()
    ])
    # Distinct combinations are few and taken before the unpivot.
    combos = df.select(*kinds.values()).distinct()
    return combos.select(F.inline(pairs)).filter("value IS NOT NULL").distinct().orderBy("kind", "value")


def select_places(df: DataFrame, places: Sequence[str] = (), default: int = 6) -> DataFrame:
    """Reviews of the chosen places; by default of the first few by name."""
    if places:
        return df.filter(F.col("place_name").isin(list(places)))
    first = (
        df.filter(F.col("place_name").isNotNull()).select("place_name").distinct()
        .orderBy("place_name").limit(default)
    )
    return df.join(first, "place_name", "left_semi")


def leaderboard(summary: DataFrame, n: int = 10, podium: int = 3) -> DataFrame:
    """Top places by positive share, with the medal places marked."""
    top = top_per_group(summary, [], [F.desc("positive_pct"), F.col("place_name")], n)
    medals = F.array(*[F.lit(m) for m in ("gold", "silver", "bronze")[:podium]])
    return top.select(
        "rank", "place_name", "positive_pct", "avg_review_rating",
        F.get(medals, (F.col("rank") - 1).cast("int")).alias("medal"),
    )


def top_bottom(summary: DataFrame) -> DataFrame:
    """The best and the worst place by positive share (last by name among equals, as in the sorted list)."""
    fields = ["place_name", "positive_pct", "negative_pct", "avg_review_rating", "total_reviews"]
    order = (-F.col("positive_pct")).alias("key")
    ends = summary.agg(
        F.min(F.struct(order, *fields)).alias("top"), F.max(F.struct(order, *fields)).alias("bottom")
    )
    rows = F.array(
        *[F.struct(F.lit(name).alias("position"), *[F.col(name)[f].alias(f) for f in fields]) for name in ("top", "bottom")]
    )
    return ends.select(F.inline(rows)).filter("place_name IS NOT NULL")


def priority_insights(complaints: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent complaints with a three-level severity."""
    top = complaints.orderBy(F.desc("complaint_count"), "aspect").limit(n)
    return top.select(
        title_case(F.col("aspect")).alias("aspect"), "complaint_count", "pct_of_all_reviews", "avg_rating",
        labels.priority_severity(F.col("pct_of_negative_reviews")).alias("severity"),
    )


def complaint_cards(complaints: DataFrame, n: int = 6) -> DataFrame:
    """The most frequent complaints with a four-level severity."""
    top = complaints.orderBy(F.desc("complaint_count"), "aspect").limit(n)
    return top.select(
        title_case(F.col("aspect")).alias("aspect"), "complaint_count", "pct_of_all_reviews", "avg_rating",
        labels.severity(F.col("pct_of_negative_reviews")).alias("severity"),
    )


def strength_cards(strengths: DataFrame, n: int = 6) -> DataFrame:
    top = strengths.orderBy(F.desc("strength_score"), "aspect").limit(n)
    return top.select(title_case(F.col("aspect")).alias("aspect"), "strength_score", "positive_review_count")


def negative_keywords(correlation: DataFrame, n: int = 25) -> DataFrame:
    return correlation.orderBy("sentiment_bias", "keyword").limit(n)


def top_reviews(df: DataFrame, n: int = 5, length: int = 500, raw: DataFrame | None = None) -> DataFrame:
    """The strongest positive and negative reviews, with a display excerpt.

    Ids are ranked first; only the texts of the 2n winners are fetched.
    """
    sided = df.filter(F.col("sentiment").isin("positive", "negative"))
    ids = sided.select("sentiment", "sentiment_score", "review_id")
    winners = top_per_group(ids, ["sentiment"], [F.desc("sentiment_score"), F.col("review_id")], n)
    return fetch_texts(winners, df, raw).select(
        "sentiment", "rank", "review_id", "place_name", "sentiment_score",
        F.substring("clean_text", 1, length).alias("excerpt"),
    )


def executive_kpis(df: DataFrame) -> DataFrame:
    """One row: review, place and rating totals and the labelled shares."""
    def share(sentiment: str):
        return percent(F.count(F.when(F.col("sentiment") == sentiment, 1)), F.count("sentiment"))

    return df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.countDistinct("place_name").alias("total_places"),
        half_even(exact_mean(F.col("review_rating")), 2).alias("avg_rating"),
        half_even(share("positive"), 1).alias("positive_pct"),
        half_even(share("negative"), 1).alias("negative_pct"),
    )


def executive_top_places(summary: DataFrame, n: int = 10) -> DataFrame:
    return top_per_group(summary, [], [F.desc("positive_pct"), F.col("place_name")], n).select(
        "rank", "place_name", half_even(F.col("positive_pct"), 1).alias("positive_pct"),
        half_even(F.col("negative_pct"), 1).alias("negative_pct"), "avg_review_rating", "total_reviews",
    )


def executive_complaints(complaints: DataFrame, n: int = 10) -> DataFrame:
    top = complaints.orderBy(F.desc("complaint_count"), "aspect").limit(n)
    return top.select(
        title_case(F.col("aspect")).alias("aspect"), "complaint_count", "pct_of_all_reviews", "avg_rating"
    )


def executive_recommendations(recs: DataFrame, n: int = 10) -> DataFrame:
    """The first recommendations with their category and actions."""
    order = [F.desc("negative_review_count"), F.col("category")]
    return top_per_group(recs, [], order, n, rank="priority").select(
        "priority", title_case(F.col("category")).alias("aspect"),
        F.array_join("actions", "; ").alias("action"), "severity",
    )
