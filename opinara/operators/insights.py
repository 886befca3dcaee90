"""Complaints, strengths, recommendations and the improvement roadmap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opinara import lexicons
from opinara.functions import labels
from opinara.functions.numbers import exact_mean, from_micro, half_even, percent, share_of
from opinara.functions.text import with_computed
from opinara.operators.aspects import Lexicon, aspect_grid
from opinara.operators.ranking import top_per_group

MIN_NEGATIVE = 3


def complaint_totals(df: DataFrame, min_reviews: int = MIN_NEGATIVE) -> DataFrame:
    """One row on the negative reviews; no row when there are fewer than ``min_reviews``."""
    negative = F.col("sentiment") == "negative"
    return df.agg(
        F.count(F.when(negative, 1)).alias("total_negative_reviews"),
        half_even(share_of(negative), 1).alias("negative_pct"),
        half_even(exact_mean(F.when(negative, F.col("review_rating"))), 2).alias("avg_negative_rating"),
    ).filter(F.col("total_negative_reviews") >= min_reviews)


def _mean_rating() -> Column:
    return half_even(F.try_divide(from_micro(F.col("rating_sum")), F.col("rated").cast("double")), 2)


def complaint_aspects(
    df: DataFrame, lexicon: Lexicon = lexicons.ASPECTS, min_reviews: int = MIN_NEGATIVE
) -> DataFrame:
    """Per aspect the negative reviews that mention it; most frequent first."""
    return complaints_of(aspect_grid(df, lexicon, polarity="negative"), min_reviews)


def complaints_of(grid: DataFrame, min_reviews: int = MIN_NEGATIVE) -> DataFrame:
    """``complaint_aspects`` from a grid of negative mentions."""
    found = grid.filter((F.col("mentions") > 0) & (F.col("negative_reviews") >= min_reviews))
    return found.select(
        "aspect",
        F.col("mentions").alias("complaint_count"),
        half_even(percent(F.col("mentions"), F.col("negative_reviews")), 1).alias("pct_of_negative_reviews"),
        half_even(percent(F.col("mentions"), F.col("reviews")), 1).alias("pct_of_all_reviews"),
        _mean_rating().alias("avg_rating"),
        "aspect_order",
    ).orderBy(F.desc("complaint_count"), "aspect_order").drop("aspect_order")


def complaint_keywords(
    df: DataFrame, top_n: int = 15, min_reviews: int = MIN_NEGATIVE, *, lexicon: Lexicon | None = None
) -> DataFrame:
    """The most frequent tokens of each aspect's negative reviews; with ``lexicon`` all aspects are known to be of it."""
    negative = df.filter(F.col("sentiment") == "negative")
    counts = _tokens_by_set(negative) if lexicon is None else _tokens_by_aspect(negative, list(lexicon))
    # The limit lets every task stop after a few rows.
    enough = negative.limit(min_reviews).agg(F.count(F.lit(1))).scalar() >= min_reviews
    ranked = top_per_group(counts, ["aspect"], [F.desc("occurrences"), F.col("token")], top_n)
    return ranked.filter(enough)


def _tokens_by_set(negative: DataFrame) -> DataFrame:
    """(aspect, token, occurrences), counted per set of aspects first, so a review is not repeated for each of its aspects."""
    per_set = (
        negative.filter(F.size("aspects") > 0).select("aspects", F.explode("tokens").alias("token"))
        .groupBy("aspects", "token").agg(F.count(F.lit(1)).alias("n"))
    )
    return per_set.select(F.explode("aspects").alias("aspect"), "token", "n").groupBy("aspect", "token").agg(
        F.sum("n").alias("occurrences")
    )


def _tokens_by_aspect(negative: DataFrame, aspects: Sequence[str]) -> DataFrame:
    """The same for known aspects: one sum each, so that a token is one row in the shuffle, whatever its sets of aspects."""
    sets = F.struct(*[F.array_contains("aspects", a).cast("long").alias(f"n{i}") for i, a in enumerate(aspects)])
    tokens = with_computed(negative.filter(F.size("aspects") > 0).select("aspects", "tokens"), _in=sets).select(
        "_in", F.explode("tokens").alias("token"))
    sums = tokens.groupBy("token").agg(*[F.sum(f"_in.n{i}").alias(f"n{i}") for i in range(len(aspects))])
    counts = F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(f"n{i}").alias("occurrences")) for i, a in enumerate(aspects)])
    return sums.select("token", F.inline(counts)).filter("occurrences > 0").select("aspect", "token", "occurrences")


def strengths(df: DataFrame, lexicon: Lexicon = lexicons.ASPECTS) -> DataFrame:
    """Per aspect the share of positive reviews that mention it; strongest first."""
    return strengths_of(aspect_grid(df, lexicon, polarity="positive"))


def strengths_of(grid: DataFrame) -> DataFrame:
    """``strengths`` from a grid of positive mentions."""
    return grid.filter(F.col("mentions") > 0).select(
        "aspect",
        half_even(percent(F.col("mentions"), F.col("positive_reviews")), 1).alias("strength_score"),
        F.col("mentions").alias("positive_review_count"),
        _mean_rating().alias("avg_rating"),
        "aspect_order",
    ).orderBy(F.desc("strength_score"), "aspect_order").drop("aspect_order")


def insight_overview(df: DataFrame) -> DataFrame:
    """One row: totals, label counts, shares and the positive-to-negative ratio of the shares."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        half_even(exact_mean(F.col("review_rating")), 2).alias("avg_rating"),
        *[F.count(F.when(F.col("sentiment") == s, 1)).alias(f"{s}_reviews") for s in lexicons.SENTIMENTS],
    )
    shares = counted.withColumns({
        "positive_pct": half_even(percent(F.col("positive_reviews"), F.col("total_reviews")), 1),
        "negative_pct": half_even(percent(F.col("negative_reviews"), F.col("total_reviews")), 1),
    })
    ratio = F.col("positive_pct") / F.greatest(F.col("negative_pct"), F.lit(0.1))
    return shares.withColumn("sentiment_ratio", half_even(ratio, 1))


def recommendations(
    complaints: DataFrame, templates: Mapping[str, tuple[str, Sequence[str]]] = lexicons.RECOMMENDATIONS
) -> DataFrame:
    """Severity, title and actions per complaint aspect.

    An aspect without a template gets generated text.
    """
    table = lexicons.recommendation_table(complaints.sparkSession, templates)
    joined = complaints.join(table, "aspect", "left")
    aspect = F.col("aspect")
    generic = F.array(
        F.concat(F.lit("Investigate customer complaints about "), aspect),
        F.concat(F.lit("Benchmark "), aspect, F.lit(" against competitors")),
        F.concat(F.lit("Create action plan for "), aspect, F.lit(" improvement")),
    )
    return joined.select(
        aspect.alias("category"),
        labels.severity(F.col("pct_of_negative_reviews")).alias("severity"),
        F.coalesce("title", F.concat(F.lit("Address issues related to: "), aspect)).alias("title"),
        F.coalesce("actions", generic).alias("actions"),
        F.col("complaint_count").alias("negative_review_count"),
        F.col("pct_of_all_reviews").alias("negative_review_pct"),
        "avg_rating",
    ).orderBy(F.desc("negative_review_count"), "category")


def improvement_roadmap(recs: DataFrame) -> DataFrame:
    """One row per action; priority follows severity, then complaint count.

    The unpartitioned window sees one row per lexicon aspect.
    """
    order = [labels.severity_order(F.col("severity")), F.desc("negative_review_count"), F.col("category")]
    ranked = recs.withColumn("priority", F.row_number().over(W.orderBy(*order)))
    actions = ranked.select("priority", "severity", "category", F.posexplode("actions").alias("step", "action_item"))
    return actions.orderBy("priority", "step").select(
        "priority", "severity", "category", "action_item",
        F.col("category").alias("impact_area"),
        F.lit("Medium").alias("estimated_effort"),
        F.concat(F.lit("Reduction in negative reviews about "), "category").alias("measure_of_success"),
    )


def filter_severity(
    roadmap: DataFrame, severities: Sequence[str] = ("critical", "high", "medium")
) -> DataFrame:
    return roadmap.filter(F.col("severity").isin(list(severities)))
