"""Union and deduplication of review batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.text import not_blank
from opinara.operators.ranking import keep_first

REVIEW_KEY = ["place_id", "review_text"]


def union_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column a batch lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def merge_reviews(reviews: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """Keep the first review per place and full text, then drop blank texts (a NULL text stays)."""
    kept = reviews.filter(F.coalesce(not_blank(F.col("review_text")), F.lit(True)))
    return keep_first(kept, REVIEW_KEY, order_by)


def dedupe_places(places: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """Places with coordinates, the first per title."""
    located = places.dropna(subset=["latitude", "longitude"])
    return keep_first(located, ["title"], order_by)
