"""Threshold labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.lexicons import (
    ALERT_LEVELS, COMPLAINT_SEVERITY, HEALTH_LABELS, LENGTH_BUCKETS, PRIORITY_SEVERITY, SEVERITY_ORDER,
)


def _above(value: Column, levels: Sequence[tuple[int, str]], otherwise: str) -> Column:
    label = F
    for bound, name in levels:
        label = label.when(value > bound, name)
    return F.when(value.isNotNull(), label.otherwise(otherwise))


def length_bucket(words: Column) -> Column:
    """Bucket a word count: each bucket includes its upper bound; 0 and beyond the last is NULL."""
    bucket = F.when(words <= 0, F.lit(None).cast("string"))
    for bound, name in LENGTH_BUCKETS:
        bucket = bucket.when(words <= bound, name)
    return bucket


def length_bucket_order(bucket: Column) -> Column:
    order = F.array(*[F.lit(name) for _, name in LENGTH_BUCKETS])
    return F.nullif(F.array_position(order, bucket), F.lit(0)).cast("int")


def sentiment_of(compound: Column) -> Column:
    return F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")


def score_of(compound: Column) -> Column:
    """Unsigned for negative reviews, signed in the neutral band."""
    return F.when(compound <= -0.05, F.abs(compound)).otherwise(compound)


def sentiment_number(label: Column) -> Column:
    return F.when(label == "positive", 1).when(label == "negative", -1).otherwise(0)


def severity(pct_of_negative: Column) -> Column:
    return _above(pct_of_negative, COMPLAINT_SEVERITY, "low")


def priority_severity(pct_of_negative: Column) -> Column:
    return _above(pct_of_negative, PRIORITY_SEVERITY, "medium")


def severity_order(level: Column) -> Column:
    order = F.array(*[F.lit(name) for name in SEVERITY_ORDER])
    position = F.array_position(order, level)
    return F.when(position > 0, position - 1).otherwise(99).cast("int")


def alert_level(negative_pct: Column) -> Column:
    return _above(negative_pct, ALERT_LEVELS, "low")


def health_label(net: Column) -> Column:
    return _above(net, HEALTH_LABELS, "poor")


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
