"""Review text preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import labels, text

MIN_REVIEW_LENGTH = 5


def clean_reviews(df: DataFrame, min_length: int = MIN_REVIEW_LENGTH) -> DataFrame:
    """Add ``clean_text`` and drop reviews shorter than ``min_length`` code points after cleaning."""
    cleaned = text.with_clean_text(df, "review_text")
    return cleaned.filter(F.char_length("clean_text") >= min_length)


def measure_reviews(df: DataFrame, min_length: int = MIN_REVIEW_LENGTH) -> DataFrame:
    """Clean and count words, for summaries that need no tokens."""
    return (
        clean_reviews(df, min_length)
        .withColumn("word_count", F.size(F.split("clean_text", " ")))
        .withColumn("review_length_bucket", labels.length_bucket(F.col("word_count")))
    )


def preprocess_reviews(
    df: DataFrame, stop_words: Sequence[str], min_length: int = MIN_REVIEW_LENGTH, *, treebank: bool = False
) -> DataFrame:
    """Clean, measure and tokenise every review, into runs of word characters or by treebank conventions."""
    measured = measure_reviews(df, min_length)
    tokenised = text.with_computed(measured, tokens=text.tokens(F.col("clean_text"), stop_words, treebank=treebank))
    return tokenised.withColumn("token_count", F.size("tokens"))


def fetch_texts(winners: DataFrame, df: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Attach ``place_name`` and ``clean_text`` to a handful of ranked ``review_id`` rows.

    Whether ``winners`` (n rows per group) is broadcast is left to Spark's size check.  With ``raw`` reviews the
    few texts are cleaned anew, so the analysis behind ``df`` is not evaluated a second time.
    """
    if raw is None:
        return df.select("review_id", "place_name", "clean_text").join(winners, "review_id")
    rows = raw.select("review_id", "place_name", "review_text").join(winners, "review_id")
    return text.with_clean_text(rows, "review_text").drop("review_text")
