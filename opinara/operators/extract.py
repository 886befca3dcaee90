"""Nested place records to one row per review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions.text import not_blank, strip
from opinara.operators.ranking import keep_first
from opinara.schemas import RAW_REVIEW, RAW_REVIEWS, REVIEW_COLUMNS


def flatten_struct(df: DataFrame, separator: str = ".") -> DataFrame:
    """One level of nested objects becomes ``parent.child`` columns; other columns are kept."""
    flat: list[Column] = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            flat += [
                F.col(f"`{field.name}`.`{child}`").alias(f"{field.name}{separator}{child}")
                for child in field.dataType.fieldNames()
            ]
        else:
            flat.append(F.col(f"`{field.name}`"))
    return df.select(*flat)


def first_text(*candidates: Column) -> Column:
    """The first candidate that is neither NULL nor empty (white space counts as text)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def _reviews_of(df: DataFrame, name: str) -> Column:
    """The review array of a column given as maps, as structs or as JSON text; never NULL.

    Elements of JSON text are parsed one by one, so an element that is no object loses itself only.
    """
    nothing = F.array().cast(RAW_REVIEWS)
    if name not in df.columns:
        return nothing
    column, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        column = F.to_json(column)
        kind = T.StringType()
    if isinstance(kind, T.StringType):
        # Malformed text yields NULL and is skipped.
        elements = F.from_json(column, T.ArrayType(T.StringType()))
        parsed = F.transform(elements, lambda e: F.from_json(e, RAW_REVIEW))
        column = F.filter(parsed, lambda e: e.isNotNull())
    return F.coalesce(column, nothing)


def _optional(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def explode_reviews(places: DataFrame, order_by: Sequence[Column | str] = ()) -> DataFrame:
    """Review rows in (``place_seq``, ``pos``) order, not yet deduplicated.

    ``order_by`` names the column that orders the places; without it the read order is used.
    """
    sequence = list(order_by)[0] if order_by else F.monotonically_increasing_id()
    sequence = F.col(sequence) if isinstance(sequence, str) else sequence
    identifier = F.coalesce(
        _optional(places, "place_id", F.lit(None).cast("string")).cast("string"),
        _optional(places, "data_id", F.lit(None).cast("string")).cast("string"),
        F.lit(""),
    )
    exploded = places.select(
        sequence.alias("place_seq"),
        _optional(places, "title", F.lit("Unknown")).alias("place_name"),
        identifier.alias("place_id"),
        _optional(places, "review_rating", F.lit(0.0)).cast("double").alias("place_rating"),
        _optional(places, "category", F.lit("")).alias("place_category"),
        _optional(places, "address", F.lit("")).alias("place_address"),
        F.posexplode(
            F.concat(_reviews_of(places, "user_reviews"), _reviews_of(places, "user_reviews_extended"))
        ).alias("pos", "r"),
    )
    zero = F.lit(0.0)

    def field(key: str) -> Column:
        return F.try_element_at("r", F.lit(key))

    def number(key: str) -> Column:
        return field(key).try_cast("double")

    return exploded.filter(F.col("r").isNotNull()).select(
        "place_seq", "pos", "place_name", "place_id", "place_rating", "place_category", "place_address",
        first_text(field("Description"), field("text"), field("text_original"), field("text_translated"))
        .alias("review_text"),
        F.coalesce(F.nullif(number("Rating"), zero), F.nullif(number("stars"), zero), number("rating_float"), zero)
        .alias("review_rating"),
        F.coalesce(first_text(field("When")), field("published_at"), F.lit("")).alias("review_date"),
        F.coalesce(first_text(field("Name")), field("name"), F.lit("")).alias("reviewer_name"),
        F.coalesce(number("photos_count"), zero).cast("long").alias("reviewer_photos"),
        F.coalesce(number("likes_count"), zero).cast("long").alias("review_likes"),
    ).filter(not_blank(F.col("review_text")))


def prefix_key(text: Column, length: int = 100) -> Column:
    """Comparison key of a review: its first characters, stripped and lower-cased."""
    return F.lower(strip(F.substring(text, 1, length)))


def dedupe_by_prefix(reviews: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """Keep the first review per place and prefix key."""
    keyed = reviews.withColumn("_prefix", prefix_key(F.col("review_text")))
    return keep_first(keyed, ["place_id", "_prefix"], order_by).drop("_prefix")


def extract_reviews(places: DataFrame, order_by: Sequence[Column | str] = ()) -> DataFrame:
    """Flat, deduplicated reviews of raw place records."""
    rows = explode_reviews(places, order_by)
    return dedupe_by_prefix(rows, ["place_seq", "pos"]).select(*REVIEW_COLUMNS)
