"""Explicit schemas for every table that crosses a storage boundary (nothing is inferred)."""

from pyspark.sql import types as T

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One element of the two review arrays, keyed by field name.  Two dialects of the record are mixed in
# the wild, with names that differ only in case (``Name``, ``name``); map keys are case-sensitive
# whatever the session says.  The extractor casts the fields it uses:
#   Description, text, text_original, text_translated, When, published_at, Name, name  (text)
#   Rating, stars, rating_float  (double)    photos_count, likes_count  (long)
RAW_REVIEW = T.MapType(_S, _S)
RAW_REVIEWS = T.ArrayType(RAW_REVIEW)

# The review arrays arrive as arrays or as JSON text of arrays; both are read as their text.
RAW_PLACES = _struct(
    ("title", _S), ("place_id", _S), ("data_id", _S), ("category", _S), ("address", _S),
    ("review_rating", _D), ("review_count", _L), ("latitude", _D), ("longitude", _D),
    ("user_reviews", _S), ("user_reviews_extended", _S),
)
# What the JSON reader is given: no value is lost because it is of another kind than declared.
RAW_PLACES_TEXT = T.StructType([T.StructField(f.name, _S, True) for f in RAW_PLACES.fields])

REVIEWS = _struct(
    ("place_name", _S), ("place_id", _S), ("place_rating", _D), ("place_category", _S),
    ("place_address", _S), ("review_text", _S), ("review_rating", _D), ("review_date", _S),
    ("reviewer_name", _S), ("reviewer_photos", _L), ("review_likes", _L),
)

PLACES = _struct(
    ("title", _S), ("latitude", _D), ("longitude", _D), ("place_id", _S), ("category", _S),
    ("address", _S), ("review_rating", _D), ("review_count", _L),
)

QUERY_STATUS = _struct(
    ("query", _S), ("status", _S), ("attempts", _I), ("error", _S), ("batch", _I),
    ("places", _L), ("reviews", _L), ("ts", T.TimestampType()),
)

REVIEW_COLUMNS = REVIEWS.fieldNames()
PLACE_COLUMNS = PLACES.fieldNames()
