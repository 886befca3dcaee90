"""Search-query lists: generation, ordering, and what is still to be collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara import lexicons

MAX_ATTEMPTS = 3


def default_areas(spark: SparkSession) -> DataFrame:
    """The areas that are searched when none are given (``area``)."""
    return spark.createDataFrame([(area,) for area in lexicons.AREAS], "area string")


def default_centres(spark: SparkSession) -> DataFrame:
    """The centres that are searched when none are given (``centre``)."""
    return spark.createDataFrame([(centre,) for centre in lexicons.GEO_CENTRES], "centre string")


def area_queries(areas: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Distinct ``"<keyword> in <area>"``: each area row yields one row per keyword (a fixed list).

    Areas are made distinct before they are multiplied, so a task holds areas, not their queries.  Only keywords of which one
    begins like a whole query of another can make equal queries of different pairs.
    """
    keywords = list(dict.fromkeys(keywords))
    # A NULL area leaves the keyword alone, which must then begin like a query too.
    overlap = any(a != b and a.startswith(f"{b} in ") for a in keywords for b in keywords)
    terms = F.array(*[F.lit(k) for k in keywords])
    pairs = areas.select("area").distinct().select("area", F.explode(terms).alias("keyword"))
    queries = pairs.select(F.concat_ws(" in ", "keyword", "area").alias("query"))
    return queries.distinct() if overlap else queries


def expansion_queries(areas: DataFrame, niches: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``area_queries`` over the keywords of several niches (by default all known ones)."""
    niches = lexicons.NICHES if niches is None else niches
    return area_queries(areas, list(dict.fromkeys(k for words in niches.values() for k in words)))


def max_coverage_queries(areas: DataFrame, keywords: Sequence[str], centres: DataFrame, keyword: str) -> DataFrame:
    """Distinct area queries plus one geo-targeted query per centre (``centre`` is ``"lat,lon"`` text).

    Both parts are distinct by themselves; they are compared only if a keyword can begin like a geo-targeted query.
    """
    start = f"{keyword} @"
    geo = centres.select(F.concat(F.lit(start), "centre", F.lit(",14z")).alias("query")).distinct()
    both = area_queries(areas, keywords).unionByName(geo)
    overlap = any(f"{k} in ".startswith(start) or start.startswith(f"{k} in ") for k in keywords)
    return both.distinct() if overlap else both


def grid_points(boxes: DataFrame, step: float = 0.02) -> DataFrame:
    """Points covering each bounding box, both ends included, with their geo-targeted query.

    The points come from integer steps, so rounding does not accumulate along a row.
    """
    def steps(low: str, high: str):
        count = F.floor((F.col(high) - F.col(low)) / step + 1e-9)
        return F.when(count >= 0, F.sequence(F.lit(0).cast("long"), count))

    rows = boxes.select("*", F.explode(steps("min_lat", "max_lat")).alias("_i"))
    cells = rows.select("*", F.explode(steps("min_lon", "max_lon")).alias("_j"))
    points = cells.withColumn("lat", F.col("min_lat") + F.col("_i") * step).withColumn(
        "lon", F.col("min_lon") + F.col("_j") * step
    )
    return points.drop("_i", "_j").withColumn(
        "query", F.format_string("%s @%.5f,%.5f,14z", F.col("keyword"), F.col("lat"), F.col("lon"))
    )


def distinct_queries(queries: DataFrame, position: str = "position") -> DataFrame:
    """Order-preserving distinct: every query with the place where it first appears."""
    return queries.groupBy("query").agg(F.min(position).alias("first_position"))


def new_queries(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed queries that the state does not know yet."""
    return listed.select("query").distinct().join(known.select("query"), "query", "left_anti")


def pending_queries(listed: DataFrame, status: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Queries to run: listed and untouched, or failed fewer than ``max_attempts`` times.

    A query that was ever completed is never retried.  One grouped pass replaces the set operations.
    """
    marks = listed.select("query", F.lit("listed").alias("mark"), F.lit(None).cast("int").alias("attempts"))
    known = status.select("query", F.col("status").alias("mark"), F.col("attempts").cast("int").alias("attempts"))

    def ever(mark: str):
        return F.coalesce(F.bool_or(F.col("mark") == mark), F.lit(False))

    failed_attempts = F.max(F.when(F.col("mark") == "failed", F.coalesce("attempts", F.lit(1))))
    seen = marks.unionByName(known).groupBy("query").agg(
        ever("listed").alias("listed"), ever("completed").alias("completed"), ever("failed").alias("failed"),
        failed_attempts.alias("attempts"),
    )
    fresh = F.col("listed") & ~F.col("failed")
    retry = F.col("failed") & (F.col("attempts") < max_attempts)
    return seen.filter(~F.col("completed") & (fresh | retry)).select(
        "query", F.when(F.col("failed"), "retry").otherwise("new").alias("reason")
    )
