"""Word, phrase and TF-IDF keyword statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions.chunks import chunks, coded, gram_codes, gram_texts
from opinara.functions.numbers import half_even
from opinara.functions.text import ngrams, with_computed, words
from opinara.operators.ranking import top_per_group
from opinara.session import materialise, stored


#: Sentiments whose terms are compared.
POLARITIES = ("positive", "negative")
_SLOTS = 512
#: Groups whose vocabularies are sent to all tasks, at most max_features terms each.
_WIDE_GROUPS = 64


def review_words(df: DataFrame, stop_words: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Vectoriser words per review: stop words go before n-grams are formed, digits stay."""
    return df.select(*keys, "review_id", words(F.col("clean_text"), stop_words).alias("words"))


def _grams(sizes: Sequence[int]) -> Column:
    return F.concat(*[ngrams(F.col("words"), n) for n in sizes])


def with_counts(df: DataFrame, terms: Column) -> DataFrame:
    """Add ``counts``: the distinct terms of an array with their counts, by the boundaries of its sorted form.

    Every step is a column of its own: inside a lambda an expression would be evaluated once for each element.
    """
    ordered, starts = F.col("_ordered"), F.col("_starts")
    df = with_computed(df, _ordered=F.sort_array(terms))
    last = F.size(ordered) - 1
    every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    df = with_computed(df, _starts=F.filter(
        every, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(last + 1))
    df = with_computed(df, _pairs=F.arrays_zip(starts.alias("i"), F.slice(ends, F.lit(1), F.size(starts)).alias("j")))
    counts = F.transform("_pairs", lambda p: F.struct(F.get(ordered, p["i"]).alias("term"), (p["j"] - p["i"]).alias("tf")))
    return with_computed(df, counts=counts).drop("_ordered", "_starts", "_pairs")


def gram_counts(word_table: DataFrame, sizes: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, term, df, total): counts of the grams of each chunk of reviews, to be summed.

    Words are numbers inside a chunk and grams are counted by one sort of these, so Spark sees a gram once for each chunk and
    not once for each occurrence.
    """
    keys, sizes = list(keys), list(sizes)
    rows = word_table.select(*keys, "words")
    schema = T.StructType([*[T.StructField(k, rows.schema[k].dataType) for k in keys], *T._parse_datatype_string(
        "term string, df long, total long").fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lengths in chunks(batch, "words"):
                group = np.zeros(len(lengths), np.int64)
                for key in keys:
                    codes, _ = coded(part[key])
                    group = np.unique(group * (codes.max() + 2) + codes + 1, return_inverse=True)[1]
                groups = int(group.max()) + 1
                row = np.repeat(np.arange(len(lengths)), lengths)
                codes, words_ = coded(part["words"].flatten())
                for n in sizes:
                    starts, grams = gram_codes(codes, row, n)
                    if not len(starts):
                        continue
                    # Grams as places among the distinct ones, so that the group fits beside them.
                    if groups > 1:
                        grams = np.unique(grams, return_inverse=True)[1] * groups + group[row[starts]]
                    order = np.argsort(grams, kind="stable")
                    ordered, review = grams[order], row[starts[order]]
                    fresh = np.append(True, ordered[1:] != ordered[:-1])
                    first = np.flatnonzero(fresh)
                    seen = fresh | np.append(True, review[1:] != review[:-1])
                    at = starts[order[first]]
                    yield pa.RecordBatch.from_arrays([
                        *[part[key].take(pa.array(row[at])) for key in keys], gram_texts(codes, words_, at, n),
                        pa.array(np.add.reduceat(seen, first, dtype=np.int64)), pa.array(np.diff(np.append(first, len(ordered)))),
                    ], names=[*keys, "term", "df", "total"])

    return rows.mapInArrow(count, schema)


def document_frequencies(word_table: DataFrame, sizes: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, term, df, total): number of reviews with the term and number of occurrences.

    The row with a NULL term counts the reviews themselves.
    """
    terms = gram_counts(word_table, sizes, keys).groupBy(*keys, "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    reviews = review_counts(word_table, keys).select(
        *keys, F.lit(None).cast("string").alias("term"), F.col("reviews").alias("df"), F.col("reviews").alias("total"))
    return terms.unionByName(reviews.filter("df > 0"))


def review_counts(word_table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, reviews): the number of reviews, without a look at their words."""
    return word_table.groupBy(*keys).agg(F.count(F.lit(1)).alias("reviews"))


def word_frequencies(df: DataFrame, top_n: int = 100) -> DataFrame:
    counts = df.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.orderBy(F.desc("occurrences"), "word").limit(top_n)


def phrase_frequencies(
    df: DataFrame, stop_words: Sequence[str], *, n: int = 3, top_n: int = 25,
    min_df: int = 2, max_df: float = 0.8, max_features: int = 5000, word_table: DataFrame | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Most frequent ``n``-grams among those in at least ``min_df`` and at most ``max_df`` of the reviews.

    ``stats`` are stored counts of at least the first ``top_n``, if there are any.
    """
    word_table = materialise(review_words(df, stop_words)) if word_table is None else word_table
    stats = document_frequencies(word_table, [n]) if stats is None else stats
    reviews = review_counts(word_table).select(F.col("reviews").cast("double")).scalar()
    kept = stats.filter(F.col("term").isNotNull() & (F.col("df") >= min_df) & (F.col("df") <= reviews * max_df))
    # The feature cut orders by the same count, so it only matters when it is the smaller number.
    return kept.orderBy(F.desc("total"), "term").limit(min(top_n, max_features)).select(
        F.col("term").alias("phrase"), F.col("total").alias("occurrences")
    )


def tfidf_keywords(
    df: DataFrame, stop_words: Sequence[str], *, keys: Sequence[str] = (), top_n: int = 20,
    sizes: Sequence[int] = (1, 2), min_df: int = 2, max_df: float = 0.85, max_features: int = 2000,
    min_reviews: int = 1, word_table: DataFrame | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """Terms by summed, L2-normalised, smoothed TF-IDF, fitted per ``keys`` group (or once).

    All groups go through one plan; groups with fewer than ``min_reviews`` reviews yield no rows.
    Equal scores are ordered by term.  ``word_table`` is the stored ``review_words`` of ``df`` with the keys, if there is one.
    ``stats`` are stored counts of at least the first ``max_features`` terms of each group, if there are any.
    """
    keys = list(keys)
    # Texts are cleaned once: the word arrays are stored, then counted and weighted.
    table = df if word_table is None else word_table.select(*keys, "words")
    for key in keys:
        table = table.filter(F.col(key).isNotNull())
    word_table = materialise(review_words(table, stop_words, keys)) if word_table is None else table
    given, stats = stats, document_frequencies(word_table, sizes, keys) if stats is None else stats
    sizes_of = review_counts(word_table, keys).filter(F.col("reviews") >= min_reviews)
    frequent = stats.filter(F.col("term").isNotNull() & (F.col("df") >= min_df))
    if keys:
        frequent = frequent.join(sizes_of, keys)
    else:
        frequent = frequent.withColumn("reviews", sizes_of.select("reviews").scalar())
    frequent = frequent.filter(F.col("df") <= F.col("reviews") * max_df)
    vocabulary = top_per_group(
        frequent, keys, [F.desc("total"), F.col("term")], max_features, rank="_rank", spread_by=["term"]
    ).select(*keys, "term", (F.log((1.0 + F.col("reviews")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    # A group's vocabulary has at most max_features terms, so it travels to its reviews in one value.  Maps are searched
    # from front to back, so it is an array of small maps, addressed by a hash of the term.
    def slot(term: Column) -> Column:
        return F.pmod(F.crc32(term), F.lit(_SLOTS)).cast("int")

    slots = vocabulary.groupBy(*keys, slot(F.col("term")).alias("slot")).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("terms"))
    by_slot = slots.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", "terms"))).alias("filled"))
    lookup = by_slot.select(*keys, F.transform(
        F.sequence(F.lit(0), F.lit(_SLOTS - 1)), lambda i: F.try_element_at("filled", i)).alias("idf"))
    if keys and given is not None:
        # Stored, the lookups of the largest groups travel to the reviews; these groups' reviews would be most of a shuffle.
        lookup = stored(lookup, "lookup")
        wide = F.broadcast(sizes_of.orderBy(F.desc("reviews"), *keys).limit(_WIDE_GROUPS).select(*keys))
        rows = word_table.join(F.broadcast(lookup.join(wide, keys, "left_semi")), keys).unionByName(
            word_table.join(wide, keys, "left_anti").join(lookup, keys))
    elif keys:
        rows = word_table.join(lookup, keys)
    else:
        rows = word_table.withColumn("idf", lookup.select("idf").scalar()).filter(F.col("idf").isNotNull())

    def idf_of(term: Column) -> Column:
        return F.try_element_at(F.get("idf", slot(term)), term)

    known = F.filter(_grams(sizes), lambda term: idf_of(term).isNotNull())
    counted = with_counts(rows, known)
    weights = F.transform("counts", lambda c: F.struct(
        c["term"].alias("term"), (c["tf"] * idf_of(c["term"])).alias("weight")))
    weighted = with_computed(counted.select(*keys, weights.alias("weights")), length=F.sqrt(
        F.aggregate("weights", F.lit(0.0), lambda total, w: total + w["weight"] * w["weight"])))
    shares = weighted.select(*keys, "length", F.inline("weights"))
    scored = shares.groupBy(*keys, "term").agg(half_even(F.sum(F.col("weight") / F.col("length")), 6).alias("score"))
    ranked = top_per_group(scored, keys, [F.desc("score"), F.col("term")], top_n)
    return ranked.select(*keys, F.col("term").alias("keyword"), "score", "rank")


def global_keywords(
    df: DataFrame, stop_words: Sequence[str], top_n: int = 30, *, word_table: DataFrame | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    return tfidf_keywords(df, stop_words, top_n=top_n, word_table=word_table, stats=stats)


def place_keywords(
    df: DataFrame, stop_words: Sequence[str], top_n: int = 15, *, word_table: DataFrame | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Keywords fitted separately per place (places with fewer than three reviews have none)."""
    return tfidf_keywords(df, stop_words, keys=["place_name"], top_n=top_n, min_reviews=3, word_table=word_table, stats=stats)


def compare_keywords(df: DataFrame, stop_words: Sequence[str], top_n: int = 10) -> DataFrame:
    return comparison_of(place_keywords(df, stop_words), top_n)


def comparison_of(by_place: DataFrame, top_n: int = 10) -> DataFrame:
    """The first ``top_n`` of ``place_keywords``, with scores to compare."""
    best = by_place.filter(F.col("rank") <= top_n)
    return best.select("place_name", "keyword", half_even(F.col("score"), 3).alias("score"))


def keyword_sentiment(
    df: DataFrame, stop_words: Sequence[str], *, top_n: int = 20, max_features: int = 2000,
    word_table: DataFrame | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """Strongest terms of all positive against all negative text, and the difference.

    Each class is one document, so the weight is the count over the length of the count vector.  The
    two ranked lists are combined by a conditional aggregate, which is their outer join.  ``stats`` are stored counts of at
    least the first ``max_features`` terms of each class, if there are any.
    """
    if stats is None:
        sides = F.col("sentiment").isin(*POLARITIES)
        sided = materialise(review_words(df.filter(sides), stop_words, ["sentiment"])) if word_table is None else word_table.filter(sides)
        stats = gram_counts(sided, [1, 2], ["sentiment"]).groupBy("sentiment", "term").agg(F.sum("total").alias("total"))
    counts = stats.select("sentiment", F.col("term").alias("keyword"), F.col("total").alias("tf"))
    order = [F.desc("tf"), F.col("keyword")]
    # How many terms have each count says which counts can be among the first max_features; only those are ranked.
    levels = counts.groupBy("sentiment", "tf").agg(F.count(F.lit(1)).alias("terms"))
    above = W.partitionBy("sentiment").orderBy(F.desc("tf")).rowsBetween(W.unboundedPreceding, -1)
    needed = levels.withColumn("above", F.coalesce(F.sum("terms").over(above), F.lit(0))).filter(
        F.col("above") < max_features).groupBy("sentiment").agg(F.min("tf").alias("least"))
    # One row a class, so the terms need not meet by class, where a task would hold half of them.
    frequent = counts.join(F.broadcast(needed), "sentiment").filter(F.col("tf") >= F.col("least"))
    kept = top_per_group(frequent, ["sentiment"], order, max_features, rank="_rank", spread_by=["keyword"])
    length = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(W.partitionBy("sentiment")))
    best = kept.withColumn("score", F.col("tf") / length).filter(F.col("_rank") <= top_n)

    def side(sentiment: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("sentiment") == sentiment, F.col("score"))), F.lit(0.0))

    merged = best.groupBy("keyword").agg(side("positive").alias("_p"), side("negative").alias("_n"))
    return merged.select(
        "keyword",
        half_even(F.col("_p"), 3).alias("positive_score"),
        half_even(F.col("_n"), 3).alias("negative_score"),
        half_even(F.col("_p") - F.col("_n"), 3).alias("sentiment_bias"),
    ).orderBy(F.desc("sentiment_bias"), "keyword")
