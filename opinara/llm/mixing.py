"""Mixing sources to target weights: random order within each source, cut at each source's exact budget.

Every document gets a hash-random key.  Within its source documents are ordered by that key, running sums of their
word counts say where each one lies, and the source's budget cuts there: whole epochs first, then the
documents (and the part of one document) that still fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.frames import fresh, n_words, named, written
from opinara.llm.ordering import digits_for, running

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``target`` from a table of one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes.  A target
    stops at ``most_epochs`` times its source's size and the excess is shared again by weight, until none is
    above.  That end state is a level L: a source gets the smaller of its limit and L times its weight.
    Sources fill up in order of limit / weight, so running sums in that order give L without repeating.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    limited = sizes.withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), (place + 1).cast("int")))
    limited = limited.withColumn("limit", F.col("source_size") * float(most_epochs))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = limited.select(
        "source", "source_size", "weight", "limit",
        (
            (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        ).alias("level"),
    )
    # The level is that of the first source, in filling order, which does not fill up.
    first_open = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(
        F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return levels.withColumn("final", first_open).select(
        "source", "source_size",
        F.when(F.col("final").isNull() | (F.col("final") * F.col("weight") > F.col("limit")), F.col("limit"))
        .otherwise(F.col("final") * F.col("weight")).alias("target"),
    )


def _key(identity: Column, seed: str) -> Column:
    text = F.concat(F.coalesce(identity.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.md5(text)


def mix(df: DataFrame, identity: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS,
        seed: str = SEED) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` for each row of ``df``.

    ``taken`` counts words with repeats; in each source it adds up to the target rounded down.  A text without
    words (null, empty) has size 0 and is never taken.  Rows with the same identity and text are interchangeable; a
    null identity is a value like any other, and so is a null source.  An empty table gives an empty result.
    """
    rows = df.select(named(df, identity).alias("doc_id"), named(df, source).alias("source"),
                     n_words(named(df, text)).alias("size"), F.xxhash64(named(df, text)).alias("content"),
                     _key(named(df, identity), seed).alias("key"))
    rows = written(rows, "mix-sizes")
    # One row per source from a partially aggregated pass.
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most_epochs)
    targets = targets.withColumnRenamed("source", "target_source")
    placed = running(rows, ["source"], "key", [F.col("doc_id"), F.col("content")], {"before": F.col("size")},
                     digits_for(rows.count()))
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("target_source")))
    budget = F.floor("target")
    left = budget - F.floor(budget / F.greatest("source_size", F.lit(1))) * F.col("source_size")
    taken = F.col("size") * F.floor(budget / F.greatest("source_size", F.lit(1))) + F.greatest(
        F.lit(0), F.least(F.col("size"), left - F.col("before")))
    return joined.select("doc_id", "source", "content", "size", "source_size", "target",
                         taken.cast("long").alias("taken"))


def materialise(df: DataFrame, identity: str = "doc_id", text: str = "text", source: str = "source",
                **settings) -> DataFrame:
    """The mix as rows: each row of ``df`` as many times as its words are taken, all columns kept.

    A document of which only a part is taken (at most one in a source) comes whole.
    """
    taken = mix(df, identity, text, source, **settings).filter("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("content").alias("_content"),
        F.ceil(F.col("taken") / F.col("size")).cast("int").alias("_times")).distinct()
    content = fresh(df, "_row_content")
    rows = df.withColumn(content, F.xxhash64(named(df, text)))
    # Repeated rows may be taken a different number of times; each then gets the larger number.
    taken = taken.groupBy("_id", "_source", "_content").agg(F.max("_times").alias("_times"))
    matched = rows.join(taken, named(rows, identity).eqNullSafe(F.col("_id"))
                        & named(rows, source).eqNullSafe(F.col("_source")) & (F.col(content) == F.col("_content")))
    epoch = fresh(df, "_epoch")
    repeated = matched.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return repeated.select(*(named(repeated, c) for c in df.columns))
