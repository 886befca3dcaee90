"""Keep-first, top-n and running totals that hold when one group has a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cells of a running total: a task sums about this part of all rows.
CELLS = 256


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order_by`` (which should be a total order).

    The leading hash makes the sort compare numbers first; the real keys still decide.  Spark turns
    the rank filter into a limit per group before the shuffle, so copies are dropped on the map side.
    """
    window = W.partitionBy("_key_hash", *keys).orderBy(*order_by)
    return (
        df.withColumn("_key_hash", F.xxhash64(*keys))
        .withColumn("_position", F.row_number().over(window))
        .filter("_position = 1")
        .drop("_key_hash", "_position")
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], n: int, *,
    rank: str = "rank", spread_by: Sequence[str] = (), buckets: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group with their 1-based rank; exact, and one plan for every n.

    With ``spread_by`` a group is first limited within hash buckets of these columns (by default as many as the session
    has shuffle partitions), so that no task sorts a whole large group.
    """
    if not keys:
        head = df.orderBy(*order_by).limit(n)
        return head.withColumn(rank, F.row_number().over(W.orderBy(*order_by)))
    if spread_by:
        buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        local = W.partitionBy(*keys, "_bucket").orderBy(*order_by)
        df = (
            df.withColumn("_bucket", F.pmod(F.xxhash64(*spread_by), F.lit(buckets)))
            .withColumn("_local", F.row_number().over(local))
            .filter(F.col("_local") <= n)
            .drop("_bucket", "_local")
        )
    window = W.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def running_total(
    df: DataFrame, key: Column, order_by: Sequence[Column], value: Column, name: str, *, total: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Inclusive running sum of ``value`` over the whole table in the order ``order_by``, and optionally its grand total.

    ``key`` is a number that never falls along that order and is never NULL.  A window without a partition would pull
    everything into one task.  Here approximate percentiles of the key cut the rows into at most ``CELLS`` cells, each cell is
    summed on its own, and the cells' totals give every cell its offset.  It is one lazy plan: the percentiles are a scalar
    subquery of it.  A ``bounded`` key, one of few whole parts such as a percentage, cuts the rows at whole numbers instead, and
    needs no subquery.  All readers of ``df`` ask for all its columns, so that they share its last shuffle.  Rows of equal
    key share a cell.
    """
    keyed = df.withColumns({"_key": key.cast("double"), "_value": value})
    whole = F.max(F.xxhash64(*keyed.columns))
    if bounded:
        cells = keyed.withColumn("_cell", F.greatest(F.least(F.floor("_key"), F.lit(CELLS)), F.lit(-CELLS)))
    else:
        steps = F.lit([i / CELLS for i in range(1, CELLS)])
        bounds = keyed.agg(F.struct(F.percentile_approx("_key", steps, F.lit(10 * CELLS)).alias("p"), whole.alias("w"))).scalar()["p"]
        cell = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col("_key"))), F.lit(0))
        cells = keyed.withColumn("_bounds", bounds).withColumn("_cell", cell).drop("_bounds")
    before = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.groupBy("_cell").agg(F.sum("_value").alias("_sum"), whole.alias("_whole")).select(
        "_cell",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(W.partitionBy(F.lit(1))).alias("_total"), "_whole",
    )
    inside = W.partitionBy("_cell").orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    summed = cells.withColumn("_inside", F.sum("_value").over(inside)).join(F.broadcast(offsets), "_cell")
    summed = summed.filter(F.col("_whole").isNotNull()).withColumn(name, F.col("_inside") + F.col("_offset"))
    if total:
        summed = summed.withColumn(total, F.col("_total"))
    return summed.drop("_key", "_cell", "_value", "_inside", "_offset", "_total", "_whole")


def global_rank(
    df: DataFrame, key: Column, order_by: Sequence[Column], name: str = "rank", *, bounded: bool = False
) -> DataFrame:
    """1-based position of every row in the whole table; see ``running_total`` for ``key``."""
    return running_total(df, key, order_by, F.lit(1).cast("long"), name, bounded=bounded)


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row with the interpolated median of ``column`` (NULLs left out), without one big sort task."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, F.col(column), [F.col(column)], F.col("_n"), "_upto", total="_all")
    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1

    def covers(position: Column) -> Column:
        return (F.col("_upto") >= position) & (F.col("_upto") - F.col("_n") < position)

    middle = ranked.filter(covers(lower) | covers(upper))
    return middle.agg(((F.min(column) + F.max(column)) / 2.0).alias(column))
