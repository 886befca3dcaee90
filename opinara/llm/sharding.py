"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in source groups by a hash of their identity.  How many rows of group i go to shard j is drawn exactly from
the multivariate hypergeometric law that a uniform shuffle implies, given the groups' sizes and the shards'
exact sizes.  Each group is then permuted locally and cut by its row of that matrix, rows are exchanged by
shard, and each shard is permuted again.  Only counts leave the executors: one per group, and groups have a
fixed expected size, so the matrix has about (rows / ``GROUP_ROWS``) x shards entries.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm.frames import fresh, named, written
from opinara.llm.ordering import digits_for

N_SHARDS = 8
GROUP_ROWS = 5_000
SEED = 20240229


def communication_matrix(group_sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Rows per (group, shard): the margins are exact, the law is that of a uniform shuffle."""
    random = np.random.default_rng(seed)
    left = np.array(shard_sizes, np.int64)
    matrix = np.zeros((len(group_sizes), len(shard_sizes)), np.int64)
    for i, size in enumerate(group_sizes):
        matrix[i] = _draw(random, left, size)
        left -= matrix[i]
    return matrix


def _draw(random: np.random.Generator, left: np.ndarray, size: int) -> np.ndarray:
    """One multivariate hypergeometric draw by its marginals, which numpy limits to 10^9 each."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for j, n in enumerate(left.tolist()):
        rest -= n
        if size == 0:
            break
        if rest == 0:
            out[j] = size
        elif n:
            if n + rest < 10**9:
                out[j] = random.hypergeometric(n, rest, size)
            else:
                # Sampling a small group out of so many rows: exact by drawing row by row in blocks.
                out[j] = _sequential(random, n, rest, size)
        size -= int(out[j])
    return out


def _sequential(random: np.random.Generator, good: int, bad: int, size: int) -> int:
    taken = 0
    for i, u in enumerate(random.random(size)):
        taken += u * (good + bad - i) < good - taken
    return taken


def shard(df: DataFrame, identity: str = "doc_id", text: str = "text", n_shards: int = N_SHARDS,
          group_rows: int = GROUP_ROWS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``df`` plus ``shard`` and ``slot``, moved to their shard and permuted there.

    Shard sizes differ by one at most; ``slot`` is gapless from 0 in each shard.  Rows with the same identity are
    told apart by their text and then by their other columns (maps excepted); equal rows are interchangeable.  Whole rows
    move twice: to their source group and to their shard.  ``df`` is read twice and has to give the same rows.
    New names get a suffix if ``df`` has them.
    """
    columns = [f"c{i}" for i in range(len(df.columns))]
    told_apart = [named(df, c) for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]
    content = F.coalesce(named(df, text).cast("string"), F.lit("")).cast("binary")
    wide = df.select(*(named(df, c).alias(n) for n, c in zip(columns, df.columns)), named(df, identity).alias("doc_id"),
                     (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"),
                     F.xxhash64(*told_apart).alias("rest"))
    identity_text = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size")
    wide = wide.withColumns({
        "draw": F.md5(F.concat(identity_text, F.lit(f":draw:{seed}"))),
        "place": F.md5(F.concat(identity_text, F.lit(f":place:{seed}"))),
    })
    # The matrix and the offsets of cells need numbers only.
    rows = written(wide.drop(*columns), "shard-rows")
    n_rows = rows.count()
    n_groups = max(1, math.ceil(n_rows / group_rows))
    group = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_groups)).cast("int")
    sizes = dict(rows.withColumn("grp", group).groupBy("grp").count().collect())
    shard_sizes = [n_rows // n_shards + (j < n_rows % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([sizes.get(i, 0) for i in range(n_groups)], shard_sizes, seed)
    cuts = written(rows.sparkSession.createDataFrame(
        [(i, np.cumsum(matrix[i]).tolist()) for i in range(n_groups)],
        T.StructType([T.StructField("cut_group", T.IntegerType()), T.StructField("cuts", T.ArrayType(T.LongType()))]),
    ), "shard-cuts")
    ties = [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("rest")]
    cell = F.substring("place", 1, digits_for(n_rows // n_shards + 1))

    def dealt(some: DataFrame) -> DataFrame:
        """Each group permuted and cut by its row of the matrix."""
        local = some.withColumn("grp", group).withColumn(
            "n", F.row_number().over(Window.partitionBy("grp").orderBy("draw", *ties)))
        return local.join(cuts, F.col("grp") == F.col("cut_group")).withColumns({
            "shard": F.size(F.filter("cuts", lambda c: c < F.col("n"))).cast("int"), "cell": cell}).drop("cuts")

    totals = dealt(rows).groupBy("shard", "cell").agg(F.count("*").alias("held"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # Written first, so that Spark knows the table's size when it chooses the join.
    offsets = written(totals.select(F.col("shard").alias("of_shard"), F.col("cell").alias("of_cell"),
                                    F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before")), "shard-offsets")
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("place", *ties)) - 1
    placed = dealt(wide).withColumn("inside", inside).join(
        offsets, (F.col("shard") == F.col("of_shard")) & (F.col("cell") == F.col("of_cell")))
    return placed.select(
        *(F.col(n).alias(c) for n, c in zip(columns, df.columns)), F.col("shard").alias(fresh(df, "shard")),
        (F.col("before") + F.col("inside")).cast("long").alias(fresh(df, "slot")))


def shard_rows(df: DataFrame, identity: str = "doc_id", text: str = "text", n_shards: int = N_SHARDS,
               group_rows: int = GROUP_ROWS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` of each row of ``shard``.

    Law ``rows``.  Size is the UTF-8 bytes (null: none) plus 1 of the text that has arrived in the shard, and the
    checksum of a null text is that of an empty one.
    """
    placed = shard(df, identity, text, n_shards, group_rows, seed)
    content = F.coalesce(named(placed, text).cast("string"), F.lit("")).cast("binary")
    return placed.select(
        named(placed, identity).alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"), F.lit("rows").alias("law"), placed[placed.columns[-2]].alias("shard"),
        placed[placed.columns[-1]].alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
