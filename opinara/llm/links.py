"""All links of the Jaccard join, not only those that connect components.

Links join rows of one component, so ``jaccard.components`` comes first and finds which texts can meet at all.  Within a
component every distinct set is searched for all its partners by the same T-occurrence search.  Equal texts are one
node with a number of copies; they are not expanded into pairs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import jaccard
from opinara.llm.frames import named, written


class Links(NamedTuple):
    """``members``: doc_id, node, n_shingles, a row for each row of the table (``node`` null: no words).

    ``pairs``: a, b with a < b, all pairs of different sets that link, each once.  ``copies``: node, copies.
    """

    members: DataFrame
    pairs: DataFrame
    copies: DataFrame


def _partners(blocks: DataFrame, sets: DataFrame, threshold: jaccard.Threshold) -> DataFrame:
    """All links within blocks (block, node, n); a block of many grams is cut into chunks, and all pairs of chunks meet."""
    total = blocks.groupBy("block").agg(F.sum("n").alias("block_n"), F.count("*").alias("held")).filter("held > 1").select(
        F.col("block").alias("of"), F.ceil(F.col("block_n") / jaccard.BLOCK_GRAMS).cast("int").alias("chunks"))
    own = blocks.join(total, F.col("block") == F.col("of")).withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "block", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def search(table: pa.Table) -> pa.Table:
        nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
        table = table.take(pa.array(at))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        chunk = table.column("own").to_numpy()
        held = table.column("grams").combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        first = np.append(0, np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False)))
        lists = jaccard._Lists(held.flatten().to_numpy(zero_copy_only=False), first)
        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in np.flatnonzero(chunk == i):
            found = lists.partners(x, threshold)
            # Where a chunk meets itself a pair is seen from both ends; where two meet, only pairs across count.
            found = found[(chunk[found] == j) & ((found > x) | (i != j))]
            low.append(np.minimum(nodes[x], nodes[found]))
            high.append(np.maximum(nodes[x], nodes[found]))
        return pa.table([pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], names=["a", "b"])

    return met.join(sets, "node").groupBy("block", "i", "j").applyInArrow(search, "a long, b long")


def links(df: DataFrame, identity: str = "doc_id", text: str = "text", width: int = 4,
          threshold: jaccard.Threshold = jaccard.Threshold()) -> Links:
    """Every link between different sets, and which rows hold each set.

    Sets, null and empty texts are as in ``jaccard.components``.  Rows are compared by their text, so null and
    repeated ids change nothing; other columns of ``df`` are not looked at.  Texts are told apart by 64-bit hashes.  An
    empty table gives empty tables.  A component of many grams costs the square of its chunks, as all of them may link.
    """
    docs = df.select(named(df, identity).cast("long").alias("doc_id"), named(df, text).cast("string").alias("text")).withColumn(
        "content", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    once = written(docs.filter("text IS NOT NULL").select(F.col("content").alias("doc_id"), "text").dropDuplicates(["doc_id"]),
                   "texts")
    # Sets are built once for each text: rows get theirs by the text's hash, the search takes those of the components.
    rows, sets = jaccard.grouped(once, width, threshold)
    rows = written(rows.select(F.col("doc_id").alias("content"), "node", "n", F.col("root").alias("block")), "grouped")
    members = written(docs.select("doc_id", "content").join(rows, "content", "left").select(
        "doc_id", "node", F.coalesce("n", F.lit(0)).alias("n_shingles")), "members")
    # Different texts may have equal sets; the search takes one of each.
    blocks = rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("block").alias("block"))
    pairs = written(_partners(blocks, sets, threshold), "pairs")
    copies = members.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"))
    return Links(members, pairs, copies)


def link_counts(df: DataFrame, identity: str = "doc_id", text: str = "text", width: int = 4,
                threshold: jaccard.Threshold = jaccard.Threshold()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``n_links``: to how many other rows each row links, copies included; see ``links``."""
    found = links(df, identity, text, width, threshold)
    both = found.pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        found.pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    near = both.join(found.copies.withColumnRenamed("node", "other"), "other").groupBy("node").agg(
        F.sum("copies").alias("near"))
    totals = found.copies.join(near, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return found.members.join(totals, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
