"""Connected components of a link table by large stars and the forests of parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.frames import written

#: Links that a task holds at most before it makes stars of them.
HELD = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, smallest)``: each node of these links that is not the smallest one that they reach from it, once."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at.reshape(2, -1)
    low = np.arange(len(nodes))
    while len(x):
        # The smallest nodes of both ends, the larger one moved below the smaller, until nodes are below their smallest.
        x, y = low[x], low[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def _forests(links: DataFrame) -> DataFrame:
    """``u``, ``v`` with u > v: the stars of the links (two long columns) that a task has, never more rows than these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def made() -> tuple[np.ndarray, np.ndarray]:
            return stars(*(np.concatenate(ends) for ends in zip(*held)))

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= HELD:
                held = [made()]
                n = len(held[0][0])
                if n > HELD // 2:
                    # The last node goes on, so that all links of a node meet if they come in order.
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:-1]) for ends in held[0]], names=["u", "v"])
                    held, n = [tuple(ends[-1:] for ends in held[0])], 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(ends) for ends in made()], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` that is no ``u`` itself."""
    others = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    return (edges.join(others, F.col("v") == F.col("n"), "left_semi").isEmpty()
            and edges.join(others, (F.col("u") == F.col("n")) & (F.col("v") < F.col("m")), "left_semi").isEmpty())


def connected(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for each node of ``links`` (``a``, ``b`` long).

    Tasks first make stars of the links they have.  Every round then moves links towards smaller nodes with partially
    aggregated minima and an equi-join, deals them by their larger node and makes stars of each part again.  A node with
    very many links is never gathered in one task: Spark splits its join partition, and only a row for each node and task
    is dealt.  Rounds end when all links are stars; each is written, so lineage stays short and a lost
    executor costs one round.
    """
    edges = written(_forests(links.select("a", "b").filter("a <> b")), "links")
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, as Spark splits a large partition of a join only if both sides are dealt for it.
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("n"), F.least("u", "m").alias("m")), "smallest")
        large = edges.join(low, F.col("v") == F.col("n")).select("u", "m")
        edges = written(_forests(_forests(large).repartition("u").sortWithinPartitions("u")), "links")
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")),
                             F.struct(F.col("v").alias("node"), F.col("v").alias("root")))).alias("e")
    return edges.select(ends).groupBy("e.node").agg(F.min("e.root").alias("root"))
