"""Hard negatives by exact inner-product search with coordinate pruning.

Rows lie in buckets of nearly equal length, cut by hash into blocks; the longest come first.  A block holds its vectors and, for
each coordinate, the list of its unit vectors' values in ascending order.  An anchor asks a block for rows that reach
a score: the score bounds the angle between the two, and the angle bounds every coordinate of the row (a cap around the
anchor's direction, seen along one axis).  On the anchor's focus coordinates, its largest ones, these feasible ranges
are stretches of the sorted lists; their intersection is verified exactly on the whole numbers.  Where the ranges rule out less
than half of a block, all its rows are verified in one product.

Two passes: the best rows of the anchor's own label give the positives, then their scores give the bounds between which
negatives of other labels are sought.  In each, blocks are visited from long to short, and what has been found so far raises
the score that is asked of later ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.frames import named, written

BLOCK_ROWS, PART_ROWS, LANE_BLOCKS = 8_192, 1_024, 2
#: Buckets of lengths within a factor of e^(1 / BUCKETS_PER_E).
BUCKETS_PER_E = 8
FOCUS = 4
#: Components of this size or more would overflow a score.
LARGEST = 1 << 25
_STEP = 64
_SLACK = 1e-6


class Block(NamedTuple):
    """Vectors of one block by ascending id; ``order[f]`` lists its rows by their unit vectors' coordinate ``f``."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    unit: np.ndarray
    order: np.ndarray
    longest: float


def feasible(focus: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of a unit vector's coordinates whose cosine with a unit vector of these coordinates is at least ``cosine``."""
    axis, cap = np.arccos(np.clip(focus, -1, 1)), math.acos(min(1.0, max(-1.0, cosine)))
    return np.cos(np.minimum(math.pi, axis + cap)) - _SLACK, np.cos(np.maximum(0.0, axis - cap)) + _SLACK


def candidates(anchor: np.ndarray, block: Block, score: float) -> np.ndarray | None:
    """Rows of ``block`` that may reach ``score`` with ``anchor``; ``None`` if the lists rule out less than half."""
    norm = float(np.sqrt(np.dot(anchor, anchor)))
    if score <= 0 or norm == 0:
        return np.zeros(0, np.int64) if score > 0 else None
    reach = norm * block.longest
    if score > reach * (1 + 1e-9):
        return np.zeros(0, np.int64)
    direction = anchor / norm
    focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
    low, high = feasible(direction[focus], score / reach)
    spans = []
    for f, a, b in zip(focus, low, high):
        values = block.unit[block.order[f], f]
        spans.append((np.searchsorted(values, a), np.searchsorted(values, b, side="right")))
    widths = [b - a for a, b in spans]
    best = int(np.argmin(widths))
    if widths[best] * 2 > len(block.ids):
        return None
    some = block.order[focus[best]][slice(*spans[best])].astype(np.int64)
    for k, f in enumerate(focus):
        if k != best:
            value = block.unit[some, f]
            some = some[(value >= low[k]) & (value <= high[k])]
    return np.sort(some)


def top(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, ties by place."""
    if len(scores) > k:
        level = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores >= level)
        rows, scores = rows[above], scores[above]
    order = np.lexsort((rows, -scores))[:k]
    return rows[order], scores[order]


def _verified(anchors: np.ndarray, block: Block, asked: np.ndarray, useful: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(anchor, rows, exact scores)`` for each anchor whose candidates are not empty; only ``useful`` anchors are asked."""
    open_ = []
    for i in np.flatnonzero(useful):
        some = candidates(anchors[i].astype(np.float64), block, float(asked[i]))
        if some is None:
            open_.append(i)
        elif len(some):
            yield i, some, block.vectors[some] @ anchors[i]
    everything = np.arange(len(block.ids))
    for at in range(0, len(open_), _STEP):
        part = open_[at : at + _STEP]
        for i, scores in zip(part, anchors[part] @ block.vectors.T):
            yield i, everything, scores


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _number_kind(largest: int, dimension: int) -> type:
    """Doubles where they hold every score exactly, else long integers."""
    return np.float64 if largest * largest * dimension < 1 << 53 else np.int64


def _build(table: pa.Table) -> pa.Table:
    """One row: a block as binaries (ids, labels, vectors, sorted coordinate lists)."""
    table = table.combine_chunks().sort_by("vec_id")
    n = table.num_rows
    vectors = _matrix(table.column("v").combine_chunks(), n).astype(np.int64)
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    unit = vectors / np.where(norms > 0, norms, 1)[:, None]
    order = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32)
    stored = np.ascontiguousarray(vectors, np.int16 if np.abs(vectors).max() < 1 << 15 else np.int32)
    return pa.table({
        "block": table.column("block").slice(0, 1), "n": [n], "ids": [table.column("vec_id").to_numpy().astype(np.int64).tobytes()],
        "labels": [table.column("label_key").to_numpy().tobytes()], "vectors": [stored.tobytes()], "lists": [np.ascontiguousarray(order).tobytes()]})


def _read(row: dict, kind: type) -> Block:
    n = row["n"]
    d = len(row["lists"]) // (4 * n)
    whole = np.frombuffer(row["vectors"], np.int16 if len(row["vectors"]) == 2 * n * d else np.int32).reshape(n, d)
    vectors = whole.astype(kind)
    norms = np.sqrt((whole.astype(np.float64) ** 2).sum(1))
    unit = whole / np.where(norms > 0, norms, 1)[:, None]
    order = np.frombuffer(row["lists"], np.int32).reshape(d, n)
    return Block(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), vectors, unit, order, float(norms.max()))


def _blocks(lanes: pa.Table, kind: type) -> Iterator[Block]:
    for i in np.argsort(lanes.column("block").to_numpy(), kind="stable"):
        yield _read(lanes.slice(int(i), 1).to_pylist()[0], kind)


def _largest(left: pa.Table, right: pa.Table, dimension: int) -> type:
    """The number kind that is exact for all vectors of both sides; blocks of short integers are below 2^15."""
    wide = any(len(v) != 2 * n * dimension for v, n in zip(right.column("vectors").to_pylist(), right.column("n").to_pylist()))
    own = int(np.abs(_matrix(left.column("v").combine_chunks(), left.num_rows)).max(initial=0))
    return _number_kind(max(own, LARGEST if wide else 1 << 15), dimension)


def _positives(k: int, dimension: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if left.num_rows and right.num_rows:
            kind = _largest(left, right, dimension)
            anchors = _matrix(left.column("v").combine_chunks(), left.num_rows).astype(kind)
            ids, keys, labels = (left.column(c).to_numpy() for c in ("vec_id", "row_key", "label_key"))
            found: list[np.ndarray] = [np.zeros(0)] * len(ids)
            for block in _blocks(right, kind):
                # The k-th best so far must be reached.
                asked = np.array([f[k - 1] if len(f) == k else -np.inf for f in found])
                for i, rows, scores in _verified(anchors, block, asked, np.isin(labels, block.labels)):
                    own = (block.labels[rows] == labels[i]) & (block.ids[rows] != ids[i])
                    rows, scores = top(rows[own], scores[own], k)
                    found[i] = -np.sort(-np.concatenate([found[i], scores]))[:k]
                    for store, value in zip(out, (np.full(len(rows), keys[i]), np.full(len(rows), ids[i]), block.ids[rows], scores)):
                        store.append(value.astype(np.int64))
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["row_key", "anchor_id", "other_id", "score"])

    return find


def _negatives(k: int, low: int, high: int, dimension: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        if left.num_rows and right.num_rows:
            kind = _largest(left, right, dimension)
            anchors = _matrix(left.column("v").combine_chunks(), left.num_rows).astype(kind)
            keys, labels = (left.column(c).to_numpy() for c in ("row_key", "label_key"))
            wanted = [np.array(p, np.int64) for p in left.column("positive_scores").to_pylist()]
            least = [-(-low * p // 100) for p in wanted]
            most = [high * p // 100 for p in wanted]
            found = [[np.zeros(0)] * len(p) for p in wanted]
            for block in _blocks(right, kind):
                # For each positive the k-th best so far, at least its lower bound; the least of these must be reached.
                asked = np.full(len(keys), np.inf)
                for i, (a, b) in enumerate(zip(least, most)):
                    for j in np.flatnonzero(a <= b):
                        asked[i] = min(asked[i], max(a[j], found[i][j][k - 1]) if len(found[i][j]) == k else a[j])
                for i, rows, scores in _verified(anchors, block, asked, np.isfinite(asked)):
                    other = (block.labels[rows] != labels[i]) & (scores >= asked[i])
                    rows, scores = rows[other], scores[other]
                    for j in np.flatnonzero(least[i] <= most[i]):
                        inside = (scores >= least[i][j]) & (scores <= most[i][j])
                        some, best = top(rows[inside], scores[inside], k)
                        found[i][j] = -np.sort(-np.concatenate([found[i][j], best]))[:k]
                        for store, value in zip(out, (np.full(len(some), keys[i]), np.full(len(some), j), block.ids[some], best)):
                            store.append(value.astype(np.int64))
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["row_key", "place", "negative_id", "negative_score"])

    return find


def mine(df: DataFrame, is_anchor: Column, identity: str = "vec_id", label: str = "label", vector: str = "vector",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``vector`` holds whole numbers; a score is an inner product with the anchor, higher first, ties by smaller id.  An anchor's
    positives are its first ``positives`` rows of the same label; for each of them come the first ``negatives`` rows of other
    labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``, ranked from 1.  ``is_anchor`` is a
    condition on ``vec_id``.  Rows with an anchor's id are neither its positives nor its negatives.

    Rows without an id, a label or a vector, with a null component or one of 2^25 or more in size, or whose vector's length is
    not the most frequent one (the smaller on ties) take no part.  Equal rows count once; an id may have several vectors.
    Without anchors, positives or fitting negatives there are no rows.
    """
    v = named(df, vector).cast("array<long>")
    usable = named(df, identity).isNotNull() & named(df, label).isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & (F.abs(x) < LARGEST))
    rows = df.filter(usable).select(named(df, identity).cast("long").alias("vec_id"),
                                    F.xxhash64(named(df, label).cast("string")).alias("label_key"), v.alias("v")).distinct()
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
    bucket = F.when(length > 0, F.floor(F.log(length) * BUCKETS_PER_E)).otherwise(-1).cast("int")
    rows = written(rows.withColumns({"bucket": bucket, "row_key": F.xxhash64("vec_id", "label_key", "v")}), "lemp-rows")
    by_length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = by_length["d"] if by_length else 0
    rows = rows.filter(F.size("v") == dimension)
    # Blocks are numbered from the longest bucket down; there are at most a few hundred buckets.
    counts = sorted(((r["bucket"], r["count"]) for r in rows.groupBy("bucket").count().collect()), reverse=True)
    numbers, n_blocks = {}, 0
    for b, count in counts:
        numbers[b] = (n_blocks, math.ceil(count / block_rows))
        n_blocks += numbers[b][1]
    if not dimension or not n_blocks:
        numbers, n_blocks = {0: (0, 1)}, 1
    first = F.create_map(*(F.lit(x) for b, (at, _) in numbers.items() for x in (b, at)))[F.col("bucket")]
    width = F.create_map(*(F.lit(x) for b, (_, n) in numbers.items() for x in (b, n)))[F.col("bucket")]
    rows = rows.withColumn("block", (first + F.pmod(F.xxhash64("row_key"), width)).cast("int"))
    anchors = rows.filter(is_anchor)
    n_parts = max(1, math.ceil(anchors.count() / PART_ROWS))
    anchors = anchors.select("vec_id", "row_key", "label_key", "v", F.pmod(F.xxhash64("row_key", F.lit(1)), F.lit(n_parts)).cast("int").alias("part"))
    blocks = written(rows.select("block", "vec_id", "label_key", "v").groupBy("block").applyInArrow(
        _build, "block int, n long, ids binary, labels binary, vectors binary, lists binary"), "lemp-blocks")
    last = (n_blocks - 1) // LANE_BLOCKS
    held = blocks.withColumns({"lane": F.floor(F.col("block") / LANE_BLOCKS).cast("int"),
                               "part": F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))}).groupBy("part", "lane")

    def asked(some: DataFrame):
        return some.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(last)))).groupBy("part", "lane")

    near = asked(anchors).cogroup(held).applyInArrow(
        _positives(positives, dimension), "row_key long, anchor_id long, other_id long, score long")
    order = Window.partitionBy("row_key").orderBy(F.desc("score"), "other_id")
    near = near.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < positives)
    near = written(near, "lemp-positives")
    scores = near.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("place", "score")))["score"].alias("positive_scores"))
    known = anchors.join(scores, "row_key")
    hard = asked(known).cogroup(held).applyInArrow(
        _negatives(negatives, low, high, dimension), "row_key long, place long, negative_id long, negative_score long")
    order = Window.partitionBy("row_key", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    positive = near.select("row_key", F.col("place").cast("long").alias("place"), "anchor_id",
                           F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(positive, ["row_key", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
