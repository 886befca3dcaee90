"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Each vector v is coded relative to the mean c of all vectors: the signs of the rotated residual (packed bits) and
two scalars, the residual's length r and the code's inner product with the unit residual.  From these an
inner product with a query follows without bias, together with an error bound that holds with high
probability.  Only vectors whose upper bound reaches the k-th best lower bound are reranked on the original numbers.

Queries are a stated set.  Vectors and queries lie in blocks by hash, so no task holds more than a block of each,
and each pair of blocks gives at most k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.frames import named, written

BLOCK_ROWS, QUERY_ROWS = 8_192, 1_024
#: Width of the bounds in standard deviations of the estimate.
EPSILON = 3.5
SEED = 20240229
_STEP = 128


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bits, length, agreement)``: packed signs, residual lengths, inner products of code and unit residual."""
    residual = (vectors - centre) @ turn.T
    length = np.linalg.norm(residual, axis=1)
    agreement = np.abs(residual).sum(1) / np.sqrt(vectors.shape[1]) / np.where(length > 0, length, 1)
    return np.packbits(residual >= 0, axis=1), length, np.where(length > 0, agreement, 1.0)


def estimate(queries: np.ndarray, bits: np.ndarray, length: np.ndarray, agreement: np.ndarray, centre: np.ndarray,
             turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x codes) and the half width of their bounds."""
    d = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    rotated = (queries @ turn.T / np.sqrt(d)).astype(np.float32)
    scale = (length / agreement).astype(np.float32)
    products = (rotated @ signs.T) * scale + (queries @ centre).astype(np.float32)[:, None]
    spread = scale * np.sqrt(np.maximum(1 - agreement**2, 0)) * (epsilon / math.sqrt(max(d - 1, 1)))
    # Single precision adds its own small error.
    norms = np.linalg.norm(queries, axis=1)
    return products, (norms[:, None] * (spread + 1e-5 * (length + np.linalg.norm(centre)))[None]).astype(np.float32)


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bits: np.ndarray,
                  length: np.ndarray, agreement: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int,
                  epsilon: float = EPSILON) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its place, and ids and exact scores of the up to k nearest of the block."""
    for at in range(0, len(queries), _STEP):
        some = queries[at : at + _STEP]
        products, half = estimate(some, bits, length, agreement, centre, turn, epsilon)
        own = query_ids[at : at + _STEP, None] == ids[None]
        upper = products + half
        lower = products - half
        lower[own] = -np.inf
        upper[own] = -np.inf
        if len(ids) > k:
            level = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            level = np.full(len(some), -np.inf)
        for i in range(len(some)):
            rerank = np.flatnonzero((upper[i] >= level[i]) & ~own[i])
            # Row by row, so that copies get the same score to the last bit and their ids decide.
            scores = (vectors[rerank] * some[i]).sum(axis=1)
            order = np.lexsort((ids[rerank], -scores))[:k]
            yield at + i, ids[rerank][order], scores[order]


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    flat = table.column(name).combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def build_index(df: DataFrame, identity: str = "vec_id", vector: str = "embedding",
                block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``(index, centre, rotation)``: every vector that takes part, with its code, in a written table.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an
    id, nor vectors whose length is not the most frequent one (the smaller on ties).  A repeated row counts
    once; an id may have several vectors.
    """
    v = named(df, vector).cast("array<double>")
    usable = named(df, identity).isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(named(df, identity).cast("long").alias("vec_id"), v.alias("v")).filter(usable).distinct()
    rows = written(rows, "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension, n = (lengths["d"], lengths["count"]) if lengths else (1, 0)
    rows = rows.filter(F.size("v") == dimension)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimension)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array(total)], names=["i", "s"])

    # One number for each dimension and task, added up.
    totals = dict(rows.select("v").mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s")).collect())
    # Rounded, so that the order in which tasks arrive does not show.
    centre = np.round(np.array([totals.get(i, 0.0) for i in range(dimension)]) / max(n, 1), 6)
    turn = rotation(dimension)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            bits, length, agreement = encode(matrix, centre, turn)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(agreement)],
                names=["vec_id", "v", "block", "bits", "length", "agreement"])

    n_blocks = max(1, math.ceil(n / block_rows))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int"))
    coded = blocked.mapInArrow(
        code, "vec_id long, v array<double>, block int, bits binary, length double, agreement double")
    return written(coded, "codes"), centre, turn


def search(df: DataFrame, is_query: Column, identity: str = "vec_id", vector: str = "embedding", k: int = 20,
           block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, epsilon: float = EPSILON) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k nearest vectors of each query row.

    ``is_query`` is a condition on ``vec_id``.  Candidates are all rows but those with the query's own id.  Scores are
    inner products of the original numbers in double precision; ties go to the smaller id.  See ``build_index`` for the
    vectors that take part; without any the result is empty.
    """
    index, centre, turn = build_index(df, identity, vector, block_rows)
    queries = index.filter(is_query).select(F.col("vec_id").alias("query_id"), "v")
    n_queries, n_blocks = queries.count(), (index.agg(F.max("block")).first()[0] or 0) + 1
    n_parts = max(1, math.ceil(n_queries / query_rows))
    part = F.pmod(F.xxhash64("query_id", "v"), F.lit(n_parts)).cast("int")
    asked = queries.withColumn("query_key", F.xxhash64("query_id", "v")).withColumn("part", part).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    schema = "query_id long, query_key long, vec_id long, score double"

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)] + [[np.zeros(0)]]
        if left.num_rows and right.num_rows:
            query_ids, keys = (left.column(c).to_numpy() for c in ("query_id", "query_key"))
            width = len(right.column("bits")[0].as_py())
            bits = np.frombuffer(b"".join(right.column("bits").to_pylist()), np.uint8).reshape(-1, width)
            for i, ids, scores in best_of_block(
                query_ids, _matrix(left, "v"), right.column("vec_id").to_numpy(), _matrix(right, "v"), bits,
                right.column("length").to_numpy(), right.column("agreement").to_numpy(), centre, turn, k, epsilon,
            ):
                for store, value in zip(out, (np.full(len(ids), query_ids[i]), np.full(len(ids), keys[i]), ids, scores)):
                    store.append(value)
        names = ["query_id", "query_key", "vec_id", "score"]
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=names)

    found = asked.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(nearest, schema)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
