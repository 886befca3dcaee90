"""Word vectors by random indexing: a word is the sum of the signed marks of its neighbours, beyond what chance gives.

Every word owns ``MARKS`` signed places among ``dims``, taken from its MD5 digest, so no table of random vectors is kept.
All sums are whole numbers, so a vector does not depend on the order in which partitions arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.chunks import chunks, coded
from opinara.functions.text import with_computed
from opinara.session import scratch_path

#: Signed places of a word: eight hexadecimal digits of its digest each.
MARKS = 4
#: The largest absolute value of a component after rounding.
LARGEST = 127


#: Words of a chunk: its sums are one row of dims + 1 numbers for each distinct word.
CHUNK_WORDS = 1 << 18


def _marks(words: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the words, ``MARKS`` each."""
    digests = b"".join(md5(word.encode()).digest() for word in words.to_pylist())
    numbers = np.frombuffer(digests, ">u4").reshape(-1, 4)[:, :MARKS].astype(np.int64)
    return (numbers >> 1) % dims, 1 - 2 * (numbers % 2)


def neighbour_sums(word_table: DataFrame, dims: int, window: int) -> DataFrame:
    """(word, sums): the summed marks of the neighbours of a word in one chunk of reviews, and last their number."""
    if window < 1:
        raise ValueError("window must be at least 1")
    width = dims + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lengths in chunks(batch, "words", CHUNK_WORDS):
                codes, words = coded(part["words"].flatten())
                row = np.repeat(np.arange(len(lengths)), lengths)
                places, signs = _marks(words, dims)
                sums, met = np.zeros(len(words) * width), np.zeros(len(words), bool)
                for distance in range(1, window + 1):
                    near = (row[distance:] == row[:-distance]) & (codes[distance:] >= 0) & (codes[:-distance] >= 0)
                    left, right = codes[:-distance][near], codes[distance:][near]
                    for word, other in ((left, right), (right, left)):
                        met[word] = True
                        at = word * width
                        sums += np.bincount(at + dims, minlength=len(sums))
                        for mark in range(MARKS):
                            sums += np.bincount(at + places[other, mark], signs[other, mark], minlength=len(sums))
                found = np.flatnonzero(met)
                cells = sums.reshape(-1, width)[found].astype(np.int64).ravel()
                ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays(
                    [words.take(pa.array(found)), pa.ListArray.from_arrays(ends, pa.array(cells))], names=["word", "sums"])

    return word_table.select("words").mapInArrow(add, "word string, sums array<long>")


def neighbour_counts(word_table: DataFrame, window: int = 2) -> DataFrame:
    """(left, right, n): how often ``right`` comes at most ``window`` words after ``left`` in ``words``."""
    if window < 1:
        raise ValueError("window must be at least 1")
    words = F.col("words")
    pairs = F.concat(*[
        F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - d, F.lit(0))), F.slice(words, F.lit(d + 1), F.size(words)),
                   lambda left, right: F.struct(left.alias("left"), right.alias("right")))
        for d in range(1, window + 1)])
    return word_table.select(F.inline(pairs)).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


def word_vectors(word_table: DataFrame, *, dims: int = 64, window: int = 2) -> DataFrame:
    """(word, vector): ``dims`` whole numbers from -127 to 127 for each word that has a neighbour in ``words``.

    A component is the marks of the word's neighbours less the share that a word of this frequency has by chance, scaled
    so that the largest is 127.  Each chunk of reviews sums the marks of a word's neighbours, so a frequent word is one row of
    ``dims`` numbers for each chunk and no task holds its occurrences.  A word alone in its reviews
    has no vector; one whose neighbours are as chance has them is all zeros.
    """
    spark = word_table.sparkSession
    parts = [F.sum(F.get("sums", F.lit(d))).alias(f"d{d}") for d in range(dims + 1)]
    stored = scratch_path(spark, "word-sums")
    neighbour_sums(word_table, dims, window).groupBy("word").agg(*parts).write.parquet(stored)
    cells = spark.read.parquet(stored)
    values = F.array(*[F.col(f"d{d}").cast("double") for d in range(dims)])
    totals = cells.agg(*[F.sum(c).alias(c) for c in cells.columns if c != "word"])
    every = totals.select(F.struct(F.col(f"d{dims}").cast("double").alias("count"), values.alias("values"))).scalar()
    rows = with_computed(
        cells.select("word", F.col(f"d{dims}").cast("double").alias("count"), values.alias("values")), every=every)
    share = F.struct(F.col("count").alias("own"), F.col("every.count").alias("all"))
    rows = with_computed(rows, _columns=F.arrays_zip(
        F.col("values").alias("x"), F.col("every.values").alias("t"), F.array_repeat(share, dims).alias("n")))
    rows = with_computed(rows, _beyond=F.transform(
        "_columns", lambda c: c["x"] - c["n"]["own"] * c["t"] / c["n"]["all"]))
    rows = with_computed(rows, _top=F.array_max(F.transform("_beyond", F.abs)))
    scaled = F.transform(
        F.arrays_zip(F.col("_beyond").alias("x"), F.array_repeat("_top", dims).alias("top")),
        lambda v: F.when(v["top"] > 0, F.floor(v["x"] * float(LARGEST) / v["top"] + 0.5)).otherwise(0).cast("byte"))
    return rows.select("word", scaled.alias("vector"))
