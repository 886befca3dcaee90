"""Exact counts of the grams that can be among the first of their group, without a shuffle of all grams.

A first pass over the stored words adds up every gram in the hashed cells of a fixed array, so a cell is never less than the total
of a gram in it, and notes the frequent short grams of each chunk of reviews.  The sums of these notes are never more than a
total, so the n-th of a group says what total any of its first n has at least.  A second pass counts all grams whose cell
reaches that.  A gram is counted at all its places or at none, whatever its cell holds besides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions.chunks import chunks, coded, gram_codes, gram_texts
from opinara.operators.ranking import top_per_group
from opinara.session import discard, scratch_path, shuffles_freed, stored

#: Pieces in which a task hands over its array of cells.
_PIECES = 64
_MOST = np.iinfo(np.uint32).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Wanted:
    """The first ``n`` grams by total of those in ``min_df`` reviews at least and in a share ``max_df`` of them at most."""

    n: int
    min_df: int = 1
    max_df: float | None = None


@dataclass(frozen=True)
class Grams:
    """Runs of so many words in each group of ``keys``, and what is wanted of every group.

    Reviews without a key belong to no group; with ``values`` only these groups count.  There are two to the power ``bits`` cells.
    """

    sizes: tuple[int, ...]
    wanted: tuple[Wanted, ...]
    keys: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    bits: int = 20

    def member(self) -> Column:
        inside = F.lit(True)
        for key in self.keys:
            inside = inside & F.col(key).isNotNull()
            if self.values:
                inside = inside & F.col(key).isin(list(self.values))
        return inside

    def floor(self) -> int:
        return min(w.min_df for w in self.wanted)


class _Chunk:
    """The words of some reviews as codes, with hashes that are the same in every task."""

    def __init__(self, part: pa.RecordBatch, lengths: np.ndarray) -> None:
        self.part, self.rows = part, len(lengths)
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.codes, self.words = coded(part["words"].flatten())
        self.hashes = _hashes(self.words.cast(pa.binary()).to_pylist())
        self._grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def groups(self, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each review's group in the chunk, and a hash of its keys."""
        group, hashes = np.zeros(self.rows, np.int64), np.zeros(self.rows, np.uint64)
        for key in keys:
            codes, values = coded(self.part[key])
            group = np.unique(group * (codes.max() + 2) + codes + 1, return_inverse=True)[1]
            known = np.append(_hashes([repr(v).encode() for v in values.to_pylist()]), np.uint64(0))
            hashes = hashes * _MIX + known[codes]
        return group, hashes

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, code, hash) of every run of ``n`` words."""
        if n not in self._grams:
            starts, grams = gram_codes(self.codes, self.row, n)
            hashes = np.full(len(starts), n, np.uint64)
            for shift in range(n):
                hashes = hashes * _MIX + self.hashes[self.codes[starts + shift]]
            self._grams[n] = starts, grams, hashes
        return self._grams[n]

    def cells(self, n: int, owner: np.ndarray, bits: int) -> np.ndarray:
        starts, _, hashes = self.grams(n)
        mixed = (hashes ^ owner[self.row[starts]]) * _MIX
        return (((mixed ^ (mixed >> np.uint64(32))) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)

    def counted(self, n: int, kept: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the runs, df, total) of every distinct gram of a group, of the ``kept`` runs."""
        starts, grams, _ = self.grams(n)
        chosen = np.flatnonzero(kept)
        if not len(chosen):
            return (np.zeros(0, np.int64),) * 3
        reviews = self.row[starts[chosen]]
        pairs, groups = grams[chosen], int(group.max()) + 1
        if int(pairs.max()) >= (1 << 62) // groups:  # as places among the distinct ones, so that the group fits beside them
            pairs = np.unique(pairs, return_inverse=True)[1]
        pairs = pairs * groups + group[reviews]
        order = np.argsort(pairs, kind="stable")
        ordered, review = pairs[order], reviews[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])
        first = np.flatnonzero(fresh)
        seen = fresh | np.append(True, review[1:] != review[:-1])
        return chosen[order[first]], np.add.reduceat(seen, first, dtype=np.int64), np.diff(np.append(first, len(ordered)))


def _hashes(values: Sequence[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(v) for v in values), np.uint64, len(values)) * _MIX + np.uint64(1)


def _leading(group: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` greatest totals of each group."""
    order = np.lexsort((-total, group))
    starts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < n]


def frequent_grams(word_table: DataFrame, spaces: Mapping[str, Grams]) -> dict[str, DataFrame]:
    """(keys, term, df, total) for each name: exact counts of at least all grams that are wanted.

    ``word_table`` is stored ``review_words``.  Its words are read twice, whatever the number of spaces.  Each task holds
    the cells of all spaces and one chunk; notes are at most twice the number wanted for each chunk and group.
    """
    spark, specs = word_table.sparkSession, list(spaces.values())
    keys = sorted({key for s in specs for key in s.keys})
    fields = [T.StructField(k, word_table.schema[k].dataType) for k in keys]
    rows = word_table.select(*keys, "words", *[s.member().alias(f"_in{i}") for i, s in enumerate(specs)])

    def of_schema(schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], names=arrow.names)

        return batch

    def noted(batch, chunk: _Chunk, i: int, n: int, at: np.ndarray, df: np.ndarray, total: np.ndarray, **more) -> pa.RecordBatch:
        starts = chunk.grams(n)[0][at]
        return batch(
            len(at), space=pa.array(np.full(len(at), i, np.int32)), term=gram_texts(chunk.codes, chunk.words, starts, n),
            df=pa.array(df), total=pa.array(total), **{k: chunk.part[k].take(pa.array(chunk.row[starts])) for k in specs[i].keys}, **more)

    counts = [T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("total", T.LongType())]
    space = T.StructField("space", T.IntegerType())
    surveyed = T.StructType([space, *fields, *counts, T.StructField("cell", T.LongType()),
                             T.StructField("piece", T.IntegerType()), T.StructField("cells", T.BinaryType())])
    result = T.StructType([space, *fields, *counts])

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, sums = of_schema(surveyed), [np.zeros(1 << s.bits, np.uint32) for s in specs]
        for given in batches:
            for part, lengths in chunks(given, "words"):
                chunk = _Chunk(part, lengths)
                for i, s in enumerate(specs):
                    group, owner = chunk.groups(s.keys)
                    member = part[f"_in{i}"].to_numpy(zero_copy_only=False)
                    for n in s.sizes:
                        inside = member[chunk.row[chunk.grams(n)[0]]]
                        cells = chunk.cells(n, owner, s.bits)
                        np.add.at(sums[i], cells[inside], np.uint32(1))
                        if n > min(s.sizes):
                            continue
                        at, df, total = chunk.counted(n, inside, group)
                        best = _leading(group[chunk.row[chunk.grams(n)[0][at]]], total, 2 * max(w.n for w in s.wanted))
                        if len(best):
                            yield noted(batch, chunk, i, n, at[best], df[best], total[best], cell=pa.array(cells[at[best]]))
        for i, cells in enumerate(sums):
            pieces = [pa.compress(p.tobytes(), "zstd", asbytes=True) for p in np.split(cells, _PIECES)]
            yield batch(_PIECES, space=pa.array(np.full(_PIECES, i, np.int32)), piece=pa.array(np.arange(_PIECES, dtype=np.int32)),
                        cells=pa.array(pieces, pa.binary()))

    scratch = scratch_path(spark, "gram-survey")
    first = stored(rows.mapInArrow(survey, surveyed), "gram-survey", scratch)
    with shuffles_freed(spark):
        most = spark.sparkContext.broadcast(_cell_sums(first, specs))
    least = _least_totals(first, rows, specs, keys, most)

    limited = rows
    for i, s in enumerate(specs):
        own = least.filter(F.col("space") == i).select(*s.keys, F.col("least").alias(f"_least{i}"))
        if s.keys:
            limited = limited.join(own, list(s.keys), "left")
        else:
            limited = limited.withColumn(f"_least{i}", F.lit(next((row[0] for row in own.collect()), None)).cast("long"))
        limited = limited.withColumn(f"_least{i}", F.coalesce(f"_least{i}", F.lit(s.floor())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, bounds = of_schema(result), _unpacked(most.value)
        for given in batches:
            for part, lengths in chunks(given, "words"):
                chunk = _Chunk(part, lengths)
                for i, s in enumerate(specs):
                    group, owner = chunk.groups(s.keys)
                    member = part[f"_in{i}"].to_numpy(zero_copy_only=False)
                    needed = np.minimum(part[f"_least{i}"].to_numpy(zero_copy_only=False), _MOST)
                    for n in s.sizes:
                        review = chunk.row[chunk.grams(n)[0]]
                        reaches = bounds[i][chunk.cells(n, owner, s.bits)] >= needed[review]
                        at, df, total = chunk.counted(n, member[review] & reaches, group)
                        if len(at):
                            yield noted(batch, chunk, i, n, at, df, total)

    counted = limited.select(*rows.columns, *[f"_least{i}" for i in range(len(specs))]).mapInArrow(count, result)
    found = stored(counted.groupBy("space", *keys, "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "grams")
    discard(spark, scratch)
    most.destroy()
    return {name: found.filter(F.col("space") == i).select(*s.keys, "term", "df", "total")
            for i, (name, s) in enumerate(spaces.items())}


def _unpacked(pieces: list[list[tuple[int, bytes]]]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(pa.decompress(p, size, "zstd", asbytes=True), np.uint32) for size, p in own]) for own in pieces]


def _cell_sums(survey: DataFrame, specs: Sequence[Grams]) -> list[list[tuple[int, bytes]]]:
    """The cells of all tasks together, packed, for each space: at most four bytes a cell, whatever the number of reviews."""
    widths = [4 * (1 << s.bits) // _PIECES for s in specs]

    def add(group: pa.Table) -> pa.Table:
        number, piece = group["space"][0].as_py(), group["piece"][0].as_py()
        total = np.zeros(widths[number] // 4, np.uint64)
        for cells in group["cells"]:
            total += np.frombuffer(pa.decompress(cells.as_py(), widths[number], "zstd", asbytes=True), np.uint32)
        packed = pa.compress(np.minimum(total, _MOST).astype(np.uint32).tobytes(), "zstd", asbytes=True)
        return pa.table({"space": pa.array([number], pa.int32()), "piece": pa.array([piece], pa.int32()),
                         "cells": pa.array([packed], pa.binary())})

    pieces = survey.filter(F.col("piece").isNotNull()).select("space", "piece", "cells")
    summed = pieces.groupBy("space", "piece").applyInArrow(add, pieces.schema)
    sums = [[(width, pa.compress(bytes(width), "zstd", asbytes=True))] * _PIECES for width in widths]
    for row in summed.collect():
        sums[row.space][row.piece] = (widths[row.space], bytes(row.cells))
    return sums


def _least_totals(survey: DataFrame, rows: DataFrame, specs: Sequence[Grams], keys: Sequence[str], most) -> DataFrame:
    """(space, keys, least): a total that all wanted grams of the group have; groups with too few notes have no row."""
    notes = survey.filter(F.col("term").isNotNull()).groupBy("space", *keys, "term").agg(
        F.sum("df").alias("df"), F.sum("total").alias("total"), F.min("cell").alias("cell"))
    bounded = T.StructType([*notes.schema.fields, T.StructField("most", T.LongType())])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _unpacked(most.value)
        for batch in batches:
            number, cell = (batch[c].to_numpy(zero_copy_only=False) for c in ("space", "cell"))
            out = np.zeros(len(number), np.int64)
            for i, cells in enumerate(bounds):
                out[number == i] = cells[cell[number == i]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "most"])

    notes = stored(notes.mapInArrow(bound, bounded), "gram-notes")
    found = []
    for i, s in enumerate(specs):
        own = notes.filter(F.col("space") == i)
        reviews = rows.filter(f"_in{i}").groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_reviews"))
        own = own.join(reviews, list(s.keys)) if s.keys else own.crossJoin(reviews)
        for j, w in enumerate(s.wanted):
            # A gram is in no more reviews than it has occurrences, and these are no more than its cell.
            sure = F.lit(True) if w.max_df is None else F.col("most") <= F.col("_reviews") * w.max_df
            best = top_per_group(own.filter((F.col("df") >= w.min_df) & sure).select(*s.keys, "term", "total"), s.keys,
                                 [F.desc("total")], w.n, rank="_rank", spread_by=["term"])
            last = best.filter(F.col("_rank") == w.n)
            found.append(last.select(
                F.lit(i).alias("space"), F.lit(j).alias("_wanted"), *[F.col(k) if k in s.keys else F.lit(None).cast(
                    rows.schema[k].dataType).alias(k) for k in keys], F.col("total").alias("_total")))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    width = max(len(s.wanted) for s in specs)
    floors = F.array(*[F.array(*[F.lit(s.wanted[j].min_df if j < len(s.wanted) else None).cast("long") for j in range(width)])
                       for s in specs])
    totals = every.groupBy("space", *keys).agg(*[F.max(F.when(F.col("_wanted") == j, F.col("_total"))).alias(f"_t{j}") for j in range(width)])
    return stored(totals.select("space", *keys, F.array_min(F.array(*[
        F.coalesce(f"_t{j}", F.get(F.get(floors, F.col("space")), F.lit(j))) for j in range(width)])).alias("least")), "gram-least")
