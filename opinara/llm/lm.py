"""Hashed maximum-entropy language model with a class-factored softmax.

``P(word | history) = P(class | history) * P(word | class)``.  The end of a text, unknown words and the most frequent
words are classes of their own; other words fall into classes by their shape.  ``P(class | history)`` is a
maximum-entropy model whose features are hashed rows of one weight table: the word before (a bucket), the bucket with
the class two back (a hashed n-gram), the class two back alone (a skip feature) and a bias.  ``P(word | class)``
follows discounted counts.  Probabilities add up to 1 over the known words, one unknown word and the end.

How it is built, over all texts:

1. Tasks cut their texts into blocks of bounded size, each with a dictionary of its distinct words.
2. Dictionaries, not texts, are joined with the corpus counts, and meet their block again.  A frequent word is one row
   in each block, so no key is hot.
3. Each token becomes a cell (history, class).  Counts of cells are sufficient for training: there are at most
   ``HISTORIES * CLASSES`` of them at any size.  Gradient updates run over partitions of that table, the
   gradients are added up by Spark, and the driver holds one weight table.
4. Tasks turn weights into log probabilities of all cells once, and score texts by lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm import textkit
from opinara.llm.frames import named, written

CLASSES = 64
END, UNKNOWN, FREQUENT, SHAPES = 0, 1, 32, 30
BUCKETS = 2_048
HISTORIES = BUCKETS * CLASSES
NGRAM_ROWS = 8_192
#: Rows of the weight table: buckets, hashed n-grams, skips, bias.
ROWS = BUCKETS + NGRAM_ROWS + CLASSES + 1
BLOCK_TOKENS = 3_000_000
#: Words seen less often share the bucket of their class.
OWN_BUCKET = 64
DISCOUNT = 0.5
ROUNDS, STEP, SMOOTHING = 16, 0.4, 4.0
#: The table of cells has a bound, and so has the number of tasks that train on it.
TRAIN_TASKS = 8
_CHUNK = 64
_END_WORD, _END_SHAPE = -1, -1


def _shapes(words: textkit.Words, at: np.ndarray) -> np.ndarray:
    """Shape of words: letters beyond ASCII, last character, length; 0 to ``SHAPES - 1``."""
    starts, ends = words.starts[at], words.ends[at]
    beyond = np.append(0, np.cumsum(words.data >= 128))
    last = words.data[ends - 1]
    kind = np.select([(last >= 97) & (last <= 122) | (last >= 128), last == ord("."), last == ord(",")], [0, 1, 2], 3)
    length = np.searchsorted([4, 7, 11], ends - starts, side="right")
    shape = (beyond[ends] > beyond[starts]) * 16 + kind * 4 + length
    return np.minimum(shape, SHAPES - 1)


def tokenise(docs: DataFrame) -> DataFrame:
    """Rows of kind ``text`` (doc_id, held_out, ids within the block) and ``words`` (dictionary of the block)."""

    def block(number: int, ids: list, held: list, lists: list, shapes: list) -> list[pa.RecordBatch]:
        tokens = np.concatenate(lists)
        words, at, codes, seen = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
        # Frequent words first: small numbers are cheap to store and to send.
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        words, at, codes = words[order], at[order], rank[codes.reshape(-1)]
        lengths = [len(x) for x in lists]
        counts = np.bincount(codes[~np.repeat(np.array(held, bool), lengths)], minlength=len(words))
        shape = np.concatenate(shapes)[at]
        n = len(ids)
        first = np.append(0, np.cumsum(lengths))
        none, whole = np.zeros(n + 1, np.int32), np.array([0, len(words)])

        def rows(kind, block_ids, doc_ids, held_out, codes_list, dictionary):
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(block_ids)), pa.array(block_ids, pa.int64()), doc_ids,
                 pa.array(held_out, pa.bool_()), codes_list, *dictionary],
                names=["kind", "block", "doc_id", "held_out", "ids", "words", "counts", "shapes"])

        empty = [textkit.list_array(np.zeros(0, np.int64), none, t) for t in (pa.int64(), pa.int64(), pa.int32())]
        return [
            rows("text", [number] * n, pa.array(ids, pa.int64()), held,
                 textkit.list_array(codes, first, pa.int32()), empty),
            rows("words", [number], pa.nulls(1, pa.int64()), [False],
                 textkit.list_array(np.zeros(0, np.int32), np.zeros(2, np.int32), pa.int32()),
                 [textkit.list_array(v, whole, t) for v, t in
                  ((words, pa.int64()), (counts, pa.int64()), (shape.astype(np.int32), pa.int32()))]),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, lists, shapes, size = [], [], [], [], 0
        for batch in batches:
            doc_ids, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop, words in textkit.slices(batch.column(2), lower=True):
                tokens = words.hashes.view(np.int64)
                forms = _shapes(words, np.arange(len(tokens)))
                for i in range(stop - start):
                    some = slice(words.first[i], words.first[i + 1])
                    ids.append(doc_ids[start + i])
                    held.append(flags[start + i])
                    lists.append(np.append(tokens[some], _END_WORD))
                    shapes.append(np.append(forms[some], _END_SHAPE).astype(np.int8))
                    size += len(lists[-1])
                    if size >= BLOCK_TOKENS:
                        yield from block(number, ids, held, lists, shapes)
                        ids, held, lists, shapes, size = [], [], [], [], 0
                        number += 1
        if ids:
            yield from block(number, ids, held, lists, shapes)

    return docs.mapInArrow(
        run, "kind string, block long, doc_id long, held_out boolean, ids array<int>, words array<long>, "
             "counts array<long>, shapes array<int>")


def _totals(entries: DataFrame) -> DataFrame:
    """Dictionary entries with the word's training count in the whole corpus, by one shuffle of entries.

    A word is one row in each block that has it.  ``first`` marks one of these rows; the word itself goes on only if it is
    frequent enough to have a bucket or class of its own.
    """
    same = Window.partitionBy("word")
    total = F.sum("n").over(same)
    first = F.row_number().over(same.orderBy("block")) == 1
    return entries.select(
        "block", "place", "shape", total.alias("n"), first.alias("first"),
        F.when(total >= OWN_BUCKET, F.col("word")).alias("word"))


class Vocabulary(NamedTuple):
    """Training tokens, distinct words, the frequent words in order, and each class's discounted count."""

    train_tokens: int
    distinct: int
    frequent: np.ndarray
    mass: np.ndarray

    def classes(self, words: np.ndarray, counts: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        out = np.where(counts == 0, UNKNOWN, shapes + UNKNOWN + FREQUENT + 1)
        out[shapes == _END_SHAPE] = END
        for i, word in enumerate(self.frequent.tolist()):
            out[(words == word) & (counts >= OWN_BUCKET) & (shapes != _END_SHAPE)] = i + UNKNOWN + 1
        return out

    def log_shares(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of P(word | class); a class of one word needs none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            shares = np.log10((counts - DISCOUNT) / self.mass[classes])
        return np.where(classes <= UNKNOWN + FREQUENT, 0.0, shares)


def _vocabulary(totals: DataFrame) -> Vocabulary:
    """Bounded facts about the words: one row for each shape, and the few most frequent words."""
    once = totals.filter("first AND n > 0")
    by_shape = {r["shape"]: r for r in once.groupBy("shape").agg(
        F.sum("n").alias("n"), F.count("*").alias("words"), (F.sum("n") - DISCOUNT * F.count("*")).alias("mass")).collect()}
    frequent = once.filter((F.col("n") >= OWN_BUCKET) & (F.col("shape") != _END_SHAPE)).orderBy(
        F.desc("n"), "word").select("word", "n", "shape").limit(FREQUENT).collect()
    mass = np.ones(CLASSES)
    for shape, row in by_shape.items():
        if shape != _END_SHAPE:
            own = sum(r["n"] - DISCOUNT for r in frequent if r["shape"] == shape)
            mass[UNKNOWN + FREQUENT + 1 + shape] = max(row["mass"] - own, DISCOUNT)
    return Vocabulary(sum(r["n"] for r in by_shape.values()), sum(r["words"] for r in by_shape.values()),
                      np.array([r["word"] for r in frequent], np.int64), mass)


def _bucket(words: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    hashed = CLASSES + (textkit.mix(words.view(np.uint64)) % np.uint64(BUCKETS - CLASSES)).astype(np.int64)
    return np.where((counts >= OWN_BUCKET) & (classes != END), hashed, classes)


def _cells(tokenised: DataFrame, totals: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row for each text: facts, base score, sum of word shares, and its tokens' cells.

    A cell is ``history * CLASSES + class``; that of a word seen once in training is stored as ``-1 - cell``, since
    training counts such words as unknown ones.
    """
    found = totals.select(F.col("block").alias("of_block"), F.col("place").cast("int").alias("place"), "n",
                          F.col("shape").cast("byte").alias("shape"), "word")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("place").to_numpy())
        counts = right.column("n").to_numpy()[order]
        shapes = right.column("shape").to_numpy()[order].astype(np.int64)
        words = right.column("word").fill_null(0).to_numpy()[order]
        classes = vocabulary.classes(words, counts, shapes)
        shares = vocabulary.log_shares(counts, classes)
        buckets = _bucket(words, counts, classes)
        lists = left.column("ids").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        first = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))[:-1]
        sizes = np.diff(np.append(first, len(codes)))
        before, two_before = np.full(len(codes), END), np.full(len(codes), END)
        token_class, token_bucket = classes[codes], buckets[codes]
        before[1:], two_before[2:] = token_bucket[:-1], token_class[:-2]
        before[first] = END
        two_before[first] = END
        two_before[first[sizes > 1] + 1] = END
        cells = (before * CLASSES + two_before) * CLASSES + token_class
        once = (counts == 1)[codes] & (token_class > UNKNOWN + FREQUENT)
        cells = np.where(once, -1 - cells, cells)
        base = np.log10(counts + 1.0) - np.log10(vocabulary.train_tokens + vocabulary.distinct + 1.0)
        return pa.table([
            left.column("doc_id"), left.column("held_out"), pa.array(sizes),
            pa.array(np.add.reduceat((counts > 0)[codes].astype(np.int64), first)),
            pa.array(np.add.reduceat(base[codes], first)), pa.array(np.add.reduceat(shares[codes], first)),
            textkit.list_array(cells.astype(np.int32), np.append(first, len(codes)), pa.int32()),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "share_score", "cells"])

    texts = tokenised.filter("kind = 'text'").select("block", "doc_id", "held_out", "ids")
    return texts.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, share_score double, "
             "cells array<int>")


def _cell_counts(cells: DataFrame) -> DataFrame:
    """``history``, ``class``, ``n`` over the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at.reshape(-1), weights=np.concatenate([n for _, n in held]))

        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            once = values < 0
            values[once] = (-1 - values[once]) // CLASSES * CLASSES + UNKNOWN
            held.append(np.unique(values, return_counts=True))
            size += len(held[-1][0])
            if len(held) > 1 and size > 4_000_000:
                held = [merge()]
                size = 0
        if held:
            keys, counts = merge()
            chunks = _rows_of(keys // CLASSES)[1] // _CHUNK
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks.astype(np.int32)), pa.array((keys // CLASSES).astype(np.int32)),
                 pa.array((keys % CLASSES).astype(np.int32)), pa.array(counts.astype(np.int64))],
                names=["chunk", "history", "class", "n"])

    counted = cells.filter("NOT held_out").select("cells").mapInArrow(run, "chunk int, history int, class int, n long")
    # Tasks have added up their own cells.  Histories whose n-gram rows are close meet in one task, so most of the weight
    # table comes from one task only; the number of cells has a bound.
    return counted.repartition(TRAIN_TASKS, "chunk").groupBy("chunk", "history", "class").agg(
        F.sum("n").alias("n")).select("history", "class", "n")


def _rows_of(histories: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the weight table that are active for each history, besides the bias."""
    bucket, skip = histories // CLASSES, histories % CLASSES
    ngram = (textkit.mix(histories.astype(np.uint64)) % np.uint64(NGRAM_ROWS)).astype(np.int64)
    return bucket, BUCKETS + ngram, BUCKETS + NGRAM_ROWS + skip


def _log_probabilities(weights: np.ndarray, histories: np.ndarray) -> np.ndarray:
    scores = weights[-1] + sum(weights[rows] for rows in _rows_of(histories))
    scores -= scores.max(1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(1, keepdims=True))


def _sum_rows(rows: np.ndarray, values: np.ndarray, into: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    into[rows[starts]] += np.add.reduceat(values[order], starts, axis=0)


def _packed(weights: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers and single-precision values of the rows that are not zero; only these are sent to tasks."""
    rows = np.flatnonzero(weights.any(axis=1)).astype(np.int32)
    return rows.tobytes(), weights[rows].astype(np.float32).tobytes()


def _unpacked(packed: tuple[bytes, bytes]) -> np.ndarray:
    table = np.zeros((ROWS, CLASSES))
    table[np.frombuffer(packed[0], np.int32)] = np.frombuffer(packed[1], np.float32).reshape(-1, CLASSES)
    return table


def _table_sums(counts: DataFrame, sent: Broadcast | None) -> np.ndarray:
    """Observed counts (without weights) or expected ones of every weight, added up by Spark in chunks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((ROWS, CLASSES))
        weights = None if sent is None else _unpacked(sent.value)
        for batch in batches:
            history, word_class, n = (c.to_numpy() for c in batch.columns)
            histories, at = np.unique(history.astype(np.int64), return_inverse=True)
            at = at.reshape(-1)
            for start in range(0, len(histories), 16_384):
                some = histories[start : start + 16_384]
                inside = (at >= start) & (at < start + len(some))
                seen = np.bincount((at[inside] - start) * CLASSES + word_class[inside], weights=n[inside],
                                   minlength=len(some) * CLASSES).reshape(-1, CLASSES)
                if weights is not None:
                    seen = np.exp(_log_probabilities(weights, some)) * seen.sum(1, keepdims=True)
                for rows in _rows_of(some):
                    _sum_rows(rows, seen, table)
                table[-1] += seen.sum(0)
        task = TaskContext.get().partitionId()
        for chunk in range(0, ROWS, _CHUNK):
            part = table[chunk : chunk + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int32()), pa.array([task], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())],
                    names=["chunk", "task", "sums"])

    def add(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("task").to_pylist(), table.column("sums").to_pylist()))
        total = sum(np.frombuffer(part, np.float32).astype(np.float64) for _, part in parts)
        return pa.table([table.column("chunk").slice(0, 1), pa.array([total.tobytes()], pa.binary())],
                        names=["chunk", "sums"])

    summed = counts.mapInArrow(run, "chunk int, task int, sums binary").groupBy("chunk").applyInArrow(
        add, "chunk int, sums binary").collect()
    out = np.zeros((ROWS, CLASSES))
    for row in summed:
        part = np.frombuffer(bytes(row["sums"])).reshape(-1, CLASSES)
        out[row["chunk"] : row["chunk"] + len(part)] = part
    return out


def train(counts: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by gradient updates, each scaled by the expected count of its weight."""
    observed = _table_sums(counts, None)
    weights = np.zeros((ROWS, CLASSES))
    weights[-1] = np.log(observed[-1] + 1e-3)
    for _ in range(rounds):
        # Each round's weights leave the driver's and the executors' disks before the next round's are sent.
        sent = counts.sparkSession.sparkContext.broadcast(_packed(weights))
        expected = _table_sums(counts, sent)
        sent.destroy()
        weights += np.clip(STEP * (observed - expected) / (expected + SMOOTHING), -1, 1)
    return weights


@lru_cache(maxsize=1)
def _cell_scores(weights: tuple[bytes, bytes]) -> np.ndarray:
    table = _unpacked(weights)
    out = np.empty((HISTORIES, CLASSES), np.float32)
    for start in range(0, HISTORIES, 16_384):
        histories = np.arange(start, min(start + 16_384, HISTORIES))
        out[histories] = _log_probabilities(table, histories) / np.log(10)
    return out.reshape(-1)


def score(df: DataFrame, is_held_out: Column, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of each row.

    It learns from all rows where ``is_held_out`` (a condition on ``doc_id``) is not true and scores all rows.  Null and
    empty texts hold the end only.  Equal rows get equal scores, ties in frequency go by hash, a null id
    is learned from, and an empty table gives an empty result.
    """
    docs = df.select(named(df, identity).cast("long").alias("doc_id"),
                     named(df, text).cast("string").alias("text"))
    docs = docs.select("doc_id", F.coalesce(is_held_out, F.lit(False)).alias("held_out"), "text")
    tokenised = written(tokenise(docs), "tokens", "kind")
    entries = tokenised.filter("kind = 'words'").select(
        "block", F.posexplode(F.arrays_zip("words", "counts", "shapes")).alias("place", "e")).select(
        "block", "place", F.col("e.words").alias("word"), F.col("e.counts").alias("n"), F.col("e.shapes").alias("shape"))
    totals = written(_totals(entries), "totals")
    vocabulary = _vocabulary(totals)
    train_tokens = vocabulary.train_tokens
    cells = written(_cells(tokenised, totals, vocabulary), "cells")
    counts = written(_cell_counts(cells), "cell-counts")
    sent = df.sparkSession.sparkContext.broadcast(_packed(train(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _cell_scores(sent.value)
        for batch in batches:
            lists = batch.column(6)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            values = np.where(values < 0, -1 - values, values)
            first = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))[:-1]
            sums = np.add.reduceat(table[values].astype(np.float64), first) if len(first) else np.zeros(0)
            total = pa.array(sums + batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(np.full(batch.num_rows, train_tokens)), batch.column(4), total],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return cells.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
