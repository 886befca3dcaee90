"""Jaccard join of n-gram sets by T-occurrence search with DivideSkip.

Two sets link when their Jaccard similarity reaches a threshold, given as a fraction so that decisions are exact.  A set
x needs an overlap of at least ``ceil(t |x|)`` with any partner, so under one global order of grams (frequent
ones last) partners share a gram of their prefixes, and as many more as the prefixes are longer.

1. Sets are built from whole texts; equal sets become one node.
2. Grams that very many prefixes hold are put last in the order; at most ``HOT`` of them exist by construction.
3. Prefix grams that only one node holds, or that no node of fitting size shares, are dropped, then nodes with too few:
   a long text that shares some phrases with others does not meet them at all.
4. Nodes meet in blocks, and a T-occurrence search finds the links of each block: inverted lists over the whole sets,
   short lists merged by count, the long ones probed by binary search.  Round one sends every node to the
   block of one frequent gram, which gathers groups of near copies; large blocks are dealt into chunks, twice and
   differently.  Round two keeps grams that still join different components.  Nodes that such grams connect are a
   family, and every family is a block, so a node is sent once however many grams it shares.
5. Links become components.  Nothing is capped: a family with too many grams for one task is cut into
   chunks, and all pairs of chunks meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm import textkit
from opinara.llm.components import connected
from opinara.llm.frames import named, written

#: Grams in more than 1 / HOT of all prefix entries go last; there can be no more than HOT of them.
HOT = 65_536
#: Grams that the prefixes of partners share at least: a sixteenth of the smaller set, of what is beyond LONG a third.
LEAST_SHARED, SHARED_PART, LONG, LONG_PART = 4, 16, 1_024, 3
#: Grams of all sets that one block holds at most, before it is cut into chunks.
BLOCK_GRAMS = 250_000


@dataclass(frozen=True)
class Threshold:
    """Similarity ``num / den``."""

    num: int = 85
    den: int = 100

    def least_overlap(self, size):
        """``ceil(t * size)``: what a set of this size shares with any partner."""
        return -(-self.num * size // self.den)

    def pair_overlap(self, a, b):
        """``ceil(t (a + b) / (1 + t))``: what makes sets of these sizes partners."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, size):
        shared = np.maximum(LEAST_SHARED, np.minimum(size, LONG) // SHARED_PART) + np.maximum(size - LONG, 0) // LONG_PART
        return size - self.least_overlap(size) + np.minimum(shared, size)

    def least_shared(self, size: Column) -> Column:
        """Prefix grams that a set of this size shares with any partner, which may be smaller."""
        smaller = F.ceil(size * self.num / self.den)
        shared = F.greatest(F.lit(LEAST_SHARED), F.floor(F.least(smaller, F.lit(LONG)) / SHARED_PART)) + F.floor(
            F.greatest(smaller - LONG, F.lit(0)) / LONG_PART)
        return F.least(smaller, shared)


def _sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from_row, to_row, grams, first)`` of whole texts."""
    for start, stop, words in textkit.slices(texts, lower=True):
        rows, hashes = textkit.shingles(words, width)
        yield start, stop, *textkit.sets_by_row(rows, hashes, stop - start)


def _node(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def hot_grams(texts: DataFrame, width: int, threshold: Threshold) -> np.ndarray:
    """The grams to put last, rarest first.  Any choice is right; this one keeps blocks small.

    Tasks count prefix grams of their own rows and hand on those they saw twice or more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)

        for batch in batches:
            for _, _, grams, first in _sets(batch.column(0), width):
                sizes = np.diff(first)
                keep = np.arange(len(grams)) - np.repeat(first[:-1], sizes) < np.repeat(threshold.prefix(sizes), sizes)
                keys, counts = np.unique(grams[keep], return_counts=True)
                total += int(keep.sum())
                held.append((keys, counts))
                if len(held) >= 32:
                    held = [merged()]
        if held:
            keys, counts = merged()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(keys[counts > 1], 0)), pa.array(np.append(counts[counts > 1], 0)),
                 pa.array(np.append(np.zeros((counts > 1).sum(), np.int64), total))], names=["gram", "n", "total"])

    counted = written(texts.mapInArrow(count, "gram long, n long, total long").groupBy("gram").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")), "gram-counts")
    total = counted.agg(F.sum("total")).first()[0] or 0
    # Fewer than HOT grams can each be more than 1 / HOT of the total.
    most = counted.filter((F.col("n") * HOT > total) & (F.col("n") >= 32)).orderBy("n", "gram").select("gram").toPandas()
    return most["gram"].to_numpy(np.int64)


def _ordered(grams: np.ndarray, first: np.ndarray, hot: np.ndarray, by_value: np.ndarray) -> np.ndarray:
    """Grams of each row in the global order: rare ones by value, then hot ones from rare to frequent."""
    place = np.zeros(len(grams), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot[by_value], grams), len(hot) - 1)
        found = hot[by_value][at] == grams
        place[found] = by_value[at[found]] + 1
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return grams[np.lexsort((grams, place, rows))]


def prefixes(docs: DataFrame, width: int, threshold: Threshold, hot: np.ndarray) -> DataFrame:
    """``doc_id``, ``node``, ``n`` and the prefix of the set, for each row of ``docs`` (doc_id, text)."""
    by_value = np.argsort(hot, kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, grams, first in _sets(batch.column(1), width):
                sizes = np.diff(first)
                nodes = np.array([_node(grams[a:b]) for a, b in zip(first, first[1:])], np.int64)
                ordered = _ordered(grams, first, hot, by_value)
                lengths = np.where(sizes > 0, np.minimum(threshold.prefix(sizes), sizes), 0)
                keep = np.arange(len(grams)) - np.repeat(first[:-1], sizes) < np.repeat(lengths, sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(nodes, mask=sizes == 0), pa.array(sizes),
                     textkit.list_array(ordered[keep], np.append(0, np.cumsum(lengths)), pa.int64())],
                    names=["doc_id", "node", "n", "prefix"])

    return docs.mapInArrow(run, "doc_id long, node long, n long, prefix array<long>")


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """``node`` and its whole set, for each text that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, grams, first in _sets(batch.column(0), width):
                first = first[np.append(True, np.diff(first) > 0)]  # rows without words have no set
                nodes = [_node(grams[a:b]) for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), textkit.list_array(grams, first, pa.int64())], names=["node", "grams"])

    return texts.mapInArrow(run, "node long, grams array<long>")


class _Lists:
    """Inverted lists over the sets of one block."""

    def __init__(self, grams: np.ndarray, first: np.ndarray):
        sizes = np.diff(first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        _, code, counts = np.unique(grams, return_inverse=True, return_counts=True)
        self.codes, self.first, self.sizes = code.reshape(-1), first, sizes
        self.postings = owner[np.argsort(self.codes, kind="stable")]  # ascending within each list
        self.starts = np.append(0, np.cumsum(counts))

    def partners(self, x: int, threshold: Threshold) -> np.ndarray:
        """All sets that reach the required overlap with set ``x``, itself left out."""
        lists = self.codes[self.first[x] : self.first[x + 1]]
        lengths = self.starts[lists + 1] - self.starts[lists]
        shared = lengths > 1
        lists, lengths = lists[shared], lengths[shared]
        needed = int(threshold.least_overlap(self.sizes[x]))
        if len(lists) < needed:
            return np.zeros(0, np.int64)
        order = np.argsort(lengths, kind="stable")
        lists, lengths = lists[order], lengths[order]
        # DivideSkip: this many of the longest lists are probed, the others merged.
        n_long = min(needed - 1, int(needed / (0.01 * np.log2(max(lengths[-1], 2)) + 1)), len(lists))
        n_short = len(lists) - n_long
        short = lists[:n_short]
        total = int(lengths[:n_short].sum())
        # Merge of the short lists: one sorted run, in which an owner's repeats are its count.
        offsets = np.repeat(self.starts[short] - np.append(0, np.cumsum(lengths[:n_short])[:-1]), lengths[:n_short])
        merged = np.sort(self.postings[np.arange(total) + offsets], kind="stable")
        starts = np.flatnonzero(np.append(True, merged[1:] != merged[:-1])) if total else np.zeros(0, np.int64)
        owners, counts = merged[starts], np.diff(np.append(starts, total))
        kept = (counts >= needed - n_long) & (owners != x)
        owners, counts = owners[kept], counts[kept]
        need = threshold.pair_overlap(self.sizes[x], self.sizes[owners])
        for done, gram in enumerate(lists[n_short:]):
            alive = counts + (n_long - done) >= need
            owners, counts, need = owners[alive], counts[alive], need[alive]
            if not len(owners):
                break
            run = self.postings[self.starts[gram] : self.starts[gram + 1]]
            at = np.minimum(np.searchsorted(run, owners), len(run) - 1)
            counts += run[at] == owners
        return owners[counts >= need]


def block_links(nodes: np.ndarray, components: np.ndarray, grams: np.ndarray, first: np.ndarray,
                threshold: Threshold) -> list[tuple[int, int]]:
    """Links that join everything in the block that its links join, given the components known before.

    Sets of the largest component are searched for only if that is needed: a pair is seen from either end.
    """
    n = len(nodes)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = [1] * n

    def join(i: int, j: int) -> bool:
        i, j = find(i), find(j)
        if i == j:
            return False
        if size[i] < size[j]:
            i, j = j, i
        parent[j] = i
        size[i] += size[j]
        return True

    known: dict[int, int] = {}
    for i, c in enumerate(components.tolist()):
        join(known.setdefault(c, i), i)
    lists = _Lists(grams, first)
    out, waiting = [], list(range(n))
    largest = max(range(n), key=lambda i: size[find(i)])
    while waiting:
        skipped = []
        for x in waiting:
            largest = find(largest)
            if size[largest] == n:
                return out
            if find(x) == largest:
                skipped.append(x)
                continue
            for y in lists.partners(x, threshold).tolist():
                if join(x, y):
                    out.append((int(nodes[x]), int(nodes[y])))
            if size[find(x)] > size[find(largest)]:
                largest = x
        # Who was skipped for a component that is no longer the largest is searched for after all.
        waiting = [x for x in skipped if find(x) != find(largest)]
    return out


def _links(blocks: DataFrame, sets: DataFrame, threshold: Threshold, deal: int | None = None) -> DataFrame:
    """Links within blocks; ``blocks``: block, node, n, component.

    A block of many grams is cut into chunks.  All pairs of chunks meet, or with ``deal`` the number of a random deal,
    only nodes of the same chunk do.
    """
    total = blocks.groupBy("block").agg(F.sum("n").alias("block_n"), F.count("*").alias("held")).filter(
        "held > 1").select(F.col("block").alias("of"), F.ceil(F.col("block_n") / BLOCK_GRAMS).cast("int").alias("chunks"))
    own = blocks.join(total, F.col("block") == F.col("of")).withColumn(
        "own", F.pmod(F.xxhash64("node", F.lit(deal or 0)), F.col("chunks")).cast("int"))
    if deal is None:
        own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    else:
        own = own.withColumn("other", F.col("own"))
    placed = own.select(
        "block", "node", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    loaded = placed.join(sets, "node")

    def search(table: pa.Table) -> pa.Table:
        nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
        table = table.take(pa.array(at))
        lists = table.column("grams").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        first = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        grams = lists.flatten().to_numpy(zero_copy_only=False)
        found = block_links(nodes, table.column("component").to_numpy(), grams, first, threshold)
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                        names=["a", "b"])

    return loaded.groupBy("block", "i", "j").applyInArrow(search, "a long, b long")


def _with_enough(entries: DataFrame, threshold: Threshold) -> DataFrame:
    """Entries of the nodes that have as many of them as any partner would share."""
    n_shared = F.count("*").over(Window.partitionBy("node"))
    return entries.withColumn("n_shared", n_shared).filter(
        F.col("n_shared") >= threshold.least_shared(F.col("n"))).drop("n_shared")


def _rooted(entries: DataFrame, found: DataFrame) -> DataFrame:
    """``entries`` with the component of their node so far."""
    return entries.join(found, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found`` (node, root) as further links join them."""
    return found if links.isEmpty() else connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def _across(entries: DataFrame) -> DataFrame:
    """Entries of the grams that nodes of different components hold, with the number of these nodes."""
    grams = entries.groupBy("gram").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("held")).filter(
        "low <> high").select("gram", "held")
    return entries.drop("held").join(grams, "gram")


class Grouped(NamedTuple):
    """``rows``: doc_id, node, n, root, lowest; ``sets``: node, grams of at least the nodes that link with others."""

    rows: DataFrame
    sets: DataFrame


def components(df: DataFrame, identity: str = "doc_id", text: str = "text", width: int = 4,
               threshold: Threshold = Threshold()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for each row of ``df``.

    Words are those of ``textkit`` with A-Z in lower case.  The set of a text holds its distinct shingles of ``width``
    words; with fewer words, the whole sequence as one.  Null texts and texts without words have an empty set, link
    with nothing and are their own component.  Equal sets always link.  ``component_id`` is the smallest
    id that links reach; a null id is never the smallest unless all are null.  An empty table gives an
    empty result.
    """
    docs = df.select(named(df, identity).cast("long").alias("doc_id"), named(df, text).cast("string").alias("text"))
    return grouped(docs, width, threshold).rows.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"))


def grouped(docs: DataFrame, width: int, threshold: Threshold) -> Grouped:
    """The components of ``docs`` (doc_id, text) with the sets that were searched; ``lowest`` is the smallest id of a component."""
    hot = hot_grams(docs.select("text"), width, threshold)
    rows = written(prefixes(docs, width, threshold, hot), "prefixes")
    members = rows.filter("node IS NOT NULL")
    nodes = written(members.groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), F.first("prefix").alias("prefix")),
                    "nodes")
    # Entries of the inverted index of prefixes, without grams that no other node of fitting size holds.
    entries = nodes.select("node", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("gram"))
    in_order = Window.partitionBy("gram").orderBy("n", "node")
    before, after = F.lag("n").over(in_order), F.lead("n").over(in_order)
    fits = (before * threshold.den >= F.col("n") * threshold.num) | (F.col("n") * threshold.den >= after * threshold.num)
    shared = entries.withColumn("fits", fits).filter("fits").drop("fits")
    active = written(_with_enough(shared, threshold), "active")
    holders = active.groupBy("gram").agg(F.count("*").alias("held"))
    first_blocks = written(active.join(holders, "gram").groupBy("node", "n").agg(
        F.max(F.struct("held", "gram"))["gram"].alias("block")), "blocks")
    ids = nodes.join(first_blocks.select("node"), "node", "left_semi").select(F.col("doc_id").alias("id"))
    texts = docs.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    sets = written(sets_of(texts, width), "sets")
    links = written(_links(first_blocks.withColumn("component", F.col("node")), sets, threshold, 1), "links")
    found = connected(links)
    large = first_blocks.groupBy("block").agg(F.sum("n").alias("block_n")).filter(F.col("block_n") > BLOCK_GRAMS)
    dealt_anew = _rooted(first_blocks.join(large.select("block"), "block"), found)
    found = _joined(found, written(_links(dealt_anew, sets, threshold, 2), "links"))
    known = _across(_rooted(active, found))
    for _ in range(2):
        known = _across(_with_enough(known, threshold))
    known = written(_with_enough(known, threshold), "meeting")
    # Partners share least_shared of these entries, so they meet even if each leaves out all but one of so many.
    in_order = Window.partitionBy("node").orderBy("held", "gram")
    routed = known.withColumns({
        "at": F.row_number().over(in_order), "entries": F.count("*").over(Window.partitionBy("node"))})
    routed = written(_across(routed.filter(
        F.col("at") <= F.col("entries") - threshold.least_shared(F.col("n")) + 1)), "routed")
    firsts = routed.groupBy("gram").agg(F.min("node").alias("a"))
    families = connected(routed.join(firsts, "gram").select("a", F.col("node").alias("b")))
    blocks = routed.select("node", "n", "component").distinct().join(families, "node").withColumnRenamed("root", "block")
    found = _joined(found, written(_links(blocks, sets, threshold), "links"))
    rooted = rows.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("lowest"))
    return Grouped(rooted.join(lowest.withColumnRenamed("root", "of"), F.col("root") == F.col("of"), "left").select(
        "doc_id", "node", "n", "root", "lowest"), sets)
