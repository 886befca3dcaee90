"""Periodic runs of words, found on a Re-Pair grammar.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are identical), at least twice as long as ``q`` and
at least ``LEAST`` words long, which no neighbouring word extends.

1. Runs lie in stretches covered by repeated ``LEAST / 2``-grams: a run of length L repeats ``L - q >= LEAST / 2`` words in a
   row.  Only such stretches, found by sorting, go on; nothing else can hold a run.
2. Each stretch is compressed by Re-Pair in rounds: an adjacent pair that occurs at least twice in the stretch becomes a
   nonterminal wherever it is more frequent than the pairs that overlap it (ties by a hash of the pair), so many pairs go at
   a time and the rounds are few.  What is left is joined by a balanced tree.
3. A run lies whole in the expansion of the lowest node that holds it, and crosses that node's boundary.  So for
   each nonterminal, once, the runs that cross its boundary are computed by longest common extensions to both sides.
4. The derivation gives all positions of each nonterminal; its runs are translated there, and intervals of one period that
   overlap by a period or more are one run.

Words are told apart by 64-bit hashes, and extensions by 64-bit polynomial hashes; collisions among n values have odds
of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import textkit
from opinara.llm.frames import fresh, named

LEAST = 12
GRAM = LEAST // 2
_STEP = 1 << 18
_U = np.uint64
_RADIX = _U(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    table = np.full(n, _RADIX, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def _gram_ids(codes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, whole)`` of the grams that begin at each place; a gram beyond its group's end is not whole."""
    n = len(codes)
    value = np.zeros(n, np.uint64)
    if n < GRAM:
        return value, np.zeros(n, bool)
    some = value[: n - GRAM + 1]
    for k in range(GRAM):
        some *= _RADIX
        some += codes[k : n - GRAM + 1 + k]
    whole = np.zeros(n, bool)
    whole[: n - GRAM + 1] = group[: n - GRAM + 1] == group[GRAM - 1 :]
    return textkit.mix(value), whole


def _covered(codes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which places lie in a gram that occurs twice or more in their group."""
    grams, whole = _gram_ids(codes, group)
    at = np.flatnonzero(whole)
    keys = textkit.mix(grams[at] ^ textkit.mix(group[at].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, at[twice], 1)
    np.add.at(edges, at[twice] + GRAM, -1)
    return np.cumsum(edges[:-1]) > 0


def _stretches(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(places, group)``: the words that can lie in a run, and the number of their stretch."""
    places, group = np.arange(len(codes)), rows
    while len(places):
        kept = _covered(codes[places], group)
        inside, groups = places[kept], group[kept]
        broken = np.ones(len(inside), bool)
        broken[1:] = (np.diff(inside) != 1) | (groups[1:] != groups[:-1])
        done = len(inside) == len(places)
        places, group = inside, np.cumsum(broken)
        if done:
            break
    return places, group


class Grammar:
    """Binary rules over a sequence cut into groups: node ``k`` has children, a length and one place where it occurs.

    Words are nodes below ``words``; ``roots`` are the nodes of the groups and ``root_at`` their places.  ``levels`` are
    the first nodes of each round; children are of earlier rounds.
    """

    def __init__(self, symbols: np.ndarray, group: np.ndarray):
        self.words = int(symbols.max()) + 1 if len(symbols) else 0
        self.left, self.right, self.length, self.at = [], [], [np.ones(self.words, np.int64)], [np.zeros(self.words, np.int64)]
        self.levels = [self.words]
        self._build(symbols.astype(np.int64), group)
        empty = np.zeros(0, np.int64)
        self.left, self.right = (np.concatenate([np.zeros(self.words, np.int64), *x]) for x in (self.left, self.right))
        self.length, self.at = np.concatenate(self.length or [empty]), np.concatenate(self.at or [empty])

    def _add(self, left: np.ndarray, right: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.left.append(left), self.right.append(right), self.length.append(length), self.at.append(at)
        self.levels.append(self.levels[-1] + len(left))
        return np.arange(self.levels[-2], self.levels[-1])

    def _replace(self, x, at, size, group, chosen, kind):
        """Replace the pairs that begin at ``chosen``; pairs of one ``kind`` become one node."""
        _, first, kind = np.unique(kind, return_index=True, return_inverse=True)
        here = chosen[first]
        nodes = self._add(x[here], x[here + 1], size[here] + size[here + 1], at[here])
        x, size = x.copy(), size.copy()
        size[chosen] += size[chosen + 1]
        x[chosen] = nodes[kind]
        kept = np.ones(len(x), bool)
        kept[chosen + 1] = False
        return x[kept], at[kept], size[kept], group[kept]

    def _build(self, x: np.ndarray, group: np.ndarray) -> None:
        at, size = np.arange(len(x)), np.ones(len(x), np.int64)
        while len(x) > 1:
            # Pairs are counted in their group; a pair's rank is its count, then a hash.
            key = textkit.mix((x[:-1].astype(np.uint64) * _RADIX + x[1:].astype(np.uint64)) * _RADIX
                              + group[:-1].astype(np.uint64))
            inside = group[:-1] == group[1:]
            _, kind, counts = np.unique(key, return_inverse=True, return_counts=True)
            count = np.where(inside, counts[kind], 0)
            if not (count > 1).any():
                break
            rank = np.where(count > 1, (np.minimum(count, 1 << 20).astype(np.int64) << 42) + (key >> _U(22)).astype(np.int64), 0)
            # Equal neighbours are one pair overlapping itself: every other one counts.
            same = np.zeros(len(rank), bool)
            same[1:] = (rank[1:] == rank[:-1]) & (rank[1:] > 0) & (key[1:] == key[:-1])
            chain = np.maximum.accumulate(np.where(same, 0, np.arange(len(rank))))
            even = (np.arange(len(rank)) - chain) % 2 == 0
            before, after = np.zeros_like(rank), np.zeros_like(rank)
            before[1:], after[:-1] = rank[:-1], rank[1:]
            chosen = np.flatnonzero((rank > 0) & even & (before <= rank) & (after <= rank))
            chosen = chosen[np.diff(chosen, prepend=-2) > 1]
            x, at, size, group = self._replace(x, at, size, group, chosen, key[chosen])
        while len(x) > 1:
            # A balanced tree over what is left of each group.
            firsts = np.maximum.accumulate(np.where(np.diff(group, prepend=group[0] - 1) != 0, np.arange(len(x)), 0))
            even = (np.arange(len(x)) - firsts) % 2 == 0
            chosen = np.flatnonzero(even[:-1] & (group[:-1] == group[1:]))
            if not len(chosen):
                break
            x, at, size, group = self._replace(x, at, size, group, chosen, chosen)
        self.roots, self.root_at = x, at

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """``(nodes, places)``: every occurrence, in the derivation, of nodes of at least ``LEAST`` words."""
        pending: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.levels]
        nodes_out, places_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def send(nodes: np.ndarray, places: np.ndarray) -> None:
            long = self.length[nodes] >= LEAST
            nodes, places = nodes[long], places[long]
            level = np.searchsorted(self.levels, nodes, side="right") - 1
            for k in np.unique(level):
                pending[k].append((nodes[level == k], places[level == k]))

        send(self.roots, self.root_at)
        for k in range(len(self.levels) - 1, -1, -1):
            if pending[k]:
                nodes, places = (np.concatenate(p) for p in zip(*pending[k]))
                pending[k] = []
                nodes_out.append(nodes), places_out.append(places)
                send(self.left[nodes], places)
                send(self.right[nodes], places + self.length[self.left[nodes]])
        return np.concatenate(nodes_out), np.concatenate(places_out)


def _extension(sums: np.ndarray, powers: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray,
               back: bool) -> np.ndarray:
    """How many words agree from ``low`` and ``high`` on (``back``: before them), at most ``limit``."""
    least, most = np.zeros_like(limit), limit.copy()
    shift = powers[high - low]
    while True:
        open_ = np.flatnonzero(least < most)
        if not len(open_):
            return least
        n = (least[open_] + most[open_] + 1) // 2
        a, b = (low[open_] - n, high[open_] - n) if back else (low[open_], high[open_])
        same = (sums[a + n] - sums[a]) * shift[open_] == sums[b + n] - sums[b]
        least[open_] = np.where(same, n, least[open_])
        most[open_] = np.where(same, most[open_], n - 1)


def _boundary_runs(symbols: np.ndarray, codes: np.ndarray, group: np.ndarray, grammar: Grammar, nodes: np.ndarray
                   ) -> tuple[np.ndarray, ...]:
    """``(node, from, to, period)`` of the runs that cross each node's boundary, places relative to the node."""
    n = len(symbols)
    powers = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers[:n], out=sums[1:])
    grams, whole = _gram_ids(codes, group)
    grams[~whole] = 0
    # Places of each word, ascending.
    order = np.argsort(symbols, kind="stable")
    keyed = symbols[order] * n + order
    begin = grammar.at[nodes]
    end = begin + grammar.length[nodes]
    boundary = begin + grammar.length[grammar.left[nodes]]
    # Both words at the boundary are in the run: the rarer one's other places give the periods.
    ranges = []
    for centre in (boundary - 1, boundary):
        base = symbols[centre] * n
        ranges.append((centre, np.searchsorted(keyed, base + begin), np.searchsorted(keyed, base + end)))
    fewer = ranges[0][2] - ranges[0][1] <= ranges[1][2] - ranges[1][1]
    centre, first, last = (np.where(fewer, a, b) for a, b in zip(*ranges))
    counts = last - first
    starts = np.zeros(len(nodes) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    for at in range(0, int(starts[-1]), _STEP):
        flat = np.arange(at, min(at + _STEP, int(starts[-1])))
        node = np.searchsorted(starts, flat, side="right") - 1
        other = order[first[node] + flat - starts[node]]
        here = centre[node]
        node, other, here = (v[other != here] for v in (node, other, here))
        low, high = np.minimum(here, other), np.maximum(here, other)
        period = high - low
        # Some gram around the pair is equal on both sides.
        maybe = (end[node] - begin[node] >= 2 * period)
        near = np.zeros(len(low), bool)
        for back in range(GRAM):
            a, b = low - back, high - back
            near |= (a >= 0) & (grams[a] == grams[b]) & (grams[b] != 0)
        some = np.flatnonzero(maybe & near)
        node, low, high, period = (v[some] for v in (node, low, high, period))
        ahead = _extension(sums, powers, low, high, end[node] - high, back=False)
        behind = _extension(sums, powers, low, high, low - begin[node], back=True)
        good = ahead + behind >= np.maximum(period, LEAST - period)
        for store, value in zip(out, (node, low - behind - begin[node], high + ahead - begin[node], period)):
            store.append(value[good])
    node, start, stop, period = (np.concatenate(x) for x in out)
    # One stretch with several periods has all multiples of the smallest.
    by = np.lexsort((period, stop, start, node))
    node, start, stop, period = (v[by] for v in (node, start, stop, period))
    fresh_ = np.ones(len(node), bool)
    fresh_[1:] = (np.diff(node) != 0) | (np.diff(start) != 0) | (np.diff(stop) != 0)
    return nodes[node[fresh_]], start[fresh_], stop[fresh_], period[fresh_]


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(which, number)``: each index as often as its count says, with 0, 1, 2, ..."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def find(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs in the sequences of ``rows``, by start, then period; places count over all."""
    none = (np.zeros(0, np.int64),) * 3
    places, group = _stretches(codes, rows)
    if not len(places):
        return none
    inner = codes[places]
    _, symbols = np.unique(inner, return_inverse=True)
    symbols = symbols.astype(np.int64)
    grammar = Grammar(symbols, group)
    nodes = np.flatnonzero(grammar.length >= LEAST)
    node, start, stop, period = _boundary_runs(symbols, inner, group, grammar, nodes)
    if not len(node):
        return none
    first = np.searchsorted(node, np.arange(len(grammar.length) + 1))
    at_node, at_place = grammar.positions()
    which, number = _ragged(np.diff(first)[at_node])
    run = first[at_node][which] + number
    begin, end, period = start[run] + at_place[which], stop[run] + at_place[which], period[run]
    order = np.lexsort((-end, begin, period))
    begin, end, period = begin[order], end[order], period[order]
    # Ends so far within one period; periods are kept apart by an offset.
    apart = period * (len(inner) + 1)
    so_far = np.maximum.accumulate(end + apart) - apart
    new = np.ones(len(begin), bool)
    new[1:] = (np.diff(period) != 0) | (begin[1:] > so_far[:-1] - period[1:])
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(begin)) - 1
    begin, length, period = begin[heads], so_far[last] - begin[heads], period[heads]
    begin = places[begin]
    order = np.lexsort((period, begin))
    return begin[order], length[order], period[order]


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]``, numbered from 0.  ``collapsed`` joins by one blank the words
    that are not in a run after its first period.  A null or empty text has no words, no runs and an empty ``collapsed``;
    equal rows get equal results; an empty table gives an empty one.  If ``df`` has columns of these names, the
    new ones get a suffix.  Rows are processed where they are, whole texts at a time, without a shuffle.
    """
    new = [fresh(df, c) for c in ("n_words", "runs", "collapsed")]
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(whole.num_columns - 1)
            for low, high, words in textkit.slices(texts, lower=False):
                start, length, period = find(words.hashes, words.rows)
                row = words.rows[start] if len(start) else start
                first = np.searchsorted(row, np.arange(high - low + 1))
                edges = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(edges, start + period, 1)
                np.add.at(edges, start + length, -1)
                kept = np.cumsum(edges[:-1]) == 0
                collapsed = []
                for i, value in enumerate(texts.slice(low, high - low).to_pylist()):
                    parts = (value or "").encode().split()
                    if first[i] < first[i + 1]:
                        here = kept[words.first[i] : words.first[i + 1]]
                        parts = [p for p, keep in zip(parts, here.tolist()) if keep]
                    collapsed.append(b" ".join(parts))
                numbers = [pa.array(v) for v in (start - words.first[row] if len(start) else start, length, period)]
                runs = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(numbers, fields=list(kind)))
                part = whole.slice(low, high - low)
                arrays = [*part.columns[:-1], pa.array(np.diff(words.first)), runs, pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    kept = df.select(*(named(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)), named(df, text).cast("string").alias("t"))
    kinds = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema.fields[:-1])]
    schema = ", ".join([*kinds, "n0 long", "n1 array<struct<start: long, length: long, period: long>>", "n2 string"])
    found = kept.mapInArrow(run, schema)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)),
                        *(F.col(f"n{i}").alias(c) for i, c in enumerate(new)))
