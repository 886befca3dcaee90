"""Rule-based valences of texts inside a task: words as numbers of a chunk of texts, the rules as array operations on them.

A word is looked up once for each task that meets it, not once for each occurrence; occurrences are numbers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from opinara import lexicons
from opinara.functions.chunks import coded

#: Bytes of text of a chunk, unless one text alone has more, and words that a task remembers: the bounds of what it holds.
CHUNK_BYTES, REMEMBERED, REMEMBERED_LENGTH = 1 << 22, 300_000, 48
#: What the rules themselves look for.
_RULE_WORDS = ("but", "so", "this", "never", "least", "at", "very")
_EDGES = re.compile(r"\A[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)")
_SAME_AS_UPPER, _HAS_UPPER = 2, 1


class Valences:
    """The lists of the rules, as arrays over the words that occur in them; word 0 is any other word."""

    def __init__(self, valences: Mapping[str, float], boosters: Mapping[str, float], negators: Sequence[str]):
        split = {tuple(p.lower().split()) for p in (*valences, *boosters, *negators)}
        phrases = [p for p in split if len(p) > 1]
        parts = (w for p in phrases for w in (*p, " ".join(p)))
        self.words = {w: i for i, w in enumerate(dict.fromkeys([*valences, *boosters, *negators, *parts, *_RULE_WORDS]), 1)}
        nothing = np.full(len(self.words) + 1, np.nan)
        value, boost = nothing.copy(), nothing.copy()
        self.known, self.boosts, self.negates = (np.zeros(len(nothing), bool) for _ in range(3))
        for word, number in valences.items():
            value[self.words[word]], self.known[self.words[word]] = number, True
        for word, number in boosters.items():
            boost[self.words[word]], self.boosts[self.words[word]] = number, True
        self.negates[[self.words[w] for w in negators]] = True
        self.value, self.scored, self.boost = value, self.known & ~self.boosts, np.where(self.boosts, boost, 0.0)
        #: Phrases by their first two words, the longest first, each with the number of the whole.
        self.phrases: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for phrase in sorted(phrases, key=lambda p: -len(p)):
            numbers = tuple(self.words[w] for w in phrase)
            self.phrases.setdefault(self._pair(numbers[0], numbers[1]), []).append((numbers, self.words[" ".join(phrase)]))
        self.pairs = np.array(sorted(self.phrases), np.int64)
        self.rule = {w: self.words[w] for w in _RULE_WORDS}

    def _pair(self, first, second):
        return first * (len(self.words) + 1) + second

    def code(self, word: str) -> int:
        """Number of a word without the marks at its edges and two bits on its case; -1 for a single character."""
        if len(word) < 2:
            return -1
        bare = word if word[0].isalnum() and word[-1].isalnum() else _EDGES.sub("", word)
        if len(bare) < 2:
            bare = word
        lower = bare.lower()
        upper = bare != lower if bare.isascii() else any(unicodedata.category(c) == "Lu" for c in bare)
        return self.words.get(lower, 0) * 4 + (bare == bare.upper()) * _SAME_AS_UPPER + upper * _HAS_UPPER

    def joined(self, codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of phrases as one word: the leftmost phrase, and the longest of those that begin there."""
        words = codes >> 2
        starts = np.flatnonzero(np.isin(self._pair(words[:-1], words[1:]), self.pairs) & (rows[:-1] == rows[1:]))
        out, kept, free = codes.copy(), np.ones(len(codes), bool), 0
        for at in starts.tolist():
            if at < free:
                continue
            for phrase, whole in self.phrases[int(self._pair(words[at], words[at + 1]))]:
                stop = at + len(phrase)
                if stop <= len(words) and rows[stop - 1] == rows[at] and tuple(words[at:stop].tolist()) == phrase:
                    case = np.bitwise_and.reduce(codes[at:stop]) & _SAME_AS_UPPER | np.bitwise_or.reduce(codes[at:stop]) & _HAS_UPPER
                    out[at], free = whole * 4 + case, stop
                    kept[at + 1:stop] = False
                    break
        return out[kept], rows[kept]

    def totals(self, codes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """The sum of the valences of each of ``n`` texts, from the codes of their words and the text of each word."""
        codes, rows = self.joined(codes, rows) if len(self.pairs) and len(codes) > 1 else (codes, rows)
        words, loud = codes >> 2, codes & 3 == _SAME_AS_UPPER + _HAS_UPPER
        # Capitals mean emphasis only where the text also has other words.
        loud &= (np.bincount(rows, ~loud, n) > 0)[rows]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows]
        at = np.flatnonzero(self.scored[words])
        value = self.value[words[at]]
        value = value + np.where(loud[at], np.sign(value) * lexicons.CAPS_BOOST, 0.0)
        before = [np.where(place[at] >= back, words[np.maximum(at - back, 0)], -1) for back in (1, 2, 3)]
        either = [np.isin(b, [self.rule["so"], self.rule["this"]]) for b in before]
        for distance, fade in enumerate((1.0, 0.95, 0.9)):
            prior = before[distance]
            # A neighbour that is itself a sentiment word changes nothing.
            plain = (prior >= 0) & ~self.known[prior]
            push = self.boost[prior] + np.where(loud[np.maximum(at - distance - 1, 0)], lexicons.CAPS_BOOST, 0.0)
            value = value + np.where(plain & self.boosts[prior], np.sign(value) * push * fade, 0.0)
            factor = np.where(plain & self.negates[prior], lexicons.NEGATION_FACTOR, 1.0)
            if distance:
                # "never so good" strengthens instead of negating.
                never = plain & (prior == self.rule["never"]) & (either[0] if distance == 1 else either[0] | either[1])
                factor = np.where(never, 1.5 if distance == 1 else 1.25, factor)
            value = value * factor
        least = (before[0] == self.rule["least"]) & ~self.known[before[0]] & ~np.isin(
            before[1], [self.rule["at"], self.rule["very"]])
        value = value * np.where(least, lexicons.NEGATION_FACTOR, 1.0)
        buts = np.flatnonzero(words == self.rule["but"])[::-1]
        but = np.full(n, -1)
        but[rows[buts]] = place[buts]  # the first of a text is written last
        turn = but[rows[at]]
        contrast = np.where((turn < 0) | (place[at] == turn), 1.0, np.where(place[at] < turn, 0.5, 1.5))
        return np.bincount(rows[at], value * contrast, n)

    def of_texts(self, texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """The total of every text of a task's batches; NULL for NULL."""
        known: dict[str, int] = {}
        for batch in texts:
            batch = batch.cast(pa.large_string())
            ends, start = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)), 0
            found = []
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_BYTES, side="right")))
                found.append(self._chunk(batch.slice(start, stop - start), known))
                start = stop
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64(), mask=batch.is_null().to_numpy(False))

    def _chunk(self, texts: pa.Array, known: dict[str, int]) -> np.ndarray:
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        rows = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        numbers, distinct = coded(split.flatten())
        if len(known) > REMEMBERED:
            known.clear()
        codes = np.empty(len(distinct), np.int64)
        for i, word in enumerate(distinct.to_pylist()):
            code = known.get(word)
            if code is None:
                code = self.code(word)
                if len(word) <= REMEMBERED_LENGTH:
                    known[word] = code
            codes[i] = code
        codes = codes[numbers]
        return self.totals(codes[codes >= 0], rows[codes >= 0], len(texts))
