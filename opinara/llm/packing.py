"""Packing documents into token sequences whose source mixture is held by deficit round-robin.

Each source is a queue of documents, cut into packets of at most ``packet`` tokens.  In every round a source's deficit
grows by its quantum, its target share of one window, and it sends packets while its deficit covers them; what is left is
carried on.  While a queue is not empty its k-th packet therefore goes in the first round r with
``r * quantum >= tokens up to the end of that packet``, so rounds, and with them deficits, follow from prefix sums of token
counts and are carried across windows and partitions exactly.  Packets in order of round, source and place in the queue
form one stream, which a second prefix sum cuts into windows.

The stream's last tokens, too few for a window, are cut into powers of two, which need no padding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from opinara.llm.frames import named, written
from opinara.llm.ordering import CELL_ROWS, digits_for, running

WINDOW, PACKET, END_ID = 2_048, 256, 1
#: Shares are whole parts of this number; a source's share is at least one part.
PARTS = 10**7
#: Words whose ids a Python worker remembers at most, and the longest (in bytes) that it does.
REMEMBERED, REMEMBERED_LENGTH = 600_000, 48
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]*")
#: ASCII marks that are neither letters, digits nor the apostrophe, which the pattern treats by what follows.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SEED = "pack-1"
NAMES = ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


class WordIds(dict):
    """Packed ids of blank-separated words under a tokenizer that drops white space between words.

    Its normaliser and word pattern never join what an ASCII blank separates, so a text's ids are those of its
    words in turn.  Words of letters of the first two Unicode blocks and closing marks skip normaliser and pattern: they are
    lowered, mapped to the byte alphabet and merged by the tokenizer's model.  Special tokens are found as the library does.
    """

    def __init__(self, tokenizer_json: str):
        super().__init__()
        #: What was remembered before the last turn: full memories are set aside once, not forgotten at once.
        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # The byte alphabet: printable Latin-1 bytes stand for themselves, the others are shifted beyond them.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}
        # The packed form of every single id.
        self.packed = [i.tobytes() for i in np.arange(self.tokenizer.get_vocab_size()).astype(self.kind)]

    def _merged(self, part: bytes) -> bytes:
        """Ids of letters in lower case, or of marks: one word of the tokenizer's pattern."""
        spelled = part.decode() if part.isascii() else part.decode("latin-1").translate(self.alphabet)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(spelled)])

    def _part(self, part: bytes) -> bytes:
        ids = self.get(part) or self.older.get(part)
        if ids is None:
            ids = self._merged(part)
            self._remember(part, ids)
        return ids

    def _remember(self, word: bytes, ids: bytes) -> None:
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) * 2 >= REMEMBERED:
                # Words that still occur come back from here; the others are forgotten at the next turn.
                self.older = dict(self)
                self.clear()
            self[word] = ids

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            letters = word.rstrip(_MARKS)
            if letters.isalpha():
                lower = letters.lower()
            else:
                text = letters.decode()
                lower = text.lower().encode() if _LETTERS.fullmatch(text) else None
            if lower is None:
                ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, self.kind).tobytes()
            elif lower == word:
                ids = self._merged(word)
            else:
                marks = word[len(letters):]
                ids = (self._part(lower) if lower else b"") + (self._part(marks) if marks else b"")
        self._remember(word, ids)
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=1)
def _word_ids(tokenizer_json: str) -> WordIds:
    return WordIds(tokenizer_json)


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``doc_id``, ``source``, ``n`` and packed ``ids`` (with the end) of ``docs`` (doc_id, source, text), a row key each."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_ids(tokenizer_json)
        end, width = np.array([end_id], known.kind).tobytes(), known.kind.itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [known.encode(t or b"") + end for t in part.column(2).cast(pa.binary()).to_pylist()]
                counts = pa.array([len(i) // width for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), counts, pa.array(ids, pa.binary())],
                                                 names=["doc_id", "source", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = docs.mapInArrow(run, f"doc_id {kind}, source string, n long, ids binary")
    return written(coded.withColumn("row", F.monotonically_increasing_id()), "pack-ids", compression="lz4_raw")


#: The round of a packet that ends ``ended`` tokens into its source's queue, in whole numbers throughout.
_ROUND = "ended div quantum * {parts}L + ((ended % quantum) * {parts}L + quantum - 1) div quantum"


def _packets(queued: DataFrame, window: int, packet: int) -> DataFrame:
    """One row per packet of ``queued`` (row, source, n, before, share) with its round; ``ended`` orders a source's packets."""
    cut = queued.withColumn("k", F.explode(F.expr(f"sequence(0L, (n - 1) div {packet})")))
    cut = cut.withColumns({"start": F.col("k") * packet, "quantum": F.col("share") * window})
    cut = cut.withColumn("length", F.least(F.lit(packet), F.col("n") - F.col("start")))
    cut = cut.withColumn("ended", F.col("before") + F.col("start") + F.col("length"))
    return cut.select("row", "source", "start", "length", "ended", F.expr(_ROUND.format(parts=PARTS)).alias("round"))


def _streamed(packets: DataFrame, rounds_per_cell: int) -> DataFrame:
    """``row``, ``start``, ``length`` and ``position`` of each packet in the stream, by sums of cells of rounds."""
    cells = packets.withColumn("cell", F.expr(f"round div {rounds_per_cell}"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.groupBy("cell").agg(F.sum("length").alias("held")).select(
        "cell", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("cell").orderBy("round", F.col("source").asc_nulls_last(), "ended").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = cells.withColumn("inside", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return placed.join(offsets, "cell").select("row", "start", "length", (F.col("offset") + F.col("inside")).alias("position"))


def _tail(total: int, window: int) -> list[int]:
    """Places at which the tokens beyond the last whole window are cut: the powers of two that add up to their number."""
    at = total - total % window
    bounds = [at]
    for power in reversed(range(window.bit_length())):
        if total % window >> power & 1:
            bounds.append(bounds[-1] + (1 << power))
    return bounds


def pack(df: DataFrame, tokenizer_path: str, identity: str = "doc_id", text: str = "text", source: str = "source",
         weight: Column | None = None, window: int = WINDOW, packet: int = PACKET, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id``, ``source``, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is the ids of its text and then ``end_id``; a null or empty text is the end alone.  ``ids`` holds a piece's ids
    as little-endian unsigned 32-bit numbers.  Each id lies in exactly one piece.  Sequences are full windows but for the last
    few, whose lengths are powers of two below the window, so nothing is padded.

    ``weight`` is a positive number that follows from ``source``; it sets the target mixture.  Without it sources weigh as
    many tokens as they have, and all last to the end; with it, sources that run dry leave their share to the others.
    Up to the end of any round, a source that is not dry has sent its target share of the rounds' tokens, less than one packet
    short.  Smaller packets hold the mixture closer and cut documents more often.

    Queues are in hash-random order.  Equal rows, and rows without an id or a source, are documents like any
    others; a null source is one more queue.  An empty table gives an empty result.  Other columns do not matter.
    """
    if window & (window - 1) or not 0 < packet <= window:
        raise ValueError("window must be a power of two and packet at most a window")
    docs = df.select(named(df, identity).alias("doc_id"), named(df, source).cast("string").alias("source"),
                     named(df, text).cast("string").alias("text"))
    tokens = tokenised(docs, tokenizer_path, end_id)
    sizes = tokens.select("row", "doc_id", "source", "n")
    per_source = sizes.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    per_source = written(per_source.withColumn("weight", (F.col("tokens") if weight is None else weight).cast("double")),
                         "pack-sources")
    total, n_docs, heaviest, weights = per_source.agg(F.sum("tokens"), F.sum("docs"), F.max("weight"), F.sum("weight")).first()
    total, n_docs, weights = total or 0, n_docs or 0, weights or 1.0
    share = F.greatest(F.lit(1), F.round(F.col("weight") * PARTS / weights)).cast("long")
    shares = per_source.select(F.col("source").alias("_source"), share.alias("share"))
    key = F.md5(F.concat_ws(":", F.lit(SEED), F.col("row").cast("string"), F.col("doc_id").cast("string")))
    queued = running(sizes.withColumn("key", key), ["source"], "key", [F.col("row")], {"before": F.col("n")}, digits_for(n_docs))
    queued = queued.join(shares, F.col("source").eqNullSafe(F.col("_source"))).select("row", "source", "n", "before", "share")
    packets = _packets(written(queued, "pack-queues"), window, packet)
    # Every round sends about a window, in packets and ends of documents.
    cells = max(1, (total // packet + n_docs) // CELL_ROWS)
    streamed = _streamed(packets, max(1, total // window // cells))
    pieces = _pieces(streamed, _tail(total, window), window)
    grouped = pieces.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    # Ids meet their pieces by a shuffle at every size.
    return _sliced(tokens.join(grouped.hint("merge"), "row").select("doc_id", "source", "n", "ids", "pieces"))


def _pieces(streamed: DataFrame, tail: list[int], window: int) -> DataFrame:
    """Packets cut where sequences end: ``row``, ``start``, ``length``, ``sequence_id``, ``offset``."""
    position, end = F.col("position"), F.col("position") + F.col("length")
    bounds = F.array(F.expr(f"(position div {window}L + 1) * {window}L"), *(F.lit(b).cast("long") for b in tail))
    cuts = F.array_sort(F.array_distinct(F.filter(bounds, lambda b: (b > position) & (b < end))))
    cut = streamed.withColumn("begin", F.explode(F.concat(F.array(position), cuts))).withColumn(
        "stop", F.coalesce(F.array_min(F.filter(cuts, lambda b: b > F.col("begin"))), end))
    begin = F.col("begin")
    last = F.filter(F.array(*(F.lit(b).cast("long") for b in tail)), lambda b: b <= begin)
    whole = begin < tail[0]
    first = F.when(whole, F.expr(f"begin div {window}L") * window).otherwise(F.array_max(last))
    number = F.when(whole, F.expr(f"begin div {window}L")).otherwise(F.lit(tail[0] // window) + F.size(last) - 1)
    return cut.select("row", (F.col("start") + begin - position).alias("start"), (F.col("stop") - begin).alias("length"),
                      number.cast("long").alias("sequence_id"), (begin - first).alias("offset"))


def _sliced(placed: DataFrame) -> DataFrame:
    """One row per piece with its ids, from ``doc_id``, ``source``, ``n``, packed ``ids`` and ``pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                pieces = part.column("pieces")
                counts = pieces.value_lengths().to_numpy()
                each = pieces.flatten()
                which = np.repeat(np.arange(part.num_rows), counts)
                totals = part.column("n").to_numpy()
                packed = part.column("ids").to_pylist()
                numbers = []
                for row, start, length in zip(which.tolist(), each.field("start").to_pylist(), each.field("length").to_pylist()):
                    width = len(packed[row]) // int(totals[row])
                    numbers.append(np.frombuffer(packed[row], f"<u{width}", length, start * width).astype("<u4").tobytes())
                take = pa.array(which)
                arrays = [part.column("doc_id").take(take), part.column("source").take(take), each.field("start"),
                          each.field("length"), pa.array(numbers, pa.binary()), pa.array(totals[which]),
                          each.field("sequence_id"), each.field("offset")]
                yield pa.RecordBatch.from_arrays(arrays, names=NAMES)

    kind = placed.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, source string, start long, length long, ids binary, doc_tokens long, "
                                  "sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of each whole sequence of ``pieces``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("_parts"))
    joined = F.aggregate("_parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"]))
    return grouped.select("sequence_id", "n_tokens", joined.alias("ids"))
