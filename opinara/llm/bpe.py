"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

The model's pieces are the vocabulary's tokens with byte b written as the character ``U+0100 + b``; a piece's
score is its negative rank, so sentencepiece merges in rank order, and piece ids are ranks.  The normaliser is
the identity (no prefix, no white-space rules), so a pre-token goes in byte for byte.  Texts are split by the
tokenizer's pattern, each pre-token is encoded on its own, and ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.frames import fresh, named

_FIRST = 0x100
_TO_BYTES = {_FIRST + b: b for b in range(256)}
_TO_PIECES = {b: _FIRST + b for b in range(256)}
# Distinct pre-tokens whose ids a Python worker remembers, and the longest that it does.
REMEMBERED, REMEMBERED_LENGTH = 100_000, 64
_BATCH_ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol-buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto; piece ids are ranks, which must be 0, 1, 2, ..., and the unknown piece is last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be gapless from 0")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte must be a token")
    normal, unknown, bpe = 1, 2, 2
    pieces = []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        piece = token.decode("latin-1").translate(_TO_PIECES).encode()
        pieces.append(_field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, normal)))
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(ranks) + 1) + _field(24, 0) + _field(40, len(ranks))
    # No beginning, end or padding piece: their ids are -1, written as 64-bit varints.
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes texts with one model; keeps the ids of frequent pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        n = self.processor.get_piece_size() - 1
        pieces = [self.processor.id_to_piece(i) for i in range(n)]
        self.tokens = [piece.translate(_TO_BYTES).encode("latin-1") for piece in pieces]
        self.names = [str(i) for i in range(n)]
        # A pre-token that is itself a token is that token, even where merges in rank order do not build it.
        self.whole = {piece: (i,) for i, piece in enumerate(self.tokens)}
        self.known: dict[str, tuple[int, ...]] = {}

    def _ids(self, pretoken: str) -> tuple[int, ...]:
        raw = pretoken.encode()
        ids = self.whole.get(raw)
        if ids is None:
            ids = tuple(self.processor.encode(raw.decode("latin-1").translate(_TO_PIECES)))
        if len(pretoken) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[pretoken] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, self._ids
        return list(chain.from_iterable([known.get(p) or ids(p) for p in self.split(text)]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``token_ids`` (array), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Null and empty texts give an empty array; special tokens' strings are ordinary text; equal rows get equal ids.
    If ``df`` has columns of these names, the new ones get a suffix.  The model is a function of the vocabulary file
    alone and is sent to tasks with the code (about a megabyte, whatever the data).  Rows are processed
    where they are, without a shuffle.
    """
    model = serialise_model(read_ranks(ranks_path))
    new = [fresh(df, c) for c in ("token_ids", "n_tokens", "ids_sha256", "decoded_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, pattern)
        names = codec.names.__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH_ROWS):
                batch = whole.slice(at, _BATCH_ROWS)
                lists, counts, ids_sha, decoded_sha = [], [], [], []
                for text_value in batch.column(batch.num_columns - 1).to_pylist():
                    ids = codec.encode(text_value or "")
                    lists.append(pa.array(ids, pa.int32()))
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                offsets = list(chain([0], _running(counts)))
                token_ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(lists))
                arrays = [*batch.columns[:-1], token_ids, pa.array(counts, pa.int64()), pa.array(ids_sha),
                          pa.array(decoded_sha)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])
        codec.known.clear()  # the worker process lives on

    kept = df.select(*(named(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)),
                     named(df, text).cast("string").alias("t"))
    kinds = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema.fields[:-1])]
    schema = ", ".join([*kinds, "n0 array<int>", "n1 long", "n2 string", "n3 string"])
    encoded = kept.mapInArrow(run, schema)
    return encoded.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)),
                          *(F.col(f"n{i}").alias(c) for i, c in enumerate(new)))


def _running(counts: list[int]) -> Iterator[int]:
    total = 0
    for n in counts:
        total += n
        yield total


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids") -> DataFrame:
    """All columns of ``df`` plus ``decoded`` (binary); null ids give null, an empty array an empty value."""
    tokens = [token for token, _ in sorted(read_ranks(ranks_path).items(), key=lambda item: item[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if v is None else b"".join(map(tokens.__getitem__, v))
                      for v in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [*batch.columns[:-1], pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    kept = df.select(*(named(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)), named(df, ids).alias("t"))
    kinds = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema.fields[:-1])]
    out = kept.mapInArrow(run, ", ".join([*kinds, "n0 binary"]))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)),
                      F.col("n0").alias(fresh(df, "decoded")))
