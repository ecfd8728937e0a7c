"""Byte-level BPE by a sentencepiece model that is written from a ranked vocabulary.

The vocabulary (``base64-token rank`` lines) becomes a sentencepiece ``ModelProto``
without training: every token's bytes are mapped to characters one to one, the
piece's score is its negative rank (so the best-scored merge is the lowest rank),
and the normaliser is the identity. Texts are cut by the pre-token pattern, each
pre-token is encoded by itself, and ids are decoded by the inverse mapping.

Ids are kept as unsigned 32-bit little-endian binary. Null text encodes as empty;
null ids decode as empty. Texts of any length are taken in runs of pre-tokens.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pre-tokens that a worker remembers before it starts over.
REMEMBERED = 100_000
#: Pre-tokens of a text in hand at a time.
RUN = 200_000

BYTE_CHARS = [chr(b) if 33 <= b <= 126 else chr(0x100 + b) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in ranked]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the unknown piece comes last."""

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    # Field numbers and enum values of sentencepiece_model.proto.
    normal, unknown, bpe = 1, 2, 2
    pieces = [piece("".join(BYTE_CHARS[b] for b in token), -float(rank), normal) for rank, token in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, unknown))
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(tokens)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normalizer)


class Codec:
    """Encoder and decoder of one model and pre-token pattern, in a Python worker."""

    def __init__(self, proto: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.pattern = regex.compile(pattern)
        back = {c: b for b, c in enumerate(BYTE_CHARS)}
        self.unknown = self.pieces.unk_id()
        names = (self.pieces.id_to_piece(i) for i in range(self.unknown))
        self.tokens = [bytes(back[c] for c in name) for name in names]
        self.whole = {token: struct.pack("<I", i) for i, token in enumerate(self.tokens)}
        self.chars = {b: c for b, c in enumerate(BYTE_CHARS)}
        self.known: dict[str, bytes] = {}

    def pretokens(self, text: str) -> Iterator[Iterable[str]]:
        if len(text) <= 4 * RUN:
            return iter([self.pattern.findall(text)])
        return batched((m.group() for m in self.pattern.finditer(text)), RUN)

    def learn(self, pretokens: Iterable[str]) -> None:
        """Encode the pre-tokens that aren't remembered, all in one call."""
        fresh = [p for p in set(pretokens) if p not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list(set(pretokens))
        merged = []
        for p in fresh:
            if (one := self.whole.get(raw := p.encode())) is not None:
                self.known[p] = one  # a pre-token that is a token needs no merges
            else:
                merged.append((p, raw.decode("latin-1").translate(self.chars)))
        for (p, _), ids in zip(merged, self.pieces.encode([m for _, m in merged], num_threads=1)):
            if self.unknown in ids:
                raise ValueError("the vocabulary lacks a byte")
            self.known[p] = np.asarray(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        out = []
        for run in self.pretokens(text or ""):
            self.learn(run)
            out.append(b"".join(map(self.known.__getitem__, run)))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


@lru_cache(maxsize=2)
def _codec(proto: bytes, pattern: str) -> Codec:
    return Codec(proto, pattern)


class BytePairTokenizer:
    """The vocabulary at ``path``, for Spark tables.

    The model (about 30 bytes a token; ``MOST_BYTES`` at most) is broadcast once. Each
    task has one Python worker, which takes ``SLICE`` rows at a time.
    """

    MOST_BYTES = 64 << 20
    SLICE = 256

    def __init__(self, spark, path: str, pattern: str):
        proto = model_proto(read_ranks(path))
        if len(proto) > self.MOST_BYTES:
            raise ValueError("the vocabulary is too large to broadcast")
        self.shared, self.pattern = spark.sparkContext.broadcast(proto), pattern

    def _added(self, df: DataFrame, source: str, out: str, method: str, then: str | None = None) -> DataFrame:
        """``df`` with ``out`` made from ``source`` by a method of the codec, and ``then`` decoded from ``out``."""
        df = df.drop(*[c for c in (out, then) if c])
        shared, pattern, size = self.shared, self.pattern, self.SLICE

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(shared.value, pattern)
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    made = [getattr(codec, method)(x) for x in part.column(source).to_pylist()]
                    part = part.append_column(out, pa.array(made, pa.binary()))
                    if then:
                        part = part.append_column(then, pa.array(map(codec.decode, made), pa.binary()))
                    yield part

        schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.BinaryType()) for c in (out, then) if c]])
        return df.mapInArrow(run, schema)

    def encode(self, df: DataFrame, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
        """``df`` with the ids of ``text``; with ``decoded``, also the bytes that these ids stand for. Columns so named are replaced."""
        return self._added(df, text, ids, "encode", decoded)

    def decode(self, df: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
        """``df`` with the bytes that ``ids`` stand for."""
        return self._added(df, ids, decoded, "decode")
