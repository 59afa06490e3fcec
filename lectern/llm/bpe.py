"""Byte-level BPE through a sentencepiece model written straight from a rank vocabulary.

Each byte becomes one character (``chr(BASE + byte)``), each rank a piece of such characters with
score ``-rank``, the normaliser is the identity. Sentencepiece's BPE joins the pair of the highest
score first, the leftmost of equal ones: the order of ranks. Encoding splits a text by the pattern and
encodes each match; ids are ranks, as the unknown piece comes last. Decoding maps ids back to bytes.

Null and empty texts encode to no ids; the ids of any text decode to its bytes, NUL included.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lectern.llm.common import bounded_batches, sliced

#: Byte b is the character BASE + b: letters of two UTF-8 bytes, away from sentencepiece's own marks.
BASE = 0x100
#: Matches kept encoded per task; the table starts anew when it is full.
CACHE = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (2**64 - 1))
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces by rank and the unknown piece, BPE, identity normalisation."""
    size = len(ranks)
    if sorted(ranks.values()) != list(range(size)) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must be 0..n-1 and hold all single bytes")
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chr(BASE + b) for b in token).encode()
        out += _field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)))
    out += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, size + 1) + b"".join(_field(n, v) for n, v in ((24, 0), (40, size), (41, -1), (42, -1), (43, -1)))
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encodes and decodes in one process."""

    def __init__(self, model: bytes, pattern: str, ranks: dict[bytes, int]):
        self.model, self.split, self.ranks = model, regex.compile(pattern).findall, ranks
        self.table = {b: chr(BASE + b) for b in range(256)}
        self.known: dict[str, bytes] = {}

    @cached_property
    def sp(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    @cached_property
    def pieces(self) -> list[bytes]:
        """The bytes of each id."""
        return sorted(self.ranks, key=self.ranks.__getitem__)

    def _learn(self, new: list[str]) -> None:
        todo, raw = [], []
        for match in new:
            utf8 = match.encode()
            if (rank := self.ranks.get(utf8)) is not None:
                self.known[match] = struct.pack("<I", rank)
            else:
                todo.append(match)
                raw.append(utf8.decode("latin-1").translate(self.table))
        if todo:
            for match, ids in zip(todo, self.sp.encode(raw, out_type=int, num_threads=1), strict=True):
                self.known[match] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        matches, known = self.split(text), self.known
        try:
            return b"".join(map(known.__getitem__, matches))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            self._learn([m for m in dict.fromkeys(matches) if m not in known])
            return b"".join(map(known.__getitem__, matches))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def _codec(key: str, shared) -> Codec:
    """This process's codec for a broadcast model; only the last one used is kept."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*shared.value)
    return _codecs[key]


class ByteBpe:
    """The operator. ``ranks_path``: a rank file; ``pattern``: what a text is split by before the merges.

    The model (of the size of the vocabulary file, about 1 MB) is read once on the driver and broadcast. A column of the output's name is replaced.
    """

    def __init__(self, spark, ranks_path: str, pattern: str):
        bounded_batches(spark)
        ranks = read_ranks(ranks_path)
        self.shared = spark.sparkContext.broadcast((serialise_model(ranks), pattern, ranks))
        self.key = uuid.uuid4().hex

    def _over(self, df: DataFrame, column: str, to: str, work) -> DataFrame:
        shared, key = self.shared, self.key
        rest = [f for f in df.schema.fields if f.name != to]
        schema = StructType([*rest, StructField(to, BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(key, shared)
            for batch in (part for whole in batches for part in sliced(whole, column)):
                values = [b"" if v is None else work(codec, v) for v in batch.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(values, pa.binary())], names=[*(f.name for f in rest), to])

        return df.mapInArrow(run, schema)

    def encode(self, df: DataFrame, text: str = "text", to: str = "ids") -> DataFrame:
        """``df`` with ``to``: the ids of the whole text as little-endian unsigned 32-bit integers."""
        return self._over(df, text, to, lambda codec, v: codec.encode(v))

    def decode(self, df: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        """``df`` with ``to``: the bytes that the ids stand for."""
        return self._over(df, ids, to, lambda codec, v: codec.decode(v))


    def both(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with ``ids`` and ``decoded``, the bytes that the ids stand for, of one pass over the rows; the text is left out."""
        shared, key = self.shared, self.key
        rest = [f for f in df.schema.fields if f.name not in (text, "ids", "decoded")]
        schema = StructType([*rest, StructField("ids", BinaryType()), StructField("decoded", BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(key, shared)
            for batch in (part for whole in batches for part in sliced(whole, text)):
                ids = [b"" if v is None else codec.encode(v) for v in batch.column(text).to_pylist()]
                decoded = list(map(codec.decode, ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=schema.names)

        return df.mapInArrow(run, schema)


def digests(df: DataFrame, bpe: ByteBpe) -> DataFrame:
    """One row per document: n_tokens, and SHA-256 of the packed ids and of the decoded bytes.

    A text is encoded and decoded in one pass over the rows; extra columns of the input are left out.
    """
    return bpe.both(df.select("doc_id", "text")).select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
