"""Blocked documents and questions that blocks put to the whole corpus.

Documents are packed into blocks of some megabytes, one row each with a compressed body, and saved.
``ask`` sends what each block wants to know to hash buckets, answers it there with all blocks' requests in sight,
and gives each block its answers back. A block states a key once however often it holds it, so a bucket
gets at most one entry a block for any key. As blocks are a saved table, a block reads the same on
each pass and answers come in the order of its requests, without keys.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BLOCK_BYTES, U64, Scratch, in_blocks

#: Rows of a block at most: null and empty texts have no bytes that would close one.
BLOCK_ROWS = 1 << 16
_SCHEMA = "block_id bigint, ids array<bigint>, sizes binary, body binary"
_OWN = ("block_id", "ids", "sizes", "body")


def lean() -> None:
    """Has this process give arrays of over a megabyte back to the system as they are freed (glibc; elsewhere nothing)."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        return


@cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    """One a process and level: a task's Python process has one thread."""
    return zstandard.ZstdCompressor(level=level)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeeze(data: bytes, level: int = 1) -> bytes:
    return _compressor(level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return _decompressor().decompress(data)


def pack(values: np.ndarray, ordered: bool = False) -> bytes:
    """Integers as compressed byte planes; ordered ones as differences."""
    values = np.ascontiguousarray(values)
    if ordered and values.size:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T if values.size else np.zeros(0, np.uint8)
    return squeeze(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype, ordered: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(unsqueeze(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel() if raw.size else np.zeros(0, dtype)
    return np.cumsum(values, dtype=dtype) if ordered else values


def join_bodies(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split_bodies(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 4], "little")
        out.append(body[at + 4 : at + 4 + n])
        at += 4 + n
    return out


class Block:
    """One row of a block table, opened. ``answers``: by question, the answers by bucket; ``more``: the table's own further columns."""

    def __init__(self, row: dict):
        self.block_id, self.ids = row["block_id"], row["ids"]
        sizes, body = np.frombuffer(row["sizes"], np.int64), unsqueeze(row["body"])
        cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
        self.texts = [body[a:b] for a, b in zip(cuts, cuts[1:])]
        self.more = {k: v for k, v in row.items() if k not in _OWN and isinstance(v, bytes)}
        self.answers = {k: {x["bucket"]: x["body"] for x in v or ()} for k, v in row.items() if k not in _OWN and k not in self.more}


def block_table(
    df: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", most: int = BLOCK_BYTES, rows: int = BLOCK_ROWS, more: tuple[str, ...] = (), describe: Callable[[list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """The documents as saved blocks of about ``most`` bytes and at most ``rows`` rows; null texts are empty. A document never spans blocks.

    ``describe`` gives a block's texts binary columns of the names in ``more``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        n, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def out():
            sizes = np.fromiter(map(len, texts), np.int64, len(texts)).tobytes()
            arrays = [pa.array([n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.binary()), pa.array([squeeze(b"".join(texts), 3)], pa.binary())]
            arrays += [pa.array([v], pa.binary()) for v in (describe(texts) if describe else [])]
            return pa.RecordBatch.from_arrays(arrays, names=[*_OWN, *more])

        for batch in batches:
            new_ids, new = batch.column(0).to_pylist(), [b"" if v is None else v for v in batch.column(1).cast(pa.binary()).to_pylist()]
            spans = [(k, min(k + rows, b)) for a, b in in_blocks(list(map(len, new)), most) for k in range(a, b, rows)]
            for a, b in spans:
                size = sum(map(len, new[a:b]))
                if texts and (held + size > most or len(texts) + b - a > rows):
                    yield out()
                    n, ids, texts, held = n + 1, [], [], 0
                ids, texts, held = ids + new_ids[a:b], texts + new[a:b], held + size
        if texts:
            yield out()

    schema = ", ".join([_SCHEMA, *(f"{name} binary" for name in more)])
    return scratch.save(df.select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, schema), "blocks")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    lean()
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1).to_pylist()[0])


def bucket_count(blocks: DataFrame, per_bucket: int = 4) -> int:
    """As many buckets that each gets about what ``per_bucket`` blocks ask."""
    return max(64, -(-blocks.count() // per_bucket))


def ask(blocks: DataFrame, name: str, request: Callable[[Block], Iterable[tuple[int, bytes]]], answer: Callable[[list[tuple[int, bytes]]], list[bytes]], scratch: Scratch) -> DataFrame:
    """``blocks`` with a column ``name`` of answers.

    ``request(block)`` gives (bucket, body), one a bucket at most; ``answer`` gets all (block_id, body) of a bucket
    by block_id and returns a body for each.
    """

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches):
            found = list(request(block))
            arrays = [pa.array([b for b, _ in found], pa.int32()), pa.array([block.block_id] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "block_id", "body"])

    def answered(table: pa.Table) -> pa.Table:
        lean()
        rows = sorted(zip(table["block_id"].to_pylist(), table["body"].to_pylist(), strict=True), key=lambda r: r[0])
        bodies = answer(rows)
        bucket = table["bucket"][0].as_py() if table.num_rows else 0
        return pa.table({"block_id": pa.array([b for b, _ in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "body": pa.array(bodies, pa.binary())})

    requests = blocks.mapInArrow(asked, "bucket int, block_id bigint, body binary")
    replies = requests.groupBy("bucket").applyInArrow(answered, "block_id bigint, bucket int, body binary")
    kept = scratch.save(replies, name)
    by_block = kept.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "body")).alias(name))
    return blocks.join(by_block, "block_id", "left")


def cut_by_bucket(keys: np.ndarray, bits: int, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) for sorted keys of so many bits; bucket by range."""
    if not keys.size:
        return []
    at = ((keys >> U64(max(0, bits - 32))).astype(np.float64) * (buckets / 2.0 ** min(bits, 32))).astype(np.int64)
    at = np.minimum(at, buckets - 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return list(zip(at[first].tolist(), first.tolist(), np.append(first[1:], keys.size).tolist(), strict=True))
