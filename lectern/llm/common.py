"""What the operators share: tables in the shared folder, text columns as bytes, word spans and hashes.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which all executors
and the driver see; only where that is unset and all runs on this machine (tests) is a folder of our own made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
BLOCK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches, of which each Python step holds some on either side; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if size > BATCH_BYTES or size <= 0:
        spark.conf.set(name, f"{BATCH_BYTES}b")


class Scratch:
    """Tables of one query in the shared folder; ``drop`` frees one early, the rest go when the JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = self._path(self.at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as a table and read again, with its lineage cut."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.at}/{name}")
        return self.load(name, df.schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(f"{self.at}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def in_blocks(sizes: list[int], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``most`` bytes each."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def sliced(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of one column, so that few values are Python objects at once."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
    for a, b in in_blocks(sizes, most):
        yield batch.slice(a, b - a)


# --- words -------------------------------------------------------------------------------------

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = U64(0x9E3779B97F4A7C15)
_P_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_powers_cache: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = int(base)
    known = _powers_cache.get(key)
    if known is None or known.size < n:
        known = np.full(max(n, 1024), base, U64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= BLOCK_BYTES * 2:
            _powers_cache[key] = known
    return known[:n]


class Words:
    """Words (runs without space, tab, LF, VT, FF, CR) of several texts, as spans of one buffer.

    ``buf``: the texts, each followed by LF. ``starts``/``ends``: byte spans of the words.
    ``first``: index of each text's first word, with the number of words at the end.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = b"\n".join([*texts, b""])
        self.buf = np.frombuffer(raw, np.uint8)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths + 1)))
        if lower:
            self.buf = _LOWER[self.buf]
        edge = np.diff(_SEPARATOR[self.buf].view(np.int8), prepend=np.int8(1))
        self.starts = np.flatnonzero(edge == -1)
        self.ends = np.flatnonzero(edge[1:] == 1) + 1 if self.buf.size else self.starts
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; the sums that it takes are made for some megabytes of text at a time."""
        out = np.empty(self.starts.size, U64)
        at = 0
        while at < self.starts.size:
            low = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, low + BLOCK_BYTES, "right")))
            starts, ends = self.starts[at:to] - low, self.ends[at:to] - low
            n = int(ends[-1])
            sums = np.empty(n + 1, U64)
            sums[0] = 0
            np.cumsum(_BYTE[self.buf[low : low + n]] * powers(_P, n), out=sums[1:])
            h = (sums[ends] - sums[starts]) * powers(_P_INVERSE, n)[starts]
            out[at:to] = mix(h ^ ((ends - starts).astype(U64) << U64(56)))
            at = to
        return out


_R = U64(0xD6E8FEB86659FD93)
_R_INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive values."""
    n = values.size
    if n < width:
        return np.zeros(0, U64)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(values * powers(_R, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(_R_INVERSE, n)[: n - width + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        more = width - have
        out = np.minimum(out[:-more], out[more:])
    return out


def packed(values: np.ndarray, dtype: str) -> bytes:
    return np.ascontiguousarray(values, dtype).tobytes()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod5(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5
