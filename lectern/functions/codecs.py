"""Byte codecs: masks, media types, run-length text compression."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: FNV-1a in 32 bits; the salt and the seed of the two masks; what positions are raised by; multipliers and shifts of the mixer.
_FNV_OFFSET, _FNV_PRIME = 2166136261, 16777619
_OBJECT_SALT, _PAGE_SEED = 0x4A4F5831, 0x4a4f4a4f
_RAISE = 0x9E3779B9
_MIXER = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1))


def fnv1a(data: bytes) -> int:
    h = _FNV_OFFSET
    for b in data:
        h = (h ^ b) * _FNV_PRIME & 0xFFFFFFFF
    return h


def _stream(seed: int, offset: int, n: int) -> np.ndarray:
    """The mask's bytes for n positions from an offset on; positions and sums are taken in 32 bits."""
    x = (np.arange(offset, offset + n, dtype=np.uint64) + np.uint64(_RAISE)).astype(np.uint32) ^ np.uint32(seed)
    for shift, factor in _MIXER:
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    return x.astype(np.uint8)


def mask(data: bytes, key: str, offset: int = 0) -> bytes:
    """Bytes XORed with the stream that an object's key seeds; its own inverse at any offset. Back slashes count as slashes, leading ones not at all."""
    seed = fnv1a(key.replace("\\", "/").lstrip("/").encode()) ^ _OBJECT_SALT
    return (np.frombuffer(data, np.uint8) ^ _stream(seed, offset, len(data))).tobytes()


def page_mask(data: bytes, offset: int = 0) -> bytes:
    """Bytes XORed with the one stream of page files, of which only the position counts; its own inverse."""
    return (np.frombuffer(data, np.uint8) ^ _stream(_PAGE_SEED, offset, len(data))).tobytes()


@F.arrow_udf(BinaryType())
def masked(data: pa.Array, key: pa.Array, offset: pa.Array) -> pa.Array:
    rows = zip(data.to_pylist(), key.to_pylist(), offset.to_pylist(), strict=True)
    return pa.array([None if d is None or k is None else mask(d, k, o or 0) for d, k, o in rows], pa.binary())


@F.arrow_udf(BinaryType())
def page_masked(data: pa.Array, offset: pa.Array) -> pa.Array:
    return pa.array([None if d is None else page_mask(d, o or 0) for d, o in zip(data.to_pylist(), offset.to_pylist(), strict=True)], pa.binary())


def ranges(length: Column, chunk: int) -> Column:
    """(start, end) byte ranges of a fixed size that cover a length; none for 0."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(chunk).cast("bigint")), lambda a: a < length), lambda a: F.struct(a.alias("start"), F.least(a + chunk, length).alias("end")))


def media_type(data: Column) -> Column:
    """The type that the first bytes tell; null if unknown."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("474946383"), "image/gif")
        .when(head.startswith("52494646") & head.endswith("57454250"), "image/webp").when(head.startswith("25504446"), "application/pdf").when(head.startswith("504B0304"), "application/zip").when(head.startswith("1F8B"), "application/gzip")
    )


def palmdoc(data: bytes) -> bytes:
    """PalmDOC decompression: literals, runs of 1 to 8 literals, back references of 3 to 10 bytes, and space pairs."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((32, c ^ 0x80))
        else:
            if i >= len(data):
                raise ValueError("cut off in a back reference")
            pair = c << 8 | data[i]
            i += 1
            back, n = pair >> 3 & 0x7FF, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise ValueError("back reference before the start")
            for _ in range(n):
                out.append(out[-back])
    return bytes(out)


@F.arrow_udf(BinaryType())
def palmdoc_decompressed(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else palmdoc(d) for d in data.to_pylist()], pa.binary())


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def percent_text(rate: Column) -> Column:
    """One decimal and %, or — for null."""
    return F.coalesce(F.concat(F.format_number(rate * 100, 1), F.lit("%")), F.lit("—"))


def box(l: Column, t: Column, r: Column, b: Column) -> Column:  # noqa: E741
    """Left, top, right and bottom as x, y, width and height, none negative in size; nulls are 0."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(z(l).alias("x"), z(t).alias("y"), F.greatest(z(r) - z(l), F.lit(0.0)).alias("width"), F.greatest(z(b) - z(t), F.lit(0.0)).alias("height"))


def source_id(value: Column) -> Column:
    """The id by which a reader names a book or chapter: parts of MD5 around the value in hexadecimal.

    Digits are written in groups of nine as numbers, any other text as its UTF-16 units; each part follows its length.
    """
    text = value.cast("string")
    digest, digits = F.md5(text), text.rlike("^[0-9]*$")
    groups = F.transform(F.regexp_extract_all(text, F.lit("([0-9]{1,9})"), F.lit(1)), lambda g: F.lower(F.hex(g.cast("bigint"))))
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1)), lambda u: F.lower(F.hex(F.conv(u, 16, 10).cast("bigint"))))
    parts = F.when(digits, groups).otherwise(F.array(F.array_join(units, "")))
    written = F.array_join(F.transform(parts, lambda p: F.concat(F.lower(F.lpad(F.hex(F.length(p).cast("bigint")), 2, "0")), p)), "g")
    head = F.concat(F.substring(digest, 1, 3), F.when(digits, "3").otherwise("4"), F.lit("2"), F.substring(digest, -2, 2), written)
    filled = F.when(F.length(head) < 20, F.concat(head, F.expr("''"), F.substring(digest, F.lit(1), F.lit(20) - F.length(head)))).otherwise(head)
    return F.concat(filled, F.substring(F.md5(filled), 1, 3))


def unwrapped_parts(parts: list[str]) -> str:
    """The text of a chapter that came in parts: each part without its checksum of 32 characters, the whole without its first one, swaps undone, base64.

    Which characters were swapped, the code points of the last ones tell: their binary digits read as a number to base 4, in groups of digits.
    """
    if not parts or any(not isinstance(p, str) for p in parts):
        raise ValueError("a part is missing")
    body = list("".join(p[32:] for p in parts)[1:])
    n = len(body)
    if n < 4:
        places = []
    elif n < 11:
        places = [0, 2]
    else:
        tail = min(4, -(-n // 10))
        code = "".join(str(int(f"{ord(c):b}", 4)) for c in reversed(body[n - tail :]))
        room = n - tail - 2
        width = len(str(room))
        places = [int(code[k : k + width]) % room for i in range(0, len(code) - width, width) for k in (i, i + 1)][:10]
    for i in range(len(places) - 1, 0, -2):
        for k in (1, 0):
            a, b = places[i] + k, places[i - 1] + k
            body[a], body[b] = body[b], body[a]
    raw = re.sub("[^A-Za-z0-9+/]", "", "".join(body).translate(str.maketrans("-_", "+/")))
    raw = raw[: len(raw) - (len(raw) % 4 == 1)]
    return base64.b64decode(raw + "=" * (-len(raw) % 4)).decode("utf-8", "replace")


@F.arrow_udf(StringType())
def parts_text(parts: pa.Array) -> pa.Array:
    """The text of an array of parts; null if one is missing."""
    return pa.array([None if not p or None in p else unwrapped_parts(p) for p in parts.to_pylist()], pa.string())
