"""Hash-derived values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(key: Column, buckets: int = 100) -> Column:
    """The first four bytes of SHA-256, big-endian, modulo ``buckets``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % buckets).cast("bigint")


def opaque_name(key: Column, length: int = 18) -> Column:
    """The beginning of SHA-256 in URL-safe base64."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(key, 256))), "+/=", "-_"), 1, length)


def document_id(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between; null if a part is null."""
    joined = F.concat(*[x for p in parts for x in (p, F.lit("\0"))][:-1])
    return F.sha2(joined, 256)


def polynomial_hash(text: Column, modulus: int) -> Column:
    """31-polynomial over the bytes of ASCII text in 32 bits, modulo ``modulus``."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295))) % modulus


def canonical_hash(prefix: str, length: int, **fields: Column) -> Column:
    """prefix and so many hex digits of SHA-256 of the fields as JSON by name; null fields are left out."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256), 1, length))
