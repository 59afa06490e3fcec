"""Date and time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feed_time(text: Column) -> Column:
    """RFC 822 or ISO 8601 text as a timestamp, UTC where no zone is given; null for anything else."""
    plain = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""))
    zoned = F.regexp_replace(plain, r"\s(GMT|UTC|UT|Z)$", " +0000")
    rfc = lambda p: F.try_to_timestamp(zoned, F.lit(p))
    return F.coalesce(rfc("d MMM yyyy HH:mm:ss xx"), rfc("d MMM yyyy HH:mm xx"), rfc("d MMM yyyy HH:mm:ss"), F.try_to_timestamp(F.when(plain.rlike("^[0-9]{4}-"), plain)))


def compact_date(text: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD."""
    return F.regexp_replace(text, "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")


def date_prefix(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))


def iso_time(text: Column) -> Column:
    """Epoch milliseconds or text as a timestamp."""
    return F.when(text.rlike("^-?[0-9]{9,}$"), F.timestamp_millis(text.cast("bigint"))).otherwise(F.try_to_timestamp(text))
