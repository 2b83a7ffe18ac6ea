"""Scalar expressions, all built from pyspark.sql.functions.

Nothing here runs Python per row: every helper returns a Column that stays
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted shapes of integers and UUIDs, and the open interval
# that makes an integer an epoch-seconds timestamp.
INTEGER_PATTERN = r"\A[+-]?[0-9]+\z"
UUID_PATTERN = (r"(?i)\A(?:[0-9a-f]{32}|(?:urn:uuid:)?[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
                r"|\{[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\})\z")
EPOCH_SECONDS_LOWER = 99_999_999      # exclusive
EPOCH_SECONDS_UPPER = 10_000_000_000  # exclusive


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_integer_text(c: Column | str) -> Column:
    """True when the text is an optional sign followed by digits only.

    Spark's cast trims blanks (' 5 ' -> 5); a strict integer parse refuses
    them, hence the pattern before the cast.
    """
    return _c(c).rlike(INTEGER_PATTERN)


def atoi(c: Column | str) -> Column:
    """Strict text -> bigint. NULL for missing, non-integer or out of range."""
    c = _c(c)
    return F.when(is_integer_text(c), c.try_cast(T.LongType()))


def canonical_uuid(c: Column | str) -> Column:
    """Lower-case 32 hex digits of a UUID in one of its whole forms (plain,
    hyphenated, in braces, urn:uuid:); any other text stays as it is."""
    c = _c(c)
    return F.when(is_uuid(c), F.lower(F.regexp_replace(c, r"(?i)\Aurn:uuid:|[{}\-]", ""))).otherwise(c)


def is_uuid(c: Column | str) -> Column:
    return _c(c).rlike(UUID_PATTERN)


def is_epoch_seconds(c: Column | str) -> Column:
    """Integer text strictly between 99,999,999 and 10,000,000,000."""
    n = atoi(c)
    return F.coalesce((n > EPOCH_SECONDS_LOWER) & (n < EPOCH_SECONDS_UPPER), F.lit(False))


def epoch_seconds(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Whole epoch seconds of a timestamp column.

    TIMESTAMP_NTZ is a wall-clock value: it is read field by field (days
    since 1970-01-01, then hour, minute, second), so the session time zone
    plays no part. TIMESTAMP (with zone) is an instant: ``unix_seconds``.
    """
    c = _c(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_seconds(c)
    days = F.unix_date(F.to_date(c)).cast("bigint")
    return (days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("bigint")


def normalise_event_name(c: Column | str) -> Column:
    """Lower case, spaces removed (the generator's event-name rule)."""
    return F.lower(F.replace(_c(c), F.lit(" "), F.lit("")))


def sorted_map(entries: Column) -> Column:
    """array<struct<key,value>> with unique keys -> map with keys in order."""
    return F.map_from_entries(F.array_sort(entries))


def kv_join(entries: Column, sep: str = ",") -> Column:
    """array<struct<key,value>> -> 'k1=v1,k2=v2' ordered by key."""
    pairs = F.transform(F.array_sort(entries),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(pairs, sep)


def sorted_json(m: Column) -> Column:
    """Map -> JSON object text with keys in byte order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
