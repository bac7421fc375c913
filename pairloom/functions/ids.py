"""Stable ids and seeded hash draws as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def digest(*parts) -> Column:
    """SHA-256 hex of the parts joined by ``|``. Use strings and integers only."""
    return F.sha2(F.concat_ws("|", *[_text(p) for p in parts]), 256)


def stable_id(*parts, length: int = 20) -> Column:
    return F.substring(digest(*parts), 1, length)


def unordered_pair_id(first: Column, second: Column, *scope, length: int = 24) -> Column:
    """The same id whichever endpoint comes first."""
    return stable_id(*scope, F.least(first, second), F.greatest(first, second), length=length)


def hash_integer(*parts, start: int = 1, digits: int = 8) -> Column:
    """A non-negative integer read from ``digits`` hex digits of the digest."""
    return F.conv(F.substring(digest(*parts), start, digits), 16, 10).cast("bigint")


def canonical_text(value: Column) -> Column:
    """Bytes or text or number to a plain string id."""
    return F.trim(value.cast("string"))


def hex_slice(hash_column: Column, digits: int = 2) -> Column:
    """Leading hex digits: an order-preserving, evenly filled slice of a hash order."""
    return F.substring(hash_column, 1, digits)
