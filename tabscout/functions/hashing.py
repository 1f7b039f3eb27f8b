"""Deterministic choices and ids from md5, computable by any SQL engine."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_BITS = 60  # 15 hex digits stay inside a signed bigint


def _text(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def h(*parts) -> Column:
    """Non-negative 60-bit hash of the parts; plain values are taken as literals."""
    digest = F.md5(F.concat_ws("|", *[_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def pick(n, *parts) -> Column:
    """An ordinal in [0, n); null when n is 0."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.try_mod(h(*parts), F.when(n > 0, n)).cast("bigint")


def pick_other(n, own, *parts) -> Column:
    """An ordinal in [0, n) other than ``own``; null when there is no other."""
    x = pick(n - 1, *parts)
    return x + F.when(x >= own, 1).otherwise(0)


def point_id(db, table) -> Column:
    return F.md5(F.concat_ws("_", db, table))


def content_id(db, table, text) -> Column:
    """First 16 hex digits of the content digest as an unsigned 64-bit number, in decimal text."""
    digest = F.md5(F.concat_ws("::", db, table, text))
    return F.conv(F.substring(digest, 1, 16), 16, 10)
