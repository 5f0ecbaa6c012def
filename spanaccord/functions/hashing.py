"""Hash based random numbers, equal on every engine and run."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hex_hash(*parts) -> Column:
    """MD5 of the parts joined by ``|``."""
    return F.md5(F.concat_ws("|", *[(F.lit(p) if isinstance(p, (int, str)) else p).cast("string") for p in parts]).cast("binary"))


def h32(*parts) -> Column:
    """First 32 bits of the hash as a number."""
    return F.conv(F.substring(hex_hash(*parts), 1, 8), 16, 10).cast("long")
