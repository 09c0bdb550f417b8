"""Random choices that depend on a seed and a cell only, so they are the same under any partitioning and in any SQL.

A key is the hex MD5 of seed|family|column|row; draws take further words into it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import column


def key(seed: int, family: str, name: str, row: Column | str, purpose: str = "") -> Column:
    start = "|".join([str(seed), family, name, *([purpose] if purpose else [])])
    return F.md5(F.concat(F.lit(f"{start}|"), column(row).cast("string")))


def number(hex_key: Column) -> Column:
    """The first eight hex digits as a bigint in [0, 2**32)."""
    return F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("bigint")


def unit(hex_key: Column) -> Column:
    """A double in [0, 1)."""
    return number(hex_key) / F.lit(4294967296.0)
