"""Expressions that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole(col: Column) -> Column:
    """The text, null counted as empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def sha256_hex(col: Column) -> Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)


def word_array(col: Column) -> Column:
    """Words of a text without empty strings."""
    return F.filter(F.split(col, SPACE), lambda w: w != "")
