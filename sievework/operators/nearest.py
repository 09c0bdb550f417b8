"""Harmonising towards many known values by an index of deletions.

Two texts within d edits of each other have a text in common that each becomes by deleting at most d letters. So the known values are
written out with all their deletions, as 64-bit hashes, and so are the values of the column that are no known value; equal hashes make a pair,
and only pairs are measured. Nothing compares all with all, and nothing is collected or broadcast, since all of it grows with the values; the planner
cannot know how many entries a value has. A value has 1 + n + n(n-1)/2 entries for
d = 2, of its first LETTERS letters at most: within d edits, beginnings of equal length have such a text in common too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import strip

LETTERS = 32


def deletions(text: Column, distance: int, letters: int = LETTERS) -> Column:
    """Hashes of a text's beginning and of all that is left of it after at most `distance` deletions."""
    rest = F.lit(1 << 30)

    def shorter(s: Column) -> Column:
        places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, rest)))

    every = F.array(F.substring(text, 1, letters))
    for _ in range(distance):
        every = F.array_distinct(F.concat(every, F.flatten(F.transform(every, shorter))))
    return F.transform(every, lambda s: F.xxhash64(s))


def nearest_known(values: DataFrame, known: DataFrame, distance: int = 2, letters: int = LETTERS) -> DataFrame:
    """value, known, edits for each different non-null value that is near a known one; both frames have one text column.

    Compared stripped and in lower case; the nearest wins, ties by the known value.
    """
    targets = known.toDF("known").filter("known is not null").groupBy(F.lower(strip("known")).alias("target")).agg(F.min("known").alias("known"))
    own = values.toDF("value").filter("value is not null").distinct().withColumn("own", F.lower(strip("value")))
    grown = targets.hint("merge")
    same = own.join(grown, F.col("own") == F.col("target")).select("value", "known", F.lit(0).alias("edits"))
    rest = own.join(grown, F.col("own") == F.col("target"), "left_anti")
    # The entries of both sides carry the compared text only; what it stands for is looked up for the pairs that are near.
    index = targets.select("target", F.explode(deletions(F.col("target"), distance, letters)).alias("key"))
    asked = rest.select("own").distinct().select("own", F.explode(deletions(F.col("own"), distance, letters)).alias("key"))
    pairs = asked.join(index.hint("merge"), "key").select("own", "target").distinct()
    measured = pairs.withColumn("edits", F.levenshtein("own", "target", distance)).filter("edits >= 0")
    near = measured.join(grown, "target").groupBy("own").agg(F.min(F.struct("edits", "known")).alias("best"))
    return same.unionByName(rest.join(near.hint("merge"), "own").select("value", "best.known", "best.edits"))


def harmonise_known(df: DataFrame, column: str, known: DataFrame, distance: int = 2, letters: int = LETTERS) -> DataFrame:
    """Values of a column within `distance` edits of a known value become it; others, nulls among them, stay."""
    if column not in df.columns:
        return df
    found = nearest_known(df.select(F.col(f"`{column}`")), known, distance, letters).filter("value <> known").select(F.col("value").alias("__value"), F.col("known").alias("__known"))
    met = df.join(found.hint("merge"), F.col(f"`{column}`") == F.col("__value"), "left")
    return met.select(*(F.coalesce("__known", F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns))
