"""What an error log is for: undoing the noise, replaying it, and scoring a cleaning against it.

A log has one row per corrupted cell and family. It is pivoted to one row per table row (a partial aggregation first, so only cells travel), and
joined by row identifier and, within the row, by column. Where several families changed a cell one after the other, undoing takes the value
before the first of them and replaying the value after the last.

Defined cases: entries that changed nothing (no-ops) count as neither errors nor repairs; rows that a cleaning dropped have repaired nothing; log columns that
the table lacks are left out; an empty log changes nothing and scores nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import to_number
from .rows import ROW

#: The order in which the families change a table.
FAMILIES = ("missing_values", "format_errors", "outliers", "typos")


def _turn(family: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, FAMILIES)), family)


def pivoted(log: DataFrame, columns: list[str]) -> DataFrame:
    """row_index, and for each column a struct (first: before all changes, last: after them, family: of the last), null for cells without an entry."""

    def cell(c: str) -> Column:
        own = F.col("column") == c
        return F.when(F.count_if(own) > 0, F.struct(
            F.min_by(F.struct("original_value"), F.when(own, _turn(F.col("error_family"))))["original_value"].alias("first"),
            F.max_by(F.struct("injected_value"), F.when(own, _turn(F.col("error_family"))))["injected_value"].alias("last"),
            F.max_by("error_family", F.when(own, _turn(F.col("error_family")))).alias("family"),
        )).alias(f"e_{c}")

    return log.filter(F.col("column").isin(*columns)).groupBy("row_index").agg(*map(cell, columns))


def _with_log(df: DataFrame, log: DataFrame, columns: list[str], row: str) -> DataFrame:
    return df.join(pivoted(log, columns).withColumnRenamed("row_index", "__row"), F.col(row).cast("bigint") == F.col("__row"), "left").drop("__row")


def _rewritten(df: DataFrame, log: DataFrame, end: str, row: str, like: DataFrame | None) -> DataFrame:
    columns = [c for c in df.columns if c != row]
    kinds = {f.name: f.dataType for f in like.schema} if like is not None else {}
    met = _with_log(df, log, columns, row)
    out = []
    for c in df.columns:
        kind = kinds.get(c, df.schema[c].dataType)
        if c == row:
            out.append(F.col(c))
        else:
            out.append(F.when(F.col(f"e_{c}").isNotNull(), F.col(f"e_{c}")[end].cast(kind)).otherwise(F.col(c).cast(kind)).alias(c))
    return met.select(*out)


def undo(noisy: DataFrame, log: DataFrame, row: str = ROW, like: DataFrame | None = None) -> DataFrame:
    """The table before the noise, with the column types of `like` where that is given."""
    return _rewritten(noisy, log, "first", row, like)


def replay(clean: DataFrame, log: DataFrame, row: str = ROW, like: DataFrame | None = None) -> DataFrame:
    """The noisy table from the clean one, with the column types of `like` (texts where it is not given, as a log's values are)."""
    if like is None:
        changed = {r["column"] for r in log.select("column").distinct().collect()}  # at most one per column of the table
        clean = clean.withColumns({c: F.col(c).cast("string") for c in clean.columns if c in changed and c != row})
    return _rewritten(clean, log, "last", row, like)


def same_value(a: Column, b: Column) -> Column:
    """Equal as text, or as numbers; null equals null."""
    x, y = a.cast("string"), b.cast("string")
    return x.eqNullSafe(y) | F.coalesce(to_number(x) == to_number(y), F.lit(False))


def ambiguous_date(text: Column) -> Column:
    """A date of digits whose day and month could be exchanged and would then be another date."""
    parts = [F.regexp_extract(text, r"^(\d{2})/(\d{2})/\d{4}$", k) for k in (1, 2)]
    first, second = (p.try_cast("int") for p in parts)
    return F.coalesce((first <= 12) & (second <= 12) & (first != second), F.lit(False))


def judged(noisy: DataFrame, repaired: DataFrame, log: DataFrame, row: str = ROW, columns: list[str] | None = None) -> DataFrame:
    """One row per cell that was corrupted or that the repair changed: row, column, family (null without an entry), noop, ambiguous, changed, right."""
    columns = columns or [c for c in noisy.columns if c != row and c in repaired.columns]
    fixed = repaired.select(F.col(row).alias("__fixed"), *(F.col(f"`{c}`").cast("string").alias(f"f_{c}") for c in columns))
    met = _with_log(noisy.select(row, *(F.col(f"`{c}`").cast("string").alias(c) for c in columns)), log, columns, row).join(fixed, F.col(row) == F.col("__fixed"), "left")
    there = F.col("__fixed").isNotNull()
    cells, counts = [], []
    for c in columns:
        entry, now = F.col(f"e_{c}"), F.col(f"f_{c}")
        changed = there & ~same_value(F.col(c), now)
        counts.append(entry.isNotNull() | changed)
        cells.append(F.struct(
            F.lit(c).alias("column"), entry["family"].alias("family"),
            F.coalesce(entry["first"].eqNullSafe(entry["last"]) & entry.isNotNull(), F.lit(False)).alias("noop"),
            F.coalesce((entry["family"] == "format_errors") & ambiguous_date(entry["last"]), F.lit(False)).alias("ambiguous"),
            changed.alias("changed"), (entry.isNotNull() & there & same_value(entry["first"], now)).alias("right"),
        ))
    met = met.filter(reduce(Column.__or__, counts))  # most rows have no such cell, and need not be taken apart
    return met.select(F.col(row).alias("row_index"), F.explode(F.filter(F.array(*cells), lambda x: x["family"].isNotNull() | x["changed"])).alias("x")).select("row_index", "x.*")


def score(noisy: DataFrame, repaired: DataFrame, log: DataFrame, row: str = ROW, columns: list[str] | None = None) -> DataFrame:
    """family, errors, noops, ambiguous, restored, changed, recall, precision.

    errors are entries that changed a cell and can be undone; ambiguous dates are counted apart. recall is restored / errors, precision
    restored / changed, both null without a divisor. The family "none" has the cells that were changed although nothing was wrong with them.
    """
    cells = judged(noisy, repaired, log, row, columns)
    real = F.col("family").isNotNull() & ~F.col("noop")
    clear = real & ~F.col("ambiguous")
    counted = cells.groupBy(F.when(F.col("family").isNull() | F.col("noop"), "none").otherwise(F.col("family")).alias("family")).agg(
        F.count_if(clear).alias("errors"), F.count_if(F.col("noop")).alias("noops"), F.count_if(real & F.col("ambiguous")).alias("ambiguous"),
        F.count_if(clear & F.col("changed") & F.col("right")).alias("restored"), F.count_if(F.col("changed") & ~(real & F.col("ambiguous"))).alias("changed"),
    )
    share = lambda over: F.round(F.col("restored") / F.nullif(F.col(over), F.lit(0)), 6)
    return counted.withColumns({"recall": share("errors"), "precision": share("changed")})


def score_by_column(noisy: DataFrame, repaired: DataFrame, log: DataFrame, row: str = ROW, columns: list[str] | None = None) -> DataFrame:
    """column, errors, restored, changed: the same count for each column."""
    cells = judged(noisy, repaired, log, row, columns)
    clear = F.col("family").isNotNull() & ~F.col("noop") & ~F.col("ambiguous")
    return cells.groupBy("column").agg(F.count_if(clear).alias("errors"), F.count_if(clear & F.col("changed") & F.col("right")).alias("restored"), F.count_if(F.col("changed")).alias("changed"))

