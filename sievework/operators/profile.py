"""Profiles and descriptions of tables.

Text columns are unpivoted to (column, value) and counted for distinct counts; top values come from sketches and one exact count of what survives
(frequent.py). Numeric columns are unpivoted to numbers and only their distinct values are shuffled. So a table of any width needs one
shuffle of each kind. Moments and missing cells come from one wide aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import is_disguised, is_numeric
from .frequent import complete_counts, long_form, top_values
from .rows import ROW

PROFILE_SCHEMA = "column string, dtype_detected string, pct_missing double, n_unique bigint, top_values array<struct<value:string,n:bigint>>, min double, max double, mean double, std double"


def kind_of(df: DataFrame, c: str) -> str:
    return "numeric" if is_numeric(df.schema[c].dataType) else "categorical/text"


def _numeric(df: DataFrame, c: str):
    x = F.col(c)
    return x.cast("int") if isinstance(df.schema[c].dataType, T.BooleanType) else x


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, found: number of distinct non-null values. Numbers are counted as numbers, the rest as text: one pass of each kind."""
    whole = [c for c in columns if isinstance(df.schema[c].dataType, (T.IntegralType, T.BooleanType))]
    real = [c for c in columns if isinstance(df.schema[c].dataType, T.FractionalType) and not isinstance(df.schema[c].dataType, T.DecimalType)]
    text = [c for c in columns if c not in whole and c not in real]
    parts = [complete_counts(df, text).groupBy("column").agg(F.count(F.lit(1)).alias("found"))] if text else []
    for names, kind in ((whole, "bigint"), (real, "double")):
        if names:
            cells = F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).cast(kind).alias("value")) for i, c in enumerate(names)])
            different = df.select(F.explode(cells).alias("cell")).select("cell.*").filter(F.col("value").isNotNull()).distinct()
            counted = different.groupBy("place").agg(F.count(F.lit(1)).alias("found"))
            parts.append(counted.select(F.element_at(F.array(*map(F.lit, names)), F.col("place") + 1).alias("column"), "found"))
    return reduce(DataFrame.unionByName, parts)


def first_examples(df: DataFrame, columns: list[str] | None = None, n: int = 3, row: str = ROW) -> DataFrame:
    """column, value, rank of the first n distinct non-null values in row order."""
    columns = columns or [c for c in df.columns if c != row]
    cells = long_form(df, columns, [row]).filter(F.col("value").isNotNull())
    first = cells.groupBy("place", "column", "value").agg(F.min(row).alias("first")).withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(64)))
    part = first.withColumn("r", F.row_number().over(Window.partitionBy("column", "salt").orderBy("first"))).filter(F.col("r") <= n)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("first"))).filter(F.col("rank") <= n).select("place", "column", "value", "rank")


def profile(df: DataFrame, top_n: int = 5, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column, in column order; see PROFILE_SCHEMA.

    Missing cells are counted once each, null or disguised. An empty table has null percentages. With approximate, distinct
    counts are HyperLogLog estimates and no values are shuffled except for the top values.
    """
    columns = columns or df.columns
    numeric = [c for c in columns if kind_of(df, c) == "numeric"]
    text = [c for c in columns if c not in numeric]
    wide = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        missing = F.col(c).isNull() if c in numeric else F.col(c).isNull() | F.coalesce(is_disguised(F.col(c).cast("string")), F.lit(False))
        wide.append(F.count_if(missing).alias(f"missing{i}"))
        if approximate:
            wide.append(F.approx_count_distinct(F.col(c)).alias(f"unique{i}"))
        if c in numeric:
            x = _numeric(df, c)
            wide += [F.min(x).cast("double").alias(f"min{i}"), F.max(x).cast("double").alias(f"max{i}"), F.bround(F.avg(x), 2).cast("double").alias(f"mean{i}"), F.bround(F.stddev_samp(x), 2).alias(f"std{i}")]
    null = lambda: F.lit(None).cast("double")
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("place"), F.lit(c).alias("column"), F.lit(kind_of(df, c)).alias("dtype_detected"),
            F.bround(F.lit(100.0) * F.col(f"missing{i}") / F.nullif(F.col("rows"), F.lit(0)), 2).alias("pct_missing"), (F.col(f"unique{i}") if approximate else F.lit(None)).cast("bigint").alias("unique"),
            *((F.col(f"{k}{i}") if c in numeric else null()).alias(k) for k in ("min", "max", "mean", "std")),
        )
        for i, c in enumerate(columns)
    ])
    base = df.agg(*wide).select(F.explode(rows).alias("r")).select("r.*")
    counted = base.withColumn("n_unique", F.col("unique"))
    if not approximate:
        counted = base.join(distinct_counts(df, columns), "column", "left").withColumn("n_unique", F.coalesce("found", F.lit(0)))
    best = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
    if text:
        tops = top_values(df, text, top_n).groupBy("column").agg(best.alias("top_values"))
        counted = counted.join(tops, "column", "left")
    else:
        counted = counted.withColumn("top_values", F.lit(None).cast("array<struct<value:string,n:bigint>>"))
    return counted.orderBy("place").select("column", "dtype_detected", "pct_missing", "n_unique", "top_values", "min", "max", "mean", "std")


def head(df: DataFrame, n: int = 5, row: str = ROW) -> DataFrame:
    """The first n rows in row order."""
    return df.orderBy(row).limit(n)


# ---------------------------------------------------------------- text for prompts; what reaches the driver is O(columns)


def _cell(value) -> str:
    return "NaN" if value is None else str(value)


def sample_text(df: DataFrame, n: int = 5, row: str = ROW) -> str:
    """The first n rows as a right-aligned table without an index."""
    columns = [c for c in df.columns if c != row]
    rows = [[_cell(r[c]) for c in columns] for r in head(df, n, row).collect()]
    widths = [max(len(x) for x in (c, *(r[i] for r in rows))) for i, c in enumerate(columns)]
    return "\n".join(" ".join(x.rjust(w) for x, w in zip(line, widths)) for line in [columns, *rows])


def schema_text(df: DataFrame, row: str = ROW) -> str:
    """One line per column: name, class, first three distinct values."""
    columns = [c for c in df.columns if c != row]
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in first_examples(df, columns, 3, row).orderBy("place", "rank").collect():
        found[r["column"]].append(r["value"])
    return "\n".join(f"- {c} ({kind_of(df, c)}): examples {', '.join(found[c])}" for c in columns)


def profile_text(df: DataFrame, row: str = ROW) -> str:
    """One line per column: share of missing cells, distinct values, and moments or the three most frequent values."""
    lines = []
    for r in profile(df, columns=[c for c in df.columns if c != row]).collect():
        start = f"- {r['column']} ({r['dtype_detected']}): missing {r['pct_missing']}%, distinct {r['n_unique']}"
        if r["dtype_detected"] == "numeric":
            lines.append(f"{start}, min {r['min']}, max {r['max']}, mean {r['mean']}, std {r['std']}")
        else:
            lines.append(f"{start}, frequent {', '.join(f'{v.value} ({v.n})' for v in (r['top_values'] or [])[:3])}")
    return "\n".join(lines)
