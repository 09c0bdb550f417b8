"""Profiles that grow with a table: one mergeable state per batch and column, stored, and the profile of any set of batches from the states alone.

A state has counts, the mean and the sum of squared deviations, least and greatest value, a distinct sketch, and a
quantile sketch (numbers) or a frequent-items sketch (text, first WIDTH characters). Its size does not depend on the rows. A batch is read once;
batches that were profiled before are never read again, and a batch that is tried twice replaces its own state.

Counts, extremes and moments of the parts are those of the whole; distinct counts, quantiles and frequent values are estimates (errors about 2 %, 1 %,
and rows / 5,000).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import is_disguised
from .profile import kind_of

WIDTH, TRACKED, QUANTILE_K, DISTINCT_BITS = 256, 10_000, 400, 13

_TOP = "struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>"
STATE_SCHEMA = f"column string, kind string, rows bigint, missing bigint, n bigint, mean double, squares double, least double, greatest double, distinct binary, spread binary, frequent {_TOP}"


def state(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column of a batch; see STATE_SCHEMA. One aggregate over the batch."""
    columns = list(columns or df.columns)
    numeric = {c for c in columns if kind_of(df, c) == "numeric"}
    wide = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        raw = F.col(f"`{c}`")
        text = raw.cast("string")
        wide.append(F.count(raw).alias(f"n{i}"))
        if c in numeric:
            x = (raw.cast("int") if isinstance(df.schema[c].dataType, T.BooleanType) else raw).cast("double") + F.lit(0.0)
            wide += [F.count_if(raw.isNull()).alias(f"missing{i}"), F.avg(x).alias(f"mean{i}"), F.var_pop(x).alias(f"var{i}"), F.min(x).alias(f"least{i}"), F.max(x).alias(f"greatest{i}"), F.kll_sketch_agg_double(x, QUANTILE_K).alias(f"spread{i}"), F.hll_sketch_agg(x.cast("string"), DISTINCT_BITS).alias(f"distinct{i}")]
        else:
            wide += [F.count_if(raw.isNull() | F.coalesce(is_disguised(text), F.lit(False))).alias(f"missing{i}"), F.hll_sketch_agg(text, DISTINCT_BITS).alias(f"distinct{i}")]
            wide.append(F.expr(f"approx_top_k_accumulate(left(cast(`{c}` as string), {WIDTH}), {TRACKED})").alias(f"frequent{i}"))
    nothing = lambda kind: F.lit(None).cast(kind)
    cells = []
    for i, c in enumerate(columns):
        number = c in numeric
        own = lambda name, kind, there: (F.col(f"{name}{i}") if there else nothing(kind)).cast(kind)  # noqa: B023, E731
        cells.append(F.struct(
            F.lit(c).alias("column"), F.lit(kind_of(df, c)).alias("kind"), F.col("rows"), F.col(f"missing{i}").alias("missing"), F.col(f"n{i}").alias("n"), own("mean", "double", number).alias("mean"),
            (F.col(f"var{i}") * F.col(f"n{i}") if number else nothing("double")).alias("squares"), own("least", "double", number).alias("least"), own("greatest", "double", number).alias("greatest"),
            F.col(f"distinct{i}").alias("distinct"), own("spread", "binary", number).alias("spread"), own("frequent", _TOP, not number).alias("frequent"),
        ))
    return df.agg(*wide).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def add_batch(df: DataFrame, store: str, batch: str, columns: list[str] | None = None) -> None:
    """Profile a batch and keep its state under its name; a second try replaces the first."""
    if not batch or "/" in batch:
        raise ValueError("a batch needs a name without slashes")
    state(df, columns).coalesce(1).write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={batch}")


def states(spark: SparkSession, store: str) -> DataFrame:
    """All stored states, with the column batch."""
    return spark.read.schema(f"{STATE_SCHEMA}, batch string").parquet(store)


def merged(parts: DataFrame) -> DataFrame:
    """The state of all batches together: one row per column."""
    means = parts.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("all_mean"))
    met = parts.join(F.broadcast(means), "column")  # one row per column
    top = F.expr(f"approx_top_k_combine(frequent, {TRACKED})")
    out = met.groupBy("column").agg(
        F.max("kind").alias("kind"), F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.sum("n").alias("n"), F.max("all_mean").alias("mean"),
        F.sum(F.col("squares") + F.col("n") * (F.col("mean") - F.col("all_mean")) * (F.col("mean") - F.col("all_mean"))).alias("squares"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("spread", QUANTILE_K).alias("spread"),
    )
    tops = parts.filter(F.col("frequent").isNotNull()).groupBy("column").agg(top.alias("frequent"))
    spread = F.when(F.col("mean").isNotNull(), F.col("spread"))
    return out.withColumn("spread", spread).join(F.broadcast(tops), "column", "left").select("column", "kind", "rows", "missing", "n", "mean", "squares", "least", "greatest", "distinct", "spread", "frequent")


def profile_of(parts: DataFrame, top_n: int = 5) -> DataFrame:
    """column, dtype_detected, pct_missing, n_unique, top_values, min, max, mean, std, median from states; estimates where profile() counts."""
    whole = merged(parts)
    share = F.bround(F.lit(100.0) * F.col("missing") / F.nullif(F.col("rows"), F.lit(0)), 2)
    std = F.when(F.col("n") > 1, F.bround(F.sqrt(F.col("squares") / (F.col("n") - 1)), 2))
    median = F.when((F.col("n") > 0) & F.col("spread").isNotNull(), F.kll_sketch_get_quantile_double("spread", F.lit(0.5)))
    tops = F.expr(f"case when frequent is not null then transform(filter(approx_top_k_estimate(frequent, {top_n + 1}), x -> x.item is not null), x -> struct(x.item as value, x.count as n)) end")
    return whole.select(
        "column", F.col("kind").alias("dtype_detected"), share.alias("pct_missing"), F.hll_sketch_estimate("distinct").alias("n_unique"), F.slice(tops, 1, top_n).alias("top_values"),
        F.col("least").alias("min"), F.col("greatest").alias("max"), F.bround("mean", 2).alias("mean"), std.alias("std"), median.alias("median"),
    )
