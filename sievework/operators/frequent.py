"""The most frequent values of columns, exact, without a shuffle of every distinct value.

First pass: each task summarises the 64-bit hashes of each column's values in TRACKED counters (a frequent-items sketch of fixed size,
which is why hashes and not texts are tracked), and the summaries are merged. Second pass: only values whose hash came out are counted, exactly;
these are at most SURVIVORS per column. A value that did not come out is rarer than twice the sketch's error and
than the rows that the survivors leave over; where the n-th count is above one of these the answer is complete. Columns for which that cannot be said (keys,
flat distributions) are counted in full.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRACKED, SURVIVORS = 10_000, 1_000


def long_form(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """place, column, value (string) for every cell, with the columns of keep."""
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)])
    return df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.*")


def _unfound(rows: int, tracked: int) -> float:
    """No value that the sketch leaves out is more frequent than this: not reported means a lower bound of at most the error, and a count at most the error above."""
    size = 1 << max(3, (int(tracked / 0.75) - 1).bit_length())
    return 2 * 3.5 / size * rows


def complete_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """place, column, value, n for every distinct non-null value: what is counted where a sketch cannot tell."""
    return long_form(df, columns).filter(F.col("value").isNotNull()).groupBy("place", "column", "value").agg(F.count(F.lit(1)).alias("n"))


def survivors(df: DataFrame, columns: list[str], n: int, tracked: int = TRACKED) -> tuple[dict[str, list[tuple[str, int]]], list[str]]:
    """({column: its n most frequent values with counts, ties by value}, columns for which the sketch cannot tell)."""
    hashed = [F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`").cast("string"))).alias(f"h{i}") for i, c in enumerate(columns)]
    wanted = min(SURVIVORS, tracked)
    found = df.select(*hashed).agg(*(F.count(f"h{i}").alias(f"n{i}") for i in range(len(columns))), *(F.expr(f"approx_top_k(h{i}, {wanted}, {tracked})").alias(f"t{i}") for i in range(len(columns)))).first()
    names = {i: [x.item for x in found[f"t{i}"] if x.item is not None] for i in range(len(columns))}
    # values whose hash came out; a hash that two values share only brings one value more
    tests = [F.col("place") == i for i, hashes in names.items() if hashes]
    if not tests:
        return {c: [] for i, c in enumerate(columns) if not found[f"n{i}"]}, [c for i, c in enumerate(columns) if found[f"n{i}"]]
    table = df.sparkSession.createDataFrame([(i, h) for i, hashes in names.items() for h in hashes], "p int, h bigint")
    cells = long_form(df, columns).filter(F.col("value").isNotNull()).withColumn("h", F.xxhash64("value"))
    met = cells.join(F.broadcast(table.withColumnRenamed("p", "place")), ["place", "h"], "left_semi")  # at most SURVIVORS a column
    counted = met.groupBy("place", "value").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pydict()
    per: dict[int, list[tuple[str, int]]] = {i: [] for i in range(len(columns))}
    for place, value, m in zip(counted["place"], counted["value"], counted["n"]):
        per[place].append((value, m))
    best, unsure = {}, []
    for i, c in enumerate(columns):
        total = found[f"n{i}"]
        ranked = sorted(per[i], key=lambda x: (-x[1], x[0].encode()))
        over = total - sum(m for _, m in ranked)
        least = ranked[n - 1][1] if len(ranked) >= n else 0
        cut = found[f"t{i}"][-1]["count"] if len(names[i]) == wanted and names[i] else 0  # what stood behind the last one reported
        if over == 0 or least > min(over, max(_unfound(total, tracked), cut)):
            best[c] = ranked[:n]
        else:
            unsure.append(c)
    return best, unsure


def top_values(df: DataFrame, columns: list[str] | None = None, n: int = 5, tracked: int = TRACKED) -> DataFrame:
    """place, column, value, n, rank of the n most frequent values: most frequent first, ties by value."""
    columns = list(columns or df.columns)
    best, unsure = survivors(df, columns, n, tracked)
    rows = [(columns.index(c), c, v, m, k + 1) for c, values in best.items() for k, (v, m) in enumerate(values)]
    parts = [df.sparkSession.createDataFrame(rows, "place int, column string, value string, n bigint, rank int")] if rows or not unsure else []
    if unsure:
        parts.append(_ranked(complete_counts(df, unsure), columns, n))
    return reduce(DataFrame.unionByName, parts)


def _ranked(counts: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Ranks are cut within salted groups first, so that no task orders all values of a column."""
    order = [F.desc("n"), F.asc("value")]
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(64)))
    part = salted.withColumn("r", F.row_number().over(Window.partitionBy("column", "salt").orderBy(*order))).filter(F.col("r") <= n)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).filter(F.col("rank") <= n)  # at most 64 * n rows per column
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column")).cast("int") - 1
    return ranked.select(place.alias("place"), "column", "value", "n", "rank")
