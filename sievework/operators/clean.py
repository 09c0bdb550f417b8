"""Cleaning operators: each takes a table and returns a new one; columns that it lacks are left out.

Row-wise operators are column expressions; those that need a statistic of a column (mode, median, bounds, frequent
values) compute it in one aggregate of fixed size and join it back as one broadcast row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import values as V
from .frequent import survivors, top_values
from .quantiles import merged_quantiles, quantiles, sketch


def _each(df: DataFrame, columns, new) -> DataFrame:
    present = [c for c in ([columns] if isinstance(columns, str) else columns) if c in df.columns]
    return df.withColumns({c: new(c) for c in present}) if present else df


def letters_to_zero(df: DataFrame, columns, wrong: str = "O", right: str = "0") -> DataFrame:
    return _each(df, columns, lambda c: V.swap_letters(c, wrong, right))


def to_number(df: DataFrame, columns) -> DataFrame:
    return _each(df, columns, V.to_number)


def to_whole(df: DataFrame, columns, default: int = 0) -> DataFrame:
    return _each(df, columns, lambda c: V.to_whole(c, default))


def fill_constant(df: DataFrame, columns, value) -> DataFrame:
    return _each(df, columns, lambda c: F.coalesce(F.col(c), F.lit(value)))


def parse_long_dates(df: DataFrame, columns) -> DataFrame:
    return _each(df, columns, V.parse_long_date)


def unify_dates(df: DataFrame, columns) -> DataFrame:
    return _each(df, columns, V.iso_date)


def date_evidence(df: DataFrame, columns) -> DataFrame:
    """column, day_first, month_first: how many cells can only be read with the day, or only with the month, in front. One aggregate."""
    present = [c for c in columns if c in df.columns]
    counts = []
    for i, c in enumerate(present):
        first, second = V.day_and_month(f"`{c}`")
        counts += [F.count_if(first.between(13, 31) & second.between(1, 12)).alias(f"d{i}"), F.count_if(first.between(1, 12) & second.between(13, 31)).alias(f"m{i}")]
    if not present:
        return df.sparkSession.createDataFrame([], "column string, day_first bigint, month_first bigint")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("day_first"), F.col(f"m{i}").alias("month_first")) for i, c in enumerate(present)])
    return df.agg(*counts).select(F.explode(cells).alias("x")).select("x.*")


def unify_dates_by_evidence(df: DataFrame, columns) -> DataFrame:
    """ISO dates; where day and month could be exchanged a column's other cells decide for all of it, the day in front if they are even.

    Cells that the column's choice cannot read are read the other way.
    """
    found = {r["column"]: r["month_first"] > r["day_first"] for r in date_evidence(df, columns).collect()}  # a row per column
    return _each(df, list(found), lambda c: V.iso_date(c, found[c]))


def rename_values(df: DataFrame, columns, names: dict[str, str]) -> DataFrame:
    return _each(df, columns, lambda c: V.rename_values(c, names))


def title_case(df: DataFrame, columns) -> DataFrame:
    return _each(df, columns, V.title)


def normalise_text(df: DataFrame, columns, case: str = "none") -> DataFrame:
    """Stripped, and in lower, upper or title case."""
    how = {"none": lambda c: c, "lower": F.lower, "upper": F.upper, "title": V.title}[case]
    return _each(df, columns, lambda c: how(V.strip(c)))


def clip_where(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    return _each(df, list(bounds), lambda c: V.clip_where(c, *bounds[c]))


def clip(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    return _each(df, list(bounds), lambda c: V.clip(c, *bounds[c]))


def drop_duplicate_rows(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """One row of each group of equal rows (null equals null); columns of ignore do not count, and of these the row with the least values stays."""
    columns = [c for c in df.columns if c not in ignore]
    rest = [c for c in ignore if c in df.columns]
    if not rest:
        return df.dropDuplicates()
    if not columns:
        return df.orderBy(*rest).limit(1)
    return df.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("__least")).select(*(F.col(f"__least.`{c}`") if c in rest else F.col(f"`{c}`") for c in df.columns))


def keep_positive_sum(df: DataFrame, columns: tuple[str, ...] = ("adults", "children", "babies")) -> DataFrame:
    """Rows whose sum is above zero, if the table has all the columns."""
    if not set(columns) <= set(df.columns):
        return df
    return df.filter(reduce(Column.__add__, map(F.col, columns)) > 0)


def keep_between(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Rows inside all bounds, both included; null is outside."""
    tests = [F.col(c).between(*b) for c, b in bounds.items() if c in df.columns]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def drop_missing_rows(df: DataFrame, columns=None, disguised: bool = False) -> DataFrame:
    columns = [c for c in (columns or df.columns) if c in df.columns]
    if not disguised:
        return df.na.drop(subset=columns)
    return df.filter(~reduce(Column.__or__, [V.is_missing(F.col(c).cast("string")) for c in columns]))


def disguised_to_null(df: DataFrame, columns) -> DataFrame:
    return _each(df, columns, lambda c: F.when(~V.is_missing(c), F.col(c)))


def na_to_null(df: DataFrame, columns=None) -> DataFrame:
    return _each(df, [c for c, kind in df.dtypes if kind == "string"] if columns is None else columns, V.na_to_null)


def _with_row(df: DataFrame, stats: list[Column]) -> DataFrame:
    """df with one row of statistics beside every row."""
    return df.crossJoin(F.broadcast(df.agg(*stats)))  # one row


def fill_mode(df: DataFrame, columns) -> DataFrame:
    """Null becomes the most frequent value, ties by the least. Only where a sketch cannot tell which that is, and for numbers, are all values counted."""
    present = [c for c in columns if c in df.columns]
    text = [c for c in present if dict(df.dtypes)[c] == "string"]
    best, unsure = survivors(df, text, 1) if text else ({}, [])
    unsure = [*unsure, *(c for c in present if c not in text)]
    df = _each(df, best, lambda c: F.coalesce(F.col(c), F.lit(best[c][0][0] if best[c] else None).cast(df.schema[c].dataType)))
    for c in unsure:
        top = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), c).limit(1).select(F.col(c).alias("__mode"))
        df = df.join(F.broadcast(top), F.lit(True), "left").withColumn(c, F.coalesce(F.col(c), F.col("__mode"))).drop("__mode")  # one row
    return df


def fill_median(df: DataFrame, columns, exact: bool = True) -> DataFrame:
    """Null becomes the median, selected by counting; with exact=False that of a sketch (rank error about 0.7 %). Either way columns
    share their passes and nothing that grows with the values is held; a column without values stays null."""
    present = [c for c in columns if c in df.columns]
    if exact:
        found = {c: v[0] for c, v in quantiles(df, present, [0.5]).items()}
    else:
        whole = sketch(df.select(*(F.col(f"`{c}`") for c in present)), present, by=[F.lit(1).alias("all")]) if present else None
        found = {r["column"]: r["value"] for r in merged_quantiles(whole, [0.5]).collect()} if present else {}
    return _each(df, present, lambda c: F.coalesce(F.col(c).cast("double"), F.lit(found.get(c)).cast("double")))


def impute(df: DataFrame, columns, most_missing: float = 0.5) -> DataFrame:
    """Per column: rows go if more cells are missing than most_missing; else numbers get the median, text the mode."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in present)).first()
    gone = [c for c in present if (shares[c] or 0) > most_missing]
    df = df.na.drop(subset=gone) if gone else df
    rest = [c for c in present if c not in gone and shares[c]]
    numeric = [c for c in rest if V.is_numeric(df.schema[c].dataType)]
    return fill_mode(fill_median(df, numeric), [c for c in rest if c not in numeric])


def outlier_bounds(df: DataFrame, columns, method: str = "std", k: float = 3.0) -> dict[str, tuple[float, float]]:
    """Bounds from the table: mean -/+ k standard deviations, or quartiles -/+ k times their distance."""
    present = [c for c in columns if c in df.columns]
    if method == "std":
        r = df.agg(*(f(c).alias(f"{k}_{c}") for c in present for k, f in (("a", F.avg), ("b", F.stddev_samp)))).first() if present else {}
        ends = {c: (r[f"a_{c}"], r[f"b_{c}"]) for c in present}
        return {c: (a - k * b, a + k * b) for c, (a, b) in ends.items() if a is not None and b is not None}
    return {c: (a - k * (b - a), b + k * (b - a)) for c, (a, b) in quantiles(df, present, [0.25, 0.75]).items() if a is not None}


def flag_outliers(df: DataFrame, bounds: dict[str, tuple], suffix: str = "_outlier") -> DataFrame:
    """A boolean column for each bounded one; false for null."""
    return df.withColumns({f"{c}{suffix}": F.coalesce(~F.col(c).between(*b), F.lit(False)) for c, b in bounds.items() if c in df.columns})


def outliers_to_null(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    return _each(df, list(bounds), lambda c: F.when(F.col(c).between(*bounds[c]), F.col(c)))


def drop_outlier_rows(df: DataFrame, bounds: dict[str, tuple], most: int = 1) -> DataFrame:
    """Rows with more than `most` cells outside their bounds go."""
    tests = [F.coalesce(~F.col(c).between(*b), F.lit(False)).cast("int") for c, b in bounds.items() if c in df.columns]
    return df.filter(reduce(Column.__add__, tests) <= most) if tests else df


def harmonise(df: DataFrame, column: str, n: int = 5, distance: int = 2) -> DataFrame:
    """Values within `distance` edits of a frequent value, after stripping and lower-casing, become that value.

    The n most frequent values are a row of literals, so nothing is joined pair by pair; the nearest wins, ties by frequency.
    """
    if column not in df.columns:
        return df
    known = top_values(df, [column], n).orderBy("rank").select("value", F.lower(V.strip("value")).alias("own")).collect()
    if not known:
        return df
    own = F.lower(V.strip(column))
    same: dict[str, str] = {}
    for r in known:
        same.setdefault(r["own"], r["value"])
    # most rows are a frequent value as they stand: distances are worked out for the others only, and no further than needed
    options = [F.struct(F.levenshtein(own, F.lit(r["own"]), distance).alias("d"), F.lit(i).alias("i"), F.lit(r["value"]).alias("v")) for i, r in enumerate(known)]
    best = F.array_min(F.filter(F.array(*options), lambda x: x["d"] >= 0))["v"]
    return df.withColumn(column, F.when(own.isin(*same), V.rename_values(own, same)).otherwise(F.coalesce(best, F.col(column))))


#: Fixed values of the hotel bookings workflow.
MEALS = {"BB": "Bed & Breakfast", "HB": "Half Board", "FB": "Full Board", "SC": "Self Catering", "Undefined": "Undefined/SC"}
GUEST_BOUNDS = {"adults": (0, 4), "children": (0, 10), "babies": (0, 4), "stays_in_weekend_nights": (0, 14), "stays_in_week_nights": (0, 50)}


def hotel_workflow(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """The whole cleaning of hotel bookings, one chain: types, dates, categories, bounds, missing values, duplicates, guests."""
    df = to_whole(letters_to_zero(df, ["lead_time", "adults"]), ["lead_time", "children", "babies", "adults"])
    df = parse_long_dates(to_number(df, "adr"), "reservation_status_date")
    df = title_case(rename_values(df, "meal", MEALS), ["market_segment", "distribution_channel", "customer_type"])
    df = clip_where(to_whole(df, ["stays_in_weekend_nights", "stays_in_week_nights"]), GUEST_BOUNDS)
    df = to_whole(fill_constant(df, "country", "Unknown"), ["agent", "company"])
    df = drop_duplicate_rows(fill_constant(df, "meal", "Undefined/SC"), ignore)
    return keep_positive_sum(df)


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, column, value: rows in and out, and null cells of each shared column before and after."""
    def long(df: DataFrame, when: str) -> DataFrame:
        shared = [c for c in before.columns if c in after.columns]
        row = df.agg(F.count(F.lit(1)).alias("__rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in shared))
        cells = [F.struct(F.lit(f"rows_{when}").alias("metric"), F.lit(None).cast("string").alias("column"), F.col("__rows").alias("value"))]
        cells += [F.struct(F.lit(f"null_{when}").alias("metric"), F.lit(c).alias("column"), F.col(c).alias("value")) for c in shared]
        return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")

    return long(before, "before").unionByName(long(after, "after"))


def _metrics(df: DataFrame, columns: list[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"null{i}") for i, c in enumerate(columns))]


def write_and_report(before: DataFrame, cleaning: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], object]) -> DataFrame:
    """Writes the cleaned table and returns what `report` returns, counted while it was written: the plan runs once.

    What a cleaning step has to know beforehand (a mode, a median) is still its own pass.
    """
    spark, columns = before.sparkSession, list(before.columns)
    into, out = Observation(f"before-{uuid.uuid4().hex}"), Observation(f"after-{uuid.uuid4().hex}")
    cleaned = cleaning(before.observe(into, *_metrics(before, columns)))
    shared = [c for c in columns if c in cleaned.columns]
    sink(cleaned.observe(out, *_metrics(cleaned, shared)))
    rows = []
    for when, seen, names in (("before", into.get, columns), ("after", out.get, shared)):
        rows.append((f"rows_{when}", None, seen["rows"]))
        rows += [(f"null_{when}", c, seen[f"null{i}"]) for i, c in enumerate(names) if c in shared]
    return spark.createDataFrame(rows, "metric string, column string, value bigint")
