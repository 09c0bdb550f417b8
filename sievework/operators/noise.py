"""Controlled noise: families of cell errors, each logged.

Every family returns (noisy, log): a new table, and one log row per corrupted cell. Which cells, and how, depends on the seed,
the family, the column and the row identifier only. Columns that the table lacks are left out; corrupted columns become
strings, except those with outliers, which keep their type. An empty table gives an empty log; a rate above 1 is a
ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws
from ..functions.values import parse_date
from .rows import ROW, exact_cuts

LOG_SCHEMA = "row_index bigint, column string, original_value string, injected_value string, error_type string, error_family string"

#: Default targets, rates and levels.
FORMAT_COLUMNS = ("reservation_status_date",)
OUTLIER_BOUNDS = {"adr": (-500, 10000), "babies": (10, 50), "stays_in_week_nights": (200, 1000), "days_in_waiting_list": (2000, 9000)}
MISSING_COLUMNS = ("country", "agent", "children", "market_segment", "meal")
TYPO_TEXT_COLUMNS = ("hotel", "deposit_type", "customer_type")
TYPO_NUMERIC_COLUMNS = ("lead_time", "adults")
BASE_RATES = {"missing": 0.10, "format": 0.15, "outliers": 0.02, "typos": 0.08}
LEVELS = {"low": 0.5, "medium": 1.0, "high": 2.0}
#: How a missing value is written, and its error type.
MISSING_FORMS = ((None, "missing_nan"), ("", "missing_empty_string"), ("NA", "missing_NA_string"), ("N/A", "missing_N/A_string"), ("unknown", "missing_unknown_string"), (" ", "missing_whitespace"))
#: How dates are written, and what gets into numbers.
DATE_PATTERNS = ("dd/MM/yyyy", "MM/dd/yyyy", "MMMM dd, yyyy", "dd-MMM-yyyy", "yyyy/MM/dd")
LETTERS = ("O", "l", "S", "B", "€", "kg", "j")


def rates_for_level(level: str) -> dict[str, float]:
    """The base rates times the level's factor, none above 0.5."""
    return {k: min(0.5, round(v * LEVELS[level], 4)) for k, v in BASE_RATES.items()}


@dataclass
class Change:
    """What happens to one column: which rows are hit, the new value, the error type, and whether it is logged."""

    family: str
    hit: Column
    value: Column
    kind: Column
    logged: Column = field(default_factory=lambda: F.lit(True))
    keep_type: bool = False


Hits = dict[tuple[str, str], Column]


def hits(df: DataFrame, wanted: dict[str, tuple], seed: int, row: str) -> Hits:
    """(family, column): the rows that are drawn, for families given as (columns, rate, least number of cells).

    The draws depend on row identifiers only, so the cuts of all families and columns are found together.
    """
    for _, rate, _ in wanted.values():
        if rate > 1:
            raise ValueError(f"rate {rate}: more cells than rows")
    cells = {f"{family}|{c}": (family, c) for family, (columns, _, _) in wanted.items() for c in columns}
    keys = {name: draws.key(seed, family, c, row) for name, (family, c) in cells.items()}

    def sizes(n_rows: int) -> dict[str, int]:
        return {name: min(n_rows, max(wanted[f][2], int(n_rows * wanted[f][1]))) for name, (f, _) in cells.items()}

    cuts = exact_cuts(df, keys, sizes, row)
    return {cell: cuts[name].takes(keys[name], F.col(row)) for name, cell in cells.items()}


def _pick(options: list[Column], k: Column) -> Column:
    return F.element_at(F.array(*options), (k % len(options)).cast("int") + 1)


def missing_changes(df: DataFrame, columns: list[str], drawn: Hits, seed: int, row: str) -> dict[str, Change]:
    out = {}
    for c in columns:
        k = draws.number(draws.key(seed, "missing", c, row, "form"))
        out[c] = Change("missing_values", drawn["missing", c], _pick([F.lit(v).cast("string") for v, _ in MISSING_FORMS], k), _pick([F.lit(t) for _, t in MISSING_FORMS], k))
    return out


def format_changes(df: DataFrame, columns: list[str], drawn: Hits, seed: int, row: str) -> dict[str, Change]:
    """Null dates are left alone; a value that is no date is logged but not changed."""
    out = {}
    for c in columns:
        text = F.col(c).cast("string")
        date = parse_date(text)
        forms = [F.date_format(date, p) for p in DATE_PATTERNS] + [F.unix_timestamp(date).cast("string")]
        new = _pick(forms, draws.number(draws.key(seed, "format", c, row, "form")))
        out[c] = Change("format_errors", drawn["format", c], F.coalesce(new, text), F.when(date.isNull(), "unparsable_original").otherwise("date_format_inconsistency"), F.col(c).isNotNull())
    return out


def outlier_changes(df: DataFrame, bounds: dict[str, tuple], drawn: Hits, seed: int, row: str) -> dict[str, Change]:
    """Integers are cut towards zero, others rounded to two digits."""
    out = {}
    for c in bounds:
        low, high = map(float, bounds[c])
        raw = F.lit(low) + draws.unit(draws.key(seed, "outliers", c, row, "value")) * F.lit(high - low)
        kind = df.schema[c].dataType
        value = raw.cast("bigint") if isinstance(kind, T.IntegralType) else F.bround(raw, 2)
        out[c] = Change("outliers", drawn["outliers", c], value, F.lit("outlier_value"), keep_type=True)
    return out


def typo_text(s: Column, u: Column, cut: Column) -> tuple[Column, Column]:
    """(new text, error type) of a misspelling; u chooses it and its place, cut where the case changes."""
    n = F.length(s)
    op, i = (u % 5).cast("int"), (F.floor(u / 5) % F.greatest(n - 1, F.lit(1))).cast("int")
    at = lambda start, size: F.substring(s, start, size)
    rest = F.lit(1 << 30)
    edge = (cut % F.greatest(n - 1, F.lit(1)) + 1).cast("int")
    forms = [
        (F.concat(at(F.lit(1), i), at(i + 2, rest)), "typo_missing_letter"),
        (F.concat(at(F.lit(1), i + 1), at(i + 1, rest)), "typo_duplicated_letter"),
        (F.concat(at(F.lit(1), i), at(i + 2, F.lit(1)), at(i + 1, F.lit(1)), at(i + 3, rest)), "typo_swapped_letters"),
        (F.concat(F.upper(at(F.lit(1), edge)), F.lower(at(edge + 1, rest))), "typo_random_case"),
        (F.concat(F.lit("  "), s, F.lit(" ")), "typo_extra_whitespace"),
    ]
    short = n < 2
    new = F.when(short, s).otherwise(F.element_at(F.array(*[v for v, _ in forms]), op + 1))
    return new, F.when(short, "typo_too_short_unchanged").otherwise(F.element_at(F.array(*[F.lit(t) for _, t in forms]), op + 1))


def typo_number(s: Column, u: Column) -> tuple[Column, Column]:
    """(new text, error type) of a number with a letter in it."""
    op = (u % 3).cast("int")
    letter = _pick([F.lit(x) for x in LETTERS], F.floor(u / 3))
    place = (F.floor(u / 21) % (F.greatest(F.lit(2), F.length(s)) - 1) + 1).cast("int")
    zero = F.instr(s, "0")
    rest = F.lit(1 << 30)
    as_zero = F.when(zero > 0, F.concat(F.substring(s, F.lit(1), zero - 1), F.lit("O"), F.substring(s, zero + 1, rest))).otherwise(F.concat(s, F.lit("O")))
    inside = F.concat(F.substring(s, F.lit(1), place), letter, F.substring(s, place + 1, rest))
    kinds = ["typo_zero_as_letter_O", "typo_unit_suffix_injected", "typo_letter_inside_number"]
    return F.element_at(F.array(as_zero, F.concat(s, letter), inside), op + 1), F.element_at(F.array(*map(F.lit, kinds)), op + 1)


def typo_changes(df: DataFrame, text: list[str], numeric: list[str], drawn: Hits, seed: int, row: str) -> dict[str, Change]:
    """Null cells that are drawn are neither changed nor logged."""
    out = {}
    for c in [*text, *numeric]:
        s = F.col(c).cast("string")
        u = draws.number(draws.key(seed, "typos", c, row, "form"))
        value, kind = typo_text(s, u, draws.number(draws.key(seed, "typos", c, row, "cut"))) if c in text else typo_number(s, u)
        out[c] = Change("typos", drawn["typos", c] & F.col(c).isNotNull(), value, kind)
    return out


def apply(df: DataFrame, changes: dict[str, Change], row: str) -> tuple[DataFrame, DataFrame]:
    """One pass for the noisy table and one for the log, both without a join or a shuffle."""
    columns = []
    for c in df.columns:
        if c not in changes:
            columns.append(F.col(c))
            continue
        ch = changes[c]
        kind = df.schema[c].dataType if ch.keep_type else T.StringType()
        columns.append(F.when(ch.hit & ch.logged, ch.value.cast(kind)).otherwise(F.col(c).cast(kind)).alias(c))
    noisy = df.select(*columns)
    if not changes:
        return noisy, df.sparkSession.createDataFrame([], LOG_SCHEMA)
    kind = lambda c: df.schema[c].dataType if changes[c].keep_type else T.StringType()
    entries = F.array(*[
        F.when(ch.hit & ch.logged, F.struct(F.col(row).cast("bigint").alias("row_index"), F.lit(c).alias("column"), F.col(c).cast("string").alias("original_value"), ch.value.cast(kind(c)).cast("string").alias("injected_value"), ch.kind.alias("error_type"), F.lit(ch.family).alias("error_family")))
        for c, ch in changes.items()
    ])
    log = df.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("e.*")
    return noisy, log


def _present(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in df.columns]


#: At least one cell per column has an outlier.
LEAST = {"missing": 0, "format": 0, "outliers": 1, "typos": 0}


def inject_missing(df: DataFrame, columns=None, rate: float = 0.10, seed: int = 42, row: str = ROW) -> tuple[DataFrame, DataFrame]:
    columns = _present(df, MISSING_COLUMNS if columns is None else columns)
    return apply(df, missing_changes(df, columns, hits(df, {"missing": (columns, rate, LEAST["missing"])}, seed, row), seed, row), row)


def inject_format(df: DataFrame, columns=None, rate: float = 0.15, seed: int = 42, row: str = ROW) -> tuple[DataFrame, DataFrame]:
    columns = _present(df, FORMAT_COLUMNS if columns is None else columns)
    return apply(df, format_changes(df, columns, hits(df, {"format": (columns, rate, LEAST["format"])}, seed, row), seed, row), row)


def inject_outliers(df: DataFrame, bounds: dict | None = None, rate: float = 0.02, seed: int = 42, row: str = ROW) -> tuple[DataFrame, DataFrame]:
    bounds = OUTLIER_BOUNDS if bounds is None else bounds
    bounds = {c: bounds[c] for c in _present(df, bounds)}
    return apply(df, outlier_changes(df, bounds, hits(df, {"outliers": (list(bounds), rate, LEAST["outliers"])}, seed, row), seed, row), row)


def inject_typos(df: DataFrame, text=None, numeric=None, rate: float = 0.10, seed: int = 42, row: str = ROW) -> tuple[DataFrame, DataFrame]:
    text, numeric = (_present(df, d if c is None else c) for c, d in ((text, TYPO_TEXT_COLUMNS), (numeric, TYPO_NUMERIC_COLUMNS)))
    return apply(df, typo_changes(df, text, numeric, hits(df, {"typos": ([*text, *numeric], rate, LEAST["typos"])}, seed, row), seed, row), row)


@dataclass(frozen=True)
class Targets:
    """Columns of each family."""

    missing: tuple[str, ...] = MISSING_COLUMNS
    format: tuple[str, ...] = FORMAT_COLUMNS
    outliers: tuple[tuple[str, tuple], ...] = tuple(OUTLIER_BOUNDS.items())
    typos_text: tuple[str, ...] = TYPO_TEXT_COLUMNS
    typos_numeric: tuple[str, ...] = TYPO_NUMERIC_COLUMNS


def inject_all(df: DataFrame, seed: int = 42, rates: dict[str, float] | None = None, targets: Targets | None = None, row: str = ROW) -> tuple[DataFrame, DataFrame]:
    """All families: missing, format, outliers, typos, in this order where columns are shared.

    Families on columns of their own are one pass; a family that meets a column changed before starts from the
    changed table.
    """
    rates, targets = BASE_RATES if rates is None else rates, targets or Targets()
    missing, format_, text, numeric = (_present(df, c) for c in (targets.missing, targets.format, targets.typos_text, targets.typos_numeric))
    bounds = {c: b for c, b in targets.outliers if c in df.columns}
    columns = {"missing": missing, "format": format_, "outliers": list(bounds), "typos": [*text, *numeric]}
    drawn = hits(df, {f: (c, rates[f], LEAST[f]) for f, c in columns.items()}, seed, row)
    steps = [
        lambda d: missing_changes(d, missing, drawn, seed, row),
        lambda d: format_changes(d, format_, drawn, seed, row),
        lambda d: outlier_changes(d, bounds, drawn, seed, row),
        lambda d: typo_changes(d, text, numeric, drawn, seed, row),
    ]
    now, logs, changes = df, [], {}
    for step in steps:
        own = step(now)
        if own.keys() & changes.keys():
            now, log = apply(now, changes, row)
            logs.append(log)
            changes, own = {}, step(now)
        changes |= own
    now, log = apply(now, changes, row)
    return now, reduce(DataFrame.unionByName, [*logs, log])


def counts_by_family(log: DataFrame) -> DataFrame:
    return log.groupBy("error_family").agg(F.count(F.lit(1)).alias("n")).orderBy("error_family")
