"""What a plan does to a schema, worked out step by step without running anything.

Each step is known by what it takes (texts, numbers, dates) and by what its columns are afterwards (type, and whether they can be null). A step
that cannot mean anything for the columns it names is refused with its number and the reason, before any job starts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import types as T

from ..functions.values import is_numeric

TEXT, NUMBER, ANY, DATE = "text", "a number", "anything", "text or a date"


@dataclass(frozen=True)
class Known:
    """A column's type and whether it can be null."""

    kind: T.DataType
    nullable: bool = True


@dataclass(frozen=True)
class Problem:
    step: int
    name: str
    reason: str

    def __str__(self) -> str:
        return f"step {self.step} ({self.name}): {self.reason}"


_STRING, _DOUBLE, _LONG, _TIME = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()
_same = lambda known, args: known
_nulls = lambda known, args: Known(known.kind, True)
#: Step -> (what it takes, what a column is afterwards). Steps on whole rows stand in _ROWS.
_COLUMNS: dict[str, tuple[str, Callable[[Known, dict], Known]]] = {
    "letters_to_zero": (ANY, lambda k, a: Known(_STRING, k.nullable)),
    "to_number": (ANY, lambda k, a: Known(_DOUBLE)),
    "to_whole": (ANY, lambda k, a: Known(_LONG, a.get("default", 0) is None)),
    "fill_constant": (ANY, lambda k, a: Known(k.kind, False)),
    "fill_mode": (ANY, _same),
    "fill_median": (NUMBER, lambda k, a: Known(_DOUBLE, k.nullable)),
    "impute": (ANY, lambda k, a: Known(_DOUBLE, k.nullable) if is_numeric(k.kind) else k),
    "parse_long_dates": (TEXT, lambda k, a: Known(_TIME)),
    "unify_dates": (DATE, lambda k, a: Known(_STRING)),
    "unify_dates_by_evidence": (DATE, lambda k, a: Known(_STRING)),
    "rename_values": (TEXT, _same),
    "title_case": (TEXT, _same),
    "normalise_text": (TEXT, _same),
    "clip_where": (NUMBER, lambda k, a: Known(k.kind, False)),
    "clip": (NUMBER, _same),
    "disguised_to_null": (ANY, _nulls),
    "outliers_to_null": (NUMBER, _nulls),
    "drop_outlier_rows": (NUMBER, _same),
    "keep_between": (NUMBER, lambda k, a: Known(k.kind, False)),
    "keep_positive_sum": (NUMBER, lambda k, a: Known(k.kind, False)),
    "drop_missing_rows": (ANY, lambda k, a: Known(k.kind, False)),
    "harmonise": (TEXT, _same),
}
_ALL_IF_NONE = {"drop_missing_rows"}
_DEFAULTS = {"keep_positive_sum": ["adults", "children", "babies"]}


def _takes(wanted: str, kind: T.DataType) -> bool:
    if wanted == TEXT:
        return isinstance(kind, T.StringType)
    if wanted == NUMBER:
        return is_numeric(kind) and not isinstance(kind, T.BooleanType)
    return wanted == ANY or isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _named(name: str, args: dict, columns) -> list[str]:
    named = args.get("columns") or args.get("bounds") or ([args["column"]] if "column" in args else []) or _DEFAULTS.get(name, [])
    if not named and name in _ALL_IF_NONE:
        return list(columns)
    return [named] if isinstance(named, str) else list(named)


def _argument(name: str, args: dict, column: str, known: Known) -> str | None:
    """What is wrong with the arguments for a column, if anything is."""
    if name == "fill_constant":
        value = args.get("value")
        if value is None:
            return f"{column} cannot be filled with nothing"
        fits = isinstance(value, bool) if isinstance(known.kind, T.BooleanType) else isinstance(value, (int, float)) and not isinstance(value, bool) if is_numeric(known.kind) else isinstance(value, str) and isinstance(known.kind, T.StringType)
        if not fits:
            return f"{column} is {known.kind.simpleString()} and cannot be filled with {value!r}"
    if "bounds" in args:
        bounds = args["bounds"][column]
        if len(bounds) != 2 or any(isinstance(b, bool) or not isinstance(b, (int, float)) for b in bounds):
            return f"the bounds of {column} are not two numbers"
        if bounds[0] > bounds[1]:
            return f"the bounds of {column} leave nothing between {bounds[0]} and {bounds[1]}"
    return None


def follow(steps, schema: T.StructType) -> tuple[dict[str, Known], list[Problem]]:
    """The columns after all steps, and what is wrong; a step with a problem is taken to change nothing. Steps count from 1."""
    now = {f.name: Known(f.dataType, f.nullable) for f in schema}
    problems = []
    for number, s in enumerate(steps, 1):
        if s.name not in _COLUMNS:
            continue  # whole rows only
        takes, becomes = _COLUMNS[s.name]
        named = _named(s.name, s.args, now)
        present = [c for c in named if c in now]
        if named and not present and s.name not in _DEFAULTS:
            problems.append(Problem(number, s.name, f"the table has none of {', '.join(named)}"))
        for c in present:
            reason = None if _takes(takes, now[c].kind) else f"{c} is {now[c].kind.simpleString()}, and {takes} is needed"
            reason = reason or _argument(s.name, s.args, c, now[c])
            if reason:
                problems.append(Problem(number, s.name, reason))
            else:
                now[c] = becomes(now[c], s.args)
    return now, problems
