"""Cleaning plans: ordered steps of known operators, checked, then compiled to one chain of DataFrame operations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..operators import clean
from .typed import Known, Problem, follow

#: Step name -> (operator, argument names).
STEPS = {
    "letters_to_zero": (clean.letters_to_zero, {"columns", "wrong", "right"}),
    "to_number": (clean.to_number, {"columns"}),
    "to_whole": (clean.to_whole, {"columns", "default"}),
    "fill_constant": (clean.fill_constant, {"columns", "value"}),
    "fill_mode": (clean.fill_mode, {"columns"}),
    "fill_median": (clean.fill_median, {"columns", "exact"}),
    "impute": (clean.impute, {"columns", "most_missing"}),
    "parse_long_dates": (clean.parse_long_dates, {"columns"}),
    "unify_dates": (clean.unify_dates, {"columns"}),
    "unify_dates_by_evidence": (clean.unify_dates_by_evidence, {"columns"}),
    "rename_values": (clean.rename_values, {"columns", "names"}),
    "title_case": (clean.title_case, {"columns"}),
    "normalise_text": (clean.normalise_text, {"columns", "case"}),
    "clip_where": (clean.clip_where, {"bounds"}),
    "clip": (clean.clip, {"bounds"}),
    "disguised_to_null": (clean.disguised_to_null, {"columns"}),
    "outliers_to_null": (clean.outliers_to_null, {"bounds"}),
    "drop_outlier_rows": (clean.drop_outlier_rows, {"bounds", "most"}),
    "drop_missing_rows": (clean.drop_missing_rows, {"columns", "disguised"}),
    "drop_duplicate_rows": (clean.drop_duplicate_rows, {"ignore"}),
    "keep_between": (clean.keep_between, {"bounds"}),
    "keep_positive_sum": (clean.keep_positive_sum, {"columns"}),
    "harmonise": (clean.harmonise, {"column", "n", "distance"}),
}
#: The seven kinds of step that a constrained plan may use.
CONSTRAINED = frozenset({"drop_missing_rows", "fill_constant", "fill_mode", "fill_median", "drop_duplicate_rows", "unify_dates", "unify_dates_by_evidence", "parse_long_dates", "normalise_text", "rename_values", "to_number", "to_whole", "keep_between"})


class PlanError(ValueError):
    """A plan that cannot be run as written."""


@dataclass
class Step:
    name: str
    args: dict = field(default_factory=dict)


@dataclass
class CleaningPlan:
    steps: list[Step]

    def to_json(self) -> str:
        return json.dumps([{"step": s.name, **s.args} for s in self.steps], indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "CleaningPlan":
        try:
            items = json.loads(text)
            return cls([Step(i["step"], {k: v for k, v in i.items() if k != "step"}) for i in items])
        except (json.JSONDecodeError, KeyError, TypeError, AttributeError) as e:
            raise PlanError(f"not a plan: {e!r}") from e

    def check(self, columns: list[str] | None = None, allowed: frozenset[str] | None = None) -> None:
        """Known steps and arguments, within the allowed ones; with columns, at least one of each step's columns exists."""
        for s in self.steps:
            if s.name not in STEPS or (allowed is not None and s.name not in allowed):
                raise PlanError(f"step {s.name!r} is not allowed")
            unknown = s.args.keys() - STEPS[s.name][1]
            if unknown:
                raise PlanError(f"step {s.name!r} has no argument {', '.join(sorted(unknown))}")
            if columns is not None:
                named = s.args.get("columns") or s.args.get("bounds") or ([s.args["column"]] if "column" in s.args else [])
                named = [named] if isinstance(named, str) else list(named)
                if named and not set(named) & set(columns):
                    raise PlanError(f"step {s.name!r} names no column of the table")

    def problems(self, schema: StructType) -> list[Problem]:
        """What a symbolic run over the types finds wrong; nothing is executed."""
        return follow(self.steps, schema)[1]

    def schema_after(self, schema: StructType) -> dict[str, Known]:
        """Type and nullability of each column after all steps."""
        return follow(self.steps, schema)[0]

    def check_types(self, schema: StructType) -> None:
        """Refuses a plan with problems, naming the first step and why."""
        if found := self.problems(schema):
            raise PlanError("; ".join(map(str, found)))

    def apply(self, df: DataFrame, allowed: frozenset[str] | None = None) -> DataFrame:
        """The compiled chain; the result has the columns of df, no more and no fewer."""
        self.check(None, allowed)
        out = df
        for s in self.steps:
            out = STEPS[s.name][0](out, **{k: {c: tuple(b) for c, b in v.items()} if k == "bounds" else tuple(v) if k == "ignore" else v for k, v in s.args.items()})
        if set(out.columns) != set(df.columns):
            raise PlanError(f"columns changed: {sorted(set(out.columns) ^ set(df.columns))}")
        return out.select(*df.columns)
