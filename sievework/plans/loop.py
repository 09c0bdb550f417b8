"""Plan, run, repair: a bounded loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.rows import ROW
from .execute import run_plan
from .planner import Planner
from .prompts import build_prompt, build_validation_prompt
from .resume import Prefixes


@dataclass
class Outcome:
    success: bool
    plan: str
    records: list[dict] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)


def run_loop(spark: SparkSession, df: DataFrame, planner: Planner, sink: Callable[[DataFrame], object], input_path: str = "", output_path: str = "", max_attempts: int = 3, timeout: float = 120, save_to: str | Path | None = None, row: str = ROW, prefixes: Prefixes | None = None) -> Outcome:
    """At most max_attempts runs and as many plans: after the last failure none is asked for.

    With prefixes, a plan begins where it departs from those before it. Failed plans are kept, and written to save_to/failed; the one that worked to save_to/generated.
    """
    plan = planner.plan(build_prompt(df, "simple", input_path, output_path, row=row))
    out = Outcome(False, plan)
    for attempt in range(1, max_attempts + 1):
        record = run_plan(spark, plan, df, sink, timeout, prefixes=prefixes)
        out.records.append(record)
        out.plan = plan
        if record["success"]:
            out.success = True
            _save(save_to, "generated", "plan.json", plan)
            break
        out.failed.append(plan)
        _save(save_to, "failed", f"attempt{attempt}.json", plan)
        if attempt < max_attempts:
            feedback = f"{record['error_message']}\n\n{record['stderr']}"
            plan = planner.revise(plan, build_validation_prompt(df, input_path, output_path, plan, feedback, row))
    return out


def _save(folder: str | Path | None, kind: str, name: str, text: str) -> None:
    if folder is not None:
        path = Path(folder) / kind / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
