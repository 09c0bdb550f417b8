"""Prompts from templates and from descriptions of a table."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators.profile import profile_text, sample_text, schema_text
from ..operators.rows import ROW

TEMPLATES = Path(__file__).parent / "templates"
APPROACHES = ("simple", "schema", "profile", "constrained", "fewshot", "validation_loop")
_WITH_SCHEMA = ("schema", "constrained", "fewshot", "validation_loop")


def load_template(approach: str) -> str:
    if approach not in APPROACHES:
        raise ValueError(f"unknown approach {approach!r}; one of {', '.join(APPROACHES)}")
    path = TEMPLATES / f"{approach}.txt"
    if not path.exists():
        raise FileNotFoundError(path)
    return path.read_text(encoding="utf-8")


def load_system_prompt() -> str:
    return (TEMPLATES / "system.txt").read_text(encoding="utf-8")


def fill(template: str, values: dict[str, str]) -> str:
    """Placeholders replaced in one pass: text that is put in is not searched again; doubled braces stay as they are."""
    return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", lambda m: values.get(m[1], m[0]), template)


def build_prompt(df: DataFrame, approach: str, input_path: str, output_path: str, n_sample_rows: int = 5, previous_script: str = "", execution_feedback: str = "", include_system_prompt: bool = True, with_sample: bool = True, row: str = ROW) -> str:
    """A prompt about df. Only what the approach needs is computed: one limit, and one aggregate or two."""
    template = load_template(approach)
    values = {"input_path": input_path, "output_path": output_path, "dataset_sample": sample_text(df, n_sample_rows, row) if with_sample else ""}
    if approach in _WITH_SCHEMA:
        values["schema_description"] = schema_text(df, row)
    if approach == "profile":
        values["profile_description"] = profile_text(df, row)
    if approach == "validation_loop":
        values |= {"previous_script": previous_script, "execution_feedback": execution_feedback}
    prompt = fill(template, values)
    return f"{load_system_prompt()}\n\n{prompt}" if include_system_prompt else prompt


def build_validation_prompt(df: DataFrame, input_path: str, output_path: str, previous_script: str, execution_feedback: str, row: str = ROW) -> str:
    return build_prompt(df, "validation_loop", input_path, output_path, previous_script=previous_script, execution_feedback=execution_feedback, with_sample=False, row=row)
