"""Plans that go on where they broke: the table after each step is kept under a hash of the steps so far.

The hash covers the table that a plan starts from, so two tables do not share anything. A revised plan begins at the end of the longest kept prefix that it
shares with an earlier one; steps that worked are not run again.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..session import exists, work_folder
from .plan import CleaningPlan, PlanError, Step


class StepFailed(PlanError):
    """A step that broke, with its number from 1."""

    def __init__(self, number: int, step: Step, cause: Exception):
        super().__init__(f"step {number} ({step.name}) failed: {str(cause).strip().splitlines()[0] if str(cause).strip() else cause!r}")
        self.number, self.step = number, step


@dataclass
class Prefixes:
    """Kept tables of one input. folder is storage that all machines see; `source` names the input (its content, not its frame)."""

    spark: SparkSession
    source: str
    folder: str | None = None
    ran: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.folder = self.folder or work_folder(self.spark, "prefixes")

    def keys(self, steps: list[Step]) -> list[str]:
        """One hash per prefix, the empty one first."""
        out, state = [], hashlib.sha256(self.source.encode())
        out.append(state.hexdigest())
        for s in steps:
            state = hashlib.sha256(f"{out[-1]}{json.dumps([s.name, s.args], sort_keys=True)}".encode())
            out.append(state.hexdigest())
        return out

    def kept(self, key: str) -> DataFrame | None:
        path = f"{self.folder}/{key}"
        return self.spark.read.parquet(path) if exists(self.spark, f"{path}/_SUCCESS") else None  # what was not written to its end does not count

    def run(self, plan: CleaningPlan, df: DataFrame, allowed: frozenset[str] | None = None) -> DataFrame:
        """The plan's result, from the longest kept prefix on; each further step is written once. Raises StepFailed."""
        plan.check(None, allowed)
        keys, begin, now = self.keys(plan.steps), 0, df
        for k in range(len(plan.steps), 0, -1):
            if (found := self.kept(keys[k])) is not None:
                begin, now = k, found
                break
        for k in range(begin, len(plan.steps)):
            step = plan.steps[k]
            try:
                CleaningPlan([step]).apply(now).write.mode("overwrite").parquet(f"{self.folder}/{keys[k + 1]}")
            except Exception as e:  # any error of a step is that step's
                raise StepFailed(k + 1, step, e) from e
            self.ran.append(step.name)
            now = self.spark.read.parquet(f"{self.folder}/{keys[k + 1]}")
        return now
