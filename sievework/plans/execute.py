"""Running plans and scripts under a time limit, with a record of each run."""

from __future__ import annotations

import os
import signal
import subprocess
import sys
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from ..sources.runs import write_record
from .plan import CleaningPlan
from .resume import Prefixes


def _record(success: bool, began: float | None, stdout: str = "", stderr: str = "", returncode: int | None = None, error: str | None = None) -> dict:
    return {"success": success, "stdout": stdout, "stderr": stderr, "returncode": returncode, "duration_seconds": round(time.monotonic() - began, 2) if began is not None else 0.0, "error_message": error}


def _limits(memory_mb: int | None, cpu_seconds: int | None) -> Callable[[], None] | None:
    if memory_mb is None and cpu_seconds is None:
        return None

    def set_limits() -> None:  # in the child, before the script
        import resource

        if memory_mb is not None:
            resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
        if cpu_seconds is not None:
            resource.setrlimit(resource.RLIMIT_CPU, (cpu_seconds, cpu_seconds + 1))

    return set_limits


def _stop_group(leader: subprocess.Popen) -> None:
    """End a process and all that it has started, also where the leader is gone already."""
    try:
        os.killpg(leader.pid, signal.SIGKILL)  # the leader's number is its group's
    except ProcessLookupError:
        pass


def run_script(path: str | Path, timeout: float = 120, working_dir: str | None = None, memory_mb: int | None = None, cpu_seconds: int | None = None) -> dict:
    """A Python script in a process group of its own; never raises. At the time limit, and when the script ends, the whole group ends.

    memory_mb bounds the address space of each process and cpu_seconds its processor time; None is no bound. What the script may
    touch is otherwise what this process may.
    """
    path = Path(path)
    if not path.exists():
        return _record(False, None, error=f"no such script: {path}")
    began = time.monotonic()
    try:
        process = subprocess.Popen([sys.executable, str(path.resolve())], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, cwd=working_dir, start_new_session=True, preexec_fn=_limits(memory_mb, cpu_seconds))
    except Exception as e:  # whatever went wrong is what the record is for
        return _record(False, began, error=str(e))
    try:
        stdout, stderr = process.communicate(timeout=timeout)
    except subprocess.TimeoutExpired:
        _stop_group(process)
        stdout, stderr = process.communicate()
        return _record(False, began, stdout, stderr, error=f"stopped after {timeout:g} s")
    finally:
        _stop_group(process)
    lines = stderr.strip().splitlines()
    error = None if process.returncode == 0 else lines[-1] if lines else f"exit code {process.returncode}"
    return _record(process.returncode == 0, began, stdout, stderr, process.returncode, error)


def run_and_log(path: str | Path, log_path: str | Path, timeout: float = 120, working_dir: str | None = None) -> dict:
    record = run_script(path, timeout, working_dir) | {"script_path": str(path)}
    write_record(record, log_path)
    return record


def in_own_session(spark: SparkSession, df: DataFrame) -> tuple[SparkSession, DataFrame, Callable[[], object]]:
    """(a session of its own, df in it, what removes the view between them): settings and views made there stay there."""
    name = f"plan_{uuid.uuid4().hex}"
    df.createOrReplaceGlobalTempView(name)
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions"):
        value = spark.conf.get(key, None)
        if value is not None:
            own.conf.set(key, value)
    return own, own.table(f"global_temp.{name}"), lambda: spark.catalog.dropGlobalTempView(name)


def run_plan(spark: SparkSession, plan: CleaningPlan | str, df: DataFrame, sink: Callable[[DataFrame], object], timeout: float = 120, allowed: frozenset[str] | None = None, prefixes: Prefixes | None = None) -> dict:
    """A plan in a session of its own: checked by names and types, compiled, then written by sink; its jobs are cancelled at the time limit.
    With prefixes, steps that ran before are not run again. Never raises."""
    began, group, found = time.monotonic(), f"plan-{uuid.uuid4().hex}", {}

    def work() -> None:
        spark.sparkContext.setJobGroup(group, "cleaning plan", interruptOnCancel=True)
        release = None
        try:
            compiled = CleaningPlan.from_json(plan) if isinstance(plan, str) else plan
            compiled.check(df.columns, allowed)
            compiled.check_types(df.schema)
            if prefixes is not None:
                sink(prefixes.run(compiled, df, allowed))
            else:
                _, own, release = in_own_session(spark, df)
                sink(compiled.apply(own, allowed))
        except Exception as e:
            found["error"] = e
        finally:
            if release is not None:
                release()

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(timeout)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        thread.join(10)
        return _record(False, began, error=f"stopped after {timeout:g} s")
    if "error" in found:
        text = str(found["error"]).strip() or repr(found["error"])
        return _record(False, began, stderr=text, returncode=1, error=text.splitlines()[0])
    return _record(True, began, returncode=0)
