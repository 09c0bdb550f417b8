"""Plans: types followed step by step, resumed after a failure, run apart from the session; scripts with all they start."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.plans import execute
from sievework.plans.plan import STEPS, CleaningPlan, PlanError, Step
from sievework.plans.resume import Prefixes, StepFailed
from sievework.plans.typed import Known

SCHEMA = T.StructType([T.StructField("t", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("d", T.DateType()), T.StructField("f", T.BooleanType()), T.StructField("key", T.LongType(), False)])


def reasons(*steps):
    return [(p.step, p.reason) for p in CleaningPlan(list(steps)).problems(SCHEMA)]


def test_types_are_followed():
    after = CleaningPlan([Step("to_number", {"columns": ["t"]}), Step("fill_median", {"columns": ["t"]}), Step("clip_where", {"bounds": {"n": [0, 3]}}), Step("unify_dates", {"columns": ["d"]}), Step("normalise_text", {"columns": ["d"]})])
    assert after.problems(SCHEMA) == []
    assert after.schema_after(SCHEMA) == {"t": Known(T.DoubleType()), "n": Known(T.IntegerType(), False), "d": Known(T.StringType()), "f": Known(T.BooleanType()), "key": Known(T.LongType(), False)}


def test_refusals():
    assert reasons(Step("fill_mode", {"columns": ["t"]}), Step("fill_median", {"columns": ["t", "n", "absent"]})) == [(2, "t is string, and a number is needed")]
    assert reasons(Step("title_case", {"columns": ["n"]}), Step("clip", {"bounds": {"f": [0, 1], "n": [5, 2]}})) == [(1, "n is int, and text is needed"), (2, "f is boolean, and a number is needed"), (2, "the bounds of n leave nothing between 5 and 2")]
    assert reasons(Step("fill_constant", {"columns": ["n", "t", "f"], "value": "x"})) == [(1, "n is int and cannot be filled with 'x'"), (1, "f is boolean and cannot be filled with 'x'")]
    assert reasons(Step("fill_constant", {"columns": ["t"]}), Step("clip", {"bounds": {"n": ["a", 2]}})) == [(1, "t cannot be filled with nothing"), (2, "the bounds of n are not two numbers")]
    assert reasons(Step("title_case", {"columns": ["absent"]}), Step("drop_missing_rows"), Step("keep_positive_sum"), Step("drop_duplicate_rows")) == [(1, "the table has none of absent")]
    assert reasons(Step("unify_dates", {"columns": ["d"]}), Step("parse_long_dates", {"columns": ["d"]}), Step("title_case", {"columns": ["d"]})) == [(3, "d is timestamp, and text is needed")]
    with pytest.raises(PlanError, match=r"step 1 \(title_case\)"):
        CleaningPlan([Step("title_case", {"columns": ["n"]})]).check_types(SCHEMA)


def test_every_step_is_known():
    from sievework.plans.typed import _COLUMNS

    assert STEPS.keys() - _COLUMNS.keys() == {"drop_duplicate_rows"}


def test_predicted_types_are_those_of_the_result(spark):
    df = spark.createDataFrame([("1", 2, None), ("x", None, "2015-01-02")], "t string, n int, s string")
    for step in [Step("to_number", {"columns": ["t"]}), Step("to_whole", {"columns": ["t"]}), Step("letters_to_zero", {"columns": ["n"]}), Step("fill_median", {"columns": ["n"]}), Step("impute", {"columns": ["n", "t"]}), Step("unify_dates", {"columns": ["s"]}), Step("parse_long_dates", {"columns": ["s"]}), Step("clip", {"bounds": {"n": [0, 1]}}), Step("clip_where", {"bounds": {"n": [0, 1]}}), Step("harmonise", {"column": "t"})]:
        plan = CleaningPlan([step])
        made, said = plan.apply(df).schema, plan.schema_after(df.schema)
        assert {f.name: f.dataType for f in made} == {c: k.kind for c, k in said.items()}, step.name


def test_refused_before_any_job(spark):
    df = spark.createDataFrame([(1, "a")], "n int, t string")
    record = execute.run_plan(spark, CleaningPlan([Step("fill_mode", {"columns": ["t"]}), Step("title_case", {"columns": ["n"]})]), df, lambda d: pytest.fail("ran"))
    assert not record["success"] and record["error_message"] == "step 2 (title_case): n is int, and text is needed"


def test_resumed_plans_run_only_what_is_new(spark, tmp_path):
    df = spark.createDataFrame([(1, " A "), (2, None), (3, "NA")], "n int, t string")
    first = [Step("normalise_text", {"columns": ["t"], "case": "lower"}), Step("disguised_to_null", {"columns": ["t"]})]
    kept = Prefixes(spark, "table 1", str(tmp_path / "kept"))
    with pytest.raises(StepFailed) as e:
        kept.run(CleaningPlan([*first, Step("rename_values", {"columns": ["t"], "names": {"a": ["b"]}}), Step("title_case", {"columns": ["t"]})]), df)
    assert e.value.number == 3 and "step 3 (rename_values)" in str(e.value)
    assert kept.ran == ["normalise_text", "disguised_to_null"]
    out = kept.run(CleaningPlan([*first, Step("rename_values", {"columns": ["t"], "names": {"a": "b"}})]), df)
    assert kept.ran[2:] == ["rename_values"] and sorted((r.n, r.t) for r in out.collect()) == [(1, "b"), (2, None), (3, None)]
    kept.run(CleaningPlan([*first, Step("rename_values", {"columns": ["t"], "names": {"a": "b"}})]), df)
    assert len(kept.ran) == 3  # nothing is left to run
    other = Prefixes(spark, "table 2", str(tmp_path / "kept"))
    other.run(CleaningPlan(first), df)
    assert len(other.ran) == 2  # another table shares nothing
    torn = kept.keys(first)[2]
    os.remove(tmp_path / "kept" / torn / "_SUCCESS")
    assert kept.kept(torn) is None


def test_own_session(spark):
    df = spark.createDataFrame([(1, "a")], "n int, t string")
    before, seen = spark.conf.get("spark.sql.session.timeZone"), {}

    def sink(d):
        seen["other"] = d.sparkSession.conf.get("spark.sql.session.timeZone")
        d.sparkSession.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        d.createOrReplaceTempView("of_the_plan")

    assert execute.run_plan(spark, CleaningPlan([Step("title_case", {"columns": ["t"]})]), df, sink)["success"]
    assert seen["other"] == before == spark.conf.get("spark.sql.session.timeZone")
    assert not spark.catalog.tableExists("of_the_plan") and not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("plan_")]


def _alive(pid):
    try:
        os.kill(pid, 0)
        with open(f"/proc/{pid}/stat") as f:
            return f.read().split()[2] != "Z"
    except (ProcessLookupError, FileNotFoundError):
        return False


@pytest.mark.parametrize("waits", [True, False])
def test_grandchildren_end_with_the_script(tmp_path, waits):
    pid = tmp_path / "pid"
    script = tmp_path / "s.py"
    script.write_text(f"import subprocess, sys, time\np = subprocess.Popen([sys.executable, '-c', 'import time; time.sleep(60)'], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)\nopen({str(pid)!r}, 'w').write(str(p.pid))\nprint('begun', flush=True)\ntime.sleep({60 if waits else 0})")
    record = execute.run_script(script, timeout=3)
    assert record["success"] is not waits and "begun" in record["stdout"]
    for _ in range(50):
        if not _alive(int(pid.read_text())):
            break
        time.sleep(0.1)
    assert not _alive(int(pid.read_text()))


def test_limits(tmp_path):
    hog, loop = tmp_path / "hog.py", tmp_path / "loop.py"
    hog.write_text("x = bytearray(2 << 30)\nprint(len(x))")
    loop.write_text("while True: pass")
    assert "MemoryError" in execute.run_script(hog, timeout=20, memory_mb=512)["error_message"]
    began = time.monotonic()
    assert not execute.run_script(loop, timeout=30, cpu_seconds=1)["success"] and time.monotonic() - began < 20


def test_dates_of_a_plan(spark):
    df = spark.createDataFrame([("03/25/2015",), ("03/04/2015",)], "t string")
    out = CleaningPlan([Step("unify_dates_by_evidence", {"columns": ["t"]})]).apply(df)
    assert sorted(r.t for r in out.select(F.col("t")).collect()) == ["2015-03-04", "2015-03-25"]
