"""The engine's operators on small tables, edge cases first."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sievework.functions import values as V
from sievework.operators import clean, noise, profile, rows
from sievework.plans import execute, planner, prompts
from sievework.plans.loop import run_loop
from sievework.plans.plan import CONSTRAINED, CleaningPlan, PlanError, Step
from sievework.sources import runs, tables

HOTEL = "_row_id long, hotel string, lead_time int, adults int, children double, babies int, meal string, country string, market_segment string, agent double, adr double, reservation_status_date string, customer_type string"


def hotel(spark, n=200):
    data = [(i, ["City Hotel", "Resort Hotel"][i % 2], i % 90, i % 4, float(i % 3), i % 2, ["BB", "HB", "SC"][i % 3], None if i % 50 == 0 else f"C{i % 9}", "Online TA", float(i % 30), 50.0 + i, (dt.date(2015, 7, 1) + dt.timedelta(days=i % 60)).isoformat() if i % 40 else None, "Transient-Party") for i in range(n)]
    return spark.createDataFrame(data, HOTEL).repartition(5)


def one(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f("v").alias("x")).collect()]


def test_numbers(spark):
    assert one(spark, ["1d", "12D", "7kg", " 12 ", "1e3", ".5", "5.", "inf", "nan", "", "-", None], V.to_number) == [None, None, None, 12.0, 1000.0, 0.5, 5.0, None, None, None, None, None]
    assert one(spark, ["3.9", "-3.9", "x", None], V.to_whole) == [3, -3, 0, 0]


def test_title_and_strip(spark):
    texts = ["offline TA/to", "transient-party", "x_y", "abc1def", "it's", " \t x ", ""]
    assert one(spark, texts, V.title) == [t.title() for t in texts]
    assert one(spark, texts, V.strip) == [t.strip() for t in texts]
    assert one(spark, ["unknown", " NA ", "x", None, " "], V.is_missing) == [True, True, False, True, True]


def test_clips(spark):
    df = spark.createDataFrame([(1,), (None,), (-3,), (99,)], "v int")
    assert [r.v for r in clean.clip_where(df, {"v": (0, 4)}).collect()] == [1, 0, 0, 4]
    assert [r.v for r in clean.clip(df, {"v": (0, 4)}).collect()] == [1, None, 0, 4]


def test_dates(spark):
    texts = ["2015-07-01", "01/07/2015", "07/25/2015", "July 01, 2015", "01-Jul-2015", "2015/07/01", "1435708800", "junk", None, "2015-07-01 10:00:00"]
    assert one(spark, texts, V.iso_date) == ["2015-07-01", "2015-07-01", "2015-07-25", "2015-07-01", "2015-07-01", "2015-07-01", "2015-07-01", None, None, "2015-07-01"]
    assert [x is not None for x in one(spark, texts, V.parse_long_date)] == [False, False, False, True, False, False, False, False, False, False]


def test_row_numbers_and_exact_samples(spark):
    df = rows.with_row_id(spark.range(1000).repartition(7))
    assert sorted(r[rows.ROW] for r in df.collect()) == list(range(1000))
    drawn = {r.id for r in rows.sample_exact(df, 290).collect()}
    assert len(drawn) == 290
    same = rows.sample_exact(df.repartition(3), 290)
    assert {r.id for r in same.collect()} == drawn
    with pytest.raises(ValueError):
        rows.sample_exact(df, 1001)
    assert rows.sample_exact(df, 0).count() == 0
    assert rows.with_row_id(spark.range(0)).count() == 0


def test_samples_of_tables_with_large_buckets(spark, monkeypatch):
    df = rows.with_row_id(spark.range(3000))
    whole = {r.id for r in rows.sample_exact(df, 777).collect()}
    monkeypatch.setattr(rows, "_SMALL", 1)
    monkeypatch.setattr(rows, "_DIGITS", 1)
    assert {r.id for r in rows.sample_exact(df, 777).collect()} == whole and len(whole) == 777
    same = spark.createDataFrame([(1,)] * 50, "_row_id long")
    assert rows.sample_exact(same, 7).count() in (0, 50)


def test_na_tokens(spark):
    assert one(spark, ["", "NA", "N/A", "None", "null", "nan", "unknown", " ", "x, y", None, "#N/A", "n/a"], V.na_to_null) == [None] * 6 + ["unknown", " ", "x, y", None, None, None]


def test_env_file(tmp_path, monkeypatch):
    for name in ("PROVIDER", "MODEL", "HOST", "CLOUD_URL", "KEY"):
        monkeypatch.delenv(f"SIEVEWORK_{name}", raising=False)
    (tmp_path / ".env").write_text("# keys\n\nSIEVEWORK_KEY='k'\nSIEVEWORK_MODEL=m\nSHELL_OTHER=1\n")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("SIEVEWORK_MODEL", "n")
    assert planner.Settings.from_environment() == planner.Settings(key="k", model="n")
    assert planner.Settings.from_environment("none") == planner.Settings(model="n")


@pytest.mark.parametrize("level", ["low", "medium", "high"])
def test_inject_all(spark, level):
    df = hotel(spark).cache()
    rates = noise.rates_for_level(level)
    noisy, log = noise.inject_all(df, rates=rates)
    before, after = ({r._row_id: r.asDict() for r in t.collect()} for t in (df, noisy))
    entries = log.collect()
    cells = {(r.row_index, r["column"]): r for r in entries}
    assert len(cells) == len(entries)
    per = {}
    for r in entries:
        per[r["column"]] = per.get(r["column"], 0) + 1
    for c in ("country", "agent", "children", "market_segment", "meal"):
        assert per[c] == int(200 * rates["missing"])
    assert per["adr"] == per["babies"] == max(1, int(200 * rates["outliers"]))
    assert per["hotel"] == per["lead_time"] == int(200 * rates["typos"])
    assert per["reservation_status_date"] <= int(200 * rates["format"])
    text = lambda x: None if x is None else str(x)
    for i in before:
        for c in before[i]:
            if (i, c) in cells:
                assert text(after[i][c]) == cells[i, c].injected_value
                assert text(before[i][c]) == cells[i, c].original_value
            else:
                assert text(after[i][c]) == text(before[i][c])
    assert {r.error_type for r in entries if r.error_family == "format_errors"} == {"date_format_inconsistency"}
    assert all(-500 <= float(r.injected_value) < 10000 for r in entries if r["column"] == "adr")
    assert dict(noisy.dtypes)["babies"] == "int" and dict(noisy.dtypes)["lead_time"] == "string"


def test_noise_edges(spark):
    df = hotel(spark, 0)
    assert noise.inject_all(df)[1].count() == 0
    with pytest.raises(ValueError):
        noise.inject_missing(hotel(spark, 10), rate=1.5)
    with pytest.raises(KeyError):
        noise.rates_for_level("none")
    short = spark.createDataFrame([(0, ""), (1, "a"), (2, "ee"), (3, None)], "_row_id long, hotel string")
    log = {r.row_index: r for r in noise.inject_typos(short, rate=1.0)[1].collect()}
    assert log[0].error_type == log[1].error_type == "typo_too_short_unchanged" and 3 not in log
    bad = spark.createDataFrame([(0, "junk"), (1, None)], "_row_id long, reservation_status_date string")
    noisy, log = noise.inject_format(bad, rate=1.0)
    assert [r.error_type for r in log.collect()] == ["unparsable_original"] and {r[1] for r in noisy.collect()} == {"junk", None}


def test_shared_columns_are_changed_in_turn(spark):
    df = hotel(spark)
    targets = noise.Targets(missing=("hotel",), format=(), outliers=(), typos_text=("hotel",), typos_numeric=())
    noisy, log = noise.inject_all(df, rates={"missing": 0.5, "format": 0, "outliers": 0, "typos": 0.5}, targets=targets)
    assert {r.error_family: r.n for r in noise.counts_by_family(log).collect()}["missing_values"] == 100
    assert noisy.count() == 200


def test_profile(spark):
    df = spark.createDataFrame([("b", 1, True), ("a", None, False), ("c", 3, True), ("b", 3, None), ("unknown", 2, None), (None, 2, None)], "t string, n int, f boolean")
    r = {x["column"]: x for x in profile.profile(df).collect()}
    assert (r["t"].pct_missing, r["t"].n_unique, [tuple(v) for v in r["t"].top_values]) == (33.33, 4, [("b", 2), ("a", 1), ("c", 1), ("unknown", 1)])
    assert (r["n"].dtype_detected, r["n"].n_unique, r["n"].min, r["n"].max, r["n"].mean, r["n"].std) == ("numeric", 3, 1.0, 3.0, 2.2, 0.84)
    assert (r["f"].dtype_detected, r["f"].mean, r["f"].pct_missing) == ("numeric", 0.67, 50.0)
    empty = profile.profile(df.limit(0)).collect()
    assert [x["column"] for x in empty] == ["t", "n", "f"] and empty[0].pct_missing is None and empty[0].n_unique == 0
    assert profile.profile(df, approximate=True).count() == 3


def test_texts(spark):
    df = hotel(spark, 20).select("_row_id", "hotel", "lead_time")
    assert profile.sample_text(df, 2).splitlines() == ["       hotel lead_time", "  City Hotel         0", "Resort Hotel         1"]
    assert profile.schema_text(df) == "- hotel (categorical/text): examples City Hotel, Resort Hotel\n- lead_time (numeric): examples 0, 1, 2"
    assert "frequent City Hotel (10), Resort Hotel (10)" in profile.profile_text(df)


def test_csv_round_trip(spark, tmp_path):
    values = ["", "NA", "N/A", "None", "null", "nan", "unknown", " ", 'x, "y"', "  pad ", "two\nlines"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    tables.write_csv(df, str(tmp_path / "t"), single=True)
    back = {r.i: r.v for r in tables.read_csv(spark, str(tmp_path / "t")).collect()}
    assert [back[i] for i in range(len(values))] == [None] * 6 + ["unknown", " ", 'x, "y"', "  pad ", "two\nlines"]
    typed = tables.read_csv(spark, str(tmp_path / "t"), "i bigint, v string")
    assert dict(typed.dtypes)["i"] == "bigint"


def test_hotel_workflow(spark):
    data = [("1O", "2", "0", "BB", "Online TA/to", None, "July 01, 2015"), ("1O", "2", "0", "BB", "Online TA/to", None, "July 01, 2015"), ("7kg", "0", "0", None, "x", "PRT", "2015-07-01"), ("5", "9", "-1", "zz", None, "", None)]
    df = spark.createDataFrame(data, "lead_time string, adults string, children string, meal string, market_segment string, country string, reservation_status_date string").withColumn("babies", F.lit(None).cast("int"))
    out = sorted((r.lead_time, r.adults, r.children, r.babies, r.meal, r.market_segment, r.country, str(r.reservation_status_date)) for r in clean.hotel_workflow(df).collect())
    assert out == [(5, 4, 0, 0, "zz", None, "", "None"), (10, 2, 0, 0, "Bed & Breakfast", "Online Ta/To", "Unknown", "2015-07-01 00:00:00")]
    assert clean.hotel_workflow(spark.range(3)).count() == 3


def test_imputation_and_outliers(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b"), (100.0, None)], "x double, t string")
    assert [r.x for r in clean.fill_median(df, ["x"]).collect()] == [1.0, 3.0, 3.0, 100.0]
    assert [r.t for r in clean.fill_mode(df, ["t"]).collect()] == ["a", "b", "b", "b"]
    assert clean.fill_mode(df.filter("t is null"), ["t"]).first().t is None
    assert clean.impute(df, ["x", "t"], most_missing=0.1).count() == 2
    assert [r.x_outlier for r in clean.flag_outliers(df, {"x": (0, 10)}).collect()] == [False, False, False, True]
    assert clean.drop_outlier_rows(df, {"x": (0, 10)}, 0).count() == 3
    assert clean.outlier_bounds(df, ["x"], "iqr", 1.5)["x"][0] < 0
    assert [r.t for r in clean.harmonise(spark.createDataFrame([("Paris",), ("Paris",), (" paris ",), ("Pariss",), ("Rome",), (None,)], "t string"), "t", 1).collect()] == ["Paris", "Paris", "Paris", "Paris", "Rome", None]


def test_plans(spark):
    df = hotel(spark, 20)
    plan = CleaningPlan([Step("fill_constant", {"columns": ["country"], "value": "?"}), Step("clip", {"bounds": {"adr": [0, 60]}})])
    assert CleaningPlan.from_json(plan.to_json()).apply(df).filter("country = '?'").count() == 1
    for bad in ("{", '[{"step": "drop_table"}]', '[{"step": "clip", "limit": 1}]', '[1]'):
        with pytest.raises(PlanError):
            CleaningPlan.from_json(bad).apply(df)
    with pytest.raises(PlanError):
        plan.apply(df, CONSTRAINED)
    with pytest.raises(PlanError):
        CleaningPlan([Step("title_case", {"columns": ["none"]})]).check(df.columns)


def test_prompts(spark):
    df = hotel(spark, 20)
    for approach in prompts.APPROACHES:
        text = prompts.build_prompt(df, approach, "IN", "OUT", previous_script="{input_path}", execution_feedback="boom")
        assert "IN" in text and "OUT" in text and text.startswith(prompts.load_system_prompt())
        assert ("boom" in text) == (approach == "validation_loop")
    assert "{input_path}" in text  # what is put in is not searched again
    assert '{{"old": "new"}}' in prompts.build_prompt(df, "constrained", "a", "b", include_system_prompt=False)
    with pytest.raises(ValueError):
        prompts.load_template("none")


def test_code_blocks(spark):
    texts = ["a ```python\nx\n``` b", "```\ny\n```", "```python\n1\n``` ```python\n2\n```", " none ", "```sql\nq\n```"]
    assert [planner.extract_code(t) for t in texts] == ["x", "y", "1", "none", "sql\nq"] == one(spark, texts, V.first_code_block)


def test_providers():
    import urllib.error

    s = planner.Settings(key="k")
    assert planner.ask_local("p", s, post=lambda url, body, timeout: {"response": body["prompt"] + str(timeout)}) == "p600"
    waits, calls = [], []

    def busy(*a):
        calls.append(a)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 429, "busy", {}, None)
        return {"choices": [{"message": {"content": "ok"}}]}

    assert planner.ask_cloud("p", s, post=busy, wait=waits.append) == "ok" and waits == [1, 2]

    def lost(*a):
        raise ConnectionError

    with pytest.raises(RuntimeError):
        planner.ask_cloud("p", s, post=lost, wait=waits.append)
    with pytest.raises(ValueError):
        planner.ask_cloud("p", planner.Settings())
    with pytest.raises(ValueError):
        planner.ask("p", planner.Settings(provider="none"))


def test_scripts(tmp_path):
    def script(body):
        path = tmp_path / "s.py"
        path.write_text(body)
        return path

    r = execute.run_script(script("print('hi')"))
    assert (r["success"], r["stdout"], r["returncode"], r["error_message"]) == (True, "hi\n", 0, None)
    r = execute.run_script(script("import sys; print('a\\nb', file=sys.stderr); sys.exit(3)"))
    assert (r["success"], r["returncode"], r["error_message"]) == (False, 3, "b")
    assert execute.run_script(script("import sys; print(' ', file=sys.stderr); sys.exit(1)"))["error_message"] == "exit code 1"
    assert execute.run_script(script("import time; time.sleep(9)"), timeout=0.5)["returncode"] is None
    assert not execute.run_script(tmp_path / "none.py")["success"]
    execute.run_and_log(script("print('é')"), tmp_path / "deep" / "log.json")
    assert "é" in (tmp_path / "deep" / "log.json").read_text(encoding="utf-8")


def test_plan_runs_and_loop(spark, tmp_path):
    df = hotel(spark, 30)
    sink = lambda x: x.write.format("noop").mode("overwrite").save()
    slow = lambda x: __import__("time").sleep(5)
    good = json.dumps([{"step": "title_case", "columns": ["hotel"]}])
    assert execute.run_plan(spark, good, df, sink)["success"]
    assert "stopped" in execute.run_plan(spark, good, df, slow, timeout=0.5)["error_message"]

    class Scripted(planner.Planner):
        def __init__(self, *plans):
            self.plans, self.asked = list(plans), []

        def plan(self, prompt):
            self.asked.append(prompt)
            return self.plans.pop(0)

    p = Scripted("{", '[{"step": "x"}]', good)
    out = run_loop(spark, df, p, sink, save_to=tmp_path)
    assert out.success and len(out.records) == 3 and len(p.asked) == 3 and "not a plan" in p.asked[1]
    assert (tmp_path / "generated" / "plan.json").exists() and len(list((tmp_path / "failed").iterdir())) == 2
    p = Scripted("{", "{", "{", "{")
    out = run_loop(spark, df, p, sink)
    assert not out.success and len(out.records) == 3 and len(p.asked) == 3
    rules = planner.RulePlanner(df)
    assert run_loop(spark, df, rules, sink).success
    runs.write_record(out.records[0] | {"script_path": "p"}, tmp_path / "r" / "a.json")
    assert runs.read_records(spark, str(tmp_path / "r")).first().success is False


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
