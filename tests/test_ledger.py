"""Logs undone, replayed and scored."""

from pyspark.sql import functions as F

from sievework.operators import ledger, noise

from .test_engine import hotel


def table(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_undo_and_replay(spark):
    df = hotel(spark).cache()
    noisy, log = noise.inject_all(df, rates=noise.rates_for_level("high"))
    assert table(ledger.undo(noisy, log, like=df)) == table(df)
    assert table(ledger.replay(df, log, like=noisy)) == table(noisy)
    assert {r._row_id: r.lead_time for r in ledger.replay(df, log).collect()} == {r._row_id: r.lead_time for r in noisy.collect()}


def test_cells_changed_twice(spark):
    df = hotel(spark).cache()
    targets = noise.Targets(missing=("hotel",), format=(), outliers=(), typos_text=("hotel",), typos_numeric=())
    noisy, log = noise.inject_all(df, rates={"missing": 0.5, "format": 0, "outliers": 0, "typos": 0.5}, targets=targets)
    assert log.groupBy("row_index").count().filter("count > 1").count() > 0
    assert table(ledger.undo(noisy, log, like=df)) == table(df)
    assert table(ledger.replay(df, log, like=noisy)) == table(noisy)


def test_scores(spark):
    schema = "_row_id long, a string, b string"
    noisy = spark.createDataFrame([(0, "x", "1"), (1, None, "2O"), (2, "q", "3"), (3, "03/04/2015", "4"), (4, "t", "5")], schema)
    log = spark.createDataFrame(
        [(1, "a", "y", None, "missing_nan", "missing_values"), (1, "b", "20", "2O", "t", "typos"), (2, "a", "q", "q", "t", "typos"), (3, "a", "2015-04-03", "03/04/2015", "f", "format_errors"), (4, "a", "z", "t", "t", "typos"), (9, "a", "z", "t", "t", "typos"), (0, "absent", "z", "t", "t", "typos")],
        noise.LOG_SCHEMA,
    )
    repaired = spark.createDataFrame([(0, "X", "1"), (1, "y", "20.0"), (2, "q", "3"), (3, "2015-04-03", "4")], schema)  # row 4 is gone
    got = {r.family: tuple(r)[1:] for r in ledger.score(noisy, repaired, log).collect()}
    assert got == {"missing_values": (1, 0, 0, 1, 1, 1.0, 1.0), "typos": (2, 0, 0, 1, 1, 0.5, 1.0), "format_errors": (0, 0, 1, 0, 0, None, None), "none": (0, 1, 0, 0, 1, None, 0.0)}
    assert {r["column"]: tuple(r)[1:] for r in ledger.score_by_column(noisy, repaired, log).collect()} == {"a": (2, 1, 3), "b": (1, 1, 1)}


def test_empty_log(spark):
    df = hotel(spark, 5)
    empty = spark.createDataFrame([], noise.LOG_SCHEMA)
    assert table(ledger.undo(df, empty)) == table(df) and table(ledger.replay(df, empty)) == table(df)
    assert ledger.score(df, df, empty).count() == 0
    assert ledger.score(df, df.withColumn("meal", F.lit("z")), empty).first().changed == 5


def test_scores_make_the_noise_once(spark):
    """What a repair's statistics, the repair and its score read is the written noisy table; only the log still comes from the orders."""
    from sievework import catalogue_repair

    made = catalogue_repair.repair_score_columns(spark, "/root/testdata/sf0.001")
    assert any("/noisy-" in f for f in made.inputFiles())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderkey") and sum("Relation" in x and "orderdate" in x for x in plan.splitlines()) == 1
    assert {r["column"] for r in made.collect()} == set(catalogue_repair._COLUMNS)
