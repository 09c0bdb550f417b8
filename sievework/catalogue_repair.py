"""Queries that use what the noise left behind: logs that are undone, replayed and scored, stable row numbers, levels from a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalogue as base
from .catalogue import load, query
from .operators import clean, incremental, ledger, nearest, noise, quantiles, rows
from .plans import execute, planner
from .plans.loop import run_loop
from .plans.plan import CleaningPlan, Step
from .plans.resume import Prefixes
from .session import work_folder
from .sources import tables

_NUM = base._NUM
_COLUMNS = ("o_orderstatus", "o_date", "o_orderpriority", "o_custkey", "o_totalprice")
_ORIGINAL = "SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_date, o_orderpriority, o_custkey, round_even(o_totalprice * 100, 0)::BIGINT AS o_totalprice FROM orders"


def _hundredths(df: DataFrame) -> DataFrame:
    return df.withColumn("o_totalprice", F.bround(F.col("o_totalprice") * 100, 0).cast("bigint")).select("o_orderkey", *_COLUMNS)


# ---------------------------------------------------------------- logs


@query("undo_orders", _ORIGINAL)
def undo_orders(spark: SparkSession, d: str) -> DataFrame:
    """All families' noise taken back by the log: the table as it was, types included."""
    noisy, log = base._inject_all(spark, d, "high")
    return _hundredths(ledger.undo(noisy, log, "o_orderkey", like=base._orders(spark, d)))


@query("replay_orders", base._all_noisy_sql("medium"))
def replay_orders(spark: SparkSession, d: str) -> DataFrame:
    """The noisy table from the clean one and the log."""
    noisy, log = base._inject_all(spark, d, "medium")
    return _hundredths(ledger.replay(base._orders(spark, d), log, "o_orderkey", like=noisy))


def _repaired(noisy: DataFrame) -> DataFrame:
    df = clean.fill_mode(clean.disguised_to_null(noisy, "o_orderstatus"), ["o_orderstatus"])
    df = clean.harmonise(clean.unify_dates(df, "o_date"), "o_orderpriority")
    df = clean.to_whole(clean.letters_to_zero(df, "o_custkey"), "o_custkey")
    return clean.outliers_to_null(df, {"o_totalprice": (0, 500000)})


def _cells_sql() -> str:
    """family, o (original), n (noisy), f (repaired), hit for every cell of the five columns."""
    r = noise.rates_for_level("medium")
    price = base._outlier("orders", "o_orderkey", "o_totalprice", -500, 10000, r["outliers"], False)
    cells = {
        "o_orderstatus": base._missing("orders", "o_orderkey", "o_orderstatus", r["missing"]), "o_date": base._format(r["format"]),
        "o_orderpriority": base._typo_text("orders", "o_orderkey", "o_orderpriority", r["typos"]), "o_custkey": base._typo_number("orders", "o_orderkey", "o_custkey", r["typos"]), "o_totalprice": price,
    }
    whole = f"trunc(coalesce(CASE WHEN regexp_full_match(replace(n, 'O', '0'), '{_NUM}') THEN try_cast(trim(replace(n, 'O', '0')) AS DOUBLE) END, 0))::BIGINT::VARCHAR"
    fixed = {
        "o_orderstatus": "coalesce(CASE WHEN lower(trim(n)) NOT IN ('', 'na', 'n/a', 'unknown', 'nan', 'none', 'null') THEN n END, (SELECT o_orderstatus FROM (SELECT o_orderstatus FROM hits_o_orderstatus WHERE lower(trim(n)) NOT IN ('', 'na', 'n/a', 'unknown', 'nan', 'none', 'null')) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))",
        "o_date": base._iso.format(c="n"), "o_custkey": whole, "o_totalprice": "CASE WHEN n::DOUBLE BETWEEN 0 AND 500000 THEN n END",
        "o_orderpriority": "(SELECT CASE WHEN near.d <= 2 THEN near.v ELSE hits_o_orderpriority.n END FROM near WHERE near.n IS NOT DISTINCT FROM hits_o_orderpriority.n)",
    }
    parts = []
    for c, x in cells.items():
        parts.append(f"hits_{c} AS (SELECT {c}, '{x.label}' AS family, {c}::VARCHAR AS o, CASE WHEN hit_{c} THEN {x.value}::VARCHAR ELSE {c}::VARCHAR END AS n, hit_{c} AS hit FROM ({x.source}))")
    parts.append("""top AS (SELECT n AS v, row_number() OVER (ORDER BY count(*) DESC, n) AS i FROM hits_o_orderpriority GROUP BY n QUALIFY i <= 5),
near AS (SELECT p.n, arg_min(top.v, levenshtein(lower(trim(p.n)), lower(trim(top.v))) * 10 + top.i) AS v, min(levenshtein(lower(trim(p.n)), lower(trim(top.v)))) AS d FROM (SELECT DISTINCT n FROM hits_o_orderpriority) p, top GROUP BY p.n)""")
    union = " UNION ALL ".join(f"SELECT '{c}' AS col, family, o, n, {fixed[c]} AS f, hit FROM hits_{c}" for c in cells)
    number = lambda x: f"CASE WHEN regexp_full_match({x}, '{_NUM}') THEN try_cast({x} AS DOUBLE) END"
    same = lambda x, y: f"({x} IS NOT DISTINCT FROM {y} OR coalesce({number(x)} = {number(y)}, false))"
    dates = "(family = 'format_errors' AND coalesce(regexp_full_match(n, '\\d{2}/\\d{2}/\\d{4}') AND n[1:2]::INT <= 12 AND n[4:5]::INT <= 12 AND n[1:2] <> n[4:5], false))".replace("n[1:2]::INT", "try_cast(n[1:2] AS INT)").replace("n[4:5]::INT", "try_cast(n[4:5] AS INT)")
    return f"WITH {', '.join(parts)}, cells AS ({union}), judged AS (SELECT *, o IS NOT DISTINCT FROM n AND hit AS noop, hit AND {dates} AS ambiguous, NOT {same('n', 'f')} AS changed, {same('o', 'f')} AS good FROM cells)"


_REAL = "hit AND NOT noop"
_SCORE = f"""{_cells_sql()}
SELECT *, round(restored::DOUBLE / nullif(errors, 0), 6) AS recall, round(restored::DOUBLE / nullif(changed, 0), 6) AS "precision" FROM (SELECT CASE WHEN {_REAL} THEN family ELSE 'none' END AS family, count(*) FILTER (WHERE {_REAL} AND NOT ambiguous) AS errors, count(*) FILTER (WHERE noop) AS noops, count(*) FILTER (WHERE {_REAL} AND ambiguous) AS ambiguous,
  count(*) FILTER (WHERE {_REAL} AND NOT ambiguous AND changed AND good) AS restored, count(*) FILTER (WHERE changed AND NOT ({_REAL} AND ambiguous)) AS changed FROM judged WHERE hit OR changed GROUP BY 1)"""


def _noise_once(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The noisy orders, written once, and their log: a repair's statistics, the repair and its score each read the noisy table."""
    noisy, log = base._inject_all(spark, d, "medium")
    noisy, path = noisy.select("o_orderkey", *_COLUMNS), work_folder(spark, "noisy")
    noisy.write.parquet(path)
    return spark.read.schema(noisy.schema).parquet(path), log


@query("repair_score_orders", _SCORE)
def repair_score_orders(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision of one cleaning, per family of errors."""
    noisy, log = _noise_once(spark, d)
    return ledger.score(noisy, _repaired(noisy), log, "o_orderkey", list(_COLUMNS))


@query("repair_score_columns", f"{_cells_sql()} SELECT col AS \"column\", count(*) FILTER (WHERE {_REAL} AND NOT ambiguous) AS errors, count(*) FILTER (WHERE {_REAL} AND NOT ambiguous AND changed AND good) AS restored, count(*) FILTER (WHERE changed) AS changed FROM judged WHERE hit OR changed GROUP BY 1")
def repair_score_columns(spark: SparkSession, d: str) -> DataFrame:
    noisy, log = _noise_once(spark, d)
    return ledger.score_by_column(noisy, _repaired(noisy), log, "o_orderkey", list(_COLUMNS))


# ---------------------------------------------------------------- row numbers


def _numbers(df: DataFrame) -> DataFrame:
    numbered = rows.with_row_id(df)
    return numbered.agg(F.count(F.lit(1)).alias("n"), F.min(rows.ROW).alias("first"), F.max(rows.ROW).alias("last"), F.count_distinct(rows.ROW).alias("different"))


def _numbers_sql(table: str) -> str:
    return f"SELECT count(*) AS n, 0::BIGINT AS first, count(*) - 1 AS last, count(*) AS different FROM ({table})"


@query("row_numbers_grouped", _numbers_sql("SELECT o_custkey FROM orders GROUP BY o_custkey"))
def row_numbers_grouped(spark: SparkSession, d: str) -> DataFrame:
    """A grouped frame, whose partitions differ from run to run."""
    return _numbers(load(spark, d, "orders").groupBy("o_custkey").count())


@query("row_numbers_joined", _numbers_sql("SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey"))
def row_numbers_joined(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(load(spark, d, "orders").join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber"))


@query("row_numbers_sorted", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS _row_id FROM orders")
def row_numbers_sorted(spark: SparkSession, d: str) -> DataFrame:
    """A sorted frame is numbered in its order."""
    return rows.with_row_id(load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey"))


# ---------------------------------------------------------------- levels

#: What the levels come to, written out: share of cells per level and family.
_SHARES = """(VALUES ('low', 'missing_values', 0.05), ('low', 'format_errors', 0.075), ('low', 'outliers', 0.01), ('low', 'typos', 0.04),
  ('medium', 'missing_values', 0.1), ('medium', 'format_errors', 0.15), ('medium', 'outliers', 0.02), ('medium', 'typos', 0.08),
  ('high', 'missing_values', 0.2), ('high', 'format_errors', 0.3), ('high', 'outliers', 0.04), ('high', 'typos', 0.16)) AS s(level, family, share)"""
_KINDS = "(VALUES ('missing_values', 'o_orderstatus'), ('format_errors', 'o_date'), ('outliers', 'o_totalprice'), ('typos', 'o_orderpriority'), ('typos', 'o_custkey')) AS k(family, col)"


@query("noise_level_counts", f"SELECT level, family, col AS \"column\", trunc((SELECT count(*) FROM orders) * share::DOUBLE)::BIGINT AS n FROM {_SHARES} JOIN {_KINDS} USING (family)")
def noise_level_counts(spark: SparkSession, d: str) -> DataFrame:
    """Log entries of each level, family and column."""
    logs = [base._inject_all(spark, d, level)[1].select(F.lit(level).alias("level"), F.col("error_family").alias("family"), "column") for level in noise.LEVELS]
    every = logs[0].unionByName(logs[1]).unionByName(logs[2])
    return every.groupBy("level", "family", "column").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- quantiles

_PRICED = ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")
_QUARTERS = (0.0, 0.25, 0.5, 0.75, 1.0)


@query("quantiles_lineitem", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS share, round(quantile_cont({c}::DOUBLE, {q}), 6) AS \"value\" FROM lineitem" for c in _PRICED for q in _QUARTERS))
def quantiles_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles of four columns, selected together."""
    found = quantiles.quantiles(load(spark, d, "lineitem"), list(_PRICED), list(_QUARTERS))
    rows_ = [(c, q, v) for c, values in found.items() for q, v in zip(_QUARTERS, values)]
    return spark.createDataFrame(rows_, "column string, share double, value double").withColumn("value", F.round("value", 6))


_FENCES = "(SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b, quantile_cont(l_quantity::DOUBLE, 0.25) AS c, quantile_cont(l_quantity::DOUBLE, 0.75) AS e FROM lineitem)"


@query("outlier_bounds_quartiles", f"SELECT l_orderkey, l_linenumber, coalesce(l_extendedprice NOT BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a), false) AS l_extendedprice_outlier, coalesce(l_quantity NOT BETWEEN c - 0.5 * (e - c) AND e + 0.5 * (e - c), false) AS l_quantity_outlier FROM lineitem, {_FENCES}")
def outlier_bounds_quartiles(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    bounds = clean.outlier_bounds(items, ["l_extendedprice", "l_quantity"], "quartiles", 0.5)
    return clean.flag_outliers(items, bounds).drop("l_extendedprice", "l_quantity")


@query("sketch_quantiles_lineitem", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {q}::DOUBLE AS share, count(*) AS n, true AS within FROM lineitem" for c in _PRICED for q in _QUARTERS))
def sketch_quantiles_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of sketches kept per file and merged: whether the rank of each is within one hundredth of what was asked for."""
    items = load(spark, d, "lineitem")
    found = quantiles.merged_quantiles(quantiles.sketch(items, list(_PRICED)), list(_QUARTERS))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in _PRICED])).alias("cell")
    counted = items.select(cells).select("cell.*").groupBy("column", "x").agg(F.count(F.lit(1)).alias("m"))
    met = counted.join(F.broadcast(found), "column")  # a row per column and share
    ranks = met.groupBy("column", "share", "n").agg(F.sum(F.when(F.col("x") < F.col("value"), F.col("m")).otherwise(0)).alias("below"), F.sum(F.when(F.col("x") <= F.col("value"), F.col("m")).otherwise(0)).alias("at_most"))
    return ranks.select("column", "share", "n", ((F.col("below") / F.col("n") - 0.01 <= F.col("share")) & (F.col("share") <= F.col("at_most") / F.col("n") + 0.01)).alias("within"))


# ---------------------------------------------------------------- profiles of batches

_MEASURED = [*base._NUMERIC["lineitem"], "l_returnflag"]


@query("profile_batches_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 'numeric' AS dtype_detected, round_even(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2)::DOUBLE AS pct_missing, min({c})::DOUBLE AS \"min\", max({c})::DOUBLE AS \"max\", round_even(avg({c}), 2)::DOUBLE AS mean, round_even(stddev_samp({c}), 2)::DOUBLE AS std FROM lineitem" for c in base._NUMERIC["lineitem"]
) + " UNION ALL SELECT 'l_returnflag', 'categorical/text', 0.0, NULL, NULL, NULL, NULL")
def profile_batches_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Three batches profiled one after the other; the profile comes from their stored states."""
    store = work_folder(spark, "profile_batches")
    for k in range(3):
        incremental.add_batch(load(spark, d, "lineitem").filter(F.col("l_orderkey") % 3 == k), store, f"b{k}", _MEASURED)
    return incremental.profile_of(incremental.states(spark, store)).drop("n_unique", "top_values", "median")


@query("profile_batches_orders", "SELECT 'o_orderpriority' AS \"column\", count(DISTINCT o_orderpriority) AS n_unique, (SELECT string_agg(o_orderpriority || ' ' || n, ', ' ORDER BY n DESC, o_orderpriority) FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)) AS top_values FROM orders")
def profile_batches_orders(spark: SparkSession, d: str) -> DataFrame:
    """Distinct and frequent values of a column with few values, for which the merged sketches are exact."""
    parts = [incremental.state(load(spark, d, "orders").filter(F.col("o_orderkey") % 2 == k), ["o_orderpriority"]) for k in range(2)]
    made = incremental.profile_of(parts[0].unionByName(parts[1]))
    best = F.array_sort(F.transform("top_values", lambda x: F.struct((-x["n"]).alias("m"), x["value"].alias("value"), x["n"].alias("n"))))
    return made.select("column", "n_unique", F.array_join(F.transform(best, lambda x: F.concat_ws(" ", x["value"], x["n"].cast("string"))), ", ").alias("top_values"))


# ---------------------------------------------------------------- cleaning that looks at the whole column

_CODES = "(SELECT o_orderkey, substr(md5(o_orderkey::VARCHAR), 1, 10) AS code FROM orders)"
_CODE_TYPOS = base._typo_text("orders", "o_orderkey", "code", 0.02, _CODES)


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 10).alias("code"))


@query("harmonize_known_orders", f"""WITH known AS (SELECT lower(trim(code)) AS target, min(code) AS code FROM {_CODES} GROUP BY 1),
noisy AS (SELECT o_orderkey, CASE WHEN hit_code THEN {_CODE_TYPOS.value} ELSE code END AS code FROM ({_CODE_TYPOS.source})), own AS (SELECT DISTINCT code, lower(trim(code)) AS own FROM noisy),
same AS (SELECT own.code, known.code AS to_code FROM own JOIN known ON own = target),
rest AS MATERIALIZED (SELECT code, own FROM own ANTI JOIN known ON own = target), measured AS (SELECT rest.code, known.code AS to_code, levenshtein(own, target) AS d FROM rest JOIN known ON abs(len(own) - len(target)) <= 2),
near AS (SELECT code, arg_min(to_code, (d, to_code)) AS to_code FROM measured WHERE d <= 2 GROUP BY code)
SELECT o_orderkey, coalesce(same.to_code, near.to_code, noisy.code) AS code FROM noisy LEFT JOIN same USING (code) LEFT JOIN near USING (code)""")
def harmonize_known_orders(spark: SparkSession, d: str) -> DataFrame:
    """Misspelled codes towards as many known codes as there are orders."""
    noisy = noise.inject_typos(_codes(spark, d), ["code"], [], rate=0.02, row="o_orderkey")[0]
    return nearest.harmonise_known(noisy, "code", _codes(spark, d).select("code"))


_MONTH_FIRST = "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%d-%b-%Y') ELSE strftime(o_orderdate, '%m/%d/%Y') END AS american, strftime(o_orderdate, '%d/%m/%Y') AS european FROM orders)"


@query("date_by_evidence", f"SELECT o_orderkey, strftime(coalesce(try_strptime(american, '%Y-%m-%d'), try_strptime(american, '%m/%d/%Y'), try_strptime(american, '%d-%b-%Y')), '%Y-%m-%d') AS american, strftime(strptime(european, '%d/%m/%Y'), '%Y-%m-%d') AS european FROM {_MONTH_FIRST}")
def date_by_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of dates, one with the month in front and one with the day, each read as its own unambiguous cells say."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    american = F.when(key % 5 == 0, F.date_format(date, "yyyy-MM-dd")).when(key % 7 == 0, F.date_format(date, "dd-MMM-yyyy")).otherwise(F.date_format(date, "MM/dd/yyyy"))
    return clean.unify_dates_by_evidence(load(spark, d, "orders").select(key, american.alias("american"), F.date_format(date, "dd/MM/yyyy").alias("european")), ["american", "european"])


@query("date_evidence_counts", f"SELECT c AS \"column\", count(*) FILTER (WHERE a BETWEEN 13 AND 31 AND b BETWEEN 1 AND 12) AS day_first, count(*) FILTER (WHERE b BETWEEN 13 AND 31 AND a BETWEEN 1 AND 12) AS month_first FROM (SELECT 'o_date' AS c, try_cast(v[1:2] AS INT) AS a, try_cast(v[4:5] AS INT) AS b FROM (SELECT CASE WHEN regexp_full_match(o_date, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN o_date END AS v FROM ({base._NOISY_DATE}))) GROUP BY c")
def date_evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the noisy dates of orders say about their order of day and month."""
    return clean.date_evidence(base._noisy_dates(spark, d), ["o_date"])


@query("cleaning_report_observed", base.ORACLE_SQL["cleaning_report"])
def cleaning_report_observed(spark: SparkSession, d: str) -> DataFrame:
    """The report of a cleaning, counted while its result is written."""
    folder = work_folder(spark, "observed")
    return clean.write_and_report(base.disguised_to_null(spark, d), lambda df: clean.drop_missing_rows(df, ["c_mktsegment"]), lambda df: df.write.parquet(folder))


# ---------------------------------------------------------------- plans

_TRIED = {"title_case": {}, "fill_median": {}, "unify_dates": {}, "fill_constant": {"value": "none"}, "to_whole": {}, "clip": {"bounds": [5, 1]}}


def _refusals(spark: SparkSession, d: str, table: str) -> DataFrame:
    df, found = load(spark, d, table), []
    for c in df.columns:
        for name, args in _TRIED.items():
            own = {"bounds": {c: args["bounds"]}} if "bounds" in args else {"columns": [c], **args}
            for p in CleaningPlan([Step("fill_mode", {"columns": [c]}), Step(name, own)]).problems(df.schema):
                found.append((c, p.step, p.name, p.reason))
    return spark.createDataFrame(found, "column string, step int, name string, reason string")


def _refusals_sql(table: str) -> str:
    kind = "CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END"
    number = "kind IN ('bigint', 'int', 'double')"
    parts = [
        ("title_case", "kind <> 'string'", "c || ' is ' || kind || ', and text is needed'"),
        ("fill_median", f"NOT {number}", "c || ' is ' || kind || ', and a number is needed'"),
        ("unify_dates", number, "c || ' is ' || kind || ', and text or a date is needed'"),
        ("fill_constant", "kind <> 'string'", "c || ' is ' || kind || ' and cannot be filled with ' || chr(39) || 'none' || chr(39)"),
        ("clip", "true", f"CASE WHEN {number} THEN 'the bounds of ' || c || ' leave nothing between 5 and 1' ELSE c || ' is ' || kind || ', and a number is needed' END"),
    ]
    cells = " UNION ALL ".join(f"SELECT c AS \"column\", 2::INTEGER AS step, '{name}' AS name, {reason} AS reason FROM t WHERE {test}" for name, test, reason in parts)
    return f"WITH t AS (SELECT column_name AS c, {kind} AS kind FROM (DESCRIBE {table})) {cells}"


@query("plan_refusals_orders", _refusals_sql("orders"))
def plan_refusals_orders(spark: SparkSession, d: str) -> DataFrame:
    """Steps that are refused for each column's type, with number and reason; no job runs."""
    return _refusals(spark, d, "orders")


_BROKEN = [Step("normalise_text", {"columns": ["c_mktsegment"], "case": "lower"}), Step("disguised_to_null", {"columns": ["c_mktsegment"]}), Step("rename_values", {"columns": ["c_mktsegment"], "names": {"machinery": ["machines"]}})]
_MENDED = [*_BROKEN[:2], Step("rename_values", {"columns": ["c_mktsegment"], "names": {"machinery": "machines"}}), Step("fill_constant", {"columns": ["c_mktsegment"], "value": "none given"})]


@query("repair_resumed_customer", f"SELECT c_custkey, CASE coalesce(lower(trim(c_mktsegment)), 'none given') WHEN 'machinery' THEN 'machines' ELSE coalesce(lower(trim(c_mktsegment)), 'none given') END AS c_mktsegment, 4::BIGINT AS steps_run FROM ({base._HOLES})")
def repair_resumed_customer(spark: SparkSession, d: str) -> DataFrame:
    """A plan that breaks in its third step and its repair: the table, and how many steps ran in all (two of the first plan, two of the second)."""
    noisy = base._noisy_customer(spark, d)[0].withColumnRenamed("c_custkey", rows.ROW)

    class Twice(planner.RulePlanner):
        def plan(self, prompt: str = "") -> str:
            return CleaningPlan(_MENDED if "What happened" in prompt else _BROKEN).to_json()

    folder, kept = work_folder(spark, "resumed"), Prefixes(spark, f"{d}/customer noisy {json.dumps(noisy.dtypes)}")
    run_loop(spark, noisy, Twice(noisy), lambda df: df.write.mode("overwrite").parquet(folder), prefixes=kept)
    return spark.read.parquet(folder).withColumnRenamed(rows.ROW, "c_custkey").withColumn("steps_run", F.lit(len(kept.ran)).cast("bigint"))


@query("plan_own_session", f"SELECT c_custkey, coalesce(lower(trim(c_mktsegment)), 'none given') AS c_mktsegment, true AS kept FROM ({base._HOLES})")
def plan_own_session(spark: SparkSession, d: str) -> DataFrame:
    """A plan whose sink changes settings: the table, and whether this session's are as they were."""
    folder, before = work_folder(spark, "own"), spark.conf.get("spark.sql.session.timeZone")

    def sink(df: DataFrame) -> None:
        df.sparkSession.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        df.write.parquet(folder)

    record = execute.run_plan(spark, base._PLAN, base._noisy_customer(spark, d)[0], sink)
    if not record["success"]:
        raise RuntimeError(record["error_message"])
    return spark.read.parquet(folder).withColumn("kept", F.lit(spark.conf.get("spark.sql.session.timeZone") == before))


# ---------------------------------------------------------------- sources


@query("csv_round_trip_documents", f"SELECT doc_id, CASE WHEN text IN ({base._na}) THEN NULL ELSE text END AS text FROM documents")
def csv_round_trip_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, with their line breaks and quotes, through a CSV that is found to have them."""
    path = work_folder(spark, "csv_documents")
    tables.write_csv(load(spark, d, "documents").select("doc_id", "text"), path)
    return tables.read_csv(spark, path, "doc_id bigint, text string")


@query("csv_typed_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, round_even(o_totalprice * 100, 0)::BIGINT AS o_totalprice, o_orderpriority FROM orders")
def csv_typed_orders(spark: SparkSession, d: str) -> DataFrame:
    """A CSV without line breaks in cells, read in splits; types are found."""
    path = work_folder(spark, "csv_orders")
    tables.write_csv(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path)
    return tables.read_csv(spark, path).withColumn("o_totalprice", F.bround(F.col("o_totalprice") * 100, 0).cast("bigint"))


# ---------------------------------------------------------------- the workflow on all columns of bookings


def _bookings() -> dict[str, str]:
    """Columns of a bookings table from orders, in SQL that both engines read; k is a row's number below 4,000, so rows repeat."""
    month = "CASE k % 4 WHEN 0 THEN 'July' WHEN 1 THEN 'August' WHEN 2 THEN 'January' ELSE 'March' END"
    text = lambda x: f"CAST({x} AS STRING)"
    return {
        "hotel": "CASE WHEN k % 3 = 0 THEN 'City Hotel' ELSE 'Resort Hotel' END", "is_canceled": "k % 2",
        "lead_time": f"CASE WHEN k % 11 = 0 THEN '1O' || {text('k % 7')} WHEN k % 13 = 0 THEN '12kg' WHEN k % 17 = 0 THEN NULL ELSE {text('k % 400')} END",
        "arrival_date_year": "2015 + k % 3", "arrival_date_month": month, "arrival_date_week_number": "k % 53 + 1", "arrival_date_day_of_month": "k % 28 + 1",
        "stays_in_weekend_nights": f"CASE WHEN k % 19 = 0 THEN NULL ELSE {text('k % 21 - 2')} END", "stays_in_week_nights": f"{text('k % 70 - 3')} || CASE WHEN k % 23 = 0 THEN '.0' ELSE '' END",
        "adults": f"CASE WHEN k % 29 = 0 THEN 'O' ELSE {text('k % 6')} END", "children": f"CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN '1.0' ELSE {text('k % 3')} END", "babies": f"{text('k % 16 - 1')}",
        "meal": "CASE k % 7 WHEN 0 THEN 'BB' WHEN 1 THEN 'HB' WHEN 2 THEN 'FB' WHEN 3 THEN 'SC' WHEN 4 THEN 'Undefined' WHEN 5 THEN NULL ELSE 'Picnic' END",
        "country": "CASE WHEN k % 10 = 0 THEN NULL ELSE 'C' || CAST(k % 30 AS STRING) END", "market_segment": "CASE k % 3 WHEN 0 THEN 'online TA' WHEN 1 THEN 'OFFLINE ta/to' ELSE 'groups' END",
        "distribution_channel": "CASE k % 3 WHEN 0 THEN 'ta/TO' WHEN 1 THEN 'DIRECT' ELSE 'corporate' END", "is_repeated_guest": "k % 2", "previous_cancellations": "k % 4", "previous_bookings_not_canceled": "k % 5",
        "reserved_room_type": "CASE WHEN k % 2 = 0 THEN 'A' ELSE 'D' END", "assigned_room_type": "CASE WHEN k % 3 = 0 THEN 'A' ELSE 'E' END", "booking_changes": "k % 3", "deposit_type": "CASE WHEN k % 9 = 0 THEN 'Non Refund' ELSE 'No Deposit' END",
        "agent": f"CASE WHEN k % 6 = 0 THEN NULL WHEN k % 8 = 0 THEN 'NULL' ELSE {text('k % 500')} || '.0' END", "company": f"CASE WHEN k % 4 <> 0 THEN NULL ELSE {text('k % 90')} END", "days_in_waiting_list": "k % 100",
        "customer_type": "CASE k % 3 WHEN 0 THEN 'transient' WHEN 1 THEN 'transient-PARTY' ELSE 'CONTRACT' END", "adr": f"CASE WHEN k % 31 = 0 THEN '75j' WHEN k % 37 = 0 THEN NULL ELSE {text('k % 300')} || '.5' END",
        "required_car_parking_spaces": "k % 2", "total_of_special_requests": "k % 5", "reservation_status": "CASE WHEN k % 2 = 1 THEN 'Canceled' ELSE 'Check-Out' END",
        "reservation_status_date": f"CASE k % 5 WHEN 0 THEN '2015-07-01' WHEN 1 THEN NULL ELSE {month} || ' ' || CASE WHEN k % 28 < 9 THEN '0' ELSE '' END || {text('k % 28 + 1')} || ', 2016' END",
    }


_BOOKINGS = _bookings()


def _bookings_sql() -> str:
    number = lambda x: f"CASE WHEN regexp_full_match({x}, '{_NUM}') THEN try_cast(trim({x}) AS DOUBLE) END"
    whole = lambda x: f"trunc(coalesce({number(x)}, 0))::BIGINT"
    clip = lambda x, low, high: f"least(greatest({x}, {low}), {high})"
    cleaned = {c: c for c in _BOOKINGS}
    cleaned |= {"lead_time": whole("replace(lead_time, 'O', '0')"), "adults": clip(whole("replace(adults, 'O', '0')"), 0, 4), "children": clip(whole("children"), 0, 10), "babies": clip(whole("babies"), 0, 4)}
    cleaned |= {"stays_in_weekend_nights": clip(whole("stays_in_weekend_nights"), 0, 14), "stays_in_week_nights": clip(whole("stays_in_week_nights"), 0, 50), "agent": whole("agent"), "company": whole("company"), "adr": number("adr")}
    cleaned |= {c: base._title.format(c=c) for c in ("market_segment", "distribution_channel", "customer_type")}
    cleaned |= {"meal": "coalesce(CASE meal WHEN 'BB' THEN 'Bed & Breakfast' WHEN 'HB' THEN 'Half Board' WHEN 'FB' THEN 'Full Board' WHEN 'SC' THEN 'Self Catering' WHEN 'Undefined' THEN 'Undefined/SC' ELSE meal END, 'Undefined/SC')", "country": "coalesce(country, 'Unknown')"}
    cleaned |= {"reservation_status_date": "strftime(try_strptime(reservation_status_date, '%B %d, %Y'), '%Y-%m-%d')"}
    raw = f"SELECT {', '.join(f'{x} AS {c}' for c, x in _BOOKINGS.items())} FROM (SELECT o_orderkey % 4000 AS k FROM orders)"
    return f"SELECT * FROM (SELECT DISTINCT {', '.join(f'{x} AS {c}' for c, x in cleaned.items())} FROM ({raw})) WHERE adults + children + babies > 0"


@query("workflow_bookings", _bookings_sql())
def workflow_bookings(spark: SparkSession, d: str) -> DataFrame:
    """The whole workflow on all 32 columns of bookings: every step has cells to change."""
    k = load(spark, d, "orders").select((F.col("o_orderkey") % 4000).alias("k"))
    bookings = k.select(*(F.expr(x).alias(c) for c, x in _BOOKINGS.items()))
    return clean.hotel_workflow(bookings).withColumn("reservation_status_date", F.date_format("reservation_status_date", "yyyy-MM-dd"))


@query("repair_three_attempts", f"""SELECT * FROM (SELECT 1::INTEGER AS attempt, 'step ''unknown'' is not allowed' AS error_message, NULL::BIGINT AS rows, NULL::BIGINT AS filled
UNION ALL SELECT 2, 'step 2 (title_case): ' || column_name || ' is ' || CASE column_type WHEN 'INTEGER' THEN 'int' ELSE 'bigint' END || ', and text is needed', NULL, NULL FROM (DESCRIBE customer) WHERE column_name = 'c_nationkey'
UNION ALL SELECT 3, NULL, count(*), count(*) - count(c_mktsegment) FROM ({base._HOLES}))""")
def repair_three_attempts(spark: SparkSession, d: str) -> DataFrame:
    """The loop up to its last attempt, on a noisy table: an unknown step, a step for another type, then a plan that works; what it wrote is counted."""
    noisy = base._noisy_customer(spark, d)[0].join(load(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").withColumnRenamed("c_custkey", rows.ROW)
    plans = [
        [{"step": "unknown"}],
        [{"step": "disguised_to_null", "columns": ["c_mktsegment"]}, {"step": "title_case", "columns": ["c_nationkey"]}],
        [{"step": "disguised_to_null", "columns": ["c_mktsegment"]}, {"step": "fill_constant", "columns": ["c_mktsegment"], "value": "none given"}],
    ]

    class Learner(planner.Planner):
        asked = 0

        def plan(self, prompt: str) -> str:
            Learner.asked += 1
            return json.dumps(plans[Learner.asked - 1])

    folder = work_folder(spark, "three")
    out = run_loop(spark, noisy, Learner(), lambda df: df.write.mode("overwrite").parquet(folder))
    counted = spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("c_mktsegment") == "none given").alias("filled"))
    attempts = spark.createDataFrame([(k + 1, r["error_message"], r["success"]) for k, r in enumerate(out.records)], "attempt int, error_message string, success boolean")
    return attempts.join(counted, F.col("success"), "left").select("attempt", "error_message", "rows", "filled")
