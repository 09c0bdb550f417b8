"""Registry of the engine's queries: callables, and the SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .operators import clean, noise, profile, rows
from .plans import execute, planner, prompts
from .plans.loop import run_loop
from .plans.plan import CleaningPlan, Step
from .session import work_folder
from .sources import runs, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def load(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# ---------------------------------------------------------------- SQL pieces


def _u(family: str, column: str, key: str, purpose: str) -> str:
    return f"('0x' || substr(md5('42|{family}|{column}|{purpose}|' || {key}), 1, 8))::BIGINT"


def _hit(family: str, column: str, key: str, rate: float, least: int = 0) -> str:
    n = f"trunc(count(*) OVER () * {rate}::DOUBLE)"
    n = f"greatest({least}, {n})" if least else n
    return f"row_number() OVER (ORDER BY md5('42|{family}|{column}|' || {key}), {key}) <= {n}"


def _choose(options: list[str], k: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} = {i} THEN {o}" for i, o in enumerate(options)) + " END"


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


class Cells:
    """SQL of one column's noise: the table with hit, value and type beside it."""

    def __init__(self, table: str, key: str, column: str, family: str, label: str, rate: float, value: str, kind: str, base: str | None = None, least: int = 0):
        self.key, self.column, self.label, self.value, self.kind = key, column, label, value, kind
        self.source = f"SELECT *, {_hit(family, column, key, rate, least)} AS hit_{column} FROM {base or table}"

    def log(self) -> str:
        return f"SELECT {self.key}::BIGINT AS row_index, '{self.column}' AS \"column\", {self.column}::VARCHAR AS original_value, {self.value}::VARCHAR AS injected_value, {self.kind} AS error_type, '{self.label}' AS error_family FROM ({self.source}) WHERE hit_{self.column}"


def _missing(table: str, key: str, column: str, rate: float) -> Cells:
    k = f"{_u('missing', column, key, 'form')} % 6"
    return Cells(table, key, column, "missing", "missing_values", rate, f"({_choose([_text(v) for v, _ in noise.MISSING_FORMS], k)})", f"({_choose([_text(t) for _, t in noise.MISSING_FORMS], k)})")


_STRFTIME = ("%d/%m/%Y", "%m/%d/%Y", "%B %d, %Y", "%d-%b-%Y", "%Y/%m/%d")
_ORDERS = "(SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_date FROM orders)"


def _format(rate: float) -> Cells:
    date = "strptime(o_date, '%Y-%m-%d')"
    forms = [f"strftime({date}, '{f}')" for f in _STRFTIME] + [f"epoch({date})::BIGINT::VARCHAR"]
    return Cells("orders", "o_orderkey", "o_date", "format", "format_errors", rate, f"({_choose(forms, _u('format', 'o_date', 'o_orderkey', 'form') + ' % 6')})", "'date_format_inconsistency'", _ORDERS)


def _outlier(table: str, key: str, column: str, low: float, high: float, rate: float, whole: bool, base: str | None = None) -> Cells:
    raw = f"({low}::DOUBLE + {_u('outliers', column, key, 'value')} / 4294967296.0::DOUBLE * {high - low}::DOUBLE)"
    return Cells(table, key, column, "outliers", "outliers", rate, f"trunc({raw})::BIGINT" if whole else f"round_even({raw}, 2)", "'outlier_value'", base, 1)


def _typo_text(table: str, key: str, column: str, rate: float, base: str | None = None) -> Cells:
    u, c = _u("typos", column, key, "form"), _u("typos", column, key, "cut")
    op, i, s = f"({u} % 5)", f"(({u} // 5) % greatest(length({column}) - 1, 1))", column
    edge = f"({c} % greatest(length({s}) - 1, 1) + 1)"
    forms = [
        f"substring({s}, 1, {i}) || substring({s}, {i} + 2)", f"substring({s}, 1, {i} + 1) || substring({s}, {i} + 1)",
        f"substring({s}, 1, {i}) || substring({s}, {i} + 2, 1) || substring({s}, {i} + 1, 1) || substring({s}, {i} + 3)",
        f"upper(substring({s}, 1, {edge})) || lower(substring({s}, {edge} + 1))", f"'  ' || {s} || ' '",
    ]
    kinds = ["'typo_missing_letter'", "'typo_duplicated_letter'", "'typo_swapped_letters'", "'typo_random_case'", "'typo_extra_whitespace'"]
    return Cells(table, key, column, "typos", "typos", rate, f"(CASE WHEN length({s}) < 2 THEN {s} ELSE {_choose(forms, op)} END)", f"(CASE WHEN length({s}) < 2 THEN 'typo_too_short_unchanged' ELSE {_choose(kinds, op)} END)", base)


def _typo_number(table: str, key: str, column: str, rate: float, base: str | None = None) -> Cells:
    u, s = _u("typos", column, key, "form"), f"({column}::VARCHAR)"
    letter = f"({_choose([_text(x) for x in noise.LETTERS], f'(({u} // 3) % 7)')})"
    place = f"(({u} // 21) % (greatest(2, length({s})) - 1) + 1)"
    zero = f"CASE WHEN instr({s}, '0') > 0 THEN substring({s}, 1, instr({s}, '0') - 1) || 'O' || substring({s}, instr({s}, '0') + 1) ELSE {s} || 'O' END"
    forms = [zero, f"{s} || {letter}", f"substring({s}, 1, {place}) || {letter} || substring({s}, {place} + 1)"]
    kinds = ["'typo_zero_as_letter_O'", "'typo_unit_suffix_injected'", "'typo_letter_inside_number'"]
    return Cells(table, key, column, "typos", "typos", rate, f"({_choose(forms, f'({u} % 3)')})", f"({_choose(kinds, f'({u} % 3)')})", base)


# ---------------------------------------------------------------- profiles


def _profile_sql(table: str, numeric: list[str] = (), text: list[str] = ()) -> str:
    parts = [f"SELECT '{c}' AS \"column\", 'numeric' AS dtype_detected, round_even(100.0 * count(*) FILTER (WHERE {c} IS NULL) / nullif(count(*), 0), 2)::DOUBLE AS pct_missing, count(DISTINCT {c}) AS n_unique, min({c})::DOUBLE AS \"min\", max({c})::DOUBLE AS \"max\", round_even(avg({c}), 2)::DOUBLE AS mean, round_even(stddev_samp({c}), 2)::DOUBLE AS std FROM {table}" for c in numeric]
    parts += [f"SELECT '{c}' AS \"column\", 'categorical/text' AS dtype_detected, round_even(100.0 * count(*) FILTER (WHERE {c} IS NULL OR lower(trim({c}::VARCHAR)) IN ('', 'na', 'n/a', 'unknown', 'nan', 'none', 'null')) / nullif(count(*), 0), 2)::DOUBLE AS pct_missing, count(DISTINCT {c}) AS n_unique FROM {table}" for c in text]
    return " UNION ALL ".join(parts)


_NUMERIC = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"], "part": ["p_partkey", "p_size", "p_retailprice"]}
_TEXTS = {"orders": ["o_orderstatus", "o_orderpriority"], "customer": ["c_name", "c_mktsegment"]}
for _t, _cols in _NUMERIC.items():
    query(f"profile_numeric_{_t}", _profile_sql(_t, numeric=_cols))(lambda spark, d, t=_t, cols=_cols: profile.profile(load(spark, d, t), columns=cols).drop("top_values"))
for _t, _cols in _TEXTS.items():
    query(f"profile_text_{_t}", _profile_sql(_t, text=_cols))(lambda spark, d, t=_t, cols=_cols: profile.profile(load(spark, d, t), columns=cols).select("column", "dtype_detected", "pct_missing", "n_unique"))

_TOP_BRANDS = "(SELECT string_agg(p_brand || ' ' || n, ', ' ORDER BY n DESC, p_brand) FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5))"
_BIG = "(SELECT *, p_size > 25 AS big FROM part)"
_MIXED = f"""SELECT 'p_brand' AS "column", 'categorical/text' AS dtype_detected, 0.0::DOUBLE AS pct_missing, count(DISTINCT p_brand) AS n_unique, {_TOP_BRANDS} AS top_values, NULL::DOUBLE AS "min", NULL::DOUBLE AS "max", NULL::DOUBLE AS mean, NULL::DOUBLE AS std FROM part UNION ALL
SELECT 'p_size', 'numeric', 0.0, count(DISTINCT p_size), NULL, min(p_size), max(p_size), round_even(avg(p_size), 2), round_even(stddev_samp(p_size), 2) FROM part UNION ALL
SELECT 'big', 'numeric', 0.0, count(DISTINCT big), NULL, min(big::INT), max(big::INT), round_even(avg(big::INT), 2), round_even(stddev_samp(big::INT), 2) FROM {_BIG}"""


@query("profile_mixed_part", _MIXED)
def profile_mixed_part(spark: SparkSession, d: str) -> DataFrame:
    """Text, a number and a boolean in one profile, top values as text."""
    made = profile.profile(load(spark, d, "part").withColumn("big", F.col("p_size") > 25), columns=["p_brand", "p_size", "big"])
    return made.withColumn("top_values", F.array_join(F.transform("top_values", lambda x: F.concat_ws(" ", x["value"], x["n"].cast("string"))), ", "))


_TOP = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS \"value\", n, rank FROM (SELECT {c}, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5" for c in _TEXTS["orders"])
_FIRST = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS \"value\", rank FROM (SELECT {c}, row_number() OVER (ORDER BY min(o_orderkey)) AS rank FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 3" for c in _TEXTS["orders"])


@query("top_values_orders", _TOP)
def top_values_orders(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_values(load(spark, d, "orders"), _TEXTS["orders"]).drop("place")


@query("first_examples_orders", _FIRST)
def first_examples_orders(spark: SparkSession, d: str) -> DataFrame:
    return profile.first_examples(load(spark, d, "orders"), _TEXTS["orders"], row="o_orderkey").drop("place")


@query("head_sample_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def head_sample_orders(spark: SparkSession, d: str) -> DataFrame:
    return profile.head(load(spark, d, "orders"), 5, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("sample_exact_orders", f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|sample|row|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 100")
def sample_exact_orders(spark: SparkSession, d: str) -> DataFrame:
    return rows.sample_exact(load(spark, d, "orders"), 100, row="o_orderkey").select("o_orderkey")


@query("row_count_orders", "SELECT count(*) AS n, max(o_orderkey) AS last FROM orders")
def row_count_orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


@query("row_numbers_orders", "SELECT count(*) AS n, min(i) AS first, max(i) AS last, count(DISTINCT i) AS different FROM (SELECT row_number() OVER () - 1 AS i FROM orders)")
def row_numbers_orders(spark: SparkSession, d: str) -> DataFrame:
    numbered = rows.with_row_id(load(spark, d, "orders"))
    return numbered.agg(F.count(F.lit(1)).alias("n"), F.min(rows.ROW).alias("first"), F.max(rows.ROW).alias("last"), F.count_distinct(rows.ROW).alias("different"))


# ---------------------------------------------------------------- noise


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_date"))


_SEGMENTS = _missing("customer", "c_custkey", "c_mktsegment", 0.1)
_NOISY_CUSTOMER = f"SELECT c_custkey, CASE WHEN hit_c_mktsegment THEN {_SEGMENTS.value} ELSE c_mktsegment END AS c_mktsegment FROM ({_SEGMENTS.source})"


def _noisy_customer(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return noise.inject_missing(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment", "absent"], row="c_custkey")


@query("missing_log_customer", _SEGMENTS.log())
def missing_log_customer(spark: SparkSession, d: str) -> DataFrame:
    return _noisy_customer(spark, d)[1]


@query("missing_noisy_customer", _NOISY_CUSTOMER)
def missing_noisy_customer(spark: SparkSession, d: str) -> DataFrame:
    return _noisy_customer(spark, d)[0]


_DATES = _format(0.15)


@query("format_log_orders", _DATES.log())
def format_log_orders(spark: SparkSession, d: str) -> DataFrame:
    return noise.inject_format(_orders(spark, d), ["o_date"], row="o_orderkey")[1]


@query("format_noisy_orders", f"SELECT o_orderkey, CASE WHEN hit_o_date THEN {_DATES.value} ELSE o_date END AS o_date FROM ({_DATES.source})")
def format_noisy_orders(spark: SparkSession, d: str) -> DataFrame:
    return noise.inject_format(_orders(spark, d), ["o_date"], row="o_orderkey")[0].select("o_orderkey", "o_date")


_PRICES = _outlier("orders", "o_orderkey", "o_totalprice", -500, 10000, 0.02, False)
_SIZES = _outlier("part", "p_partkey", "p_size", 200, 1000, 0.02, True)


@query("outlier_log_orders", _PRICES.log().replace("o_totalprice::VARCHAR AS original_value", "round_even(o_totalprice * 100, 0)::BIGINT AS original_value").replace(f"{_PRICES.value}::VARCHAR", f"round_even({_PRICES.value} * 100, 0)::BIGINT"))
def outlier_log_orders(spark: SparkSession, d: str) -> DataFrame:
    """Values in hundredths: doubles are written differently by different engines."""
    log = noise.inject_outliers(_orders(spark, d), {"o_totalprice": (-500, 10000)}, row="o_orderkey")[1]
    return log.withColumns({c: F.bround(F.col(c).cast("double") * 100, 0).cast("bigint") for c in ("original_value", "injected_value")})


@query("outlier_log_part", _SIZES.log())
def outlier_log_part(spark: SparkSession, d: str) -> DataFrame:
    return noise.inject_outliers(load(spark, d, "part"), {"p_size": (200, 1000)}, row="p_partkey")[1]


@query("outlier_noisy_orders", f"SELECT o_orderkey, CASE WHEN hit_o_totalprice THEN {_PRICES.value} ELSE o_totalprice END AS o_totalprice FROM ({_PRICES.source})")
def outlier_noisy_orders(spark: SparkSession, d: str) -> DataFrame:
    return noise.inject_outliers(_orders(spark, d), {"o_totalprice": (-500, 10000)}, row="o_orderkey")[0].select("o_orderkey", "o_totalprice")


@query("typo_text_log_orders", _typo_text("orders", "o_orderkey", "o_orderpriority", 0.1).log() + " UNION ALL " + _typo_text("orders", "o_orderkey", "o_orderstatus", 0.1).log())
def typo_text_log_orders(spark: SparkSession, d: str) -> DataFrame:
    return noise.inject_typos(_orders(spark, d), ["o_orderpriority", "o_orderstatus"], [], row="o_orderkey")[1]


@query("typo_num_log_part", _typo_number("part", "p_partkey", "p_size", 0.1).log())
def typo_num_log_part(spark: SparkSession, d: str) -> DataFrame:
    return noise.inject_typos(load(spark, d, "part"), [], ["p_size"], row="p_partkey")[1]


_ALL = noise.Targets(missing=("o_orderstatus",), format=("o_date",), outliers=(("o_totalprice", (-500, 10000)),), typos_text=("o_orderpriority",), typos_numeric=("o_custkey",))


def _all_sql(level: str) -> str:
    r = noise.rates_for_level(level)
    cells = [
        _missing("orders", "o_orderkey", "o_orderstatus", r["missing"]), _format(r["format"]), _outlier("orders", "o_orderkey", "o_totalprice", -500, 10000, r["outliers"], False),
        _typo_text("orders", "o_orderkey", "o_orderpriority", r["typos"]), _typo_number("orders", "o_orderkey", "o_custkey", r["typos"]),
    ]
    part = lambda c: c.log() if c.column != "o_totalprice" else c.log().replace("o_totalprice::VARCHAR AS original_value", "NULL AS original_value").replace(f"{c.value}::VARCHAR", "NULL")
    return " UNION ALL ".join(map(part, cells))


def _inject_all(spark: SparkSession, d: str, level: str) -> tuple[DataFrame, DataFrame]:
    return noise.inject_all(_orders(spark, d), rates=noise.rates_for_level(level), targets=_ALL, row="o_orderkey")


def _all_log(level: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Outlier values are left out: doubles are written differently by different engines; outlier_log_orders has them."""
        double = F.col("column") == "o_totalprice"
        return _inject_all(spark, d, level)[1].withColumns({c: F.when(~double, F.col(c)) for c in ("original_value", "injected_value")})

    return run


for _level in noise.LEVELS:
    query(f"inject_all_orders_{_level}", _all_sql(_level))(_all_log(_level))


def _all_noisy_sql(level: str) -> str:
    """The noisy table itself, prices in hundredths."""
    r = noise.rates_for_level(level)
    texts = [_missing("orders", "o_orderkey", "o_orderstatus", r["missing"]), _format(r["format"]), _typo_text("orders", "o_orderkey", "o_orderpriority", r["typos"]), _typo_number("orders", "o_orderkey", "o_custkey", r["typos"])]
    price = _outlier("orders", "o_orderkey", "o_totalprice", -500, 10000, r["outliers"], False)
    parts = [f"(SELECT o_orderkey, CASE WHEN hit_{c.column} THEN {c.value}::VARCHAR ELSE {c.column}::VARCHAR END AS {c.column} FROM ({c.source}))" for c in texts]
    parts.append(f"(SELECT o_orderkey, round_even(CASE WHEN hit_o_totalprice THEN {price.value} ELSE o_totalprice END * 100, 0)::BIGINT AS o_totalprice FROM ({price.source}))")
    return "SELECT o_orderkey, o_orderstatus, o_date, o_orderpriority, o_custkey, o_totalprice FROM " + " JOIN ".join(f"{p} AS t{i}" + (" USING (o_orderkey)" if i else "") for i, p in enumerate(parts))


@query("inject_all_noisy_orders", _all_noisy_sql("medium"))
def inject_all_noisy_orders(spark: SparkSession, d: str) -> DataFrame:
    noisy = _inject_all(spark, d, "medium")[0]
    return noisy.withColumn("o_totalprice", F.bround(F.col("o_totalprice") * 100, 0).cast("bigint"))


@query("error_family_counts_orders", f"SELECT error_family, count(*) AS n FROM ({_all_sql('medium')}) GROUP BY error_family")
def error_family_counts_orders(spark: SparkSession, d: str) -> DataFrame:
    return noise.counts_by_family(_inject_all(spark, d, "medium")[1])


_RATES = """VALUES ('low', 'missing', 0.05), ('low', 'format', 0.075), ('low', 'outliers', 0.01), ('low', 'typos', 0.04),
  ('medium', 'missing', 0.1), ('medium', 'format', 0.15), ('medium', 'outliers', 0.02), ('medium', 'typos', 0.08),
  ('high', 'missing', 0.2), ('high', 'format', 0.3), ('high', 'outliers', 0.04), ('high', 'typos', 0.16)"""


@query("noise_levels", f"SELECT level, family, trunc((SELECT count(*) FROM orders) * rate::DOUBLE) / (SELECT count(*) FROM orders) AS rate FROM ({_RATES}) AS t(level, family, rate)")
def noise_levels(spark: SparkSession, d: str) -> DataFrame:
    """Share of cells that each level corrupts, by family, as the logs of orders have it."""
    names = F.create_map(*[F.lit(x) for pair in (("missing_values", "missing"), ("format_errors", "format"), ("outliers", "outliers"), ("typos", "typos")) for x in pair])
    logs = [_inject_all(spark, d, level)[1].select(F.lit(level).alias("level"), "error_family", "column") for level in noise.LEVELS]
    counted = logs[0].unionByName(logs[1]).unionByName(logs[2]).groupBy("level", "error_family").agg((F.count(F.lit(1)) / F.count_distinct("column")).alias("n"))
    total = load(spark, d, "orders").agg(F.count(F.lit(1)).alias("rows"))
    return counted.crossJoin(F.broadcast(total)).select("level", F.element_at(names, F.col("error_family")).alias("family"), (F.col("n") / F.col("rows")).alias("rate"))


# ---------------------------------------------------------------- cleaning


_na = ", ".join(_text(x) for x in V.NA_TOKENS)


@query("na_normalize", f"SELECT c_custkey, CASE WHEN c_mktsegment IN ({_na}) THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM ({_NOISY_CUSTOMER})")
def na_normalize(spark: SparkSession, d: str) -> DataFrame:
    return clean.na_to_null(_noisy_customer(spark, d)[0])


@query("csv_round_trip_customer", f"SELECT c_custkey, CASE WHEN c_mktsegment IN ({_na}) THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM ({_NOISY_CUSTOMER})")
def csv_round_trip_customer(spark: SparkSession, d: str) -> DataFrame:
    path = work_folder(spark, "csv_round_trip_customer")
    tables.write_csv(_noisy_customer(spark, d)[0], path)
    return tables.read_csv(spark, path)


_NUM = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


_TYPED = _typo_number("part", "p_partkey", "p_size", 0.1)
_NOISY_SIZE = f"SELECT p_partkey, CASE WHEN hit_p_size THEN {_TYPED.value} ELSE p_size::VARCHAR END AS v FROM ({_TYPED.source})"


@query("coerce_numeric", f"SELECT p_partkey, CASE WHEN regexp_full_match(v, '{_NUM}') THEN try_cast(trim(v) AS DOUBLE) END AS number, trunc(coalesce(CASE WHEN regexp_full_match(v, '{_NUM}') THEN try_cast(trim(v) AS DOUBLE) END, 0))::BIGINT AS whole FROM ({_NOISY_SIZE})")
def coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    noisy = noise.inject_typos(load(spark, d, "part").select("p_partkey", "p_size"), [], ["p_size"], row="p_partkey")[0]
    return noisy.select("p_partkey", V.to_number("p_size").alias("number"), V.to_whole("p_size").alias("whole"))


@query("letters_to_zero_part", "SELECT p_partkey, replace(p_size::VARCHAR || 'O', 'O', '0')::BIGINT AS p_size FROM part")
def letters_to_zero_part(spark: SparkSession, d: str) -> DataFrame:
    noisy = load(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("O")).alias("p_size"))
    return clean.to_whole(clean.letters_to_zero(noisy, "p_size"), "p_size")


_title = "array_to_string(list_transform(regexp_extract_all({c}, '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"


@query("title_case", f"SELECT p_partkey, {_title.format(c='p_type')} AS p_type, {_title.format(c='p_name')} AS p_name FROM part")
def title_case(spark: SparkSession, d: str) -> DataFrame:
    return clean.title_case(load(spark, d, "part").select("p_partkey", "p_type", "p_name"), ["p_type", "p_name"])


@query("category_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def category_map(spark: SparkSession, d: str) -> DataFrame:
    return clean.rename_values(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "Filled", "O": "Open"})


_CLIPS = "(SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS v FROM part)"


def _clips(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("v"))


@query("clip_where", f"SELECT p_partkey, CASE WHEN v >= 10 THEN CASE WHEN v <= 30 THEN v ELSE 30 END ELSE 10 END AS v FROM {_CLIPS}")
def clip_where(spark: SparkSession, d: str) -> DataFrame:
    return clean.clip_where(_clips(spark, d), {"v": (10, 30)})


@query("clip_null_safe", f"SELECT p_partkey, CASE WHEN v IS NOT NULL THEN least(greatest(v, 10), 30) END AS v FROM {_CLIPS}")
def clip_null_safe(spark: SparkSession, d: str) -> DataFrame:
    return clean.clip(_clips(spark, d), {"v": (10, 30)})


_NOISY_DATE = f"SELECT o_orderkey, CASE WHEN hit_o_date THEN {_DATES.value} ELSE o_date END AS o_date FROM ({_DATES.source})"


def _noisy_dates(spark: SparkSession, d: str) -> DataFrame:
    return noise.inject_format(_orders(spark, d), ["o_date"], row="o_orderkey")[0].select("o_orderkey", "o_date")


@query("date_parse_strict", f"SELECT o_orderkey, strftime(try_strptime(o_date, '%B %d, %Y'), '%Y-%m-%d') AS o_date FROM ({_NOISY_DATE})")
def date_parse_strict(spark: SparkSession, d: str) -> DataFrame:
    return clean.parse_long_dates(_noisy_dates(spark, d), "o_date").withColumn("o_date", F.date_format("o_date", "yyyy-MM-dd"))


_iso = "strftime(coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%d/%m/%Y'), try_strptime({c}, '%m/%d/%Y'), try_strptime({c}, '%B %d, %Y'), try_strptime({c}, '%d-%b-%Y'), try_strptime({c}, '%Y/%m/%d'), CASE WHEN regexp_full_match({c}, '-?[0-9]+') THEN TIMESTAMP '1970-01-01' + to_seconds(try_cast({c} AS BIGINT)) END), '%Y-%m-%d')"


@query("date_unify_iso", f"SELECT o_orderkey, {_iso.format(c='o_date')} AS o_date FROM ({_NOISY_DATE})")
def date_unify_iso(spark: SparkSession, d: str) -> DataFrame:
    return clean.unify_dates(_noisy_dates(spark, d), "o_date")


@query("fill_const", f"SELECT c_custkey, coalesce(c_mktsegment, 'Unknown') AS c_mktsegment FROM ({_NOISY_CUSTOMER})")
def fill_const(spark: SparkSession, d: str) -> DataFrame:
    return clean.fill_constant(_noisy_customer(spark, d)[0], "c_mktsegment", "Unknown")


_HOLES = f"SELECT c_custkey, CASE WHEN c_mktsegment IS NULL OR lower(trim(c_mktsegment)) IN ('', 'na', 'n/a', 'unknown', 'nan', 'none', 'null') THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM ({_NOISY_CUSTOMER})"


@query("disguised_to_null", _HOLES)
def disguised_to_null(spark: SparkSession, d: str) -> DataFrame:
    return clean.disguised_to_null(_noisy_customer(spark, d)[0], "c_mktsegment")


@query("fill_mode", f"WITH h AS ({_HOLES}) SELECT c_custkey, coalesce(c_mktsegment, (SELECT c_mktsegment FROM h WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment FROM h")
def fill_mode(spark: SparkSession, d: str) -> DataFrame:
    return clean.fill_mode(disguised_to_null(spark, d), ["c_mktsegment"])


@query("fill_median", f"SELECT p_partkey, coalesce(v::DOUBLE, (SELECT median(v) FROM {_CLIPS})) AS v FROM {_CLIPS}")
def fill_median(spark: SparkSession, d: str) -> DataFrame:
    return clean.fill_median(_clips(spark, d), ["v"])


@query("impute", f"SELECT p_partkey, coalesce(v::DOUBLE, (SELECT median(v) FROM {_CLIPS})) AS v FROM {_CLIPS}")
def impute(spark: SparkSession, d: str) -> DataFrame:
    return clean.impute(_clips(spark, d), ["v"])


@query("dropna_rows", f"SELECT * FROM ({_HOLES}) WHERE c_mktsegment IS NOT NULL")
def dropna_rows(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_missing_rows(disguised_to_null(spark, d), ["c_mktsegment"])


@query("dedup_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def dedup_rows(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_duplicate_rows(load(spark, d, "orders").select("o_orderstatus", "o_orderpriority"))


@query("dedup_keep_first", "SELECT min(o_orderkey) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders GROUP BY ALL")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_duplicate_rows(load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ("o_orderkey",))


@query("guest_style_filter", "SELECT p_partkey, p_size % 2 AS adults, p_size % 3 AS children, p_size % 5 AS babies FROM part WHERE p_size % 2 + p_size % 3 + p_size % 5 > 0")
def guest_style_filter(spark: SparkSession, d: str) -> DataFrame:
    return clean.keep_positive_sum(load(spark, d, "part").select("p_partkey", *((F.col("p_size") % k).alias(c) for k, c in ((2, "adults"), (3, "children"), (5, "babies")))))


@query("between_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def between_filter(spark: SparkSession, d: str) -> DataFrame:
    return clean.keep_between(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), {"o_totalprice": (1000, 50000)})


@query("outlier_flag", f"SELECT p_partkey, v, coalesce(v NOT BETWEEN 5 AND 45, false) AS v_outlier FROM {_CLIPS}")
def outlier_flag(spark: SparkSession, d: str) -> DataFrame:
    return clean.flag_outliers(_clips(spark, d), {"v": (5, 45)})


_NULLED = f"(SELECT p_partkey, CASE WHEN v BETWEEN 5 AND 45 THEN v END AS v FROM {_CLIPS})"


@query("outlier_null_impute", f"SELECT p_partkey, coalesce(v::DOUBLE, (SELECT median(v) FROM {_NULLED})) AS v FROM {_NULLED}")
def outlier_null_impute(spark: SparkSession, d: str) -> DataFrame:
    return clean.fill_median(clean.outliers_to_null(_clips(spark, d), {"v": (5, 45)}), ["v"])


@query("outlier_bounds_std", "SELECT p_partkey, abs(p_retailprice - avg(p_retailprice) OVER ()) > 1.5 * stddev_samp(p_retailprice) OVER () AS p_retailprice_outlier FROM part")
def outlier_bounds_std(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part").select("p_partkey", "p_retailprice")
    return clean.flag_outliers(part, clean.outlier_bounds(part, ["p_retailprice"], k=1.5)).drop("p_retailprice")


@query("drop_outlier_rows", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE (l_quantity NOT BETWEEN 5 AND 45)::INT + (l_discount NOT BETWEEN 0.01 AND 0.09)::INT <= 1")
def drop_outlier_rows(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_outlier_rows(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), {"l_quantity": (5, 45), "l_discount": (0.01, 0.09)})


_PRIORITY = _typo_text("orders", "o_orderkey", "o_orderpriority", 0.1)
_NOISY_PRIORITY = f"SELECT o_orderkey, CASE WHEN hit_o_orderpriority THEN {_PRIORITY.value} ELSE o_orderpriority END AS p FROM ({_PRIORITY.source})"
_HARMONISE = f"""WITH n AS ({_NOISY_PRIORITY}), top AS (SELECT p AS v, row_number() OVER (ORDER BY count(*) DESC, p) AS i FROM n GROUP BY p QUALIFY i <= 5),
w AS (SELECT n.p, arg_min(top.v, levenshtein(lower(trim(n.p)), lower(trim(top.v))) * 10 + top.i) AS v, min(levenshtein(lower(trim(n.p)), lower(trim(top.v)))) AS d FROM (SELECT DISTINCT p FROM n) n, top GROUP BY n.p)
SELECT n.o_orderkey, CASE WHEN w.d <= 2 THEN w.v ELSE n.p END AS o_orderpriority FROM n JOIN w USING (p)"""


@query("harmonize_topk", _HARMONISE)
def harmonize_topk(spark: SparkSession, d: str) -> DataFrame:
    noisy = noise.inject_typos(_orders(spark, d), ["o_orderpriority"], [], row="o_orderkey")[0].select("o_orderkey", "o_orderpriority")
    return clean.harmonise(noisy, "o_orderpriority")


@query("normalise_text", "SELECT c_custkey, lower(trim('  ' || c_mktsegment || ' ')) AS c_mktsegment FROM customer")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    padded = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")).alias("c_mktsegment"))
    return clean.normalise_text(padded, "c_mktsegment", "lower")


_ANSWER = """CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'Here: ```python' || chr(10) || text || chr(10) || '``` done' WHEN 2 THEN '```' || chr(10) || text || '``` and ```python' || chr(10) || 'pass' || chr(10) || '```' ELSE '```' || text END"""


@query("code_fence_extract", f"SELECT doc_id, regexp_replace(CASE WHEN regexp_matches(v, '(?s)```python\\s*.*?```') THEN regexp_extract(v, '(?s)```python\\s*(.*?)```', 1) WHEN regexp_matches(v, '(?s)```\\s*.*?```') THEN regexp_extract(v, '(?s)```\\s*(.*?)```', 1) ELSE v END, '^\\s+|\\s+$', '', 'g') AS v FROM (SELECT doc_id, {_ANSWER} AS v FROM documents)")
def code_fence_extract(spark: SparkSession, d: str) -> DataFrame:
    """The texts of documents as a model might answer them: bare, fenced, fenced twice, with a fence left open."""
    return load(spark, d, "documents").select("doc_id", V.first_code_block(F.expr(_ANSWER.replace("chr(10)", "'\\n'"))).alias("v"))


_WORKFLOW_COLUMNS = "SELECT p_size::VARCHAR || 'O' AS lead_time, p_size % 2 AS adults, p_size % 3 AS children, p_size % 7 - 1 AS babies, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'BB' END AS meal, p_brand AS market_segment, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_type END AS country FROM part"


@query("workflow_part", f"SELECT DISTINCT * FROM (SELECT replace(lead_time, 'O', '0')::BIGINT AS lead_time, least(greatest(adults, 0), 4)::BIGINT AS adults, least(greatest(children, 0), 10)::BIGINT AS children, least(greatest(babies, 0), 4)::BIGINT AS babies, coalesce(CASE meal WHEN 'BB' THEN 'Bed & Breakfast' ELSE meal END, 'Undefined/SC') AS meal, {_title.format(c='market_segment')} AS market_segment, coalesce(country, 'Unknown') AS country FROM ({_WORKFLOW_COLUMNS})) WHERE adults + children + babies > 0")
def workflow_part(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    hotel = load(spark, d, "part").select(
        F.concat(size.cast("string"), F.lit("O")).alias("lead_time"), (size % 2).alias("adults"), (size % 3).alias("children"), (size % 7 - 1).alias("babies"),
        F.when(size % 5 != 0, "BB").alias("meal"), F.col("p_brand").alias("market_segment"), F.when(size % 4 != 0, F.col("p_type")).alias("country"),
    )
    return clean.hotel_workflow(hotel)


@query("cleaning_report", f"WITH h AS ({_HOLES}) SELECT 'rows_before' AS metric, NULL AS \"column\", count(*) AS \"value\" FROM h UNION ALL SELECT 'null_before', 'c_custkey', 0 UNION ALL SELECT 'null_before', 'c_mktsegment', count(*) FILTER (WHERE c_mktsegment IS NULL) FROM h UNION ALL SELECT 'rows_after', NULL, count(c_mktsegment) FROM h UNION ALL SELECT 'null_after', 'c_custkey', 0 UNION ALL SELECT 'null_after', 'c_mktsegment', 0")
def cleaning_report(spark: SparkSession, d: str) -> DataFrame:
    holes = disguised_to_null(spark, d)
    return clean.report(holes, clean.drop_missing_rows(holes, ["c_mktsegment"]))


# ---------------------------------------------------------------- plans and runs

_PLAN = CleaningPlan([Step("normalise_text", {"columns": ["c_mktsegment"], "case": "lower"}), Step("disguised_to_null", {"columns": ["c_mktsegment"]}), Step("fill_constant", {"columns": ["c_mktsegment"], "value": "none given"})])


@query("plan_customer", f"SELECT c_custkey, coalesce(lower(trim(c_mktsegment)), 'none given') AS c_mktsegment FROM ({_HOLES})")
def plan_customer(spark: SparkSession, d: str) -> DataFrame:
    return CleaningPlan.from_json(_PLAN.to_json()).apply(_noisy_customer(spark, d)[0])


@query("execution_log_scan", "SELECT * FROM (VALUES ('plan0', true, '', '', 0::INTEGER, NULL, true), ('plan1', false, '', 'step ''drop_table'' is not allowed', 1, 'step ''drop_table'' is not allowed', true)) AS t(script_path, success, stdout, stderr, returncode, error_message, timed)")
def execution_log_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two logged runs of plans, one that works and one that is refused; how long they took differs from run to run."""
    folder = work_folder(spark, "runs")
    noisy = _noisy_customer(spark, d)[0]
    for i, plan in enumerate((_PLAN.to_json(), json.dumps([{"step": "drop_table"}]))):
        record = execute.run_plan(spark, plan, noisy, lambda df: df.write.format("noop").mode("overwrite").save())
        runs.append_record(spark, record | {"script_path": f"plan{i}"}, folder)
    log = runs.read_records(spark, folder)
    return log.select("script_path", "success", "stdout", "stderr", "returncode", "error_message", (F.col("duration_seconds") >= 0).alias("timed"))


@query("repair_loop", "SELECT * FROM (VALUES (0::INTEGER, false, 'step ''unknown'' is not allowed'), (1, true, NULL)) AS t(attempt, success, error_message)")
def repair_loop(spark: SparkSession, d: str) -> DataFrame:
    """A first plan that fails, and a rule planner's that works: the attempts."""
    noisy = _noisy_customer(spark, d)[0].withColumnRenamed("c_custkey", rows.ROW)

    class Second(planner.RulePlanner):
        def plan(self, prompt: str = "") -> str:
            return json.dumps([{"step": "unknown"}]) if "What happened" not in prompt else super().plan(prompt)

    out = run_loop(spark, noisy, Second(noisy), lambda df: df.write.format("noop").mode("overwrite").save())
    return spark.createDataFrame([(i, r["success"], r["error_message"]) for i, r in enumerate(out.records)], "attempt int, success boolean, error_message string")


def _prompt_sql() -> str:
    """The prompts about customer: templates are literals, what they are filled with comes from the table."""
    numeric = {"c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False}

    def cell(c: str) -> str:
        return f"coalesce({c}::VARCHAR, 'NaN')"

    def line(f: Callable[[str], str]) -> str:
        return " || ' ' || ".join(f"lpad({f(c)}, w_{c}, ' ')" for c in numeric)

    def kind(c: str) -> str:
        return "numeric" if numeric[c] else "categorical/text"

    def examples(c: str) -> str:
        return f"(SELECT '- {c} ({kind(c)}): examples ' || string_agg(v, ', ' ORDER BY f) FROM (SELECT {c}::VARCHAR AS v, min(c_custkey) AS f FROM customer WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY f LIMIT 3))"

    def described(c: str) -> str:
        gone = f"{c} IS NULL" if numeric[c] else f"{c} IS NULL OR lower(trim({c})) IN ('', 'na', 'n/a', 'unknown', 'nan', 'none', 'null')"
        start = f"'- {c} ({kind(c)}): missing ' || round_even(100.0::DOUBLE * count(*) FILTER (WHERE {gone}) / count(*), 2) || '%, distinct ' || count(DISTINCT {c})"
        if numeric[c]:
            return f"(SELECT {start} || ', min ' || min({c})::DOUBLE || ', max ' || max({c})::DOUBLE || ', mean ' || round_even(avg({c}), 2) || ', std ' || round_even(stddev_samp({c}), 2) FROM customer)"
        top = f"(SELECT string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 3))"
        return f"(SELECT {start} || ', frequent ' || {top} FROM customer)"

    widths = ", ".join(f"greatest({len(c)}, max(len({cell(c)})))::INTEGER AS w_{c}" for c in numeric)
    filled = "template"
    for name, value in (("dataset_sample", "sample"), ("schema_description", "columns"), ("profile_description", "described"), ("input_path", "'in'"), ("output_path", "'out'"), ("previous_script", "''"), ("execution_feedback", "''")):
        filled = f"replace({filled}, '{{{name}}}', {value})"
    return f"""WITH first AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 5), widths AS (SELECT {widths} FROM first),
lines AS (SELECT -1 AS i, {line(_text)} AS line FROM widths UNION ALL SELECT c_custkey, {line(cell)} FROM first, widths),
about AS (SELECT (SELECT string_agg(line, chr(10) ORDER BY i) FROM lines) AS sample, {" || chr(10) || ".join(map(examples, numeric))} AS columns, {" || chr(10) || ".join(map(described, numeric))} AS described)
SELECT approach, {_text(prompts.load_system_prompt())} || chr(10) || chr(10) || {filled} AS prompt
FROM (VALUES {", ".join(f"({_text(a)}, {_text(prompts.load_template(a))})" for a in prompts.APPROACHES)}) AS t(approach, template), about"""


@query("prompt_texts", _prompt_sql())
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """One prompt for each approach."""
    df = load(spark, d, "customer").withColumnRenamed("c_custkey", rows.ROW)
    return spark.createDataFrame([(a, prompts.build_prompt(df, a, "in", "out")) for a in prompts.APPROACHES], "approach string, prompt string")
