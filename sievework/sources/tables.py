"""Reading and writing tables so that blanks, quotes and missing values survive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import NUMBER
from ..operators.clean import na_to_null

_READ = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_WRITE = {"header": "true", "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def has_breaks_in_cells(spark: SparkSession, path: str) -> bool:
    """Whether a cell of a CSV holds a line break: only then does a line have an odd number of quotes. A scan of lines in splits, which ends
    at the first one found."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).limit(1).isEmpty()


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """A CSV with a header. Text that stands for null becomes null before types are inferred.

    Files are read in splits unless cells hold line breaks; multi_line says so beforehand, and None has it checked. With a schema and a
    known multi_line the file is scanned once; without a schema one aggregate finds the types first.
    """
    if multi_line is None:
        multi_line = has_breaks_in_cells(spark, path)
    text = na_to_null(spark.read.options(**_READ | {"multiLine": str(multi_line).lower()}).csv(path))
    if schema:
        wanted = spark.createDataFrame([], schema).schema
        return text.select(*(text[f.name].try_cast(f.dataType).alias(f.name) for f in wanted))
    return infer_types(text)


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a whole number, a number or a boolean get that type; one aggregate decides."""
    tests = []
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        tests += [F.count(x).alias(f"n{i}"), F.count_if(x.rlike(r"^\s*[+-]?\d{1,18}\s*$")).alias(f"w{i}"), F.count_if(x.rlike(NUMBER)).alias(f"d{i}"), F.count_if(F.lower(x).isin("true", "false")).alias(f"b{i}")]
    r = df.agg(*tests).first()
    kinds = {}
    for i, c in enumerate(df.columns):
        n, w, d, b = (r[f"{k}{i}"] for k in "nwdb")
        # whole numbers with nulls are doubles, as in data frames without a nullable integer
        kinds[c] = "double" if n == 0 else "bigint" if w == n else "double" if d == n else "boolean" if b == n else "string"
    return df.select(*(F.trim(F.col(f"`{c}`")).try_cast(k).alias(c) if k != "string" else F.col(f"`{c}`") for c, k in kinds.items()))


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of CSV files with headers, or one file in it."""
    (df.coalesce(1) if single else df).write.mode("overwrite").options(**_WRITE).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
