"""Column expressions whose meaning differs from Spark's nearest built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that stand for a missing value, compared stripped and in lower case.
DISGUISED = ("", "na", "n/a", "unknown", "nan", "none", "null")
#: What a CSV reader of data frames takes for null by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(column(c), r"(?U)^\s+|\s+$", "")


def is_disguised(c: Column | str) -> Column:
    return F.lower(strip(c)).isin(*DISGUISED)


def is_missing(c: Column | str) -> Column:
    """Null or disguised; never null itself."""
    return column(c).isNull() | F.coalesce(is_disguised(c), F.lit(False))


def na_to_null(c: Column | str) -> Column:
    """Null where a CSV reader of data frames would put one."""
    return F.when(~column(c).isin(*NA_TOKENS), column(c))


def to_number(c: Column | str) -> Column:
    """A double, or null for what is not a plain decimal number (no suffixes, no inf or nan)."""
    text = column(c).cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def to_whole(c: Column | str, default: int | None = 0) -> Column:
    """A number cut towards zero to a bigint; `default` where it is none."""
    number = to_number(c)
    return (F.coalesce(number, F.lit(float(default))) if default is not None else number).cast("bigint")


def title(c: Column | str) -> Column:
    """The first letter after each non-letter in upper case, the others in lower case."""
    parts = F.regexp_extract_all(column(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def swap_letters(c: Column | str, wrong: str, right: str) -> Column:
    return F.regexp_replace(column(c).cast("string"), wrong, right)


def clip_where(c: Column | str, low, high) -> Column:
    """Values outside the bounds become a bound; null becomes the lower bound."""
    x = column(c)
    x = F.when(x >= low, x).otherwise(F.lit(low))
    return F.when(x <= high, x).otherwise(F.lit(high))


def clip(c: Column | str, low, high) -> Column:
    """Values outside the bounds become a bound; null stays null."""
    return F.when(column(c).isNotNull(), F.least(F.greatest(column(c), F.lit(low)), F.lit(high)))


def parse_long_date(c: Column | str) -> Column:
    """A date written like "July 01, 2015"; null for every other form."""
    return F.try_to_timestamp(column(c), F.lit("MMMM dd, yyyy"))


#: Date forms in the order in which they are tried. Day before month: where both readings are possible this one holds.
DATE_FORMS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "MMMM dd, yyyy", "dd-MMM-yyyy", "yyyy/MM/dd")


#: The same with month before day: for columns whose unambiguous cells say so.
MONTH_FIRST_FORMS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMMM dd, yyyy", "dd-MMM-yyyy", "yyyy/MM/dd")


def parse_date(c: Column | str, month_first: bool = False) -> Column:
    """A timestamp from any of DATE_FORMS, an ISO date-time, or epoch seconds."""
    text = strip(column(c).cast("string"))
    epoch = F.when(text.rlike(r"^-?\d{1,12}$"), F.timestamp_seconds(text.try_cast("bigint")))
    forms = [F.try_to_timestamp(text, F.lit(f)) for f in (MONTH_FIRST_FORMS if month_first else DATE_FORMS)]
    date_time = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:"), F.try_to_timestamp(text))
    return F.coalesce(*forms, epoch, date_time)


def day_and_month(c: Column | str) -> tuple[Column, Column]:
    """The first and second number of a date like 03/04/2015, as they stand; null for every other form."""
    text = strip(column(c).cast("string"))
    return tuple(F.regexp_extract(text, r"^(\d{2})/(\d{2})/\d{4}$", k).try_cast("int") for k in (1, 2))  # type: ignore[return-value]


def iso_date(c: Column | str, month_first: bool = False) -> Column:
    return F.date_format(parse_date(c, month_first), "yyyy-MM-dd")


def rename_values(c: Column | str, names: dict[str, str]) -> Column:
    """Exact matches renamed, others kept."""
    if not names:
        return column(c)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, column(c)), column(c))


def is_numeric(kind: T.DataType) -> bool:
    """Numbers and booleans are numeric, everything else is text."""
    return isinstance(kind, (T.NumericType, T.BooleanType))


#: Fixed value: what opens and closes a block of code in a model's answer.
FENCE = "```"


def _block(opening: str) -> str:
    """Pattern of a block: its opening mark, its text up to the first fence after that."""
    return rf"(?s){opening}\s*(.*?){FENCE}"


def first_code_block(c: Column | str) -> Column:
    """The first fenced Python block of a text, else its first fenced block, else the text; stripped."""
    x, found = column(c), None
    for opening in (f"{FENCE}python", FENCE):
        test, inside = x.rlike(_block(opening)), F.regexp_extract(x, _block(opening), 1)
        found = F.when(test, inside) if found is None else found.when(test, inside)
    return strip(found.otherwise(x))


def last_line(c: Column | str) -> Column:
    return F.element_at(F.split(strip(c), "\n"), -1)
