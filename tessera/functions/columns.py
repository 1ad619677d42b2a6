"""Column expressions shared by the operators. All are built-in Spark functions, so they
stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the behaviour we reproduce.
# Missing-value tokens recognised when a text table is read (the public default
# NA set of pandas.read_csv), matched exactly, without trimming:
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
# Text forms accepted as booleans by the same reader:
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
# Smallest positive double used as the floor of |actual| in MAPE:
MAPE_EPSILON = 2.220446049250313e-16
# ---------------------------------------------------------------------------

# Integer and decimal literals as written in text files. Kept ASCII and anchored so
# that Java regex (Spark) and RE2 (DuckDB oracle) agree.
INT_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_PATTERN = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
INF_PATTERN = r"^\s*[+-]?(inf|Inf|INF|infinity|Infinity)\s*$"
REQUEST_ID_PATTERN = r"^[A-Za-z0-9._-]{1,128}$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def q(name: str) -> str:
    """Backtick-quote a column name (names may hold spaces, dots, slashes)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def is_numeric_type(dt: T.DataType) -> bool:
    # booleans are categorical everywhere (one rule for profiling and training)
    return isinstance(dt, NUMERIC_TYPES)


def is_missing(df: DataFrame, name: str) -> Column:
    """Missing = null, or NaN for floating columns."""
    dt = df.schema[name].dataType
    c = col(name)
    if isinstance(dt, FLOAT_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def na_token_to_null(c: Column) -> Column:
    """A text cell equal to one of the NA tokens becomes null."""
    return F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def numeric_text(c: Column) -> Column:
    """True when a text cell parses as a number the way a text reader would."""
    return c.rlike(FLOAT_PATTERN) | c.rlike(INF_PATTERN)


def source_name(c: Column, default: str = "json-api") -> Column:
    """Last path segment of an uploaded file name, either slash style."""
    last = F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.coalesce(last, F.lit(default))


def retry_delay(attempt: Column, base: float = 2.0, cap: float = 60.0) -> Column:
    """Capped exponential back-off: min(base * 2^max(attempt-1, 0), cap)."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt.cast("double") - 1.0, F.lit(0.0))),
                   F.lit(float(cap)))


def valid_request_id(c: Column) -> Column:
    return F.coalesce(c.rlike(REQUEST_ID_PATTERN), F.lit(False))
