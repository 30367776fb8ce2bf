"""Number rules shared by the comparator, the checks and the metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the smallest step above 1.0 that the comparator adds before rounding.
EPSILON = 2.220446049250313e-16

NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def exact(column: Column | str, precision: int = 18, scale: int = 2) -> Column:
    """A money or quantity column as a decimal, so sums do not depend on row order."""
    return (F.col(column) if isinstance(column, str) else column).cast(T.DecimalType(precision, scale))


def total(column: Column | str) -> Column:
    """Sum in which a missing value counts as zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(F.coalesce(column, F.lit(0)))


def rounded(column: Column, decimals: int) -> Column:
    return F.round(column, decimals).cast("double")


def round_half_up(value: Column, decimals: int) -> Column:
    """floor((v + eps) * 10^d + 0.5) / 10^d: halves go towards plus infinity.

    From 2^53 / 10^d on, a double has no digits to round there and stays as it is.
    """
    factor = float(10**decimals)
    small = F.floor((value + F.lit(EPSILON)) * F.lit(factor) + F.lit(0.5)).cast("double") / F.lit(factor)
    return F.when(F.abs(value) < F.lit(2.0**53 / factor), small).otherwise(value)


def is_numeric_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def numeric_value(column: Column, data_type: T.DataType, dates: bool = True) -> Column:
    """The number in a cell: numbers, numeric text, and (optionally) dates as epoch milliseconds."""
    if is_numeric_type(data_type):
        value = column.cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    if isinstance(data_type, T.StringType):
        value = F.when(column.rlike(NUMBER_TEXT), F.trim(column).try_cast("double"))
        return F.when(F.abs(value) != F.lit(float("inf")), value)
    if dates and isinstance(data_type, (T.DateType, T.TimestampNTZType)):
        as_ntz = column.cast("timestamp_ntz")
        midnight = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.floor(F.timestamp_diff("MICROSECOND", midnight, as_ntz) / F.lit(1000)).cast("double")
    if dates and isinstance(data_type, T.TimestampType):
        return F.unix_millis(column).cast("double")
    return F.lit(None).cast("double")


def cell_key(column: Column, data_type: T.DataType, decimals: int = 2) -> Column:
    """Comparable text of a cell: ``n:`` rounded number, ``null``, or ``s:`` trimmed text."""
    number = numeric_value(column, data_type)
    return (
        F.when(number.isNotNull(), F.concat(F.lit("n:"), round_half_up(number, decimals).cast("string")))
        .when(column.isNull(), F.lit("null"))
        .otherwise(F.concat(F.lit("s:"), F.trim(column.cast("string"))))
    )
