"""Interactive filters and sorts over a result table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.numbers import is_numeric_type
from tallyframe.functions.words import natural_key


def contains_filter(df: DataFrame, needle: str) -> DataFrame:
    """Rows in which any column contains the text, ignoring case. An empty needle keeps all."""
    wanted = needle.strip().lower()
    if not wanted:
        return df
    hits = [F.contains(F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit(wanted)) for c in df.columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def sort_key(column: str, data_type: T.DataType) -> Column:
    """Numbers with null as 0, dates by instant, text in natural order ignoring case."""
    if is_numeric_type(data_type):
        return F.coalesce(F.col(column), F.lit(0))
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(column)
    return natural_key(F.col(column).cast("string"))


def typed_sort(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """A total sort; Spark range-partitions it, so no task holds the whole table."""
    key = sort_key(column, df.schema[column].dataType)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first())
