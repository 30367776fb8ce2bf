"""Signal checks on a result: all checks in one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import numeric_value


@dataclass(frozen=True)
class SignalChecks:
    min_row_count: int | None = None
    require_nonzero_columns: tuple[str, ...] = ()
    require_nonnull_columns: tuple[str, ...] = ()
    min_distinct_counts: Mapping[str, int] = field(default_factory=dict)


def check_failures(df: DataFrame, checks: SignalChecks) -> DataFrame:
    """Failed checks: code, column, expected, actual, message."""
    aggregates = [F.count("*").alias("rows")]
    for i, c in enumerate(checks.require_nonzero_columns):
        number = numeric_value(F.col(f"`{c}`"), df.schema[c].dataType, dates=False)
        aggregates.append(F.count_if(number != 0).alias(f"z{i}"))
    for i, c in enumerate(checks.require_nonnull_columns):
        aggregates.append(F.count_if(F.col(f"`{c}`").isNull()).alias(f"u{i}"))
    for i, c in enumerate(checks.min_distinct_counts):
        aggregates.append(F.count_distinct(f"`{c}`").alias(f"d{i}"))
    one = df.agg(*aggregates)
    some = F.col("rows") > 0

    def failure(when: Column, code: str, column: str | None, expected, actual: Column, *message) -> Column:
        parts = [m if isinstance(m, Column) else F.lit(m) for m in message]
        return F.when(when, F.struct(
            F.lit(code).alias("code"), F.lit(column).cast("string").alias("column"),
            F.lit(expected).cast("bigint").alias("expected"), actual.cast("bigint").alias("actual"),
            F.concat(*[p.cast("string") for p in parts]).alias("message")))

    found = []
    least = checks.min_row_count
    too_few = F.lit(False) if least is None else F.col("rows") < least
    if least is not None:
        found.append(failure(too_few, "min_row_count", None, least, F.col("rows"),
                             f"Expected at least {least} rows but found ", F.col("rows"), "."))
    if checks.require_nonzero_columns or checks.require_nonnull_columns or checks.min_distinct_counts:
        found.append(failure(~some & ~too_few, "empty_result_set", None, None, F.lit(0),
                             "Signal checks could not be validated because the result set is empty."))
    for i, c in enumerate(checks.require_nonzero_columns):
        found.append(failure(some & (F.col(f"z{i}") == 0), "require_nonzero_columns", c, None, F.col(f"z{i}"),
                             f"Column {c} was zero or null for every returned row."))
    for i, c in enumerate(checks.require_nonnull_columns):
        found.append(failure(some & (F.col(f"u{i}") > 0), "require_nonnull_columns", c, None, F.col(f"u{i}"),
                             f"Column {c} was null in ", F.col(f"u{i}"), " returned row(s)."))
    for i, (c, low) in enumerate(checks.min_distinct_counts.items()):
        found.append(failure(some & (F.col(f"d{i}") < low), "min_distinct_counts", c, low, F.col(f"d{i}"),
                             f"Column {c} had ", F.col(f"d{i}"), f" distinct non-null value(s); expected at least {low}."))
    if not found:
        return df.sparkSession.createDataFrame([], "code string, column string, expected bigint, actual bigint, message string")
    return one.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f")).select("f.*")


def verify_results(cases: Sequence[tuple[str, DataFrame, int | None, SignalChecks]]) -> DataFrame:
    """One verdict per named result: pinned row count and number of failed checks."""
    parts = []
    for name, df, pinned_rows, checks in cases:
        failures = check_failures(df, checks).agg(F.count("*").alias("failed_checks"))
        rows = df.agg(F.count("*")).scalar()
        parts.append(failures.select(F.lit(name).alias("case_id"), rows.alias("row_count"),
                                     F.lit(pinned_rows).cast("bigint").alias("expected_rows"), "failed_checks"))
    verdict = reduce(DataFrame.unionByName, parts)
    pinned_ok = F.col("expected_rows").isNull() | (F.col("row_count") == F.col("expected_rows"))
    return verdict.withColumn("passed", pinned_ok & (F.col("failed_checks") == 0))
