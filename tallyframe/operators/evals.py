"""Evaluation statistics over tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z_95 = 1.96


def missing_tables(expected: Column | str, retrieved: Column | str) -> Column:
    """Distinct expected names that were not retrieved, in order."""
    none = F.expr("cast(array() as array<string>)")
    expected, retrieved = (F.col(c) if isinstance(c, str) else c for c in (expected, retrieved))
    return F.array_except(F.coalesce(expected, none), F.coalesce(retrieved, none))


def classify(rows_match: Column, signals_passed: Column, expected: Column, retrieved: Column, disallowed_used: Column) -> Column:
    """Status of a case. A match that uses a forbidden column or fails its checks is not a pass."""
    used = F.coalesce(F.size(disallowed_used), F.lit(0)) > 0
    return (
        F.when(rows_match & used, "disallowed_column_used")
        .when(rows_match & ~F.coalesce(signals_passed, F.lit(True)), "low_signal_success")
        .when(rows_match, "pass")
        .when(F.size(missing_tables(expected, retrieved)) > 0, "retrieval_miss")
        .otherwise("result_mismatch")
    )


def ratio(part: Column, whole: Column, decimals: int = 4) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), decimals)


def wilson_lower(passes: Column, attempts: Column, z: float = Z_95) -> Column:
    """Lower bound of the Wilson score interval at four decimals; 0 without attempts."""
    n = attempts.cast("double")
    p, zz = passes / n, z * z
    margin = F.lit(z) * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)
    bound = (p + zz / (2 * n) - margin) / (1 + zz / n)
    return F.when(attempts > 0, F.round(F.greatest(bound, F.lit(0.0)), 4)).otherwise(F.lit(0.0))


def _passed() -> Column:
    return F.count_if(F.col("status") == "pass")


def summarize(results: DataFrame, *by: str) -> DataFrame:
    """total, passed, failed and accuracy, by run or any grouping."""
    summed = results.groupBy(*by).agg(F.count("*").alias("total"), _passed().alias("passed"))
    return summed.withColumn("failed", F.col("total") - F.col("passed")).withColumn(
        "accuracy", ratio(F.col("passed"), F.col("total")))


def status_counts(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by, "status").agg(F.count("*").alias("cases"))


def reliability(results: DataFrame, repetition: str = "repetition") -> DataFrame:
    """One row over all repetitions: mean, least and greatest accuracy, share of perfect runs, pass rate, Wilson bound."""
    runs = summarize(results, repetition)
    perfect = F.count_if((F.col("total") > 0) & (F.col("passed") == F.col("total")))
    one = runs.agg(
        F.count("*").alias("repetitions"),
        F.coalesce(F.round(F.avg(F.col("accuracy").cast("decimal(10,4)")).cast("double"), 4), F.lit(0.0)).alias("mean_accuracy"),
        F.coalesce(F.min("accuracy"), F.lit(0.0)).alias("min_accuracy"),
        F.coalesce(F.max("accuracy"), F.lit(0.0)).alias("max_accuracy"),
        perfect.alias("perfect"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_attempts"),
        F.coalesce(F.sum("passed"), F.lit(0)).alias("total_passes"),
    )
    return one.select(
        "repetitions", "mean_accuracy", "min_accuracy", "max_accuracy",
        ratio(F.col("perfect"), F.col("repetitions")).alias("all_cases_passed_rate"), "total_attempts", "total_passes",
        ratio(F.col("total_passes"), F.col("total_attempts")).alias("pass_rate"),
        wilson_lower(F.col("total_passes"), F.col("total_attempts")).alias("wilson_lower_95"),
    )


def per_case(results: DataFrame, case: str = "case_id") -> DataFrame:
    """Attempts, passes, pass rate and a map of status counts per case (statuses are a fixed handful)."""
    counted = results.groupBy(case, "status").agg(F.count("*").alias("n"))
    return counted.groupBy(case).agg(
        F.sum("n").alias("attempts"),
        F.sum(F.when(F.col("status") == "pass", F.col("n")).otherwise(0)).alias("passes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"),
    ).withColumn("pass_rate", ratio(F.col("passes"), F.col("attempts")))


def retrieval_recall(cases: DataFrame) -> DataFrame:
    """Add recall (1 when nothing is expected), full_recall and extra_tables to (expected, retrieved) rows."""
    hits = F.size(F.array_intersect("expected_tables", "retrieved_tables"))
    wanted = F.size(F.array_distinct("expected_tables"))
    return cases.select(
        "*", F.when(wanted == 0, 1.0).otherwise(hits / wanted).alias("recall"), (hits == wanted).alias("full_recall"),
        F.array_except("retrieved_tables", "expected_tables").alias("extra_tables"),
    )


def recall_summary(cases: DataFrame, order_by: str) -> DataFrame:
    """Averages over all cases, and the case with most retrieved tables (the first on ties)."""
    r = retrieval_recall(cases)
    widest = F.min(F.struct((-F.size("retrieved_tables")).alias("n"), F.col(order_by).alias("id")))
    return r.agg(
        F.count("*").alias("case_count"), F.count_if("full_recall").alias("full_recall_count"),
        F.round(F.avg(F.col("recall").cast("decimal(12,8)")).cast("double"), 4).alias("average_recall"),
        F.round(F.avg(F.size("retrieved_tables")), 4).alias("average_table_count"),
        F.round(F.avg(F.size("extra_tables")), 4).alias("average_extra_tables"),
        widest.alias("w"),
    ).select("*", F.col("w.id").alias("widest_case"), (-F.col("w.n")).cast("bigint").alias("widest_table_count")).drop("w")


def breakdown(results: DataFrame, column: str) -> DataFrame:
    """Summary and Wilson bound by intent, failure class, difficulty or (array) tag."""
    if results.schema[column].dataType.typeName() == "array":
        results = results.withColumn(column, F.explode(column))
    return summarize(results, column).withColumn("wilson_lower_95", wilson_lower(F.col("passed"), F.col("total")))
