"""Sources: JDBC and parquet tables, case files, trace logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.sqltext import clean_output, referenced_tables

CASE_SCHEMA = (
    "id string, intentId string, question string, canonicalQuestion string, difficulty string, tags array<string>, "
    "expected_tables array<string>, expected_columns array<string>, disallowed_columns array<string>, expected_sql string, "
    "expected_row_count int, failure_class string, comparison struct<mode:string,order:string,tolerance:double,decimals:int,"
    "compare_columns:array<string>,value_columns:array<string>>, signal_checks struct<min_row_count:double,"
    "require_nonzero_columns:array<string>,require_nonnull_columns:array<string>,min_distinct_counts:map<string,double>>"
)
TRACE_SCHEMA = (
    "timestamp timestamp, pipeline string, runId string, event string, startedAt timestamp, endedAt timestamp, "
    "durationMs double, attempt int, questionIndex int, payload string"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(
    spark: SparkSession, url: str, table: str, split_column: str, lower: int, upper: int, parts: int, **options: str
) -> DataFrame:
    """A database table in parallel ranges of a key. Filters and columns are pushed to the database."""
    settings = dict(options, url=url, dbtable=table, partitionColumn=split_column, lowerBound=str(lower),
                    upperBound=str(upper), numPartitions=str(parts), fetchsize=options.get("fetchsize", "10000"))
    return spark.read.format("jdbc").options(**settings).load()


def trimmed_unique(values: Column) -> Column:
    """Trimmed, non-empty, distinct strings in order; null becomes empty."""
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, none), lambda x: F.trim(x)), lambda x: x != ""))


def normalize_cases(cases: DataFrame) -> DataFrame:
    """Fill defaults of case records. A record without id, question or SQL is an error when it is read."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    need = lambda c: F.coalesce(text(c), F.raise_error(F.lit(f"case without {c}")).cast("string"))
    lists = {c: trimmed_unique(F.col(c)) for c in ("tags", "expected_columns", "disallowed_columns")}
    named = trimmed_unique(F.col("expected_tables"))
    return cases.withColumns({
        "id": need("id"), "question": need("question"), "expected_sql": need("expected_sql"),
        "intentId": F.coalesce(text("intentId"), text("id")),
        "canonicalQuestion": F.coalesce(text("canonicalQuestion"), text("question")),
        "expected_tables": F.when(F.size(named) > 0, named).otherwise(referenced_tables(clean_output(F.col("expected_sql")))),
        **lists,
    })


def read_cases(spark: SparkSession, path: str, case_id: str | None = None, tag: str | None = None) -> DataFrame:
    """Normalised cases of a JSON-array file, optionally one case or one tag. Finding nothing is an error."""
    raw = spark.read.schema(CASE_SCHEMA).json(path, multiLine=True, mode="FAILFAST")
    cases = normalize_cases(raw)
    if case_id:
        cases = cases.filter(F.col("id") == case_id)
    if tag:
        cases = cases.filter(F.array_contains("tags", tag))
    if cases.isEmpty():
        raise ValueError(f"no case matches in {path}")
    return cases


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace lines; folders of single batches (see sinks.append_trace) are read like any file."""
    return spark.read.schema(TRACE_SCHEMA).option("recursiveFileLookup", "true").json(path)


def stream_trace(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TRACE_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def read_files(spark: SparkSession, path: str, columns: Sequence[str] = ("path", "value")) -> DataFrame:
    """Whole text files with their paths."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.input_file_name().alias(columns[0]), F.col("value").alias(columns[1]))


