"""Sinks: trace lines, reports, CSV exports, seeded tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.explore import contains_filter
from tallyframe.operators.profile import title
from tallyframe.sources.retail_schema import with_defaults


def append_trace(events: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Append events as JSON lines. With a ``batch`` the append may be repeated: it has a folder of its own, which a retry replaces."""
    if batch is None:
        events.write.mode("append").json(path)
    else:
        events.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")


def stream_trace_to(events: DataFrame, path: str, checkpoint: str):
    """Append a stream of events as JSON lines; the caller starts and stops the query. Spark's file sink keeps a list of whole
    batches beside the files, so readers through Spark see no line of a batch that was written twice."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def path_segment(text: Column) -> Column:
    """Text fit for a path: runs of other characters become one dash."""
    clean = F.regexp_replace(F.trim(text), "[^A-Za-z0-9._-]+", "-")
    return F.regexp_replace(clean, "^-+|-+$", "")


def write_report(report: DataFrame, path: str, run_at: Column, dataset: Column, model: Column) -> None:
    """Report rows under run time, dataset and model."""
    report.withColumns({
        "run_ts": F.date_format(run_at, "yyyy-MM-dd'T'HH-mm-ss"), "dataset": path_segment(dataset), "model": path_segment(model),
    }).write.mode("append").partitionBy("run_ts", "dataset", "model").json(path)


def export_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, needle: str = "", labels: Mapping[str, str] | None = None) -> None:
    """Visible columns of the filtered rows under their labels. Fields are quoted only where needed; null is empty."""
    kept = contains_filter(df, needle)
    shown = kept.select(*[F.col(c).cast("string").alias((labels or {}).get(c, title(c))) for c in columns or df.columns])
    shown.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="",
                                      ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def seed_table(spark: SparkSession, rows: Sequence[Mapping], schema: T.StructType, name: str) -> DataFrame:
    """Replace a table by literal rows; fields that a row leaves out are null or their default."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    given = [tuple(None if r.get(f.name) is None else str(r[f.name]) for f in schema.fields) for r in rows]
    df = with_defaults(spark.createDataFrame(given, text), schema)
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    return spark.table(name)
