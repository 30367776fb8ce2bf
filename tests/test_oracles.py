"""Queries beside their SQL on small made tables with odd rows."""

import datetime

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tools.check_oracle import table


def both(spark, folder, name, **tables):
    """What the query and what its SQL says of the tables, each as columns and sorted rows."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    want = con.execute(entry.oracle_sql()[name])
    return table(got.columns, [tuple(r) for r in got.collect()]), table([c[0] for c in want.description], want.fetchall())


def test_usage_without_cached_tokens(spark, tmp_path):
    rows = [(1, 0, "assistant", "a" * 50), (2, 0, "user", "b" * 60), (2, 1, "assistant", "c" * 600), (3, 0, "user", "short"), (3, 1, "assistant", "d" * 41), (4, 0, "user", None)]
    got, want = both(spark, tmp_path, "conversation_usage", conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got == want and len(got[1]) == 3


def test_durations_are_exact(spark, tmp_path):
    """A group of more durations than a sketch tells apart, means that end in a five, equal, null and lone durations."""
    day = datetime.datetime(2024, 1, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, day, 1, "click", (i * 7919 % 30011) / 100) for i in range(25_000)]
    rows += [(30_000 + 100 * g + i, day + datetime.timedelta(days=g), 1, "purchase", (g * 37 + i * i) % 1009 / 100) for g in range(1, 60) for i in range(g)]
    rows += [(90_000 + i, day, 2, "purchase", v) for i, v in enumerate([0.0, None, 5.0, 5.0, 5.0])] + [(99_999, None, 3, "click", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got, want = both(spark, tmp_path, "trace_durations", events=df)
    assert got == want and len(got[1]) == 62


def _orders(spark, folder):
    rows = [(i, i % 50, "OFP"[i % 3], 1.0, datetime.datetime(1995, 1, 1), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")[i % 5]) for i in range(3000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")


def test_statements_stay_where_they_are(spark, tmp_path):
    """Templates go to the statements; a log of small files is not sent to every task."""
    _orders(spark, tmp_path)
    plan = entry.queries()["first_issues"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_moved_copies_have_as_many_parts_as_they_need(spark, tmp_path):
    _orders(spark, tmp_path)
    spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("files_signature_checks", "table_signatures"):
        plan = entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "REBALANCE_PARTITIONS_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan, name
