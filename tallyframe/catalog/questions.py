"""Questions derived from the orders: one natural-language question per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def questions(spark: SparkSession, folder: str) -> DataFrame:
    o = spark.read.parquet(f"{folder}/orders.parquet")
    date, priority = F.col("o_orderdate"), F.col("o_orderpriority")
    part = lambda pattern: F.date_format(date, pattern)
    text = (
        F.when(priority == "1-URGENT", F.concat(
            F.lit("Show top customers by net sales in "), part("MMM"), F.lit(", "), part("yy")))
        .when(priority == "2-HIGH", F.concat(
            F.lit("Which products sold the most units in "), part("MMMM"), F.lit(" "), part("yyyy"), F.lit("?")))
        .when(priority == "3-MEDIUM", F.concat(
            F.lit("How many SKUs and invoiceCounts by document type in "), part("MMM"), F.lit(". "), part("yyyy")))
        .when(priority == "4-NOT SPECIFIED", F.concat(
            F.lit("Biggest debits by ledger account since "), part("MMM"), F.lit(" "), part("dd")))
        .otherwise(F.concat(
            F.lit("Revenue of seltzer, energy bars and carbonated water brands from Jan, 97 to "),
            part("MMMM"), F.lit(" , "), part("yyyy")))
    )
    return o.select(F.col("o_orderkey").alias("question_id"), text.alias("text"))


QUESTIONS_SQL = """SELECT o_orderkey AS question_id, CASE
    WHEN o_orderpriority = '1-URGENT' THEN 'Show top customers by net sales in ' || STRFTIME(o_orderdate, '%b, %y')
    WHEN o_orderpriority = '2-HIGH' THEN 'Which products sold the most units in ' || STRFTIME(o_orderdate, '%B %Y') || '?'
    WHEN o_orderpriority = '3-MEDIUM' THEN 'How many SKUs and invoiceCounts by document type in ' || STRFTIME(o_orderdate, '%b. %Y')
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Biggest debits by ledger account since ' || STRFTIME(o_orderdate, '%b %d')
    ELSE 'Revenue of seltzer, energy bars and carbonated water brands from Jan, 97 to ' || STRFTIME(o_orderdate, '%B , %Y')
    END AS text FROM orders"""
