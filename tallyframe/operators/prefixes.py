"""Token estimates and groups of texts that share a reusable prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4)).cast("bigint")


def prefix_groups(df: DataFrame, prefix: Column) -> DataFrame:
    """Count texts per prefix: most shared first, then longest, then by hash.

    Only the full hash and the length are shuffled, and equal prefixes are folded before the shuffle. The hash is shortened
    for display alone.
    """
    keyed = df.select(F.sha2(prefix, 256).alias("hash"), F.length(prefix).alias("length"), estimate_tokens(prefix).alias("tokens"))
    return (
        keyed.groupBy("hash", "length")
        .agg(F.count("*").alias("case_count"), F.max("tokens").alias("estimated_tokens"))
        .orderBy(F.desc("case_count"), F.desc("estimated_tokens"), "hash")
        .select(F.substring("hash", 1, 16).alias("prefix_hash"), "case_count", "estimated_tokens")
    )
