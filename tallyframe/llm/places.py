"""Places of rows in the order of their group, without a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.common import written

_PART = 33  # monotonically_increasing_id() has a partition's number above this bit, the row's number in it below


def placed(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with `place`, from 0 in their group by `order` (nulls first), and `members`, the group's size.

    Rows are range-partitioned and sorted over the cluster and written; a partition reports one row for each group in it, and sums
    of these give each partition's first place. Rows that are equal in all keys are told apart by where they were read, so even
    they spread over partitions. Groups may be null.
    """
    keys = [*group, *order]
    sorted_rows = written(
        df.withColumn("read_at", F.monotonically_increasing_id()).repartitionByRange(*keys, "read_at").sortWithinPartitions(*keys, "read_at")
        .drop("read_at").withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", _PART)))
    runs = sorted_rows.groupBy("part", *group).agg(F.min("row").alias("first_row"), F.count("*").alias("size"))
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))  # a row for each partition that holds some of the group
    runs = runs.select(
        F.col("part").alias("run_part"), *[F.col(g).alias(f"run_{g}") for g in group],
        (F.sum("size").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("size") - F.col("first_row")).alias("shift"),
        F.sum("size").over(whole).alias("members"))
    same = F.col("part") == F.col("run_part")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"run_{g}"))
    return sorted_rows.join(runs, same).withColumn("place", F.col("row") + F.col("shift")).drop("row", "part", "run_part", "shift", *[f"run_{g}" for g in group])
