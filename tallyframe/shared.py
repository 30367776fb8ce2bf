"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only under a local master that names no spark.checkpoint.dir, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints"
#: While a table is written: shuffle files go when it is there, and rows reach Python in small batches, as texts may be long.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


#: Where this package lies.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers look for this package where the driver has found it. On a cluster it is shipped like any package."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_folder(spark: SparkSession, name: str = "table") -> str:
    """A new path below spark.checkpoint.dir. A machine's own folder will do for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or LOCAL_FOLDER
    return f"{base.rstrip('/')}/tallyframe-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written as a table in the shared folder and read again: lineage ends here, and a lost executor costs no earlier stage.

    The shuffle files behind the rows are given back once the table is there. Pages keep the session's codec: contexts of heavier ones
    lie outside the heap, where many small files add up.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    before = {key: spark.conf.get(key) for key in _WHILE_WRITING}
    try:
        for key, value in _WHILE_WRITING.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
