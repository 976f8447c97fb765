"""Cut lineage by a table in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the checkpoint folder set on its context; a folder of this machine only where all of Spark is one process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        option = sc._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        found = tempfile.mkdtemp(prefix="claimloom-")
        sc.setCheckpointDir(found)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """df as the right side of a join on ids of claims or mentions: sorted and merged, never broadcast. Spark judges a written table by its compressed bytes, and
    ids in order compress to one or two each, so a broadcast by size would take many times that size in the driver."""
    return df.hint("merge")
