"""Scans of the tables, snapshots of the model, and derived tables that are written once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimloom.plans.lineage import cut
from claimloom.schemas import TABLES, Tables


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_snapshot(spark: SparkSession, folder: str) -> Tables:
    """The model's tables as written by write_snapshot; schemas are given, nothing is inferred."""
    return Tables(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()})


def write_snapshot(tables: Tables, folder: str) -> None:
    """Each table into a folder of its own; a new version goes to a new folder."""
    for name in TABLES:
        if (df := getattr(tables, name)) is not None:
            df.write.parquet(f"{folder}/{name}")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def file_state(spark: SparkSession, path: str) -> tuple[str, int, int, int]:
    """What changes when a table's files do: its full path, bytes, number of files and time of change. Two calls to the file system, however many files there are."""
    fs, at = _path(spark, path)
    summary, full = fs.getContentSummary(at), fs.makeQualified(at).toString()
    return full, summary.getLength(), summary.getFileCount(), fs.getFileStatus(at).getModificationTime()


def once(path: str, rows: DataFrame, *order: str, finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """finish(rows) as a table under path: read where it is there, else written first, by ranges of the columns of order if any are given. What finish adds, such as names
    from small tables, is neither shuffled nor sorted.

    A version is a folder of its own and counts from the moment its job has ended, so a job that was lost leaves nothing that is read; of two that were written at the
    same time, which are equal, the first name is taken."""
    spark = rows.sparkSession
    fs, at = _path(spark, path)
    done = lambda: sorted(v.getPath().toString() for v in (fs.listStatus(at) if fs.exists(at) else ()) if fs.exists(_path(spark, f"{v.getPath().toString()}/_SUCCESS")[1]))
    found = done()
    if not found:
        kept = cut(rows).repartitionByRange(*order).sortWithinPartitions(*order) if order else rows  # ranges are found by a look at all rows, which are made once
        finish(kept).write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/{uuid.uuid4().hex}")
        found = done()
    return spark.read.schema(finish(rows).schema).parquet(found[0])
