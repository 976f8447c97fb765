"""Dense numbers in an order, without a task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.plans.lineage import cut


def numbered(df: DataFrame, order: list[str | Column], first: int = 1, name: str = "seq") -> DataFrame:
    """df with a number: first, first + 1, ... in the order, whatever the partitions: a sort by ranges, which is written, and the numbers of rows of the ranges before, of which the driver sees one each."""
    rows = cut(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    counts = dict(rows.groupBy(part.alias("_part")).count().collect())
    starts = [*accumulate((counts.get(k, 0) for k in range(max(counts, default=0))), initial=first)]
    return rows.withColumn(name, listed(starts)[part.cast("int")] + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place")


def listed(numbers: list[int]) -> Column:
    """Numbers as one literal array of longs; the optimizer folds it."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """df sorted by ranges for a step whose time is in its rows, not in their bytes: by bytes Spark would make about as many tasks as there are cores, so that some cores get two of them and the others wait."""
    spark = df.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
