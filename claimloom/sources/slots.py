"""Tables in versions, in slots by the hash of a key: a version rewrites the slots that it touches and shares the others with the one before.

A version is there when its manifest, a row for each slot with the version that wrote it, has been written; so one that broke off
has done nothing, and one that is written again replaces itself. Slots are folders, so readers that know their keys read few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 16


class SlotTable:
    """A table under a folder; version -1 is empty. Its manifest, of as many rows as it has slots, is all that a driver reads."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, slots: int = SLOTS) -> None:
        self.spark, self.folder, self.schema, self.key, self.slots = spark, folder, schema, key, slots
        self.empty = spark.createDataFrame([], schema)
        self.columns = self.empty.columns

    def _slot(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.slots)).cast("int")

    def manifest(self, version: int) -> dict[int, int]:
        """slot -> the version that wrote it."""
        if version < 0:
            return {}
        return {r.slot: r.version for r in self.spark.read.schema("slot int, version long").parquet(f"{self.folder}/manifest/of={version}").collect()}

    def latest(self, below: int = 1 << 62) -> int:
        """The last version there is, below a number; -1 if there is none."""
        self.spark.createDataFrame([], "slot int, version long").coalesce(1).write.mode("ignore").parquet(f"{self.folder}/manifest/of=-1")
        found = [p.rpartition("=")[2] for p in self._folders(f"{self.folder}/manifest")]
        return max([-1, *(int(v) for v in found if int(v) < below)])

    def _folders(self, path: str) -> list[str]:
        """The versions that are whole."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = [s.getPath() for s in files.listStatus(hadoop)]
        return [p.getName() for p in there if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def read(self, version: int, slots: list[int] | None = None) -> DataFrame:
        """The rows of a version; of some slots, where they are given."""
        found = self.manifest(version)
        places = [f"{self.folder}/rows/of={v}/slot={k}" for k, v in found.items() if slots is None or k in slots]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.empty

    def touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._slot()).distinct().collect()]

    def read_keys(self, version: int, keys: DataFrame) -> DataFrame:
        """The rows of some keys (key); only their slots are read."""
        return self.read(version, self.touched(keys)).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def replace(self, version: int, rows: DataFrame, keys: DataFrame) -> int:
        """Write version: the last one below it, but of the keys only rows, which have no others. Gives the number of slots that it rewrote."""
        last = self.latest(version)
        slots, before = self.touched(keys), self.manifest(last)
        kept = self.read(last, slots).join(keys.select(self.key).distinct(), self.key, "left_anti")
        now = kept.unionByName(rows.select(*self.columns)).withColumn("slot", self._slot())
        if slots:
            now.repartition("slot").sortWithinPartitions("slot", self.key).write.mode("overwrite").partitionBy("slot").parquet(f"{self.folder}/rows/of={version}")
        there = [r[0] for r in self.spark.read.schema(f"{self.schema}, slot int").parquet(f"{self.folder}/rows/of={version}").select("slot").distinct().collect()] if slots else []
        after = [(k, v) for k, v in before.items() if k not in slots] + [(k, version) for k in there]
        self.spark.createDataFrame(after, "slot int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/of={version}")
        return len(slots)
