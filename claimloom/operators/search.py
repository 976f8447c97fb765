"""Substring search over entities through an inverted table of trigrams, which gives candidates; the search itself then looks at these only.

Postings lie in slots by the hash of their trigram, sorted by it, so a search reads the slots of a few trigrams and of these the row groups that hold them.
Trigrams that nearly all entities have are not read: a table of counts tells the rarest of a pattern, whose postings bound the candidates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.plans.lineage import cut
from claimloom.sources.slots import SLOTS, SlotTable

#: Of a pattern, the rarest trigrams whose postings are intersected.
RAREST = 4


def trigrams(text: Column) -> Column:
    """The distinct strings of three characters in a text, as ilike sees it; none for shorter ones and null."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def postings(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """trigram, entity_id: of names, identifiers and aliases."""
    texts = entities.select(F.col("id").alias("entity_id"), F.explode(F.array("canonical_name", "normalized_id")).alias("text")).unionByName(aliases.select("entity_id", F.col("alias").alias("text")))
    return texts.where("text is not null").select(F.explode(trigrams(F.col("text"))).alias("trigram"), "entity_id").distinct()


class TrigramIndex:
    """The index under a folder. Postings of texts that an entity no longer has may stay: candidates are looked at again."""

    def __init__(self, spark: SparkSession, folder: str, slots: int = SLOTS) -> None:
        self.spark = spark
        self.lists = SlotTable(spark, f"{folder}/postings", "trigram string, entity_id long", "trigram", slots)
        self.counts = SlotTable(spark, f"{folder}/counts", "trigram string, n long", "trigram", slots)

    def add(self, entities: DataFrame, aliases: DataFrame) -> TrigramIndex:
        """A version with the postings of these entities too; only the slots of their trigrams are written again."""
        version = self.lists.latest() + 1
        fresh = cut(postings(entities, aliases))
        both = cut(self.lists.read_keys(version - 1, fresh).unionByName(fresh).distinct())
        self.counts.replace(version, both.groupBy("trigram").agg(F.count("*").alias("n")), fresh)
        self.lists.replace(version, both, fresh)
        return self

    def needed(self, pattern: str) -> list[str] | None:
        """The trigrams that a text must have to hold a pattern of % and _; None if it has none that are certain."""
        if "\\" in pattern:
            return None
        runs = [r for r in re.split("[%_]", pattern) if r]
        found = self.spark.range(1).select(F.array_distinct(F.flatten(F.array(*[trigrams(F.lit(r)) for r in runs])))).first()[0] if runs else []
        return found or None

    def candidates(self, query: str) -> DataFrame | None:
        """entity_id of all entities that may hold the query, and others; None where only a scan can tell."""
        needed = self.needed(query)
        if needed is None:
            return None
        version = self.lists.latest()
        wanted = self.spark.createDataFrame([(x,) for x in needed], "trigram string")
        known = {r.trigram: r.n for r in self.counts.read_keys(self.counts.latest(), wanted).collect()}  # a row for a trigram of the query, of at most 200
        if len(known) < len(needed):
            return self.lists.empty.select("entity_id")  # some trigram is nowhere
        rarest = sorted(needed, key=lambda x: (known[x], x))[:RAREST]
        keys = self.spark.createDataFrame([(x,) for x in rarest], "trigram string")
        rows = self.lists.read(version, self.lists.touched(keys)).where(F.col("trigram").isin(rarest))
        return rows.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("entity_id")
