"""Sections into overlapping chunks, without a UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.textnorm import BLANK_CHARS

MOST_CHARS, OVERLAP = 12_000, 800


def split_into_chunks(sections: DataFrame, key: str = "document_id", most_chars: int = MOST_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """sections (key, section_index, section_title, text) -> key, section_index, start, section_title, text, token_estimate.

    A stripped text of at most most_chars is one chunk; a longer one gives windows that advance by most_chars - overlap
    until one reaches the end; windows are stripped and blank ones dropped. A null text is no section and gives none.
    """
    return placed_chunks(sections, key, most_chars, overlap).drop("place")


def placed_chunks(sections: DataFrame, key: str = "document_id", most_chars: int = MOST_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """As split_into_chunks, with the chunk's place within its section: where a document is one section, that numbers its chunks without a shuffle."""
    strip = lambda c: F.btrim(c, F.lit(BLANK_CHARS))
    rows = sections.withColumn("text", strip(F.col("text"))).where("text is not null")
    n = F.length("text")
    last = F.greatest(n - overlap - 1, F.lit(0))
    starts = F.when(n <= most_chars, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, F.lit(most_chars - overlap)))
    windows = F.transform(starts, lambda s: F.struct(s.alias("start"), strip(F.substring(F.col("text"), s + 1, F.lit(most_chars))).alias("text")))
    windows = F.filter(windows, lambda w: (w["text"] != "") | (w["start"] == 0))
    rows = rows.select(key, "section_index", "section_title", F.posexplode(windows).alias("place", "w"))
    rows = rows.select(key, "section_index", F.col("w")["start"].alias("start"), "section_title", F.col("w")["text"].alias("text"), "place")
    return rows.withColumn("token_estimate", F.greatest(F.lit(1), F.floor(F.length("text") / 3)).cast("int")).select(key, "section_index", "start", "section_title", "text", "token_estimate", "place")


def number_chunks(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """chunk_index: the place within the document."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("section_index", "start")
    return chunks.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int"))
