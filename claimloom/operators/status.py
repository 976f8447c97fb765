"""States of documents and batches, derived from what they consist of rather than updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("queued", "parsing", "chunked", "extracting", "uploaded")


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("int")), F.lit(0))


def document_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, status, error of every document, from its chunks (document_id, id, status, error)."""
    status = F.col("status")
    # errors of a document's failed chunks only, in the order of ids; the counts, which every document has, are combined by hash
    wrong = chunks.where((status == "failed") & F.col("error").isNotNull()).groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("chunk"), "error"))).alias("wrong"))
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"), _count(status.isin("queued", "extracting")).alias("open"), _count(status == "failed").alias("failed"), _count(status == "done").alias("done"))
    errors = F.nullif(F.array_join(F.transform("wrong", lambda x: x["error"]), "; "), F.lit(""))
    rows = documents.select("id").join(counts, "id", "left").join(wrong, "id", "left").withColumn("errors", errors)
    none = F.col("n").isNull()
    state = F.when(none, "failed").when(F.col("open") > 0, "extracting").when(F.col("failed") == 0, "done").when(F.col("done") == 0, "failed").otherwise("partial")
    error = F.when(none, "No chunks were generated").when(state.isin("failed", "partial"), F.col("errors"))
    return rows.select("id", state.alias("status"), error.alias("error"))


def item_status(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Items mirror their document; those without one keep their own state."""
    docs = documents.select(F.col("id").alias("document_id"), F.col("status").alias("s"), F.col("error").alias("e"))
    rows = items.join(docs, "document_id", "left")
    has = F.col("s").isNotNull()
    return rows.withColumns({"status": F.coalesce("s", "status"), "error": F.when(has, F.col("e")).otherwise(F.col("error"))}).select(*items.columns)


def batch_status(batches: DataFrame, items: DataFrame) -> DataFrame:
    """id, status, submitted_count, accepted_count of every batch, from its items (batch_id, document_id, status); the first rule that fits."""
    status = F.col("status")
    counts = items.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.count("document_id").alias("accepted"), _count(status == "queued").alias("queued"), _count(status == "done").alias("done"),
        _count(status.isin(*ACTIVE)).alias("active"), _count(status.isin("failed", "rejected")).alias("failed"), _count(status == "partial").alias("partial"),
    )
    rows = batches.select("id").join(counts.withColumnRenamed("batch_id", "id"), "id", "left").fillna(0)
    c = F.col
    state = (
        F.when((c("n") == 0) | (c("accepted") == 0), "failed")
        .when((c("queued") == c("accepted")) & (c("failed") == 0), "queued")
        .when(c("active") > 0, "processing")
        .when((c("done") == c("accepted")) & (c("failed") == 0), "done")
        .when((c("done") > 0) | (c("partial") > 0), "partial")
        .otherwise("failed")
    )
    return rows.select("id", state.alias("status"), c("n").cast("int").alias("submitted_count"), c("accepted").cast("int").alias("accepted_count"))


def batches_of_document(batches: DataFrame, items: DataFrame, document_id: int) -> DataFrame:
    """The status of every batch that holds the document."""
    mine = items.where(F.col("document_id") == document_id).select("batch_id").distinct()
    return batch_status(batches.join(mine, F.col("id") == F.col("batch_id"), "left_semi"), items.join(mine, "batch_id", "left_semi"))
