"""Arriving documents, batch by batch, through the same functions as a batch run, up to states, entities, relations and evidence.

A micro-batch is written as one version of its documents, chunks and claims, named by its number: when a batch is delivered again it
replaces itself, so at-least-once delivery gives each claim once. Its claims' entities are resolved against the state that the batch before left
(resolve.resolve_into), of which it reads and rewrites what its mentions touch; nothing is resolved twice.

Of a document that comes again the last version that could be parsed counts; one that cannot be parsed is `failed` with its error, and keeps the claims
that it had. A document whose text is null is an empty one, and loses them. If one batch has several versions of a document, the
greatest text counts, or that of the greatest `arrived` if there is such a column.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from claimloom.operators import extract, status
from claimloom.operators.assemble import mentions_of, with_entities
from claimloom.operators.chunking import number_chunks, placed_chunks, split_into_chunks
from claimloom.operators.extract import Extractor, rule_extractor
from claimloom.operators.numbering import in_order, listed
from claimloom.operators.project import hashed_relations
from claimloom.operators.resolve import empty_state, resolve_mentions_into
from claimloom.plans.lineage import by_merge, cut
from claimloom.schemas import Tables
from claimloom.sources import sections
from claimloom.sources.slots import SLOTS


class Processed(NamedTuple):
    """What became of documents: their states (document_id, title, status, error, parsed), their chunks with states, and projected claims; and the table that chunks and claims are read from."""

    documents: DataFrame
    chunks: DataFrame
    claims: DataFrame
    answered: DataFrame


def one_version(documents: DataFrame) -> DataFrame:
    """documents with one row for a document_id; only ids are counted where none comes twice."""
    twice = documents.groupBy("document_id").count().where("count > 1").select("document_id")
    if twice.isEmpty():
        return documents
    payload = "content" if "content" in documents.columns else "text"
    last = F.max_by(payload, "arrived") if "arrived" in documents.columns else F.max(payload)
    several = documents.join(twice, "document_id", "left_semi").groupBy("document_id").agg(last.alias(payload))
    return documents.join(twice, "document_id", "left_anti").select("document_id", payload).unionByName(several)


def sections_of(documents: DataFrame) -> DataFrame:
    """document_id, title, section_index, section_title, text, error of documents (document_id, text), or (document_id, content) through the parsers; a row with an error for what cannot be parsed."""
    if "content" in documents.columns:
        return sections.parse(documents)
    none = F.lit(None).cast("string")
    return documents.select("document_id", none.alias("title"), F.lit(0).alias("section_index"), F.lit("Body").alias("section_title"), "text", none.alias("error"))


def process(documents: DataFrame, extractor: Extractor = rule_extractor, repair: Extractor | None = None, keep: Callable[[DataFrame], DataFrame] = cut) -> Processed:
    """Parse, chunk and ask once, and take states and claims from what was written on the way (keep). Ids are 64-bit hashes of (document, chunk, place).

    Chunks are asked about in the order of documents, so that claims are written in theirs. What comes as text is one section of one document: it is read again rather than written, and its chunks are numbered where they are."""
    files = "content" in documents.columns
    parsed = keep(sections_of(documents)) if files else sections_of(documents)
    sections_ = parsed.where("error is null and text is not null")
    parts = number_chunks(split_into_chunks(sections_)) if files else placed_chunks(sections_).withColumnRenamed("place", "chunk_index")
    parts = parts.select(F.xxhash64("document_id", "chunk_index").alias("id"), "document_id", "chunk_index", "section_title", "text", "token_estimate")
    answered = keep(extract.kept_claims(in_order(parts, "document_id", "chunk_index"), extractor, repair))
    status_, error = F.when(F.col("valid"), "done").otherwise("failed"), F.when(~F.col("valid"), F.coalesce("error", F.lit(extract.INVALID)))
    chunks = answered.select(*parts.columns, status_.alias("status"), error.alias("error"))
    states = chunks.select("id", "document_id", "status", "error")
    if files:
        failed = parsed.where("error is not null").select("document_id", "title", F.lit("failed").alias("status"), "error", F.lit(False).alias("parsed"))
        good = parsed.where("error is null").groupBy(F.col("document_id").alias("id")).agg(F.first("title", ignorenulls=True).alias("title"))
        done = good.join(status.document_status(good, states), "id").select(F.col("id").alias("document_id"), "title", "status", "error", F.lit(True).alias("parsed")).unionByName(failed)
    else:
        done = status.document_status(parsed.select(F.col("document_id").alias("id")), states)
        done = done.select(F.col("id").alias("document_id"), F.lit(None).cast("string").alias("title"), "status", "error", F.lit(True).alias("parsed"))
    return Processed(done, chunks, _claims(answered), answered)


def _claims(answered: DataFrame, *more: str | Column) -> DataFrame:
    """The claims of kept_claims' rows; an id is that of the first place with the fingerprint, the values are the last one's."""
    rows = answered.where("valid").select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "task", "before", F.posexplode("claims").alias("k", "c"))
    c = F.col("c")
    return rows.select(
        F.xxhash64("document_id", "chunk_index", c["first"]).alias("id"), "document_id", "chunk_id", "chunk_index", c["position"].alias("position"), c["subject"].alias("subject"), c["object"].alias("object"),
        c["subject"]["canonical_key"].alias("subject_key"), c["predicate"].alias("predicate"), c["object"]["canonical_key"].alias("object_key"), c["qualifiers"].alias("qualifiers"), F.sha2(c["folded"], 256).alias("qualifiers_hash"),
        c["evidence_text"].alias("evidence_text"), c["confidence"].cast("float").alias("confidence"), c["negated"].alias("negated"), c["speculative"].alias("speculative"), F.sha2(c["payload"], 256).alias("claim_fingerprint"), *more,
    )


def placed_claims(answered: DataFrame) -> tuple[DataFrame, int]:
    """(claims with their place _n: 0, 1, ... in the order of document, chunk and position, their number) of written rows of kept_claims; the driver sees one row for a task."""
    counts = dict(answered.groupBy("task").agg(F.max(F.col("before") + F.size("claims"))).collect())
    starts = [*accumulate((counts.get(k, 0) for k in range(max(counts, default=-1) + 1)), initial=0)]
    return _claims(answered, (listed(starts)[F.col("task")] + F.col("before") + F.col("k")).alias("_n")), starts[-1]


def claims_of_documents(documents: DataFrame, extractor: Extractor = rule_extractor) -> DataFrame:
    """documents (document_id, text or content) -> projected claims, one for a chunk and fingerprint."""
    return process(documents, extractor).claims


@functools.cache
def _schemas() -> dict[str, str]:
    """Of each written table, its columns as JSON, as the functions above give them for no documents."""
    spark = SparkSession.active()
    made = process(spark.createDataFrame([], "document_id long, text string"), keep=lambda df: df)
    ends = made.claims.select("*", F.lit(None).cast("long").alias("subject_entity_id"), F.lit(None).cast("long").alias("object_entity_id"))
    return {name: df.schema.json() for name, df in (("documents", made.documents), ("chunks", made.chunks), ("claims", ends), ("numbers", spark.createDataFrame([], "next long")))}


def _read(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """All versions of a written table, with their batch; nothing before the first batch."""
    schema = StructType.fromJson(json.loads(_schemas()[name])).add("batch", "long")
    empty = spark.createDataFrame([], schema)
    empty.drop("batch").coalesce(1).write.mode("ignore").parquet(f"{sink}/{name}/batch=-1")
    return spark.read.schema(schema).parquet(f"{sink}/{name}")


def ingest_stream(
    spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, extractor: Extractor = rule_extractor, files_per_batch: int = 100, repair: Extractor | None = None, slots: int = SLOTS
) -> StreamingQuery:
    """Read Parquet files of documents as they appear under source; batch n writes documents, chunks and claims with their entities as batch=n under the sink, and version n of the state of entities."""
    state = empty_state(spark, f"{sink}/state", slots)

    def write(batch: DataFrame, number: int) -> None:
        made = process(one_version(batch), extractor, repair)
        first = _read(spark, sink, "numbers").where(F.col("batch") < number).agg(F.coalesce(F.max("next"), F.lit(1))).first()[0]
        placed, n = placed_claims(made.answered)
        resolved = resolve_mentions_into(state, number, mentions_of(placed, first))
        ends = with_entities(placed.select("_n", "subject", "object"), resolved, first).select("_n", "subject_entity_id", "object_entity_id")  # the wide columns are shuffled once
        placed.join(by_merge(ends), "_n").drop("_n").write.mode("overwrite").parquet(f"{sink}/claims/batch={number}")
        made.chunks.write.mode("overwrite").parquet(f"{sink}/chunks/batch={number}")
        made.documents.write.mode("overwrite").parquet(f"{sink}/documents/batch={number}")
        spark.range(1).select(F.lit(first + 2 * n).cast("long").alias("next")).write.mode("overwrite").parquet(f"{sink}/numbers/batch={number}")

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _current(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """The rows of documents' last parsed versions, with their batch."""
    last = _read(spark, sink, "documents").where("parsed").groupBy("document_id").agg(F.max("batch").alias("batch"))
    return _read(spark, sink, name).join(last, ["document_id", "batch"])


def current_claims(spark: SparkSession, sink: str) -> DataFrame:
    """All claims that count, with their batch."""
    return _current(spark, sink, "claims")


def stored_claims(spark: SparkSession, sink: str) -> DataFrame:
    return current_claims(spark, sink).drop("batch", "subject", "object", "chunk_index", "position")


def stored_chunks(spark: SparkSession, sink: str) -> DataFrame:
    """id, document_id, chunk_index, section_title, text, token_estimate, status, error of the chunks that count."""
    return _current(spark, sink, "chunks").drop("batch")


def stored_documents(spark: SparkSession, sink: str) -> DataFrame:
    """id, title, status, error of every document, as its last batch left it."""
    row = F.max_by(F.struct("title", "status", "error"), "batch")
    return _read(spark, sink, "documents").groupBy(F.col("document_id").alias("id")).agg(row.alias("r")).select("id", "r.*")


def stored_graph(spark: SparkSession, sink: str, slots: int = SLOTS) -> Tables:
    """The claims that count, their relations and evidence, and of the state the entities and aliases that they refer to; no mention is resolved again."""
    claims = current_claims(spark, sink).drop("batch")
    components = empty_state(spark, f"{sink}/state", slots)[1]
    ends = claims.select(F.explode(F.array("subject_entity_id", "object_entity_id")).alias("id")).distinct()
    entities = components.read(components.latest()).join(ends, "id", "left_semi")
    relations, evidence = hashed_relations(claims)
    aliases = entities.select(F.col("id").alias("entity_id"), F.explode("aliases").alias("a")).select("entity_id", F.col("a")["alias"].alias("alias"), F.col("a")["normalized_alias"].alias("normalized_alias"))
    return Tables(entities=entities.drop("component", "aliases"), aliases=aliases, claims=claims, relations=relations.drop("first_claim"), relation_evidence=evidence)
