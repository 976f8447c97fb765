"""The evidence graph of a knowledge base or document: edges, nodes, evidence samples, summary.

Evidence that repeats a sentence of the same document for the same relation counts once, with its highest
confidence. That is an aggregate with a map-side part, not a window, so a relation or document with a third of
all claims is combined before the shuffle. Wide columns are joined after the top edges are known.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.textnorm import entity_type_literal, predicate_literal
from claimloom.plans.lineage import cut
from claimloom.schemas import Tables, bounded


def one(df: DataFrame, what: str) -> DataFrame:
    """df, or KeyError if it has no row."""
    if df.limit(1).isEmpty():
        raise KeyError(f"{what} not found")
    return df


def scoped_claims(t: Tables, knowledge_base_id: int | None = None, document_id: int | None = None) -> DataFrame:
    """Claims of one knowledge base or of one document; exactly one must be given."""
    if (knowledge_base_id is None) == (document_id is None):
        raise ValueError("give a knowledge base or a document, not both")
    if document_id is not None:
        return t.claims.where(F.col("document_id") == document_id)
    members = t.memberships.where(F.col("knowledge_base_id") == knowledge_base_id).select("document_id")
    return t.claims.join(members, "document_id", "left_semi")


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def distinct_evidence(t: Tables, knowledge_base_id: int | None = None, document_id: int | None = None) -> DataFrame:
    """relation_id, document_id, evidence_text, confidence, claim_id: one row for a sentence of a document under a relation."""
    claims = scoped_claims(t, knowledge_base_id, document_id).select(F.col("id").alias("claim_id"), "document_id", "evidence_text", "confidence")
    rows = t.relation_evidence.select("relation_id", "claim_id").join(claims, "claim_id")
    best = F.min(F.struct(F.col("confidence").isNull().alias("none"), (-F.col("confidence")).alias("c"), "claim_id"))
    rows = rows.groupBy("relation_id", "document_id", "evidence_text").agg(best.alias("best"))
    return rows.select("relation_id", "document_id", "evidence_text", (-F.col("best.c")).alias("confidence"), F.col("best.claim_id").alias("claim_id"))


def edges(
    t: Tables, knowledge_base_id: int | None = None, document_id: int | None = None, *, limit: int = 300, min_document_count: int = 1, predicate: str | None = None,
    entity_type: str | None = None, include_negated: bool = True, include_speculative: bool = True, evidence: DataFrame | None = None,
) -> DataFrame:
    """The top relations by documents, evidence and confidence, with both entities; none for an unknown knowledge base or document."""
    bounded("limit", limit)
    bounded("min_document_count", min_document_count)
    evidence = distinct_evidence(t, knowledge_base_id, document_id) if evidence is None else evidence
    kept = []
    if predicate:
        kept.append(F.col("predicate") == predicate_literal(predicate))
    if entity_type:
        kind = entity_type_literal(entity_type)
        kept.append((F.col("subject_type") == kind) | (F.col("object_type") == kind))
    if not include_negated:
        kept.append(~F.col("negated"))
    if not include_speculative:
        kept.append(~F.col("speculative"))
    counts = evidence.groupBy("relation_id").agg(
        F.count("*").cast("int").alias("evidence_count"), F.countDistinct("document_id").cast("int").alias("document_count"),
        F.avg("confidence").cast("float").alias("confidence"), F.max("confidence").cast("float").alias("max_confidence"),
    )
    counts = counts.where(F.col("document_count") >= min_document_count)
    side = lambda role: t.entities.select(
        F.col("id").alias(f"{role}_entity_id"), F.col("canonical_name").alias(f"{role}_name"), F.col("entity_type").alias(f"{role}_type"), F.col("normalized_id").alias(f"{role}_normalized_id")
    )
    rows = t.relations.withColumnRenamed("id", "relation_id").join(counts, "relation_id").join(side("subject"), "subject_entity_id").join(side("object"), "object_entity_id").where(all_of(kept))
    order = [F.desc("document_count"), F.desc("evidence_count"), F.desc_nulls_last("confidence"), F.asc("id")]
    return rows.select(
        F.col("relation_id").alias("id"), "subject_entity_id", "subject_name", "subject_type", "subject_normalized_id", "predicate", "object_entity_id", "object_name", "object_type",
        "object_normalized_id", "qualifiers", "negated", "speculative", "evidence_count", "document_count", "confidence", "max_confidence",
    ).orderBy(*order).limit(limit)


def nodes(top: DataFrame) -> DataFrame:
    """Entities of the edges in the order of first sight, subject before object. There are at most twice `limit`."""
    order = Window.orderBy(F.desc("document_count"), F.desc("evidence_count"), F.desc_nulls_last("confidence"), F.asc("id"))
    placed = top.withColumn("place", F.row_number().over(order) * 2)
    side = lambda role, k: placed.select(
        F.col(f"{role}_entity_id").alias("id"), F.col(f"{role}_name").alias("label"), F.col(f"{role}_type").alias("type"), F.col(f"{role}_normalized_id").alias("normalized_id"), (F.col("place") + k).alias("place")
    )
    both = side("subject", 0).unionByName(side("object", 1))
    return both.groupBy("id", "label", "type", "normalized_id").agg(F.min("place").alias("place")).orderBy("place")


def represented_documents(top: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: how many documents stand behind the returned edges."""
    return evidence.join(top.select(F.col("id").alias("relation_id")), "relation_id", "left_semi").agg(F.countDistinct("document_id").alias("document_count"))


def summary(top: DataFrame, evidence: DataFrame) -> DataFrame:
    """node_count, relation_count, document_count."""
    ends = top.select(F.explode(F.array("subject_entity_id", "object_entity_id")).alias("id")).agg(F.countDistinct("id").alias("node_count"))
    one = F.lit(1).alias("k")
    counts = [ends.select(one, "node_count"), top.agg(F.count("*").alias("relation_count")).select(one, "relation_count"), represented_documents(top, evidence).select(one, "document_count")]
    return reduce(lambda a, b: a.join(b, "k"), counts).drop("k")


def evidence_samples(t: Tables, top: DataFrame, evidence: DataFrame, evidence_limit: int = 3) -> DataFrame:
    """The best sentences of each edge: relation_id, rank, claim_id, document_id, filename, section, sentence, confidence."""
    bounded("evidence_limit", evidence_limit)
    mine = evidence.join(top.select(F.col("id").alias("relation_id")), "relation_id", "left_semi")
    order = Window.partitionBy("relation_id").orderBy(F.desc_nulls_last("confidence"), "claim_id")
    best = mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= evidence_limit)
    chunk_of = t.claims.select(F.col("id").alias("claim_id"), "chunk_id")
    sections = t.chunks.select(F.col("id").alias("chunk_id"), F.col("section_title").alias("section"))
    files = t.documents.select(F.col("id").alias("document_id"), "filename")
    out = best.join(chunk_of, "claim_id").join(files, "document_id").join(sections, "chunk_id", "left")
    return out.select("relation_id", "rank", "claim_id", "document_id", "filename", "section", F.col("evidence_text").alias("sentence"), "confidence")


def graph(t: Tables, knowledge_base_id: int | None = None, document_id: int | None = None, *, evidence_limit: int = 3, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges with samples, summary). The deduplicated evidence is used three times and written."""
    evidence = cut(distinct_evidence(t, knowledge_base_id, document_id))
    top = edges(t, knowledge_base_id, document_id, evidence=evidence, **options)
    samples = evidence_samples(t, top, evidence, evidence_limit).groupBy(F.col("relation_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "claim_id", "document_id", "filename", "section", "sentence", "confidence"))).alias("evidence_samples")
    )  # at most evidence_limit to a list
    full = top.join(samples, "id", "left").withColumns({"label": F.col("predicate"), "evidence": F.try_element_at("evidence_samples", F.lit(1))["sentence"]})
    full = full.withColumns({"width": F.least(F.lit(8), 1 + F.col("document_count")), "color": F.when(F.col("negated"), "red").when(F.col("speculative"), "orange")})
    return nodes(top), full, summary(top, evidence)
