"""Listings, searches and statistics over knowledge bases, documents, claims and entities.

Counts are aggregated by side before they are joined, so a document's chunks never multiply its claims.
Pages that sort are ordered to the last id, so that they do not overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.textnorm import entity_type_literal, predicate_literal
from claimloom.operators.graph import all_of, graph, one, scoped_claims
from claimloom.operators.numbering import numbered
from claimloom.operators.search import TrigramIndex
from claimloom.schemas import Tables, bounded


def of_knowledge_base(t: Tables, knowledge_base_id: int) -> DataFrame:
    """Claims of a knowledge base that exists."""
    one(t.knowledge_bases.where(F.col("id") == knowledge_base_id), "knowledge base")
    return scoped_claims(t, knowledge_base_id)


#: Rows up to the end of a page that a task may hold; pages further on are found by numbers.
NEAR = 10_000


def _page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page in the order. One near the start is a top-k of the rows up to its end; for others the rows are sorted by ranges and numbered by the sizes of the ranges before, so no task holds more than its range on disk and the page."""
    if bounded("offset", offset) + limit <= NEAR:
        return df.orderBy(*order).offset(offset).limit(limit)
    rows = numbered(df, order, name="_n")
    return rows.where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).orderBy("_n").drop("_n")


def entity_search(t: Tables, knowledge_base_id: int, query: str | None = None, entity_type: str | None = None, limit: int = 100, offset: int = 0, index: TrigramIndex | None = None) -> DataFrame:
    """Entities of a knowledge base by name, identifier or any alias, with all aliases and counts in scope. With an index, only the entities that it names are looked at and counted; patterns without three characters in a row are scanned for."""
    bounded("limit", limit, "page")
    bounded("query", len(query or ""))
    among = index.candidates(query.strip()) if index is not None and query else None
    if among is not None:
        t = t.with_(entities=t.entities.join(among.withColumnRenamed("entity_id", "id"), "id", "left_semi"), aliases=t.aliases.join(among, "entity_id", "left_semi"))
    claims = of_knowledge_base(t, knowledge_base_id).select("id", "document_id", "subject_entity_id", "object_entity_id")
    roles = claims.select("id", "document_id", F.explode(F.array_distinct(F.array("subject_entity_id", "object_entity_id"))).alias("entity_id")).where("entity_id is not null")
    roles = roles if among is None else roles.join(among, "entity_id", "left_semi")
    counts = roles.groupBy("entity_id").agg(F.countDistinct("document_id").cast("int").alias("document_count"), F.count("*").cast("int").alias("evidence_count"))
    aliases = t.aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    if query:
        aliases = t.aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.max(F.col("alias").ilike(f"%{query.strip()}%")).alias("hit"))
    rows = t.entities.join(counts, F.col("id") == F.col("entity_id")).drop("entity_id").join(aliases, F.col("id") == F.col("entity_id"), "left")
    kept = []
    if query:
        pattern = f"%{query.strip()}%"
        kept.append(F.col("canonical_name").ilike(pattern) | F.coalesce(F.col("normalized_id").ilike(pattern), F.lit(False)) | F.coalesce("hit", F.lit(False)))
    if entity_type:
        kept.append(F.col("entity_type") == entity_type_literal(entity_type))
    rows = rows.where(all_of(kept)).select("id", "canonical_name", "entity_type", "normalized_id", "aliases", "document_count", "evidence_count")
    return _page(rows, [F.desc("document_count"), "canonical_name", "id"], limit, offset)


_CLAIM = ("id", "document_id", "chunk_id", "subject_text", "subject_type", "subject_entity_id", "predicate", "object_text", "object_type", "object_entity_id", "evidence_text", "confidence", "negated", "speculative")


def knowledge_base_claims(t: Tables, knowledge_base_id: int, limit: int = 100, offset: int = 0, predicate: str | None = None, entity_type: str | None = None) -> DataFrame:
    """Claims in scope with file and section, by id."""
    bounded("limit", limit, "page")
    kept = []
    if predicate:
        kept.append(F.col("predicate") == predicate_literal(predicate))
    if entity_type:
        kind = entity_type_literal(entity_type)
        kept.append((F.col("subject_type") == kind) | (F.col("object_type") == kind))
    page = _page(of_knowledge_base(t, knowledge_base_id).where(all_of(kept)).select(*_CLAIM), ["id"], limit, offset)
    files = t.documents.select(F.col("id").alias("document_id"), "filename")
    sections = t.chunks.select(F.col("id").alias("chunk_id"), "section_title")
    return page.join(files, "document_id").join(sections, "chunk_id", "left").orderBy("id")


def knowledge_base_graph(t: Tables, knowledge_base_id: int, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graph.graph of a knowledge base; KeyError for an unknown one."""
    one(t.knowledge_bases.where(F.col("id") == knowledge_base_id), "knowledge base")
    return graph(t, knowledge_base_id, **options)


def document_graph(t: Tables, document_id: int, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graph.graph of a document; KeyError for an unknown one."""
    one(t.documents.where(F.col("id") == document_id), "document")
    return graph(t, document_id=document_id, **options)


def document_claims(t: Tables, document_id: int, limit: int = 100, offset: int = 0) -> DataFrame:
    """Claims of one document by id; none for an unknown document."""
    bounded("limit", limit, "page")
    return _page(t.claims.where(F.col("document_id") == document_id).select(*_CLAIM), ["id"], limit, offset)


def knowledge_bases(t: Tables, limit: int = 100) -> DataFrame:
    """Knowledge bases, oldest first, with their documents, batches and relations."""
    bounded("limit", limit, "base_page")
    documents = t.memberships.groupBy("knowledge_base_id").agg(F.count("*").alias("document_count"))
    batches = t.batches.groupBy("knowledge_base_id").agg(F.count("*").alias("batch_count"))
    pairs = t.relation_evidence.join(t.claims.select(F.col("id").alias("claim_id"), "document_id"), "claim_id").select("relation_id", "document_id")
    relations = pairs.join(t.memberships, "document_id").groupBy("knowledge_base_id").agg(F.countDistinct("relation_id").alias("relation_count"))
    out = t.knowledge_bases
    for counts, name in ((documents, "document_count"), (batches, "batch_count"), (relations, "relation_count")):
        out = out.join(counts.withColumnRenamed("knowledge_base_id", "id"), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("int"))
    return _page(out, ["created_at", "id"], limit)


def knowledge_base_stats(t: Tables, knowledge_base_id: int) -> DataFrame:
    """One row: the knowledge base with its documents, claims and relations."""
    base = one(t.knowledge_bases.where(F.col("id") == knowledge_base_id), "knowledge base")
    members = t.memberships.where(F.col("knowledge_base_id") == knowledge_base_id).agg(F.countDistinct("document_id").cast("int").alias("document_count"))
    claims = scoped_claims(t, knowledge_base_id).select(F.col("id").alias("claim_id"))
    # a claim supports one relation at most, so that its row is one: a single distinct count, which needs no copies of rows
    of_claims = claims.join(t.relation_evidence, "claim_id", "left").agg(F.count("*").cast("int").alias("claim_count"), F.countDistinct("relation_id").cast("int").alias("relation_count"))
    k = F.lit(knowledge_base_id).cast("long").alias("id")
    return base.join(members.select(k, "document_count"), "id").join(of_claims.select(k, "claim_count", "relation_count"), "id")


def _document_counts(t: Tables, documents: DataFrame) -> DataFrame:
    is_ = lambda status: F.sum((F.col("status") == status).cast("int")).cast("int")
    chunks = t.chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("chunk_count"), is_("done").alias("done_chunks"), is_("failed").alias("failed_chunks"))
    claims = t.claims.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias("claim_count"))
    return documents.join(chunks, "id", "left").join(claims, "id", "left").fillna(0, ["chunk_count", "done_chunks", "failed_chunks", "claim_count"])


def knowledge_base_documents(t: Tables, knowledge_base_id: int, limit: int = 100, offset: int = 0) -> DataFrame:
    """Documents of a knowledge base, newest first, with counts."""
    bounded("limit", limit, "page")
    one(t.knowledge_bases.where(F.col("id") == knowledge_base_id), "knowledge base")
    members = t.memberships.where(F.col("knowledge_base_id") == knowledge_base_id).select(F.col("document_id").alias("id"), "added_via_batch_id")
    # the page first: only its documents are counted
    page = _page(t.documents.select("id", "filename", "status", "error", "created_at").join(members, "id"), [F.desc("created_at"), F.desc("id")], limit, offset)
    return _document_counts(t, page).orderBy(F.desc("created_at"), F.desc("id"))


def documents(t: Tables, limit: int = 50) -> DataFrame:
    bounded("limit", limit, "document_page")
    page = _page(t.documents.select("id", "filename", "status", "error", "created_at"), [F.desc("created_at"), F.desc("id")], limit)
    return _document_counts(t, page).orderBy(F.desc("created_at"), F.desc("id"))


def document_detail(t: Tables, document_id: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(document, chunks by status, number of claims, knowledge bases)."""
    document = one(t.documents.where(F.col("id") == document_id), "document")
    histogram = t.chunks.where(F.col("document_id") == document_id).groupBy("status").agg(F.count("*").cast("int").alias("count")).orderBy("status")
    claims = t.claims.where(F.col("document_id") == document_id).agg(F.count("*").cast("int").alias("claim_count"))
    bases = t.knowledge_bases.join(t.memberships.where(F.col("document_id") == document_id).select(F.col("knowledge_base_id").alias("id")), "id", "left_semi").select("id", "slug", "name").orderBy("id")
    return document, histogram, claims, bases


def knowledge_base_batches(t: Tables, knowledge_base_id: int, limit: int = 50) -> DataFrame:
    bounded("limit", limit, "document_page")
    one(t.knowledge_bases.where(F.col("id") == knowledge_base_id), "knowledge base")
    return _page(t.batches.where(F.col("knowledge_base_id") == knowledge_base_id), [F.desc("created_at"), F.desc("id")], limit)


def batch_detail(t: Tables, batch_id: int, item_metadata: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(batch with the knowledge base's name, items by position with their documents' state); item_metadata, if given, is joined on position."""
    header = one(t.batches.where(F.col("id") == batch_id), "batch").join(t.knowledge_bases.select(F.col("id").alias("knowledge_base_id"), F.col("name").alias("knowledge_base_name")), "knowledge_base_id")
    docs = t.documents.select(F.col("id").alias("document_id"), F.col("status").alias("document_status"), "title")
    items = t.batch_items.where(F.col("batch_id") == batch_id).join(docs, "document_id", "left")
    if item_metadata is not None:
        items = items.join(item_metadata, "position", "left")
    return header, items.orderBy("position")


def finished_share(items: DataFrame) -> DataFrame:
    """batch_id, finished: the share of items in a final state, 0 for none."""
    return items.groupBy("batch_id").agg(F.avg(F.col("status").isin("done", "partial", "failed", "rejected").cast("int")).alias("finished"))


def removed_counts(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: how many relations and entities pruning removes."""
    k = F.lit(1).alias("k")
    return relations.agg(F.count("*").alias("removed_relations")).select(k, "removed_relations").join(entities.agg(F.count("*").alias("removed_entities")).select(k, "removed_entities"), "k").drop("k")


def orphans(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(relations without evidence, entities in none of the other relations): what pruning removes."""
    supported = t.relation_evidence.select(F.col("relation_id").alias("id")).distinct()  # combined in each task: evidence is not shuffled
    lone = t.relations.join(supported, "id", "left_anti")
    alive = t.relations.join(lone.select("id"), "id", "left_anti")
    used = alive.select(F.explode(F.array("subject_entity_id", "object_entity_id")).alias("id"))
    return lone, t.entities.join(used, "id", "left_anti")
