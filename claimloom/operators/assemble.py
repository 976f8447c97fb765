"""From extracted claims to the graph: both ends resolved, relations, evidence and aliases upserted; and the same again for a stored knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import browse, extract, project, resolve
from claimloom.operators.chunking import number_chunks, split_into_chunks
from claimloom.operators.extract import Extractor, rule_extractor
from claimloom.operators.graph import one, scoped_claims
from claimloom.operators.numbering import numbered
from claimloom.plans.lineage import by_merge, cut
from claimloom.schemas import Tables
from claimloom.sources import sections
from claimloom.sources.slots import SlotTable

_IDENTITY = ("canonical_key", "canonical_name", "entity_type", "normalized_id", "normalized_alias")
_FACTS = ("id", "subject", "object", "predicate", "qualifiers", "qualifiers_hash", "negated", "speculative")  # what relations are made of


def mentions_of(claims: DataFrame, first: int = 1, place: str = "_n") -> DataFrame:
    """seq and identity of both ends of every claim, the subject first: claims lie in places 0, 1, ... of their order, their mentions in seq from first."""
    ends = F.explode(F.array(*[F.struct((F.col(place) * 2 + (first + k)).alias("seq"), *[F.col(side)[c].alias(c) for c in _IDENTITY]) for k, side in enumerate(("subject", "object"))]))
    return claims.select(ends.alias("end")).select("end.*")


def with_entities(claims: DataFrame, made: resolve.Resolved, first: int = 1, place: str = "_n") -> DataFrame:
    """claims (place, subject, object) with the entity ids of both ends."""
    for k, side in enumerate(("subject", "object")):
        ids = made.groups.withColumnsRenamed({"entity_id": f"{side}_entity_id", **{c: f"_{c}" for c in resolve.IDENTITY}})
        equal = resolve.equal([F.col(side)[c] for c in resolve.IDENTITY], [F.col(f"_{c}") for c in resolve.IDENTITY])
        claims = claims.drop(f"{side}_entity_id").join(ids, equal, "inner" if made.several is None else "left").drop(*[f"_{c}" for c in resolve.IDENTITY])
        if made.several is not None:  # mentions that were walked have their entities one by one
            one_by_one = made.several.where(F.pmod(F.col("seq") - first, F.lit(2)) == k).select(F.floor((F.col("seq") - first) / 2).cast("long").alias(place), F.col("entity_id").alias("_walked"))
            claims = claims.join(by_merge(one_by_one), place, "left").withColumn(f"{side}_entity_id", F.coalesce(f"{side}_entity_id", "_walked")).drop("_walked")
    return claims


def claims_to_graph(claims: DataFrame, entities: DataFrame | None = None, aliases: DataFrame | None = None, order: list[str] | None = None) -> Tables:
    """Projected claims (project_claims) in their order of arrival (default: by id) -> entities, aliases, claims, relations and evidence.

    entities and aliases, if given, are the state to go on from. An alias keeps its last spelling."""
    placed = numbered(claims, order or ["id"], 0, "_n")
    made = resolve.resolve_mentions(mentions_of(placed), entities, aliases)
    facts = with_entities(placed, made).drop("_n")
    spelled = made.spelled
    if aliases is not None:
        spelled = spelled.unionByName(aliases.select(F.lit(0).cast("long").alias("seq"), "entity_id", "alias", "normalized_alias"))
    relations, evidence = project.relations_of(facts, cut)
    return Tables(entities=cut(made.found), aliases=project.latest_aliases(spelled), claims=facts, relations=relations, relation_evidence=evidence)


def merged_relations(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, ids (id, relation_id)): new relations that the old ones have keep the old id, and give them their qualifiers; ids says how new ids are called."""
    known = old.select(F.col("id").alias("old_id"), *project.RELATION)
    both = cut(new.join(known, project.RELATION, "left").withColumn("relation_id", F.coalesce("old_id", "id")))
    kept = old.join(both.select(F.col("relation_id").alias("id")), "id", "left_anti")
    return kept.unionByName(both.drop("id", "old_id").withColumnRenamed("relation_id", "id").select(*old.columns)), both.select("id", "relation_id")


def rebuild_graph(t: Tables, knowledge_base_id: int) -> tuple[Tables, DataFrame, DataFrame]:
    """(tables, failed sample, counts): stored claims (claim_json) of a knowledge base projected and resolved again over the entities at hand.

    A claim that cannot be read keeps the evidence it had; of claims of a chunk that now say the same the first stays. Relations
    and entities that nothing supports any more are pruned."""
    one(t.knowledge_bases.where(F.col("id") == knowledge_base_id), "knowledge base")
    rows = project.read_stored(scoped_claims(t, knowledge_base_id).select("id", "chunk_id", "claim_json"))
    projected, failed, counts = project.rebuilt(rows)
    good, counts = projected.select(*_FACTS), cut(counts)
    made = claims_to_graph(good, t.entities, t.aliases)
    relations, names = merged_relations(t.relations, made.relations)
    # of the scope, unreadable claims keep what they had, and claims that repeat others go
    replaced = rows.where("readable").select("id")
    gone = replaced.join(by_merge(good.select("id")), "id", "left_anti")
    fresh = made.relation_evidence.withColumnRenamed("relation_id", "id").join(names, "id").select("relation_id", "claim_id")
    stays = t.relation_evidence.select("relation_id", "claim_id").join(by_merge(replaced.withColumnRenamed("id", "claim_id")), "claim_id", "left_anti")
    evidence = cut(stays.select("relation_id", "claim_id").unionByName(fresh))
    now = t.with_(entities=made.entities, aliases=made.aliases, relations=cut(relations), relation_evidence=evidence, claims=t.claims.join(by_merge(gone), "id", "left_anti"))
    lone, unused = browse.orphans(now)
    now = now.with_(relations=now.relations.join(lone.select("id"), "id", "left_anti"), entities=now.entities.join(unused.select("id"), "id", "left_anti"))
    return now, failed, _beside(counts, browse.removed_counts(lone, unused))


def failed_ids(claims: DataFrame, scope: DataFrame) -> DataFrame:
    """Ids of the scope's claims that cannot be read."""
    return claims.join(by_merge(scope), "id", "left_semi").where(~project.readable(F.col("claim_json"))).select("id")


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of one row as one row."""
    k = F.lit(1).alias("k")
    return a.select(k, *a.columns).join(b.select(k, *b.columns), "k").drop("k")


def extract_again(chunks: DataFrame, stored: SlotTable, version: int, extractor: Extractor = rule_extractor, repair: Extractor | None = None) -> tuple[DataFrame, int]:
    """(states of these chunks, slots rewritten): chunks (id, document_id, section_title, text) are asked about again, and stored claims (chunk_id, position, document_id, claim as JSON) of just these chunks are replaced.

    A chunk whose answer fails keeps the claims that it had. Delivering it again with the same version changes nothing."""
    answered = cut(extract.answers(chunks, extractor, repair))
    good = answered.where("valid")
    found = good.select("chunk_id", "document_id", F.posexplode("claims").alias("position", "claim"))
    rows = found.select("chunk_id", "document_id", "position", F.to_json("claim").alias("claim_json"))
    return extract.chunk_states(answered), stored.replace(version, rows, good.select("chunk_id"))


def parse_again(documents: DataFrame, chunks: SlotTable, claims: SlotTable, version: int, **parsers) -> tuple[DataFrame, int]:
    """(document_id, error of what cannot be parsed, slots rewritten): documents (document_id, content) are parsed again; those that can be have only their new chunks, and none of their old claims.

    chunks are kept by document_id, claims by document_id too; documents that cannot be parsed keep what they had."""
    parsed = cut(sections.parse(documents, **parsers))
    good = parsed.where("error is null").select("document_id").distinct()
    fresh = number_chunks(split_into_chunks(parsed.where("error is null")))
    fresh = fresh.select(F.xxhash64("document_id", "chunk_index").alias("id"), "document_id", "chunk_index", "section_title", "text", "token_estimate", F.lit("queued").alias("status"))
    touched = chunks.replace(version, fresh.select(*chunks.columns), good)
    return parsed.where("error is not null").select("document_id", "error"), touched + claims.replace(version, claims.empty, good)
