"""Table schemas, vocabularies and parameter bounds of the evidence-graph model."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

#: Columns of the model's tables (fixed values). JSON is canonical text, which can be grouped by; VARIANT and MAP cannot.
TABLES = {
    "documents": "id long, sha256 string, filename string, source_path string, title string, status string, error string, created_at timestamp",
    "chunks": "id long, document_id long, chunk_index int, section_title string, text string, token_estimate int, status string, error string, created_at timestamp",
    "knowledge_bases": "id long, slug string, name string, description string, created_at timestamp",
    "memberships": "knowledge_base_id long, document_id long, added_via_batch_id long",
    "batches": "id long, knowledge_base_id long, name string, status string, submitted_count int, accepted_count int, error string, created_at timestamp",
    "batch_items": "id long, batch_id long, position int, filename string, document_id long, sha256 string, status string, error string",
    "entities": "id long, canonical_key string, canonical_name string, entity_type string, normalized_id string",
    "aliases": "entity_id long, alias string, normalized_alias string",
    "claims": "id long, document_id long, chunk_id long, subject_text string, subject_type string, subject_entity_id long, predicate string, object_text string, object_type string, object_entity_id long, evidence_text string, confidence float, negated boolean, speculative boolean, claim_fingerprint string, claim_json string",
    "relations": "id long, subject_entity_id long, predicate string, object_entity_id long, qualifiers string, qualifiers_hash string, negated boolean, speculative boolean",
    "relation_evidence": "relation_id long, claim_id long",
}

#: Entity types by their folded spelling (fixed values); others pass through.
ENTITY_TYPES = {
    "assay": "Assay", "cellline": "CellLine", "cell_line": "CellLine", "compound": "Compound", "disease": "Disease", "drug": "Drug",
    "gene": "Gene", "mutation": "Mutation", "organism": "Organism", "other": "Other", "pathway": "Pathway", "protein": "Protein",
}

#: Parameter -> (least, most) (fixed values).
BOUNDS = {
    "limit": (1, 2000), "evidence_limit": (1, 20), "min_document_count": (1, 1 << 31), "page": (1, 1000), "document_page": (1, 500),
    "base_page": (1, 500), "query": (0, 200), "offset": (0, 1 << 62), "files": (1, 200),
}


def bounded(name: str, value: int, kind: str | None = None) -> int:
    low, high = BOUNDS[kind or name]
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")
    return value


@dataclass(frozen=True)
class Tables:
    """The model's tables as DataFrames; a query needs only some of them."""

    documents: DataFrame | None = None
    chunks: DataFrame | None = None
    knowledge_bases: DataFrame | None = None
    memberships: DataFrame | None = None
    batches: DataFrame | None = None
    batch_items: DataFrame | None = None
    entities: DataFrame | None = None
    aliases: DataFrame | None = None
    claims: DataFrame | None = None
    relations: DataFrame | None = None
    relation_evidence: DataFrame | None = None

    def with_(self, **given: DataFrame) -> Tables:
        return Tables(**{f.name: given.get(f.name, getattr(self, f.name)) for f in fields(self)})
