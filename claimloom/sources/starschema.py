"""The model's tables, derived from an order-and-supply star schema.

Regions are knowledge bases, customers documents, orders chunks, and order lines claims: a supplier's nation acts on
a part's type. model_sql says the same in SQL, as common table expressions whose names begin with m_.

tables() derives them in the query's own plan; stored_tables() writes what takes windows, joins and aggregates once for each
state of the star schema, so that queries scan it with pushed filters.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.operators import project, status
from claimloom.plans.lineage import shared_folder
from claimloom.schemas import Tables
from claimloom.sources.tables import file_state, once, table

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

PREDICATES = {"A": "ACTIVATES", "N": "BINDS_TO", "R": "INHIBITS"}
_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    key, doc = F.col("o_orderkey"), F.col("o_custkey")
    state = F.when(doc % 29 == 0, "failed").when((F.col("o_orderstatus") == "O") & (key % 50 == 0), "queued").when(key % 10 == 0, "failed").otherwise("done")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, folder, "orders").select(
        key.alias("id"), doc.alias("document_id"), place.cast("int").alias("chunk_index"), F.col("o_orderpriority").alias("section_title"), state.alias("status"), F.col("o_orderdate").alias("created_at")
    )
    return rows.withColumn("error", F.when(F.col("status") == "failed", F.concat(F.lit("E"), F.col("id").cast("string"))))


def documents(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """The newest has the largest remainder of its key by 997."""
    key = F.col("c_custkey")
    name = F.concat(F.lit("doc-"), key.cast("string"), F.lit(".pdf"))
    rows = table(spark, folder, "customer").select(
        key.alias("id"), F.sha2(name, 256).alias("sha256"), name.alias("filename"), F.concat(F.lit("uploads/"), name).alias("source_path"), F.lit(None).cast("string").alias("title"),
        F.timestamp_seconds(1_700_000_000 + key % 997 * 3600).alias("created_at"),
    )
    return rows.join(status.document_status(rows, parts), "id")


def entities(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select(
        (F.col("n_nationkey").cast("long") + 1).alias("id"), F.col("n_name").alias("canonical_name"), F.when(F.col("n_nationkey") % 2 == 0, "Drug").otherwise("Compound").alias("entity_type"),
        F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("CHEBI:"), F.col("n_nationkey").cast("string"))).alias("normalized_id"),
    )
    kinds = table(spark, folder, "part").groupBy(F.col("p_type").alias("canonical_name")).agg((F.min("p_partkey") + 1000).alias("id"))
    kinds = kinds.select("id", "canonical_name", F.lit("Protein").alias("entity_type"), F.lit(None).cast("string").alias("normalized_id"))
    rows = nations.unionByName(kinds)
    key = F.coalesce(F.concat(F.lit("id:"), F.lower("normalized_id")), F.concat(F.lit("name:"), F.lower("canonical_name")))
    return rows.withColumn("canonical_key", F.concat(F.lower("entity_type"), F.lit("|"), key))


def aliases(found: DataFrame) -> DataFrame:
    spellings = F.explode(F.array(F.col("canonical_name"), F.concat(F.lit("The "), F.col("canonical_name"))))
    return found.select(F.col("id").alias("entity_id"), spellings.alias("alias")).withColumn("normalized_alias", F.lower("alias"))


def lines(spark: SparkSession, folder: str, found: DataFrame, with_brand: bool = False) -> DataFrame:
    """What named() makes claims of, by keys alone. Ids: the order's key and the line's place among the order's lines, where orders are joined too, since lines lie by order there."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE))
    rows = table(spark, folder, "lineitem").withColumn("id", F.col("l_orderkey") * 1000 + place)
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey").cast("long") + 1).alias("subject_entity_id"))
    kinds = found.select(F.col("id").alias("object_entity_id"), F.col("canonical_name").alias("p_type"))
    parts = table(spark, folder, "part").join(kinds, "p_type").select(F.col("p_partkey").alias("l_partkey"), "object_entity_id", (F.col("p_size") % 7 == 0).alias("negated"), *(["p_brand"] if with_brand else []))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("document_id"))
    rows = rows.join(orders, "l_orderkey").join(suppliers, "l_suppkey").join(parts, "l_partkey")
    return rows.select(
        "id", "document_id", F.col("l_orderkey").alias("chunk_id"), "subject_entity_id", "object_entity_id", "l_returnflag", (1 - F.col("l_discount")).cast("float").alias("confidence"), "negated",
        (F.col("l_linestatus") == "F").alias("speculative"), *(["p_brand"] if with_brand else []),
    )


def named(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Claims with entity ids and qualifiers of lines()."""
    side = lambda role: found.select(F.col("id").alias(f"{role}_entity_id"), F.col("canonical_name").alias(f"{role}_text"), F.col("entity_type").alias(f"{role}_type"))
    predicate = F.element_at(F.create_map(*[F.lit(x) for p in PREDICATES.items() for x in p]), F.col("l_returnflag"))
    qualifiers = F.concat(F.lit('{"brand":"'), F.col("p_brand"), F.lit('"}')) if "p_brand" in rows.columns else F.lit("{}")
    return rows.join(side("subject"), "subject_entity_id").join(side("object"), "object_entity_id").select(
        "id", "document_id", "chunk_id", "subject_text", "subject_type", "subject_entity_id", predicate.alias("predicate"), "object_text", "object_type", "object_entity_id",
        F.concat_ws(" ", "subject_text", "l_returnflag", "object_text").alias("evidence_text"), "confidence", "negated", "speculative", qualifiers.alias("qualifiers"),
    ).withColumn("qualifiers_hash", F.sha2("qualifiers", 256))


def tables(spark: SparkSession, folder: str, with_brand: bool = False) -> Tables:
    parts, found = chunks(spark, folder), entities(spark, folder)
    facts = named(lines(spark, folder, found, with_brand), found)
    return _tables(spark, folder, documents(spark, folder, parts), parts, found, facts, *project.relations_of(facts))


STORED = ("chunks", "documents", "claims", "relations", "relation_evidence")


def stored_tables(spark: SparkSession, folder: str, with_brand: bool = False, needed: tuple[str, ...] = STORED) -> Tables:
    """As tables(), with documents, chunks, claims, relations and evidence as tables in the shared folder, written when first asked for; those that are not needed are derived, and cost nothing unless they are read.

    Their place is named by the state of the source files and by model_sql, so changed sources or rules give another one. Claims lie by document
    and id: a document's are a few row groups, and a document with a third of all claims is split over files. Entities, which are few, are written
    as well, so that their size is known."""
    state = [file_state(spark, f"{folder}/{name}.parquet") for name in SOURCES]
    place = lambda brand, kind: f"{shared_folder(spark)}/{kind}-{hashlib.sha256(repr((state, model_sql(brand))).encode()).hexdigest()[:32]}"
    base, own = place(False, "model"), place(with_brand, "model")  # documents and chunks have no brands
    keep = lambda name, at, rows, *order, **how: once(f"{at}/{name}", rows, *order, **how) if name in needed else how.get("finish", lambda x: x)(rows)
    parts = keep("chunks", base, chunks(spark, folder))
    docs = keep("documents", base, documents(spark, folder, parts))
    found = once(place(False, "entities"), entities(spark, folder).coalesce(1))
    facts = keep("claims", own, lines(spark, folder, found, with_brand), "document_id", "id", finish=lambda rows: named(rows, found))
    relations, evidence = project.relations_of(facts, lambda rows: keep("relations", own, rows))
    return _tables(spark, folder, docs, parts, found, facts, relations, keep("relation_evidence", own, evidence))


def _tables(spark: SparkSession, folder: str, docs: DataFrame, parts: DataFrame, found: DataFrame, facts: DataFrame, relations: DataFrame, evidence: DataFrame) -> Tables:
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("n_nationkey"))
    regions = table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("r"))
    batch = F.floor(F.col("document_id") / 2).cast("long")
    bases = F.explode(F.array_distinct(F.array("r", F.col("document_id") % 5)))
    members = customers.join(regions, "n_nationkey").select(bases.alias("knowledge_base_id"), "document_id", batch.alias("added_via_batch_id"))
    items = docs.select(
        "id", F.floor(F.col("id") / 2).cast("long").alias("batch_id"), (F.col("id") % 2).cast("int").alias("position"), "filename", F.when(F.col("id") % 7 != 0, F.col("id")).alias("document_id"),
        F.when(F.col("id") % 7 == 0, "rejected").when((F.col("id") % 22).isin(0, 1), "queued").otherwise(F.col("status")).alias("status"), F.lit(None).cast("string").alias("error"),
    )
    batches = customers.select(batch.alias("id")).distinct().select(
        "id", (F.col("id") % 5).alias("knowledge_base_id"), F.concat(F.lit("batch "), F.col("id").cast("string")).alias("name"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 991 * 60).alias("created_at")
    )
    r = table(spark, folder, "region")
    kbs = r.select(F.col("r_regionkey").cast("long").alias("id"), F.concat(F.lit("kb-"), F.lower("r_name")).alias("slug"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("description"), F.timestamp_seconds(1_700_000_000 + F.col("r_regionkey")).alias("created_at"))
    return Tables(docs, parts, kbs, members, batches, items, found, aliases(found), facts, relations, evidence)


def model_sql(with_brand: bool = False) -> str:
    qualifiers = """'{"brand":"' || p_brand || '"}'""" if with_brand else "'{}'"
    return f"""
with m_chunks as (
  select o_orderkey as id, o_custkey as document_id, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as integer) as chunk_index, o_orderpriority as section_title,
    case when o_custkey % 29 = 0 then 'failed' when o_orderstatus = 'O' and o_orderkey % 50 = 0 then 'queued' when o_orderkey % 10 = 0 then 'failed' else 'done' end as status
  from orders),
m_rolled as (
  select c.c_custkey as id, count(k.id) as n, count(*) filter (where k.status = 'queued') as open, count(*) filter (where k.status = 'failed') as failed, count(*) filter (where k.status = 'done') as done,
    string_agg('E' || k.id, '; ' order by k.id) filter (where k.status = 'failed') as errors
  from customer c left join m_chunks k on k.document_id = c.c_custkey group by c.c_custkey),
m_documents as (
  select id, 'doc-' || id || '.pdf' as filename, id % 997 as age,
    case when n = 0 then 'failed' when open > 0 then 'extracting' when failed = 0 then 'done' when done = 0 then 'failed' else 'partial' end as status,
    case when n = 0 then 'No chunks were generated' when open = 0 and failed > 0 then errors end as error
  from m_rolled),
m_entities as (
  select cast(n_nationkey + 1 as bigint) as id, n_name as canonical_name, case when n_nationkey % 2 = 0 then 'Drug' else 'Compound' end as entity_type, case when n_nationkey % 3 = 0 then 'CHEBI:' || n_nationkey end as normalized_id from nation
  union all select min(p_partkey) + 1000, p_type, 'Protein', null from part group by p_type),
m_aliases as (select id as entity_id, canonical_name as alias from m_entities union all select id, 'The ' || canonical_name from m_entities),
m_lines as (select *, l_orderkey * 1000 + row_number() over (partition by l_orderkey order by {", ".join(_LINE)}) as id from lineitem),
m_claims as (
  select l.id, o.o_custkey as document_id, l.l_orderkey as chunk_id, s.canonical_name as subject_text, s.entity_type as subject_type, s.id as subject_entity_id,
    case l_returnflag when 'A' then 'ACTIVATES' when 'N' then 'BINDS_TO' else 'INHIBITS' end as predicate, p_type as object_text, t.entity_type as object_type, t.id as object_entity_id,
    s.canonical_name || ' ' || l_returnflag || ' ' || p_type as evidence_text, cast(1 - l_discount as float) as confidence, p_size % 7 = 0 as negated, l_linestatus = 'F' as speculative, {qualifiers} as qualifiers
  from m_lines l join orders o on o.o_orderkey = l.l_orderkey join supplier u on u.s_suppkey = l.l_suppkey join part p on p.p_partkey = l.l_partkey
    join m_entities s on s.id = u.s_nationkey + 1 join m_entities t on t.canonical_name = p.p_type and t.entity_type = 'Protein'),
m_relations as (
  select subject_entity_id, predicate, object_entity_id, negated, speculative, qualifiers, min(id) as id from m_claims group by all),
m_evidence as (
  select r.id as relation_id, c.id as claim_id, c.document_id, c.chunk_id, c.evidence_text, c.confidence
  from m_claims c join m_relations r using (subject_entity_id, predicate, object_entity_id, negated, speculative, qualifiers)),
m_members as (
  select distinct k as knowledge_base_id, c_custkey as document_id from (select cast(n_regionkey as bigint) as k, c_custkey from customer join nation on n_nationkey = c_nationkey union all select c_custkey % 5, c_custkey from customer)),
m_items as (
  select id, id // 2 as batch_id, cast(id % 2 as integer) as position, filename, case when id % 7 <> 0 then id end as document_id,
    case when id % 7 = 0 then 'rejected' when id % 22 in (0, 1) then 'queued' else status end as own_status, status as document_status, error as document_error
  from m_documents)
"""
