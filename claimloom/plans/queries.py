"""Every query of the evidence graph by name, over the star schema's tables, and the SQL that stands against it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import claimjson, textnorm
from claimloom.operators import assemble, browse, chunking, extract, graph, ingest, project, resolve, search, status
from claimloom.plans.lineage import cut, shared_folder
from claimloom.schemas import TABLES, Tables
from claimloom.sources import pdfwriter, sections, starschema
from claimloom.sources.pieces import pieces
from claimloom.sources.tables import table
from claimloom.streaming import incremental

KB, DOC = 1, 7
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODEL, FINE = starschema.model_sql(), starschema.model_sql(with_brand=True)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _edges_sql(scope: str, having: str = "", where: str = "", columns: str = "") -> str:
    return f"""
    , best as (
      select relation_id, document_id, evidence_text, confidence, claim_id from m_evidence {scope}
      qualify row_number() over (partition by relation_id, document_id, evidence_text order by confidence desc nulls last, claim_id) = 1),
    top as (
      select r.id, r.subject_entity_id, s.canonical_name as subject_name, s.entity_type as subject_type, s.normalized_id as subject_normalized_id, r.predicate, r.object_entity_id, o.canonical_name as object_name,
        o.entity_type as object_type, o.normalized_id as object_normalized_id, r.qualifiers, r.negated, r.speculative, e.* exclude relation_id
      from m_relations r join (
        select relation_id, cast(count(*) as integer) as evidence_count, cast(count(distinct document_id) as integer) as document_count, cast(avg(confidence) as float) as confidence, max(confidence) as max_confidence
        from best group by relation_id {having}) e on e.relation_id = r.id
      join m_entities s on s.id = r.subject_entity_id join m_entities o on o.id = r.object_entity_id {where}
      order by document_count desc, evidence_count desc, confidence desc nulls last, r.id limit 300)
    {columns}"""


_ROUNDED = "select * replace (round(cast(confidence as double), 6) as confidence, round(cast(max_confidence as double), 6) as max_confidence) from top"
_IN_KB = f"where document_id in (select document_id from m_members where knowledge_base_id = {KB})"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in names})


@query(MODEL + _edges_sql(_IN_KB, columns=_ROUNDED))
def graph_edges_kb(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(graph.edges(starschema.stored_tables(spark, folder, needed=("claims", "relations", "relation_evidence")), KB), "confidence", "max_confidence")


_STRICT = "where r.predicate = 'BINDS_TO' and (s.entity_type = 'Drug' or o.entity_type = 'Drug') and not r.negated and not r.speculative"


@query(FINE + _edges_sql(_IN_KB, "having count(distinct document_id) >= 2", _STRICT, _ROUNDED))
def graph_edges_filtered(spark: SparkSession, folder: str) -> DataFrame:
    t = starschema.stored_tables(spark, folder, with_brand=True, needed=("claims", "relations", "relation_evidence"))
    found = graph.edges(t, KB, min_document_count=2, predicate=" binds to", entity_type="drug", include_negated=False, include_speculative=False)
    return rounded(found, "confidence", "max_confidence")


@query(MODEL + _edges_sql(f"where document_id = {DOC}", columns=_ROUNDED))
def document_graph(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(graph.edges(starschema.stored_tables(spark, folder, needed=("claims", "relations", "relation_evidence")), document_id=DOC), "confidence", "max_confidence")


_NODES = """
    , placed as (select *, 2 * row_number() over (order by document_count desc, evidence_count desc, confidence desc nulls last, id) as place from top)
    select id, label, type, normalized_id, cast(min(place) as integer) as place from (
      select subject_entity_id as id, subject_name as label, subject_type as type, subject_normalized_id as normalized_id, place from placed
      union all select object_entity_id, object_name, object_type, object_normalized_id, place + 1 from placed) group by all"""


@query(MODEL + _edges_sql(_IN_KB, columns=_NODES))
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.graph(starschema.stored_tables(spark, folder), KB)[0]


_SUMMARY = """
    select (select count(distinct id) from (select subject_entity_id as id from top union all select object_entity_id from top)) as node_count, (select count(*) from top) as relation_count,
      (select count(distinct document_id) from best where relation_id in (select id from top)) as document_count"""


@query(MODEL + _edges_sql(_IN_KB, columns=_SUMMARY))
def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    return graph.graph(starschema.stored_tables(spark, folder), KB)[2]


_SAMPLES = """
    select b.relation_id, cast(b.rank as integer) as rank, b.claim_id, b.document_id, d.filename, k.section_title as section, b.evidence_text as sentence, round(cast(b.confidence as double), 6) as confidence
    from (select *, row_number() over (partition by relation_id order by confidence desc nulls last, claim_id) as rank from best where relation_id in (select id from top)) b
    join m_documents d on d.id = b.document_id join m_claims c on c.id = b.claim_id left join m_chunks k on k.id = c.chunk_id where b.rank <= 3"""


@query(MODEL + _edges_sql(_IN_KB, columns=_SAMPLES))
def graph_evidence_topk(spark: SparkSession, folder: str) -> DataFrame:
    t = starschema.stored_tables(spark, folder)
    evidence = graph.distinct_evidence(t, KB)
    return rounded(graph.evidence_samples(t, graph.edges(t, KB, evidence=evidence), evidence), "confidence")


@query(MODEL + f"""
    , roles as (
      select distinct entity_id, id, document_id from (select subject_entity_id as entity_id, id, document_id from m_claims {_IN_KB} union all select object_entity_id, id, document_id from m_claims {_IN_KB})),
    counts as (select entity_id, cast(count(distinct document_id) as integer) as document_count, cast(count(*) as integer) as evidence_count from roles group by entity_id)
    select e.id, e.canonical_name, e.entity_type, e.normalized_id, a.aliases, c.document_count, c.evidence_count
    from m_entities e join counts c on c.entity_id = e.id left join (select entity_id, string_agg(distinct alias, '|' order by alias) as aliases, max(cast(alias ilike '%the %a%' as integer)) as hit from m_aliases group by entity_id) a on a.entity_id = e.id
    where e.canonical_name ilike '%the %a%' or coalesce(e.normalized_id ilike '%the %a%', false) or a.hit = 1
    order by document_count desc, canonical_name, id limit 100""")  # fmt: skip
def entity_search(spark: SparkSession, folder: str) -> DataFrame:
    return browse.entity_search(starschema.stored_tables(spark, folder, needed=("claims",)), KB, " the %a").withColumn("aliases", F.array_join("aliases", "|"))


@query(SQL["entity_search"])
def entity_search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """As entity_search, through the trigrams of names, identifiers and aliases."""
    t = starschema.stored_tables(spark, folder, needed=("claims",))
    index = search.TrigramIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", slots=16).add(t.entities, t.aliases)
    return browse.entity_search(t, KB, " the %a", index=index).withColumn("aliases", F.array_join("aliases", "|"))


_CLAIM_COLUMNS = ", ".join(f"c.{x}" for x in browse._CLAIM if x != "confidence") + ", round(cast(c.confidence as double), 6) as confidence"


@query(MODEL + f"""
    select {_CLAIM_COLUMNS}, d.filename, k.section_title from m_claims c join m_documents d on d.id = c.document_id left join m_chunks k on k.id = c.chunk_id
    where c.document_id in (select document_id from m_members where knowledge_base_id = {KB}) and c.predicate = 'INHIBITS' and (c.subject_type = 'Drug' or c.object_type = 'Drug') order by c.id limit 1000 offset 10""")  # fmt: skip
def kb_claims(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(browse.knowledge_base_claims(starschema.stored_tables(spark, folder, needed=("chunks", "documents", "claims")), KB, 1000, 10, "inhibits", "drug"), "confidence")


@query(MODEL + f"select {_CLAIM_COLUMNS} from m_claims c where c.document_id = {DOC} order by c.id limit 100")
def document_claims(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(browse.document_claims(starschema.stored_tables(spark, folder, needed=("claims",)), DOC), "confidence")


@query(MODEL + """
    select cast(r_regionkey as bigint) as id, 'kb-' || lower(r_name) as slug, r_name as name,
      cast((select count(*) from m_members m where m.knowledge_base_id = r_regionkey) as integer) as document_count,
      cast((select count(distinct batch_id) from m_items i where i.batch_id % 5 = r_regionkey) as integer) as batch_count,
      cast((select count(distinct relation_id) from m_evidence e join m_members m using (document_id) where m.knowledge_base_id = r_regionkey) as integer) as relation_count
    from region""")  # fmt: skip
def kb_list(spark: SparkSession, folder: str) -> DataFrame:
    return browse.knowledge_bases(starschema.stored_tables(spark, folder, needed=("claims", "relation_evidence"))).drop("created_at", "description")


@query(MODEL + f"""
    select cast(r_regionkey as bigint) as id, 'kb-' || lower(r_name) as slug, r_name as name,
      cast((select count(*) from m_members where knowledge_base_id = {KB}) as integer) as document_count,
      cast((select count(*) from m_claims {_IN_KB}) as integer) as claim_count, cast((select count(distinct relation_id) from m_evidence {_IN_KB}) as integer) as relation_count
    from region where r_regionkey = {KB}""")  # fmt: skip
def kb_stats(spark: SparkSession, folder: str) -> DataFrame:
    return browse.knowledge_base_stats(starschema.stored_tables(spark, folder, needed=("claims", "relation_evidence")), KB).drop("created_at", "description")


_COUNTED = """
    , page as ({page})
    select p.id, p.filename, p.status, p.error, {more} cast(coalesce(k.n, 0) as integer) as chunk_count, cast(coalesce(k.done, 0) as integer) as done_chunks, cast(coalesce(k.failed, 0) as integer) as failed_chunks, cast(coalesce(c.n, 0) as integer) as claim_count
    from page p left join (select document_id, count(*) as n, count(*) filter (where status = 'done') as done, count(*) filter (where status = 'failed') as failed from m_chunks group by document_id) k on k.document_id = p.id
    left join (select document_id, count(*) as n from m_claims group by document_id) c on c.document_id = p.id"""


@query(MODEL + _COUNTED.format(more="p.id // 2 as added_via_batch_id,", page=f"select * from m_documents where id in (select document_id from m_members where knowledge_base_id = {KB}) order by age desc, id desc limit 1000 offset 5"))
def kb_documents(spark: SparkSession, folder: str) -> DataFrame:
    return browse.knowledge_base_documents(starschema.stored_tables(spark, folder, needed=("chunks", "documents", "claims")), KB, 1000, 5).drop("created_at")


@query(MODEL + _COUNTED.format(more="", page="select * from m_documents order by age desc, id desc limit 500"))
def documents_list(spark: SparkSession, folder: str) -> DataFrame:
    return browse.documents(starschema.stored_tables(spark, folder, needed=("chunks", "documents", "claims")), 500).drop("created_at")


@query(MODEL + f"""
    select d.id, d.filename, d.status, (select string_agg(status || '=' || n, ',' order by status) from (select status, count(*) as n from m_chunks where document_id = {DOC} group by status)) as chunks,
      cast((select count(*) from m_claims where document_id = {DOC}) as integer) as claim_count,
      (select string_agg('kb-' || lower(r_name), ',' order by r_regionkey) from region join m_members on knowledge_base_id = r_regionkey where document_id = {DOC}) as bases
    from m_documents d where d.id = {DOC}""")  # fmt: skip
def document_detail(spark: SparkSession, folder: str) -> DataFrame:
    doc, histogram, count, bases = browse.document_detail(starschema.stored_tables(spark, folder, needed=("chunks", "documents", "claims")), DOC)
    joined = lambda rows, name: rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), ",").alias(name)).withColumn("k", F.lit(1))
    chunks = joined(histogram.select(F.struct(F.col("status").alias("o"), F.concat_ws("=", "status", F.col("count").cast("string")).alias("v")).alias("x")), "chunks")
    slugs = joined(bases.select(F.struct(F.col("id").alias("o"), F.col("slug").alias("v")).alias("x")), "bases")
    return doc.select("id", "filename", "status", F.lit(1).alias("k")).join(chunks, "k").join(count.withColumn("k", F.lit(1)), "k").join(slugs, "k").drop("k")


@query(MODEL + f"select distinct batch_id as id, batch_id % 5 as knowledge_base_id, 'batch ' || batch_id as name from m_items where batch_id % 5 = {KB} qualify dense_rank() over (order by batch_id % 991 desc, batch_id desc) <= 500")
def kb_batches(spark: SparkSession, folder: str) -> DataFrame:
    return browse.knowledge_base_batches(starschema.stored_tables(spark, folder, needed=()), KB, 500).drop("created_at")


_ITEMS = "select batch_id, position, filename, document_id, case when document_id is null then own_status else document_status end as status, case when document_id is not null then document_error end as error from m_items"


@query(MODEL + _ITEMS)
def batch_items(spark: SparkSession, folder: str) -> DataFrame:
    t = starschema.stored_tables(spark, folder, needed=("chunks", "documents"))
    return status.item_status(t.batch_items, t.documents).drop("id", "sha256")


_ROLLED = """
    select batch_id as id, case when accepted = 0 then 'failed' when queued = accepted and bad = 0 then 'queued' when active > 0 then 'processing' when done = accepted and bad = 0 then 'done'
      when done > 0 or partly > 0 then 'partial' else 'failed' end as status, cast(n as integer) as submitted_count, cast(accepted as integer) as accepted_count
    from (select batch_id, count(*) as n, count(document_id) as accepted, count(*) filter (where s = 'queued') as queued, count(*) filter (where s = 'done') as done, count(*) filter (where s in ('failed', 'rejected')) as bad,
      count(*) filter (where s = 'partial') as partly, count(*) filter (where s in ('queued', 'parsing', 'chunked', 'extracting', 'uploaded')) as active from ({}) group by batch_id)"""


@query(MODEL + _ROLLED.format("select *, own_status as s from m_items"))
def batch_rollup(spark: SparkSession, folder: str) -> DataFrame:
    t = starschema.stored_tables(spark, folder, needed=("chunks", "documents"))
    return status.batch_status(t.batches, t.batch_items)


@query(MODEL + "select batch_id, cast(count(*) filter (where own_status in ('done', 'partial', 'failed', 'rejected')) as double) / count(*) as finished from m_items group by batch_id")
def batch_progress(spark: SparkSession, folder: str) -> DataFrame:
    return browse.finished_share(starschema.stored_tables(spark, folder, needed=("chunks", "documents")).batch_items)


@query(MODEL + "select id, status, error from m_documents")
def document_status(spark: SparkSession, folder: str) -> DataFrame:
    return starschema.stored_tables(spark, folder, needed=("chunks", "documents")).documents.select("id", "status", "error")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "text")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("document_id") % 5
    name = F.when(k == 0, F.lit("C:\\docs\\a b.pdf")).when(k == 1, F.lit(" ../../x/Paper.PDF ")).when(k == 2, F.lit("notes.txt")).when(k == 3, F.lit("fake.pdf")).otherwise(F.lit("in/"))
    content = F.encode(F.when(k == 3, F.col("text")).when(F.col("document_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("%PDF-"), F.col("text"))), "UTF-8")
    return _texts(spark, folder).select(F.col("document_id").alias("position"), name.alias("filename"), content.alias("content"))


_FILES = """
    with f as (select doc_id as position, case doc_id % 5 when 0 then 'a b.pdf' when 1 then 'Paper.PDF' when 2 then 'notes.txt' when 3 then 'fake.pdf' else 'document.pdf' end as filename,
      coalesce(case when doc_id % 5 = 3 then text when doc_id % 7 = 0 then '' else '%PDF-' || text end, '') as content from documents),
    v as (select *, octet_length(encode(content)) as size_bytes, case when filename = 'notes.txt' then 'Only PDF files are supported' when octet_length(encode(content)) > 3000 then 'File exceeds the 3000 byte limit'
      when content = '' then 'File is empty' when not contains(left(content, 1000), '%PDF-') then 'File is not a valid PDF' end as error from f)"""


@query(_FILES + "select position, filename, size_bytes, error, case when error is null then sha256(content) end as sha256, case when error is null then 'uploads/' || sha256(content) || '.pdf' end as source_path from v")
def upload_validation(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.validate_uploads(_files(spark, folder), 3000)


def _registered(validated: DataFrame) -> DataFrame:
    ok = validated.where("error is null")
    known = ok.where("position % 4 = 0").groupBy("sha256").agg(F.min("position").alias("id"))
    state = F.when(F.col("id") % 3 == 0, "done").when(F.col("id") % 3 == 1, "failed").otherwise("extracting")
    known = known.select("id", "sha256", F.lit("old.pdf").alias("filename"), F.lit("old").alias("source_path"), state.alias("status"), F.lit(None).cast("string").alias("error"))
    return ingest.register_documents(known, ok.where("position % 4 <> 0")).drop("source_path", "error")


_REGISTERED = """
    , ok as (select *, sha256(content) as sha256 from v where error is null),
    known as (select sha256, min(position) as id, case when min(position) % 3 = 0 then 'done' when min(position) % 3 = 1 then 'failed' else 'extracting' end as status from ok where position % 4 = 0 group by sha256),
    incoming as (select sha256, arg_max(filename, position) as filename, min(position) as first from ok where position % 4 <> 0 group by sha256)
    select coalesce(k.id, i.first + 1 + (select max(id) from known)) as id, sha256, coalesce(i.filename, 'old.pdf') as filename,
      case when i.sha256 is not null and (k.sha256 is null or k.status = 'failed') then 'queued' else k.status end as status, k.sha256 is null as inserted, i.sha256 is not null and (k.sha256 is null or k.status = 'failed') as queued
    from known k full join incoming i using (sha256)"""  # fmt: skip


def _all_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a PDF of an accepted name."""
    k = F.col("document_id") % 3
    name = F.when(k == 0, F.lit("C:\\docs\\a b.pdf")).when(k == 1, F.lit(" ../../x/Paper.PDF ")).otherwise(F.lit("in/"))
    return _texts(spark, folder).select(F.col("document_id").alias("position"), name.alias("filename"), F.encode(F.concat(F.lit("%PDF-"), F.coalesce("text", F.lit(""))), "UTF-8").alias("content"))


_ALL_FILES = """
    with f as (select doc_id as position, case doc_id % 3 when 0 then 'a b.pdf' when 1 then 'Paper.PDF' else 'document.pdf' end as filename, '%PDF-' || coalesce(text, '') as content from documents),
    v as (select *, case when octet_length(encode(content)) > 104857600 then 'File exceeds the 104857600 byte limit' end as error from f)"""


@query(_ALL_FILES + "select distinct sha256(content) as sha256, octet_length(encode(content)) as n_bytes from v where error is null")
def document_dedup_all(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct contents of every document, with the default limit."""
    return ingest.stored_contents(_all_files(spark, folder)).select("sha256", F.length("content").cast("long").alias("n_bytes"))


@query(_ALL_FILES + _REGISTERED)
def register_documents_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every document registered beside those that are known, with the default limit."""
    return _registered(ingest.validate_uploads(_all_files(spark, folder)))


@query(r"""
    with t as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from documents where text is not null),
    w as (select doc_id, text, unnest(case when length(text) <= 2000 then [0] else range(0, greatest(length(text) - 200, 1), 1800) end) as start from t)
    select doc_id as document_id, cast(row_number() over (partition by doc_id order by start) - 1 as integer) as chunk_index, sha256(c) as sha256, cast(greatest(1, length(c) // 3) as integer) as token_estimate
    from (select doc_id, start, regexp_replace(substring(text, start + 1, 2000), '^\s+|\s+$', '', 'g') as c from w) where c <> '' or start = 0""")  # fmt: skip
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 2,000 characters, so that most documents give several."""
    return _chunked(spark, folder, most_chars=2000, overlap=200)


def _chunked(spark: SparkSession, folder: str, **windows: int) -> DataFrame:
    rows = _texts(spark, folder).withColumns({"section_index": F.lit(0), "section_title": F.lit("Body")})
    parts = chunking.number_chunks(chunking.split_into_chunks(rows, **windows))
    return parts.select("document_id", "chunk_index", F.sha2("text", 256).alias("sha256"), "token_estimate")


@query(SQL["chunk_documents"].replace("1800)", "11200)").replace("2000", "12000").replace("- 200", "- 800"))
def chunk_documents_default(spark: SparkSession, folder: str) -> DataFrame:
    """The windows of an ingest: 12,000 characters that overlap by 800."""
    return _chunked(spark, folder)


def _tei(spark: SparkSession, folder: str) -> DataFrame:
    head = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'
    content = F.concat(
        F.lit(head), F.col("p_name"), F.lit("</title></titleStmt></fileDesc><profileDesc><abstract><p> On  "), F.col("p_type"), F.lit("</p></abstract></profileDesc></teiHeader><text><body><div><head>Results</head><p>"),
        F.repeat(F.concat("p_name", F.lit(" ")), F.col("p_size").cast("int")), F.lit("</p></div><div><p>short</p></div></body></text></TEI>"),
    )
    content = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit(" \f"), F.col("p_name"))).when(F.col("p_partkey") % 13 == 0, F.lit(" ")).otherwise(content)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("document_id"), F.encode(content, "UTF-8").alias("content"))


@query("""
    with p as (select p_partkey as id, p_name, p_type, trim(repeat(p_name || ' ', p_size)) as body, p_partkey % 11 = 0 as plain, p_partkey % 13 = 0 and p_partkey % 11 <> 0 as blank from part)
    select id as document_id, p_name as title, 0 as section_index, 'Abstract' as section_title, 'On ' || p_type as text, cast(null as varchar) as error from p where not plain and not blank
    union all select id, p_name, 1, 'Results', body, null from p where not plain and not blank and length(body) > 80
    union all select id, null, 0, 'Page 2', trim(p_name), null from p where plain
    union all select id, null, null, null, null, 'No text sections extracted from PDF' from p where blank""")
def parse_sections(spark: SparkSession, folder: str) -> DataFrame:
    return sections.parse(_tei(spark, folder), fallback=sections.page_sections)


PAGE_LINES = 20


def _pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a PDF file of pages of 20 lines, written in three ways; every fourth is cut off after its header."""

    def file_of(key: int, text: str | None) -> bytes:
        lines = (text or "").split("\n")
        return pdfwriter.pdf_of([lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)], key % 4) if key % 4 < 3 else b"%PDF-1.7\n1 0 obj << /Type /Ca"

    def written(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts, "text"):
            files = [file_of(k, t) for k, t in zip(part.column("document_id").to_pylist(), part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("document_id"), pa.array(files, pa.binary())], names=["document_id", "content"])

    return _texts(spark, folder).mapInArrow(written, "document_id long, content binary")


@query(rf"""
    with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    p as (select doc_id, lines, unnest(range((len(lines) + {PAGE_LINES - 1}) // {PAGE_LINES})) as n from t where doc_id % 4 <> 3),
    q as (select doc_id, n, trim(regexp_replace(array_to_string(lines[{PAGE_LINES} * n + 1 : {PAGE_LINES} * n + {PAGE_LINES}], ' '), '\s+', ' ', 'g')) as text from p)
    select doc_id as document_id, cast(row_number() over (partition by doc_id order by n) - 1 as integer) as section_index, 'Page ' || (n + 1) as section_title, sha256(text) as sha256, cast(null as varchar) as error from q where text <> ''
    union all select doc_id, null, null, null, 'the file has no catalog' from documents where doc_id % 4 = 3
    union all select doc_id, null, null, null, '{sections.NO_SECTIONS}' from q group by doc_id having max(text) = ''""")
def pdf_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Files that the parsing service cannot read: the text of their pages, or why there is none."""
    found = sections.parse(_pdfs(spark, folder), parser=sections.tei_sections)
    return found.select("document_id", "section_index", "section_title", F.sha2("text", 256).alias("sha256"), "error")


def _answer(asked: str) -> str:
    """An extractor that fails on passages with a given syllable."""
    return "no answer" if "ung" in asked.rpartition("\nPassage:\n")[2] else '{"claims": []}'


_PROCESSED = SQL["pdf_sections"].partition("    select doc_id as document_id")[0].rstrip() + f""",
    w as (select doc_id, text, unnest(case when length(text) <= 12000 then [0] else range(0, greatest(length(text) - 800, 1), 11200) end) as start from q where text <> ''),
    g as (select doc_id, count(*) as n, count(*) filter (contains(substring(text, start + 1, 12000), 'ung')) as bad from w group by doc_id),
    states as (
      select d.doc_id, coalesce(n, 0) as chunk_count, case when n is null or bad = n then 'failed' when bad = 0 then 'done' else 'partial' end as status,
        case when d.doc_id % 4 = 3 then 'the file has no catalog' when n is null then '{sections.NO_SECTIONS}' when bad > 0 then left(repeat('{extract.INVALID}; ', bad), (length('{extract.INVALID}') + 2) * bad - 2) end as error
      from documents d left join g on g.doc_id = d.doc_id)"""


def _processed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    made = incremental.process(_pdfs(spark, folder), _answer)
    return made.documents.withColumnRenamed("document_id", "id"), made.chunks


@query(f"{_PROCESSED} select doc_id as document_id, status, error, chunk_count from states")
def processing_states(spark: SparkSession, folder: str) -> DataFrame:
    """Files parsed and asked about: what fails is failed with its error, chunks make up the states of documents."""
    documents, chunks = _processed(spark, folder)
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    return documents.join(counts, "id", "left").select(F.col("id").alias("document_id"), "status", "error", F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"))


@query(_PROCESSED + """
    , m_items as (select doc_id // 10 as batch_id, case when doc_id % 9 <> 0 then doc_id end as document_id, case when doc_id % 9 = 0 then 'rejected' else status end as own_status from states)
    """ + _ROLLED.format("select *, own_status as s from m_items"))
def processing_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of ten such files, one in nine of them rejected before; a batch's state follows its documents'."""
    documents, _ = _processed(spark, folder)
    batch, rejected = F.floor(F.col("id") / 10).cast("long").alias("batch_id"), F.col("id") % 9 == 0
    items = documents.select("id", batch, (F.col("id") % 10).cast("int").alias("position"), F.lit("a.pdf").alias("filename"), F.when(~rejected, F.col("id")).alias("document_id"), F.when(rejected, "rejected").otherwise("queued").alias("status"), F.lit(None).cast("string").alias("error"))
    items = cut(status.item_status(items, documents.select("id", "status", "error")))
    return status.batch_status(items.select(F.col("batch_id").alias("id")).distinct(), items)


_MESSY = "'  ' || p_name || ' – ' || p_brand || chr(9) || '\"' || p_type || '\".  '"


def _messy(spark: SparkSession, folder: str) -> tuple[DataFrame, F.Column]:
    text = F.concat(F.lit("  "), F.col("p_name"), F.lit(" – "), F.col("p_brand"), F.lit('\t"'), F.col("p_type"), F.lit('".  '))
    return table(spark, folder, "part"), text


@query(f"select p_partkey, regexp_replace(trim(regexp_replace(replace({_MESSY}, '–', '-'), '\\s+', ' ', 'g')), '^$', 'Unknown') as cleaned from part")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    part, text = _messy(spark, folder)
    return part.select("p_partkey", textnorm.clean_text(text).alias("cleaned"))


@query(f"select p_partkey, upper(trim(regexp_replace({_MESSY}, '[^0-9A-Za-z]+', '_', 'g'), '_')) as predicate from part")
def normalize_predicate(spark: SparkSession, folder: str) -> DataFrame:
    part, text = _messy(spark, folder)
    return part.select("p_partkey", textnorm.normalize_predicate(text).alias("predicate"))


@query(f"""select p_partkey, lower(rtrim(trim(regexp_replace(replace({_MESSY}, '–', '-'), '\\s+', ' ', 'g')), '".')) as alias,
      case when p_size % 3 = 0 then 'CellLine' when p_size % 3 = 1 then 'Drug' else p_type end as entity_type,
      case when p_size % 3 = 0 then 'cellline' when p_size % 3 = 1 then 'drug' else lower(p_type) end || '|' || case when p_partkey % 10 = 0 then 'id:' || lower(p_brand) else 'name:' || lower(rtrim(trim(regexp_replace(replace({_MESSY}, '–', '-'), '\\s+', ' ', 'g')), '".')) end as canonical_key
      from part""")  # fmt: skip
def normalize_entities(spark: SparkSession, folder: str) -> DataFrame:
    part, text = _messy(spark, folder)
    kind = F.when(F.col("p_size") % 3 == 0, F.lit(" cell-LINE")).when(F.col("p_size") % 3 == 1, F.lit("DRUG")).otherwise(F.col("p_type"))
    identity = textnorm.entity_identity(text, kind, F.when(F.col("p_partkey") % 10 == 0, F.col("p_brand")))
    return part.select("p_partkey", identity.alias("i")).select("p_partkey", F.col("i.normalized_alias").alias("alias"), "i.entity_type", "i.canonical_key")


def _qualifiers() -> F.Column:
    return F.concat(F.lit('{"unit":" nM ","none":null,"k":'), F.get_json_object("props", "$.k"), F.lit(',"of":["A", null]}'))


@query("""select event_id, '{"k":' || (props::json->>'k') || ',"of":["A",null],"unit":"nM"}' as canonical, sha256('{"k":' || (props::json->>'k') || ',"of":["a",null],"unit":"nm"}') as qualifiers_hash from events""")
def qualifier_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", claimjson.canonical_qualifiers(_qualifiers()).alias("canonical"), claimjson.qualifiers_hash(_qualifiers()).alias("qualifiers_hash"))


_PRINT = """sha256('{"evidence":"' || lower(evidence_text) || '","negated":' || negated || ',"object":"protein|name:' || lower(object_text) || '","predicate":"' || predicate || '","qualifiers":' || qualifiers || ',"speculative":' || speculative || ',"subject":"' || lower(subject_type) || '|name:' || lower(subject_text) || '"}')"""


def _printed(claims: DataFrame) -> DataFrame:
    key = lambda role: textnorm.entity_identity(F.col(f"{role}_text"), F.col(f"{role}_type"), F.lit(None).cast("string"))["canonical_key"]
    c = F.col
    return claims.withColumn("claim_fingerprint", claimjson.claim_fingerprint(key("subject"), c("predicate"), key("object"), c("qualifiers"), c("evidence_text"), c("negated"), c("speculative")))


@query(FINE + f"select id, {_PRINT} as claim_fingerprint from m_claims")
def claim_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return _printed(starschema.stored_tables(spark, folder, with_brand=True, needed=("claims",)).claims).select("id", "claim_fingerprint")


@query(MODEL + f", p as (select *, {_PRINT} as claim_fingerprint from m_claims) select min(id) as id, chunk_id, claim_fingerprint, round(cast(arg_max(confidence, id) as double), 6) as confidence from p group by chunk_id, claim_fingerprint")
def claim_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = _printed(starschema.stored_tables(spark, folder, needed=("claims",)).claims).select("id", "chunk_id", "claim_fingerprint", "confidence")
    return rounded(project.dedup_claims(rows), "confidence")


@query(FINE + "select r.id, subject_entity_id, predicate, object_entity_id, qualifiers, sha256(qualifiers) as qualifiers_hash, negated, speculative, n from m_relations r join (select relation_id, count(*) as n from m_evidence group by relation_id) e on e.relation_id = r.id")
def relation_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Relations by the hash of their columns; here they are called by their first claim, which SQL can say."""
    relations, evidence = project.hashed_relations(starschema.stored_tables(spark, folder, with_brand=True, needed=("claims",)).claims)
    named = relations.join(evidence.groupBy(F.col("relation_id").alias("id")).agg(F.count("*").alias("n")), "id")
    return named.drop("id").withColumnRenamed("first_claim", "id")


@query(MODEL + "select subject_entity_id as entity_id, lower(subject_text) as normalized_alias, arg_max(case when id % 3 = 0 then upper(subject_text) when id % 3 = 1 then lower(subject_text) else subject_text end, id) as alias from m_claims group by subject_entity_id, lower(subject_text)")
def alias_upsert(spark: SparkSession, folder: str) -> DataFrame:
    c = starschema.stored_tables(spark, folder, needed=("claims",)).claims
    text = F.when(F.col("id") % 3 == 0, F.upper("subject_text")).when(F.col("id") % 3 == 1, F.lower("subject_text")).otherwise(F.col("subject_text"))
    return project.latest_aliases(c.select(F.col("subject_entity_id").alias("entity_id"), text.alias("alias"), textnorm.normalize_alias(text).alias("normalized_alias"), F.col("id").alias("seq")))


@query(MODEL + """
    select knowledge_base_id, document_id, document_id // 2 as added_via_batch_id from m_members
    union all select 4, c_custkey, min(c_custkey % 10) from customer where (4, c_custkey) not in (select (knowledge_base_id, document_id) from m_members) group by c_custkey""")
def membership_insert(spark: SparkSession, folder: str) -> DataFrame:
    t = starschema.stored_tables(spark, folder, needed=("chunks", "documents"))
    added = t.documents.select(F.lit(4).cast("long").alias("knowledge_base_id"), F.col("id").alias("document_id"), F.explode(F.array(F.col("id") % 10, F.lit(10).cast("long"))).alias("added_via_batch_id"))
    return ingest.add_memberships(t.memberships, added)


@query(MODEL + """
    select knowledge_base_id, document_id, document_id // 2 as added_via_batch_id from m_members
    union all select 0, c_custkey, null from customer where (0, c_custkey) not in (select (knowledge_base_id, document_id) from m_members)""")
def default_enrol(spark: SparkSession, folder: str) -> DataFrame:
    t = starschema.stored_tables(spark, folder, needed=("chunks", "documents"))
    return ingest.enrol_all(t.memberships, t.documents, 0)


@query(MODEL + """
    , alive as (select * from m_relations where predicate <> 'INHIBITS' and subject_entity_id > 3)
    select 'relation' as kind, id from m_relations where predicate = 'INHIBITS' or subject_entity_id <= 3
    union all select 'entity', id from m_entities where id not in (select subject_entity_id from alive) and id not in (select object_entity_id from alive)""")
def orphan_prune(spark: SparkSession, folder: str) -> DataFrame:
    t = starschema.stored_tables(spark, folder, needed=("claims", "relations", "relation_evidence"))
    gone = t.relations.where("predicate = 'INHIBITS' or subject_entity_id <= 3").select(F.col("id").alias("relation_id"))
    relations, entities = browse.orphans(t.with_(relation_evidence=t.relation_evidence.join(gone, "relation_id", "left_anti")))
    return relations.select(F.lit("relation").alias("kind"), "id").unionByName(entities.select(F.lit("entity").alias("kind"), "id"))


@query(MODEL + f"""
    , kb as (select * from m_claims {_IN_KB}), p as (select *, {_PRINT} as claim_fingerprint from kb where id % 13 <> 0)
    select id, chunk_id, claim_fingerprint, predicate, cast(null as bigint) as failed from p qualify row_number() over (partition by chunk_id, claim_fingerprint order by id) = 1
    union all select null, null, null, null, count(*) from kb where id % 13 = 0""")
def rebuild_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Claims stored as JSON, one in thirteen of them with a confidence out of range."""
    t = starschema.stored_tables(spark, folder, needed=("claims",))
    projected, _, counts = project.rebuilt(project.read_stored(graph.scoped_claims(t, KB).select("id", "chunk_id", _stored().alias("claim_json"))))
    none = lambda kind: F.lit(None).cast(kind)
    failed = counts.select(none("long").alias("id"), none("long").alias("chunk_id"), none("string").alias("claim_fingerprint"), none("string").alias("predicate"), "failed")
    return projected.select("id", "chunk_id", "claim_fingerprint", "predicate", none("long").alias("failed")).unionByName(failed)


def _stored() -> F.Column:
    """Claims as JSON; one in thirteen has a confidence out of range."""
    side = lambda role: F.struct(F.col(f"{role}_text").alias("text"), F.lower(f"{role}_type").alias("type"))
    return F.to_json(F.struct(
        side("subject").alias("subject"), F.lower(F.replace("predicate", F.lit("_"), F.lit(" "))).alias("predicate"), side("object").alias("object"), F.struct(F.col("evidence_text").alias("sentence")).alias("evidence"),
        F.when(F.col("id") % 13 == 0, 7.5).otherwise(F.col("confidence")).alias("confidence"), "negated", "speculative",
    ))


@query()
def entity_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of parts: several identifiers to a name and names to an identifier. Held against a sequential run in the tests."""
    part = table(spark, folder, "part")
    identity = textnorm.entity_identity(F.col("p_name"), F.lit("Protein"), F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("BRAND:"), F.col("p_brand"))))
    mentions = part.select(F.col("p_partkey").alias("seq"), identity.alias("i")).select("seq", "i.*")
    assigned, entities = resolve.resolve_entities(mentions)
    return assigned.join(entities.select(F.col("id").alias("entity_id"), "canonical_key", "canonical_name", "normalized_id"), "entity_id")


@query()
def entity_resolution_batches(spark: SparkSession, folder: str) -> DataFrame:
    """As entity_resolution, in three batches that go on from the state of the one before."""
    part = table(spark, folder, "part")
    identity = textnorm.entity_identity(F.col("p_name"), F.lit("Protein"), F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("BRAND:"), F.col("p_brand"))))
    mentions = cut(part.select(F.col("p_partkey").alias("seq"), identity.alias("i")).select("seq", "i.*"))
    state = resolve.empty_state(spark, f"{shared_folder(spark)}/state-{uuid.uuid4().hex}", slots=16)
    third = mentions.agg(F.max("seq")).first()[0] // 3
    batch = F.least(F.floor(F.col("seq") / third), F.lit(2))
    assigned = [resolve.resolve_into(state, k, mentions.where(batch == k)) for k in range(3)]
    entities = state[1].read(state[1].latest()).select(F.col("id").alias("entity_id"), "canonical_key", "canonical_name", "normalized_id")
    return assigned[0].unionByName(assigned[1]).unionByName(assigned[2]).join(entities, "entity_id")


@query("""select event_id, '{"a":"}\\"","b":' || props || '}' as object from events""")
def first_json_object(spark: SparkSession, folder: str) -> DataFrame:
    answer = F.concat(F.lit('<think>{"no":1}</think>Here: ```json {"a":"}\\"","b":'), F.col("props"), F.lit("} and {more} ```"))
    return table(spark, folder, "events").select("event_id", claimjson.first_json_object(answer).alias("object"))


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Drug"), F.col("o_custkey"), F.when(key % 3 == 0, " does not inhibit").when(key % 3 == 1, " may bind to").otherwise(" activates"), F.lit(" Protein"), key % 97, F.lit(". Nothing else was seen."))
    return table(spark, folder, "orders").select(key.alias("id"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("section_title"), text.alias("text"))


_EXTRACTED = """
    select o_orderkey as chunk_id, o_custkey as document_id, 0 as position, 'Drug' || o_custkey as subject, case o_orderkey % 3 when 0 then 'inhibits' when 1 then 'binds to' else 'activates' end as predicate,
      'Protein' || (o_orderkey % 97) as object, 'Drug' || o_custkey || case o_orderkey % 3 when 0 then ' does not inhibit' when 1 then ' may bind to' else ' activates' end || ' Protein' || (o_orderkey % 97) || '.' as sentence,
      o_orderkey % 3 = 0 as negated, o_orderkey % 3 = 1 as speculative from orders"""


@query(_EXTRACTED)
def extract_claims(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("claim")
    return extract.extract(_passages(spark, folder)).select(
        "chunk_id", "document_id", "position", c["subject"]["text"].alias("subject"), c["predicate"].alias("predicate"), c["object"]["text"].alias("object"), c["evidence"]["sentence"].alias("sentence"),
        c["negated"].alias("negated"), c["speculative"].alias("speculative"),
    )


@query(f"with e as ({_EXTRACTED}) select chunk_id as document_id, upper(replace(predicate, ' ', '_')) as predicate, 'other|name:' || lower(subject) as subject_key, sentence as evidence_text, negated, speculative from e")
def incremental_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that arrive as files, a few files to a micro-batch."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = _passages(spark, folder).select(F.col("id").alias("document_id"), "text")
    rows.repartition(6, "document_id").write.parquet(f"{top}/in")
    incremental.ingest_stream(spark, f"{top}/in", "document_id long, text string", f"{top}/out", f"{top}/checkpoint", files_per_batch=3, slots=8).awaitTermination()
    return incremental.stored_claims(spark, f"{top}/out").select("document_id", "predicate", "subject_key", "evidence_text", "negated", "speculative")


@query(MODEL + f"""
    , i as ({_ITEMS})
    select i.batch_id, b.r_name as knowledge_base_name, i.position, i.filename, i.document_id, d.status as document_status, d.id is not null as known
    from i join region b on b.r_regionkey = i.batch_id % 5 left join m_documents d on d.id = i.document_id where i.batch_id = {DOC}""")
def batch_detail(spark: SparkSession, folder: str) -> DataFrame:
    """A batch with its items; whether a document is known comes as metadata by position."""
    t = starschema.stored_tables(spark, folder, needed=("chunks", "documents"))
    known = t.batch_items.where(F.col("batch_id") == DOC).select("position", F.col("document_id").isNotNull().alias("known"))
    header, items = browse.batch_detail(t, DOC, known)
    return header.select(F.col("id").alias("batch_id"), "knowledge_base_name").join(items, "batch_id").select("batch_id", "knowledge_base_name", "position", "filename", "document_id", "document_status", "known")


@query(MODEL + _ROLLED.format(f"select *, own_status as s from m_items where batch_id in (select batch_id from m_items where document_id = {DOC + 1})"))
def batches_of_document(spark: SparkSession, folder: str) -> DataFrame:
    t = starschema.stored_tables(spark, folder, needed=("chunks", "documents"))
    return status.batches_of_document(t.batches, t.batch_items, DOC + 1)


_INGESTED = """
    , h as (select *, case when error is null then sha256(content) end as sha256, octet_length(encode(content)) as n from v),
    d as (select sha256, arg_max(filename, position) as filename, min(position) as first from h where sha256 is not null group by sha256)
    select h.position, h.filename, h.n as size_bytes, h.error, case when h.error is not null then 'rejected' else 'queued' end as status, d.first + 1 as document_id, d.sha256 is not null as was_new_document, d.sha256 is not null as queued_for_processing
    from h left join d on d.sha256 = h.sha256"""


def _ingested(spark: SparkSession, folder: str, files: DataFrame, most_bytes: int) -> DataFrame:
    """files as one batch of uploads into an empty model."""
    empty = lambda name: spark.createDataFrame([], TABLES[name])
    bases = starschema.tables(spark, folder).knowledge_bases
    t = Tables(documents=empty("documents"), batches=empty("batches"), memberships=empty("memberships"), batch_items=empty("batch_items"), knowledge_bases=bases)
    now, batch, metadata = ingest.ingest_batch(t, files, KB, " uploads ", most_bytes=most_bytes, most_files=1 << 62)
    items = now.batch_items.where(F.col("batch_id") == batch).withColumn("position", F.col("position").cast("long"))
    return items.join(metadata, "position").select("position", "filename", "size_bytes", "error", "status", "document_id", "was_new_document", "queued_for_processing")


@query(_FILES + _INGESTED)
def ingest_batch(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, good and bad names and sizes among them: every one has an item, and a rejected one says why."""
    return _ingested(spark, folder, _files(spark, folder), 3000)


@query(_ALL_FILES + _INGESTED)
def ingest_batch_all(spark: SparkSession, folder: str) -> DataFrame:
    """All documents under accepted names and with the default limit."""
    return _ingested(spark, folder, _all_files(spark, folder), ingest.MOST_BYTES)


@query(f"""
    with e as ({_EXTRACTED})
    select 'other|name:' || lower(subject) as subject_key, upper(replace(predicate, ' ', '_')) as predicate, 'other|name:' || lower(object) as object_key, negated, speculative, count(*) as evidence_count, count(distinct document_id) as document_count
    from e group by all""")
def extract_to_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Passages through extraction, resolution and the upsert of relations and evidence."""
    claims = project.project_claims(extract.extract(_passages(spark, folder)).withColumn("id", F.col("chunk_id")))  # a passage has one claim
    made = assemble.claims_to_graph(cut(claims))
    side = lambda role: made.entities.select(F.col("id").alias(f"{role}_entity_id"), F.col("canonical_key").alias(f"{role}_key"))
    counts = made.relation_evidence.join(made.claims.select(F.col("id").alias("claim_id"), "document_id"), "claim_id").groupBy(F.col("relation_id").alias("id")).agg(F.count("*").alias("evidence_count"), F.countDistinct("document_id").alias("document_count"))
    rows = made.relations.join(counts, "id").join(side("subject"), "subject_entity_id").join(side("object"), "object_entity_id")
    return rows.select("subject_key", "predicate", "object_key", "negated", "speculative", "evidence_count", "document_count")


@query(MODEL + f"""
    , kb as (select * from m_claims {_IN_KB}), p as (select *, {_PRINT} as claim_fingerprint from kb where id % 13 <> 0),
    gone as (select id from p qualify row_number() over (partition by chunk_id, claim_fingerprint order by id) > 1)
    select relation_id, count(*) as evidence_count, sum(claim_id) as claims from m_evidence where claim_id not in (select id from gone) group by relation_id""")
def rebuild_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Relations and evidence after a knowledge base's stored claims are projected and resolved again; every entity and relation is found as it was."""
    t = starschema.stored_tables(spark, folder, needed=("claims", "relations", "relation_evidence"))
    t = t.with_(claims=t.claims.withColumn("claim_json", _stored()), entities=t.entities, aliases=t.aliases)
    now, _, _ = assemble.rebuild_graph(t, KB)
    rows = now.relation_evidence.join(now.relations.select(F.col("id").alias("relation_id")), "relation_id")
    return rows.groupBy("relation_id").agg(F.count("*").alias("evidence_count"), F.sum("claim_id").alias("claims"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
