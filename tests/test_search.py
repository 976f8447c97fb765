"""Substring search through trigrams against a scan, and replacement of what was extracted again."""

import oracle
import pytest

from claimloom.operators import assemble, browse, extract, search
from claimloom.plans import queries
from claimloom.sources import pdfwriter, starschema
from claimloom.sources.slots import SlotTable


@pytest.fixture(scope="module")
def model(spark, small):
    t = starschema.tables(spark, small)
    extra = spark.createDataFrame([(1, "Straße 100%_x", "straße 100%_x"), (2, "İstanbul ab", "i"), (3, "a", "a")], "entity_id long, alias string, normalized_alias string")
    return t.with_(aliases=t.aliases.unionByName(extra)).with_(**{n: getattr(t, n).cache() for n in ("entities", "claims")})


@pytest.fixture(scope="module")
def index(spark, model, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    first = search.TrigramIndex(spark, folder, slots=4)
    first.add(model.entities.where("id % 2 = 0"), model.aliases.where("entity_id % 2 = 0"))
    return first.add(model.entities.where("id % 2 = 1"), model.aliases.where("entity_id % 2 = 1"))


@pytest.mark.parametrize("query", ["the", "STRASSE", "straße", "chebi:1", "an%a", "ab", "%", "_he a%", "zzzz", "100%\\_", "i̇stan", "brass  "])
def test_an_index_changes_nothing(model, index, query):
    columns = ["id", "document_count", "evidence_count"]
    scan, found = (browse.entity_search(model, 1, query, limit=1000, index=i).select(columns).collect() for i in (None, index))
    assert scan == found


def test_only_rare_postings_are_read(model, index):
    assert index.needed("ab") is None and index.needed("a%b_c") is None and index.needed("x\\%abc") is None and set(index.needed("abcd%xyz")) == {"abc", "bcd", "xyz"}
    few = index.candidates("the promo")
    assert 0 < few.count() < model.entities.count() / 4 and index.candidates("qqqq").count() == 0
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "In(trigram" in plan or "trigram" in plan.split("PushedFilters")[1]


def test_query_and_sql(spark, small):
    assert oracle.difference(queries.QUERIES["entity_search_indexed"](spark, small), oracle.connect(small), queries.SQL["entity_search_indexed"]) is None
    for name in ("kb_stats", "kb_list"):
        assert oracle.difference(queries.QUERIES[name](spark, small), oracle.connect(small), queries.SQL[name]) is None


def test_one_chunk_extracted_again_rewrites_its_slot(spark, tmp_path):
    stored = SlotTable(spark, f"{tmp_path}/claims", "chunk_id long, document_id long, position int, claim_json string", "chunk_id", slots=16)
    chunk = "id long, document_id long, section_title string, text string"
    chunks = spark.createDataFrame([(k, k // 4, "S", f"Drug{k} inhibits Target{k}. Drug{k} activates Target{k}.") for k in range(80)], chunk)
    _, all_slots = assemble.extract_again(chunks, stored, 0)
    again = spark.createDataFrame([(7, 1, "S", "Drug7 activates Other7."), (8, 2, "S", "crash")], chunk)

    def service(asked):
        if asked.endswith("crash"):
            raise ValueError("no answer")
        return extract.rule_extractor(asked)

    for _ in range(2):  # delivered twice
        states, touched = assemble.extract_again(again, stored, 1, service)
        assert touched == 1 and all_slots == 16
        assert {r.id: (r.status, r.error) for r in states.collect()} == {7: ("done", None), 8: ("failed", "no answer")}
    rows = stored.read(1).collect()
    assert len(rows) == 159 and ["Other7" in r.claim_json for r in rows if r.chunk_id == 7] == [True] and sum(r.chunk_id == 8 for r in rows) == 2
    before = {(r.chunk_id, r.position, r.claim_json) for r in stored.read(0).collect() if r.chunk_id != 7}
    assert before == {(r.chunk_id, r.position, r.claim_json) for r in rows if r.chunk_id != 7}


def test_a_document_parsed_again_has_its_new_chunks_only(spark, tmp_path):
    chunks = SlotTable(spark, f"{tmp_path}/chunks", "id long, document_id long, chunk_index int, section_title string, text string, token_estimate int, status string", "document_id", slots=8)
    claims = SlotTable(spark, f"{tmp_path}/claims", "document_id long, claim_json string", "document_id", slots=8)
    claims.replace(0, spark.createDataFrame([(k, "{}") for k in range(20)], "document_id long, claim_json string"), spark.range(20).withColumnRenamed("id", "document_id"))
    file = lambda *pages: bytearray(pdfwriter.pdf_of([[p] for p in pages], 1))
    docs = lambda *rows: spark.createDataFrame(rows, "document_id long, content binary")
    assemble.parse_again(docs(*[(k, file("one", "two", f"three {k}")) for k in range(20)]), chunks, claims, 0)
    claims.replace(0, spark.createDataFrame([(k, "{}") for k in range(20)], "document_id long, claim_json string"), spark.range(20).withColumnRenamed("id", "document_id"))
    failed, touched = assemble.parse_again(docs((3, file("new")), (4, bytearray(b"junk"))), chunks, claims, 1)
    assert [tuple(r) for r in failed.collect()] == [(4, "the file is not a PDF")] and touched == 2
    now = chunks.read(1).collect()
    assert [(r.chunk_index, r.text, r.status) for r in now if r.document_id == 3] == [(0, "new", "queued")] and sum(r.document_id == 4 for r in now) == 3 and len(now) == 58
    assert sorted(r.document_id for r in claims.read(1).collect()) == [k for k in range(20) if k != 3]
