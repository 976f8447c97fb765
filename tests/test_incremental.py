"""State between batches: resolution in parts against one run, tables in slots, states of documents and chunks of a stream."""

import random

import oracle
import pytest
from pyspark.sql import functions as F

from claimloom.operators import browse, ingest, numbering, project, resolve
from claimloom.plans import queries
from claimloom.sources import pdfwriter, sections
from claimloom.sources.slots import SlotTable
from claimloom.streaming import incremental

MENTION = "seq long, canonical_key string, canonical_name string, entity_type string, normalized_id string, normalized_alias string"


def mentions(seed, n, names=7, identifiers=4):
    r = random.Random(seed)
    out = []
    for seq in range(1, n + 1):
        name, kind, external = f"n{r.randrange(names)}", r.choice(["Drug", "Drug", "Protein"]), r.choice([None, None, f"X:{r.randrange(identifiers)}", f"x:{r.randrange(identifiers)}"])
        key = f"{kind.lower()}|id:{external.lower()}" if external else f"{kind.lower()}|name:{name}"
        out.append((seq, key, name.upper() if r.random() < 0.3 else name, kind, external, name))
    return out


@pytest.mark.parametrize(("seed", "cuts"), [(1, (15, 40)), (2, (30,))])
def test_batches_give_what_one_run_gives(spark, tmp_path, seed, cuts):
    rows = mentions(seed, 60, names=40 if seed == 2 else 7)
    whole_assigned, whole_entities = resolve.resolve_entities(spark.createDataFrame(rows, MENTION))
    state, got, start = resolve.empty_state(spark, str(tmp_path), slots=4), [], 0
    for version, end in enumerate((*cuts, len(rows))):
        batch = spark.createDataFrame(rows[start:end], MENTION)
        if version == 1 and seed == 1:  # a batch that broke off, or is delivered twice, replaces what it did
            resolve.resolve_into(state, version, batch).collect()
        got += resolve.resolve_into(state, version, batch).collect()
        start = end
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole_assigned.select("seq", "entity_id").collect()))
    last = state[1].read(state[1].latest())
    columns = ["id", "canonical_key", "canonical_name", "entity_type", "normalized_id"]
    assert sorted(map(tuple, last.select(columns).collect()), key=repr) == sorted(map(tuple, whole_entities.select(columns).collect()), key=repr)
    spelled = {}
    for (seq, _, name, _, _, alias), entity in zip(rows, (e for _, e in sorted(map(tuple, got)))):
        spelled[entity, alias] = name
    assert {(r.id, a.normalized_alias): a.alias for r in last.collect() for a in r.aliases} == spelled


def test_a_run_of_equal_mentions_is_walked_once(spark):
    base = mentions(3, 12)
    rows = [(k + 1, *m[1:]) for k, m in enumerate(m for m in base for _ in range(5))]
    slow = {}
    state, by = resolve.Arrivals(), {}
    for seq, key, name, kind, external, alias in rows:
        by[seq] = state.resolve(seq, key, name, kind, external, alias)
    assigned, _ = resolve.resolve_entities(spark.createDataFrame(rows, MENTION))
    slow = {r.seq: r.entity_id for r in assigned.collect()}
    assert slow == by


def test_a_version_rewrites_the_slots_of_its_keys(spark, tmp_path):
    t = SlotTable(spark, str(tmp_path), "k long, v string", "k", slots=16)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    rows = [(k, f"a{k}") for k in range(100)]
    assert t.latest() == -1 and t.read(-1).count() == 0
    assert t.replace(0, frame(rows), keys(*range(100))) == 16
    assert t.replace(1, frame([(7, "b"), (7, "c")]), keys(7, 500)) <= 2  # a share of at most 2 in 16 is written again
    assert sorted(map(tuple, t.read(1).collect())) == sorted([r for r in rows if r[0] != 7] + [(7, "b"), (7, "c")])
    assert sorted(map(tuple, t.read(0).collect())) == rows and t.read_keys(1, keys(7, 8)).count() == 3
    t.replace(2, frame([]), keys(*range(100)))
    assert t.read(2).count() == 0 and t.latest() == 2 and t.latest(2) == 1


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, k) for k in range(1000)], "a long, b long")
    one, many = (numbering.numbered(df.repartition(n), ["a"], 5).select("seq", "a").collect() for n in (1, 13))
    assert sorted(one) == sorted(many) == [(k + 5, k) for k in range(1000)]
    assert numbering.numbered(df.limit(0), ["a"]).count() == 0


def stream(spark, top, rows, schema, extractor=None, **more):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{top}/in")
    args = {"extractor": extractor} if extractor else {}
    incremental.ingest_stream(spark, f"{top}/in", schema, f"{top}/out", f"{top}/cp", slots=4, **args, **more).awaitTermination()


def test_states_of_what_fails(spark, tmp_path):
    def service(asked):
        if "crash" in asked.rpartition("Passage:")[2]:
            raise TimeoutError("no answer in time")
        return "not JSON" if "bad" in asked.rpartition("Passage:")[2] else incremental.rule_extractor(asked)

    schema = "document_id long, content binary"
    file = lambda *pages: bytearray(pdfwriter.pdf_of([[p] for p in pages], 0))
    rows = [(1, file("Xa inhibits Yb.", "Xa inhibits Zc.")), (2, bytearray(b"junk")), (3, file("bad")), (4, file("bad one", "Xa activates Yb.")), (5, file("crash")), (6, file(" "))]
    stream(spark, tmp_path, rows, schema, service)
    out = f"{tmp_path}/out"
    states = lambda: {r.id: (r.status, r.error) for r in incremental.stored_documents(spark, out).collect()}
    invalid = incremental.extract.INVALID
    assert states() == {1: ("done", None), 2: ("failed", "the file is not a PDF"), 3: ("failed", invalid), 4: ("partial", invalid), 5: ("failed", "no answer in time"), 6: ("failed", sections.NO_SECTIONS)}
    assert {(r.document_id, r.chunk_index, r.status) for r in incremental.stored_chunks(spark, out).collect()} == {(1, 0, "done"), (1, 1, "done"), (3, 0, "failed"), (4, 0, "failed"), (4, 1, "done"), (5, 0, "failed")}
    assert sorted(r.document_id for r in incremental.stored_claims(spark, out).collect()) == [1, 1, 4]
    # a document that is parsed again in vain keeps its claims; one that is parsed loses the old ones; two versions in a batch count once
    stream(spark, tmp_path, [(1, bytearray(b"%PDF-")), (3, file("Xa inhibits Yb.")), (4, file("A0 inhibits B0.")), (4, file("A1 inhibits B1."))], schema, service)
    assert states()[1] == ("failed", "the file has no catalog") and states()[3] == ("done", None) and states()[4][0] == "done"
    assert sorted(r.document_id for r in incremental.stored_claims(spark, out).collect()) == [1, 1, 3, 4]


def test_a_stream_without_files_has_nothing(spark, tmp_path):
    spark.createDataFrame([], "document_id long, text string").write.parquet(f"{tmp_path}/in")
    incremental.ingest_stream(spark, f"{tmp_path}/in", "document_id long, text string", f"{tmp_path}/out", f"{tmp_path}/cp", slots=2).awaitTermination()
    out = f"{tmp_path}/out"
    assert incremental.stored_claims(spark, out).count() == incremental.stored_documents(spark, out).count() == incremental.stored_graph(spark, out, 2).relations.count() == 0


def test_hashed_relations_need_no_join(spark):
    r = random.Random(2)
    rows = [(k, 1 if k % 3 == 0 else r.randrange(4), "P", 2 if k % 3 == 0 else r.randrange(3), '{"a":1}' if k % 2 else '{"A":1}', "h", False, False) for k in range(300)]  # a third of all claims in one relation
    claims = spark.createDataFrame(rows, "id long, subject_entity_id long, predicate string, object_entity_id long, qualifiers string, qualifiers_hash string, negated boolean, speculative boolean")
    relations, evidence = project.hashed_relations(claims)
    plan = evidence._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    old, links = project.relations_of(claims)
    name = {x.id: tuple(x[c] for c in project.RELATION) for x in relations.collect()}
    want = {x.id: tuple(x[c] for c in project.RELATION) for x in old.collect()}
    assert len(name) == len(want) and {(name[x.relation_id], x.claim_id) for x in evidence.collect()} == {(want[x.relation_id], x.claim_id) for x in links.collect()}
    assert {tuple(x[c] for c in project.RELATION): x.qualifiers for x in relations.collect()} == {tuple(x[c] for c in project.RELATION): x.qualifiers for x in old.collect()}
    with pytest.raises(Exception, match="share the hash"):
        project.hashed_relations(claims, F.lit(1).cast("long"))[0].collect()


@pytest.mark.parametrize("name", ["processing_states", "processing_batches", "relation_upsert"])
def test_query_and_sql(spark, small, name):
    assert oracle.difference(queries.QUERIES[name](spark, small), oracle.connect(small), queries.SQL[name]) is None


def test_resolution_in_batches_is_that_of_one(spark, small):
    columns = ["seq", "entity_id", "canonical_key", "canonical_name", "normalized_id"]
    one, many = (sorted(map(tuple, queries.QUERIES[n](spark, small).select(columns).collect()), key=repr) for n in ("entity_resolution", "entity_resolution_batches"))
    assert one == many


def test_deep_pages_are_those_of_a_sort(spark, monkeypatch):
    df = spark.createDataFrame([(k * 37 % 500, k % 7) for k in range(500)], "id long, v long").repartition(7)
    order = [F.desc("v"), "id"]
    near = browse._page(df, order, 40, 230).collect()
    monkeypatch.setattr(browse, "NEAR", 100)
    page = browse._page(df, order, 40, 230)
    assert page.collect() == near and page.columns == ["id", "v"] and browse._page(df, order, 40, 490).count() == 10 and browse._page(df, order, 5, 1 << 40).count() == 0


def test_uploads_that_are_null_or_could_not_be_read(spark):
    files = spark.createDataFrame([(0, "a.pdf", None, None), (1, "b.pdf", bytearray(b"%PDF-1"), None), (2, "c.pdf", None, "disk error"), (3, "d.txt", bytearray(b"%PDF-1"), None)], "position long, filename string, content binary, read_error string")
    assert [bytes(r.content) for r in ingest.stored_contents(files).collect()] == [b"%PDF-1"] and ingest.stored_contents(files.drop("read_error")).count() == 1
    uploads = ingest.validate_uploads(files)
    documents = ingest.register_documents(spark.createDataFrame([], "id long, sha256 string, filename string, source_path string, status string, error string"), uploads)
    got = {r.position: (r.status, r.error) for r in ingest.batch_items(uploads, documents, 1).collect()}
    assert got == {0: ("rejected", "File is empty"), 1: ("queued", None), 2: ("failed", "disk error"), 3: ("rejected", "Only PDF files are supported")}
    assert tuple(ingest.upload_bytes(uploads).first()) == (12, 6) and tuple(ingest.upload_bytes(uploads.limit(0)).first()) == (0, 0)


def test_graphs_of_what_is_not_there_are_refused(spark, small):
    t = queries.starschema.tables(spark, small)
    for asked in (lambda: browse.knowledge_base_graph(t, 99), lambda: browse.document_graph(t, -5)):
        with pytest.raises(KeyError):
            asked()
    nodes, _, _ = browse.document_graph(t, queries.DOC, limit=3)
    assert nodes.count() <= 6
