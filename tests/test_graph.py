"""The evidence graph: every query against its SQL, and what the star schema does not reach by small cases."""

import json
import random

import oracle
import pytest
from pyspark.sql import functions as F

from claimloom.functions import claimjson, textnorm
from claimloom.operators import browse, chunking, graph, ingest, project, resolve, status
from claimloom.plans import queries
from claimloom.sources import sections, starschema
from claimloom.streaming import incremental


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, small, name):
    assert oracle.difference(queries.QUERIES[name](spark, small), oracle.connect(small), queries.SQL[name]) is None


def values(spark, column, *texts, names=("a", "b", "c")):
    df = spark.createDataFrame(texts, ", ".join(f"{n} string" for n in names[: len(texts[0])]))
    return [r[0] for r in df.select(column).collect()]


def test_names_types_and_predicates(spark):
    key = textnorm.entity_identity(F.col("a"), F.col("b"), F.col("c"))["canonical_key"]
    one, two, three, four, five, met, prot = values(
        spark, key, ("  Aspirin ", "Drug", None), ("ASPIRIN", "drug", None), ("acetylsalicylic acid", "Drug", "CHEBI:15365"), ("Aspirin", "drug", "chebi:15365"), ("Straße.", None, " "), ("MET", "Gene", None), ("MET", "Protein", None)
    )
    assert one == two == "drug|name:aspirin" and three == four == "drug|id:chebi:15365" and met != prot and five == "other|name:strasse"
    assert values(spark, textnorm.normalize_predicate(F.col("a")), (" binds to ",), ("up-regulates",), ("α",), (None,), ("ﬁx–it",)) == ["BINDS_TO", "UP_REGULATES", "RELATED_TO", "RELATED_TO", "FIX_IT"]
    assert [textnorm.predicate_literal(x) for x in (" binds to ", "up-regulates", "α", "")] == ["BINDS_TO", "UP_REGULATES", "RELATED_TO", "RELATED_TO"]
    assert values(spark, textnorm.normalize_entity_type(F.col("a")), ("cell line",), ("CELL-LINE",), ("cellLine",), ("Odd Kind",), (None,)) == ["CellLine", "CellLine", "CellLine", "Odd Kind", "Other"]
    assert values(spark, textnorm.clean_text(F.col("a")), ("a\u3000\x1c b\u2212c",), ("\u00a0",), (None,)) == ["a b-c", "Unknown", "Unknown"]
    assert values(spark, textnorm.normalize_alias(F.col("a")), ("'A.B';",), ("...",)) == ["a.b", ""]


def test_qualifiers_and_fingerprints(spark):
    a, b = '{"unit":" nM ","value":"10","unused":null,"l":[null,{"x":null}]}', '{"l":[null,{}],"value":"10","unit":"NM"}'
    assert len(set(values(spark, claimjson.canonical_qualifiers(F.col("a")), (a,), (b,)))) == 2
    assert len(set(values(spark, claimjson.qualifiers_hash(F.col("a")), (a,), (b,)))) == 1
    assert values(spark, claimjson.canonical_qualifiers(F.col("a")), (None,), ('{"a":"","b":1e-05}',)) == ["{}", '{"a":"","b":1e-05}']
    made = claimjson.claim_fingerprint(F.lit("s"), F.lit("inhibits"), F.lit("o"), F.lit("{}"), F.col("a"), F.col("b").isNotNull(), F.lit(False))
    one, same, negated, other = values(spark, made, ("It does.", None), ("it DOES", None), ("It does.", "x"), ("It did.", None))
    assert one == same and len({one, negated, other}) == 3


def test_answers_become_claims(spark):
    got = values(spark, claimjson.first_json_object(F.col("a")), ('<THINK>{</THINK>```json\n{"a":"}"} tail```',), ("none",), ('x {"a":{"b":1}',), (None,))
    assert got == ['{"a":"}"}', "none", '{"a":{"b":1}', ""]
    claim = {"subject": {"text": "a"}, "predicate": "p", "object": {"text": "b"}, "evidence": {"sentence": "s"}, "confidence": "0.5", "negated": "true", "extra": 1}
    assert claimjson.validated_bundle(json.dumps({"claims": [claim]}))[0]["negated"] is True
    for wrong in ({"confidence": 2}, {"subject": {}}, {"predicate": 5}, {"qualifiers": []}):
        assert claimjson.validated_bundle(json.dumps({"claims": [claim, claim | wrong]})) is None
    assert claimjson.validated_bundle("{}") == [] and claimjson.validated_bundle("no") is None


@pytest.mark.parametrize("n", [0, 1, 12_000, 12_001, 22_400, 23_200, 23_201, 40_000])
def test_windows(spark, n):
    text = "".join(random.Random(n).choice("abcdef") for _ in range(n))
    starts = [0]
    while starts[-1] + 12_000 < n:
        starts.append(starts[-1] + 11_200)
    df = spark.createDataFrame([(1, 0, "t", f" {text}\n")], "document_id long, section_index int, section_title string, text string")
    got = chunking.number_chunks(chunking.split_into_chunks(df)).orderBy("chunk_index").collect()
    assert [r.text for r in got] == [text[s : s + 12_000] for s in starts] and [r.token_estimate for r in got] == [max(1, len(text[s : s + 12_000]) // 3) for s in starts]


def test_uploads(spark):
    files = [(0, "C:\\fakepath\\paper.pdf", b"%PDF-1.7 x"), (1, "../../paper.pdf", b"%PDF-1.7 x"), (2, "notes.txt", b"%PDF-1.7"), (3, "fake.pdf", b"not a PDF"), (4, "empty.pdf", b""), (5, "large.pdf", b"%PDF-" + bytes(2000))]
    df = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in files], "position long, filename string, content binary")
    got = {r.position: r for r in ingest.validate_uploads(df, 1024).collect()}
    assert got[0].filename == got[1].filename == "paper.pdf" and got[0].sha256 == got[1].sha256 and got[0].error is None
    assert [got[k].error for k in (2, 3, 4, 5)] == ["Only PDF files are supported", "File is not a valid PDF", "File is empty", "File exceeds the 1024 byte limit"]
    assert ingest.stored_contents(df, 1024).count() == 1


def test_ladders(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id long")
    chunks = spark.createDataFrame([(2, 9, "failed", "b"), (2, 3, "failed", "a"), (2, 4, "done", None)], "document_id long, id long, status string, error string")
    assert {r.id: (r.status, r.error) for r in status.document_status(docs, chunks).collect()} == {1: ("failed", "No chunks were generated"), 2: ("partial", "a; b")}
    batches = spark.createDataFrame([(k,) for k in range(1, 9)], "id long")
    items = {2: [None, "rejected"], 3: [1, "queued"], 4: [1, "queued", None, "rejected"], 5: [1, "done"], 6: [1, "done", None, "rejected"], 7: [1, "failed"], 8: [1, "extracting"]}
    rows = [(k, v[i], v[i + 1]) for k, v in items.items() for i in range(0, len(v), 2)]
    got = status.batch_status(batches, spark.createDataFrame(rows, "batch_id long, document_id long, status string"))
    assert [r.status for r in got.orderBy("id").collect()] == ["failed", "failed", "queued", "processing", "done", "partial", "failed", "processing"]


def in_order(mentions):
    """The rule of resolution as one plain sequence."""
    entities, aliases, out = [], {}, []
    for seq, key, name, kind, external, alias in mentions:
        hit = next((e for e in entities if e["key"] == key), None)
        if hit is None:
            owners = [e for e in entities if e["kind"] == kind and alias in aliases[e["id"]]]
            if len(owners) == 1 and (external is None or owners[0]["external"] is None or owners[0]["external"].lower() == external.lower()):
                hit = owners[0]
                if external is not None and hit["external"] is None:
                    hit.update(key=key, external=external)
        elif external is not None and hit["external"] is None:
            hit["external"] = external
        if hit is None:
            hit = {"id": seq, "key": key, "name": name, "kind": kind, "external": external}
            entities.append(hit)
            aliases[seq] = set()
        aliases[hit["id"]].add(alias)
        out.append((seq, hit["id"]))
    return out, {(e["id"], e["key"], e["name"], e["kind"], e["external"]) for e in entities}


MENTION = "seq long, canonical_key string, canonical_name string, entity_type string, normalized_id string, normalized_alias string"


def mention(seq, name, external=None, kind="Drug"):
    return seq, f"{kind.lower()}|" + (f"id:{external.lower()}" if external else f"name:{name.lower()}"), name, kind, external, name.lower()


@pytest.mark.parametrize("seed", range(3))
def test_resolution_is_that_of_a_sequence(spark, seed):
    r = random.Random(seed)
    rows = [mention(1, "A1"), mention(2, "A2"), mention(3, "A1", "X"), mention(4, "A2", "X"), mention(5, "a2"), mention(6, "B", "Y"), mention(7, "B", "Z"), mention(8, "b"), mention(9, "B")]
    rows += [mention(10 + k, f"n{r.randrange(40)}", r.choice([None, None, None, "I", "j"]) and f"I{r.randrange(30)}", r.choice(["Drug", "drug", "Gene"])) for k in range(400)]
    want, entities = in_order(rows)
    df = spark.createDataFrame(rows, MENTION)
    assigned, found = resolve.resolve_entities(df)
    assert sorted(map(tuple, assigned.select("seq", "entity_id").collect())) == want
    assert {tuple(x) for x in found.select("id", "canonical_key", "canonical_name", "entity_type", "normalized_id").collect()} == entities


def test_resolution_goes_on_from_a_state(spark):
    first = [mention(1, "A"), mention(2, "B", "X"), mention(3, "C")]
    later = [mention(1, "a", "Q"), mention(2, "b"), mention(3, "D")]
    assigned, entities = resolve.resolve_entities(spark.createDataFrame(first, MENTION))
    aliases = assigned.join(spark.createDataFrame(first, MENTION).select("seq", "normalized_alias"), "seq").drop("seq")
    again, now = resolve.resolve_entities(spark.createDataFrame(later, MENTION), entities, aliases)
    assert dict(map(tuple, again.select("seq", "entity_id").collect())) == {1: 1, 2: 2, 3: 6}
    assert {r.id: r.normalized_id for r in now.collect()} == {1: "Q", 2: "X", 3: None, 6: None}


def test_bounds_and_scopes(spark, small):
    t = starschema.tables(spark, small)
    for wrong in ({"limit": 0}, {"limit": 2001}, {"min_document_count": 0}):
        with pytest.raises(ValueError):
            graph.edges(t, 1, **wrong)
    with pytest.raises(ValueError):
        graph.scoped_claims(t, 1, 2)
    with pytest.raises(ValueError):
        graph.scoped_claims(t)
    with pytest.raises(KeyError):
        browse.knowledge_base_stats(t, 99)
    nodes, edges, summary = graph.graph(t, document_id=-1)
    assert (nodes.count(), edges.count(), tuple(summary.first())) == (0, 0, (0, 0, 0))


def test_graph_with_samples(spark, small):
    t = starschema.tables(spark, small)
    _, edges, _ = graph.graph(t, 1, limit=5, evidence_limit=2)
    for e in edges.collect():
        assert 1 <= len(e.evidence_samples) <= 2 and e.evidence == e.evidence_samples[0].sentence and e.label == e.predicate and e.width == min(8, 1 + e.document_count)
    plan = edges._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_knowledge_bases_can_be_made(spark, small):
    kbs = starschema.tables(spark, small).knowledge_bases
    made = ingest.create_knowledge_base(kbs, "  New ", " ")
    row = made.where("name = 'New'").first()
    assert made.count() == kbs.count() + 1 and row.description is None
    with pytest.raises(ValueError):
        ingest.create_knowledge_base(kbs, "  ")


def test_sections_fall_back(spark):
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><p>{}</p><div><head>In</head><p>{}</p></div></div></body></text></TEI>'
    rows = [(1, tei.format("x" * 80, "y" * 81)), (2, "one\f\ftwo"), (3, tei.format("short", "short")), (4, None)]
    df = spark.createDataFrame([(a, None if b is None else bytearray(b.encode())) for a, b in rows], "document_id long, content binary")
    got = sorted(((r.document_id, r.section_title, r.error is not None) for r in sections.parse(df, fallback=sections.page_sections).collect()), key=repr)
    assert got == [(1, "In", False), (2, "Page 1", False), (2, "Page 3", False), (3, None, True), (4, None, True)]


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    docs = [(k, f"Drug{k} inhibits Target{k % 3}. Drug{k} inhibits Target{k % 3}.") for k in range(20)]
    df = spark.createDataFrame(docs, "document_id long, text string")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        incremental.ingest_stream(spark, f"{tmp_path}/in", "document_id long, text string", f"{tmp_path}/out", f"{tmp_path}/cp", files_per_batch=2).awaitTermination()
    stored = incremental.stored_claims(spark, f"{tmp_path}/out")
    columns = ["document_id", "predicate", "evidence_text", "claim_fingerprint"]
    assert sorted(stored.select(columns).collect()) == sorted(incremental.claims_of_documents(df).select(columns).collect()) and stored.count() == 20


def test_replacing_is_idempotent(spark):
    old, new = (spark.createDataFrame(r, "document_id long, v int") for r in ([(1, 1), (1, 2), (2, 3)], [(1, 9)]))
    once = project.replace_rows(old, new, "document_id")
    assert sorted(map(tuple, project.replace_rows(once, new, "document_id").collect())) == [(1, 9), (2, 3)]
