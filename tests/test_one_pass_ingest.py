"""Arriving texts: one pass of Python from chunk to projected claims, which are numbered where they lie."""

import json
import random

from pyspark.sql import functions as F

from claimloom.functions import claimjson
from claimloom.operators import chunking, extract, project, status
from claimloom.streaming import incremental

PARTS = ["{", "}", '"', "\\", "a", "<think>", "</THINK>", "<analysis>", "</analysis>", "```json ", "```", " ", "\n", "　", '{"claims": []}', '"x}"', ":", "1", ",", "\x85", "[", "]", "K"]


def test_the_json_in_an_answer_is_that_of_the_single_forms(spark):
    r = random.Random(7)
    texts = [None, "", *["".join(r.choices(PARTS, k=r.randint(0, 9))) for _ in range(3000)]]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = claimjson.first_json_object(F.col("t"))
    for row in df.select("t", found.alias("f"), claimjson.claims_of(found).isNotNull().alias("v")).collect():
        text, claims = claimjson.answered(row.t)
        assert (text, claims is not None) == (row.f, row.v), row.t
        assert claims == claimjson.validated_bundle(text)


def test_claims_are_projected_chosen_and_numbered_without_a_shuffle(spark):
    claim = lambda s, c: {"subject": {"text": s}, "predicate": "p", "object": {"text": "b"}, "evidence": {"sentence": "s"}, "confidence": c}

    def service(asked):
        words = asked.rpartition("\nPassage:\n")[2].split()
        return "no" if words[:1] == ["bad"] else json.dumps({"claims": [claim(w, k / 10) for k, w in enumerate(words)]})

    docs = spark.createDataFrame([(k * 37 % 100, "a B A c b" if k % 5 else "bad", ) for k in range(100)] + [(200, None), (201, " "), (202, "z " * 4000 + " " * 13000 + "y")], "document_id long, text string").repartition(5)
    made = incremental.process(docs, service)
    plan = made.claims._jdf.queryExecution().executedPlan().toString() + made.chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
    placed, n = incremental.placed_claims(made.answered)
    rows = sorted(placed.collect(), key=lambda x: x["_n"])
    assert [x["_n"] for x in rows] == [*range(n)] and [(x.document_id, x.chunk_index, x.position) for x in rows] == sorted((x.document_id, x.chunk_index, x.position) for x in rows)
    # what the separate steps give
    parts = chunking.number_chunks(chunking.split_into_chunks(docs.select("document_id", F.lit(0).alias("section_index"), F.lit("Body").alias("section_title"), "text"))).withColumn("id", F.xxhash64("document_id", "chunk_index"))
    found = extract.extract(parts, service).join(parts.select(F.col("id").alias("chunk_id"), "chunk_index"), "chunk_id").withColumn("id", F.xxhash64("document_id", "chunk_index", "position"))
    want = project.dedup_claims(project.project_claims(found).drop("claim"), "position")
    columns = ["id", "document_id", "chunk_id", "chunk_index", "position", "subject", "object", "predicate", "qualifiers", "qualifiers_hash", "evidence_text", "confidence", "negated", "speculative", "claim_fingerprint"]
    assert sorted(made.claims.select(columns).collect()) == sorted(want.select(columns).collect())
    assert {(x.id, x.chunk_index, x.text) for x in made.chunks.collect()} == {(x.id, x.chunk_index, x.text) for x in parts.collect()}
    states = {x.document_id: (x.status, x.error) for x in made.documents.collect()}
    assert states[0] == ("failed", extract.INVALID) and states[37] == ("done", None) and states[200] == ("failed", "No chunks were generated") and states[201][0] == "done"


def test_errors_of_a_document_are_in_the_order_of_ids(spark):
    chunks = spark.createDataFrame([(3, 1, "failed", "c"), (1, 1, "failed", "a"), (2, 1, "done", "x"), (4, 1, "failed", None), (5, 2, "failed", None), (6, 3, "done", None)], "id long, document_id long, status string, error string")
    got = {r.id: (r.status, r.error) for r in status.document_status(spark.range(1, 5), chunks).collect()}
    assert got == {1: ("partial", "a; c"), 2: ("failed", None), 3: ("done", None), 4: ("failed", "No chunks were generated")}
