"""Claims of answers are parsed once."""

from claimloom.operators import extract
from claimloom.streaming import incremental


def test_claims_are_parsed_once(spark):
    docs = spark.createDataFrame([(1, "Xa inhibits Yb. Xc may bind to Yd."), (2, "nothing"), (3, None)], "document_id long, text string")
    made = incremental.process(docs)
    assert "_bundles" not in made.claims._jdf.queryExecution().toString()  # claims come from what was written
    assert sorted((r.document_id, r.position, r.evidence_text, r.speculative) for r in made.claims.collect()) == [(1, 0, "Xa inhibits Yb.", False), (1, 1, "Xc may bind to Yd.", True)]
    parts = spark.createDataFrame([(1, 1, None, "Xa inhibits Yb."), (2, 1, None, "x")], "id long, document_id long, section_title string, text string")
    found = {r.chunk_id: r for r in extract.answers(parts, lambda q: "no" if q.endswith("x") else extract.rule_extractor(q)).collect()}
    assert found[1].valid and len(found[1].claims) == 1 and not found[2].valid and found[2].claims is None
