"""Benchmark passages in documents that are kept."""

import cases

from claimloom.llm import decontaminate


def test_spans_are_cut_out_of_kept_documents(spark):
    item = [f"q{i}" for i in range(40)]
    body = cases.prose(4, 3000)
    rows = [
        (1, " ".join(body[:1500] + item + body[1500:]) + "."), (2, " ".join(body[:100] + item)), (3, " ".join(body[:900] + item[:20] + item[:20] + item[20:] + body[900:])), (4, "é, " * 50 + "(" + " ".join(body) + ") " + ", ".join(item).upper() + "!"),
        (5, " ".join(body + ["tiny", "item"])), (6, None), (7, ""),
    ]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "tiny item")], "item_id long, text string")
    cleaned = decontaminate.clean_documents(docs, items)
    assert cleaned.columns == docs.columns
    got = {r.doc_id: r.text for r in cleaned.collect()}
    whole = " ".join(body)
    assert {i: t and " ".join(t.split()) for i, t in got.items() if i != 4} == {1: whole + ".", 3: whole, 5: whole + " tiny item", 6: None, 7: ""}
    assert got[4] == "é, " * 50 + "(" + whole + ") !"
    assert all(s.last - s.first < 12 for r in decontaminate.score(cleaned, items).collect() for s in r.spans)
