"""Repeated passages against brute force over all 50-byte strings, for several ways of cutting the work."""

import random

import cases
import oracle
import pytest

from claimloom.llm import phrases, queries


def slow(rows):
    rows = [(doc, (text or "").encode()) for doc, text in rows]
    order = lambda doc: (1 << 63) - 1 if doc is None else doc
    first = {}
    for doc, text in rows:
        for i in range(len(text) - 49):
            w = text[i : i + 50]
            first[w] = min(first.get(w, order(doc)), order(doc))
    out = []
    for doc, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - 49):
            if first[text[i : i + 50]] < order(doc):
                gone[i : i + 50] = b"\1" * 50
        spans = [(i, next((j for j in range(i, len(gone)) if not gone[j]), len(gone))) for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])]
        out.append((doc, len(text), tuple(spans), bytes(b for b, g in zip(text, gone) if not g)))
    return sorted(out, key=repr)


def found(docs, **sizes):
    got = phrases.without_repeats(docs, sizes=phrases.Sizes(**sizes))
    rows = [(r.doc_id, r.n_bytes, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in got.collect()]
    phrases.release_tables(got)
    return sorted(rows, key=repr)


def corpus():
    """Copies, passages in changing surroundings, runs of one byte, nulls, and texts of zero bytes."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abé0") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(30), text(14), "x" * 70, "ab" * 45, "\0" * 60 + "end", text(200)]
    rows = [(None, None), (3, ""), (4, "a" * 49), (5, "a" * 50), (2, "a" * 51), (6, "a" * 3000), (None, "a" * 80)]
    for doc in range(10, 60):
        rows.append((doc - 30, text(r.randint(0, 20)) + r.choice(passages) + text(r.randint(0, 20)) + r.choice(passages)[r.randint(0, 20) :] + text(3)))
    return rows + [rows[-1], (rows[-1][0], rows[-2][1]), (900, rows[-1][1]), (-7, passages[5][3:160])]


@pytest.mark.parametrize("sizes", [{}, {"part": 700, "step": 300, "bucket": 1500, "gather": 2000}, {"part": 900, "step": 60, "bucket": 2000, "contents": 0}, {"part": 4000, "bucket": 6000, "contents": 1, "gather": 1}])
def test_every_string_gives_the_same(spark, sizes):
    rows = corpus()
    docs = spark.createDataFrame([(a, b, 1, "p") for a, b in rows], "doc_id long, text string, part long, spans string").repartition(3)
    assert found(docs, **sizes) == slow(rows)


def test_edges(spark):
    assert found(cases.empty(spark)) == []
    rows = [(a, b) for a, b in cases.texts() if b is None or len(b) < 6000]
    docs = spark.createDataFrame([(a, b, 7, 7, "h", "row", "key", 7, True) for a, b in rows], cases.SCHEMA)
    assert found(docs) == slow(rows)


def test_a_long_text_is_parsed_in_steps(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh ") for _ in range(3_500_000))
    at = 1_048_500  # over the border of two steps
    docs = spark.createDataFrame([(1, "x" + long[at : at + 400] + "y"), (2, long)], "doc_id long, text string")
    (_, _, _, _), (_, n, spans, kept) = found(docs)
    assert n == len(long) and spans == ((at, at + 400),) and kept == (long[:at] + long[at + 400 :]).encode()


def test_query_and_sql(spark, small):
    got = queries.queries()["op12_prefix_free_parsing"](spark, small)
    assert oracle.difference(got, oracle.connect(small), phrases.ORACLE_SQL) is None
