"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter

import cases
import oracle
import pytest

from claimloom.llm import common, queries, spelling


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow(rows, letters, least):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and distance(w, v) == 1] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def found(docs, *limits):
    return [tuple(r) for r in spelling.variants(docs, "doc_id", "text", *limits).select("word", "form", "root", "n", "n_near", "form_n").collect()]


CHAIN = "abcdefgh " * 40 + "abcdefg " * 18 + "abcdef " * 8 + "abcde " * 3 + "abcdx " * 3 + "bacde " * 9 + "aabbcc abbbcc aabbcc abbbcc aabbcc abbbcc abbcc abbcc abbcc" + " éàüöß ÉàÜöß éàüöÿ" * 4 + " ab×cd ab÷cd" * 3


@pytest.mark.parametrize("limits", [(5, 3), (1, 1), (3, 2)])
def test_all_pairs_give_the_same(spark, limits):
    rows = [(a, b) for a, b in cases.texts() if b is None or len(b) < 9000] + [(1, CHAIN), (2, CHAIN.upper())]
    docs = spark.createDataFrame([(a, b, 7, "k") for a, b in rows], "doc_id long, text string, n long, word string")
    got = found(docs, *limits)
    assert len(got) == len(set(got)) and set(got) == slow(rows, *limits)


def test_a_chain_of_forms_ends_at_its_root(spark):
    docs = spark.createDataFrame([(1, CHAIN)], "doc_id long, text string")
    roots = {r[0]: r[2] for r in found(docs)}
    assert roots["abcde"] == roots["abcdef"] == roots["abcdefg"] == "abcdefgh" and roots["abcdefgh"] == "abcdefgh"


def test_edges(spark, monkeypatch):
    assert found(cases.empty(spark)) == []
    whole = set(found(cases.documents(spark)))
    assert whole == slow(cases.texts(), 5, 3)
    monkeypatch.setattr(spelling, "HELD", 3)  # counts that leave a task in many parts
    assert set(found(cases.documents(spark))) == whole


def test_query_and_sql(spark, small):
    got = queries.queries()["op11_symmetric_delete"](spark, small)
    assert oracle.difference(got, oracle.connect(small), spelling.ORACLE_SQL) is None


def test_words_are_never_broadcast(spark, monkeypatch):
    plans, cut = [], common.cut

    def seen(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, **options)

    monkeypatch.setattr(common, "cut", seen)
    out = spelling.variants(spark.createDataFrame([(1, CHAIN)], "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
