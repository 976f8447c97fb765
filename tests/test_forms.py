"""Forms made in one pass against the single forms, over texts with blanks, dashes, case folds and characters that NFKC changes."""

import json
import random

from pyspark.sql import functions as F

from claimloom.functions import claimjson, textnorm
from claimloom.schemas import ENTITY_TYPES

PARTS = ["a", "B", "İ", "ß", "ﬁ", "Ⅷ", "é", "é", "–", "−", "-", "_", " ", " ", "　", "\x1c", "\x85", " ", "\n", "\t", ".", ";", '"', "'", "`", "\\", "/", "¨", "ẞ", "ς", "中", "\U0001d49c", "0", "²"]


def strings(n: int) -> list[str | None]:
    deal = random.Random(5)
    made = ["".join(deal.choices(PARTS, k=deal.randint(0, 8))) for _ in range(n)]
    return [None, "", " ", *PARTS, *made]


def test_identities_agree_with_the_single_forms(spark):
    texts, deal = strings(1500), random.Random(6)
    kinds = [None, "cell-LINE", "-drug-", " small--molecule", "_gene", "- -", *ENTITY_TYPES, *strings(300)]
    rows = [(t, deal.choice(kinds), deal.choice(texts)) for t in texts] + [("x", k, None) for k in kinds]
    df = spark.createDataFrame(rows, "t string, k string, x string").repartition(3)
    kind, external, alias = textnorm.normalize_entity_type(F.col("k")), textnorm.normalize_external_id(F.col("x")), textnorm.normalize_alias(F.col("t"))
    part = F.coalesce(F.concat(F.lit("id:"), textnorm.casefold(external)), F.concat(F.lit("name:"), alias))
    single = F.struct(F.concat(textnorm.casefold(kind), F.lit("|"), part).alias("canonical_key"), textnorm.clean_text(F.col("t")).alias("canonical_name"), kind.alias("entity_type"), external.alias("normalized_id"), alias.alias("normalized_alias"))
    got = df.select("t", "k", "x", textnorm.entity_identity(F.col("t"), F.col("k"), F.col("x")).alias("i"), single.alias("s"), textnorm.normalize_predicate(F.col("t")).alias("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.i == r.s, r
        assert r.p == textnorm.predicate_literal(r.t) and r.s.entity_type == textnorm.entity_type_literal(r.k)


def test_fingerprints_are_of_sorted_json(spark):
    texts = strings(200)
    rows = [(t, json.dumps({"b": t, "a": [None, {"k": t}], "n": None}), i % 2 == 0) for i, t in enumerate(texts)] + [("q", None, None)]
    df = spark.createDataFrame(rows, "t string, q string, b boolean")
    c = F.col
    made = claimjson.claim_fingerprint(c("t"), c("t"), F.lit('o"\\\n'), c("q"), c("t"), c("b"), F.lit(None).cast("boolean"))
    plain = {}
    for t, q, b in rows:
        value = {k: v for k, v in json.loads(q or "{}").items() if v is not None}
        if value:
            tidy = None if t is None else textnorm.tidy(t)
            value = {"a": [None, {} if tidy is None else {"k": tidy}]} | ({} if tidy is None else {"b": tidy})
        members = {"subject": t, "predicate": textnorm.predicate_literal(t), "object": 'o"\\\n', "qualifiers": value, "evidence": textnorm.alias_of(t), "negated": bool(b), "speculative": False}
        plain[(t, q, b)] = json.dumps(members, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    expected = spark.createDataFrame([(*k, v) for k, v in plain.items()], "t string, q string, b boolean, v string").select("t", "q", "b", F.sha2("v", 256)).collect()
    assert set(map(tuple, df.select("t", "q", "b", made).collect())) == set(map(tuple, expected))


def test_bundles_that_no_column_can_hold_are_invalid(spark):
    claim = {"subject": {"text": "a"}, "predicate": "p", "object": {"text": "b"}, "evidence": {"sentence": "s", "page": 7}, "confidence": 0.5}
    half = json.loads('"\\ud800"')
    wrong = [claim | {"predicate": half}, claim | {"qualifiers": {"k": half}}, claim | {"confidence": float("nan")}, *(claim | {"evidence": {"sentence": "s", "page": p}} for p in (1 << 31, float("inf"), half))]
    texts = [json.dumps({"claims": [claim]})] + [json.dumps({"claims": [claim, w]}) for w in wrong] + ['{"claims":[{"confidence":1' + "0" * 400 + "}]}", "[" * 100_000, None, '{"claims":[]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", claimjson.claims_of(F.col("t")).alias("c")).collect()}
    assert got[0][0].evidence.page == 7 and got[0][0].qualifiers == "{}" and got[len(texts) - 1] == []
    assert [i for i, c in got.items() if c is None] == list(range(1, len(texts) - 1))


def test_batches_are_cut_into_pieces():
    import pyarrow as pa

    from claimloom.sources.pieces import pieces

    texts = ["x" * n for n in (0, 5, 700, 3, 3, 900)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "text"])
    cut = list(pieces([batch, batch.slice(0, 0)], "text", 10, 3))
    assert [p.column("id").to_pylist() for p in cut] == [[0, 1], [2], [3, 4], [5], [6]]
    assert [x for p in cut for x in p.column("text").to_pylist()] == texts
    assert [p.num_rows for p in pieces([batch], "text", 1 << 20, 3)] == [3, 3, 1]
