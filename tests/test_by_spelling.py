"""Mentions are resolved by their spellings; claims are parsed and projected in one pass."""

import json
import random

import oracle
import pytest
from pyspark.sql import functions as F

from claimloom.functions import claimjson, textnorm
from claimloom.operators import project, resolve
from claimloom.plans import queries

MENTION = "seq long, canonical_key string, canonical_name string, entity_type string, normalized_id string, normalized_alias string"
ENTITIES = "id long, canonical_key string, canonical_name string, entity_type string, normalized_id string"


def mention(seq, name, external=None, kind="Drug"):
    return seq, f"{kind.lower()}|" + (f"id:{external.lower()}" if external else f"name:{name.lower()}"), name, kind, external, name.lower()


def in_order(old, mentions, highest):
    """(entity by seq, entities) of mentions after old ones, one by one."""
    state, by = resolve.Arrivals(), {}
    for seq, key, name, kind, external, alias in old:
        by[seq] = state.resolve(seq, key, name, kind, external, alias)
    before = {i: dict(e) for i, e in state.entities.items()}
    owned = [(i, alias) for (_, alias), ids in state.owners.items() for i in ids]
    got = {m[0]: state.resolve(highest + m[0], *m[1:]) for m in mentions}
    return before, owned, got, state.entities


def resolved(spark, before, owned, mentions):
    entities = spark.createDataFrame([(i, *e.values()) for i, e in before.items()], ENTITIES)
    aliases = spark.createDataFrame([(i, a, a) for i, a in owned], "entity_id long, alias string, normalized_alias string")
    return resolve.resolve_mentions(spark.createDataFrame(mentions, MENTION), entities, aliases)


def test_mentions_that_find_old_entities_are_not_walked(spark):
    old = [mention(1, "A"), mention(2, "B", "X"), mention(3, "C", "Y"), mention(4, "D")]
    later = [mention(k, *[("a",), ("B",), ("b", "x"), ("C", "y"), ("d",)][k % 5]) for k in range(1, 60)]
    before, owned, want, _ = in_order(old, later, 4)
    made = resolved(spark, before, owned, later)
    assert made.several is None  # each is found by its key or its only owner
    df = spark.createDataFrame(later, MENTION)
    assert dict(map(tuple, made.of(df).collect())) == want
    assert {r.alias for r in made.spelled.where("normalized_alias = 'a'").collect()} == {"a"} and made.found.count() == 4


@pytest.mark.parametrize("seed", range(2))
def test_old_entities_and_new_mentions_are_resolved_in_order(spark, seed):
    r = random.Random(seed)
    any_of = lambda n, names: [mention(k, f"n{r.randrange(names)}", r.choice([None, None, None, f"I{r.randrange(25)}", f"i{r.randrange(25)}"]), r.choice(["Drug", "Drug", "Gene"])) for k in range(1, n + 1)]
    old, later = any_of(40, 30), any_of(120, 50)
    highest = max(in_order(old, [], 0)[0])
    before, owned, want, entities = in_order(old, later, highest)
    made = resolved(spark, before, owned, later)
    assert made.several is not None and not made.groups.isEmpty()
    assert dict(map(tuple, made.of(spark.createDataFrame(later, MENTION)).collect())) == want
    assert {tuple(x) for x in made.found.select("id", "canonical_key", "canonical_name", "entity_type", "normalized_id").collect()} == {(i, *e.values()) for i, e in entities.items()}


ODD = ["Aspirin", " ASPIRIN . ", "a–b", "ﬁx Å", "", "\"q\"", "x\x1fy", "ß", "cell-LINE", "id: 1"]


def test_one_pass_gives_the_single_forms(spark):
    r = random.Random(4)
    term = lambda: {"text": r.choice(ODD), "type": r.choice([None, "drug", "cell line", "Odd—kind"]), "normalized_id": r.choice([None, None, " CHEBI:1 ", ""])}
    bundle = [{"subject": term(), "predicate": r.choice(["binds to", "", "inhibits–x"]), "object": term(), "qualifiers": r.choice([{}, {"b": " x ", "a": None, "c": ["Q", None]}]), "evidence": {"sentence": r.choice(ODD)}, "confidence": 0.5, "negated": r.random() < 0.5} for _ in range(60)]
    stored = [(k, k % 7, json.dumps(c)) for k, c in enumerate(bundle)]
    claims = spark.createDataFrame(stored, "id long, chunk_id long, claim_json string")
    c = F.col("claim")
    parsed = claims.select("id", "chunk_id", F.element_at(claimjson.claims_of(F.concat(F.lit('{"claims":['), "claim_json", F.lit("]}"))), 1).alias("claim"))
    identity = lambda role: textnorm.entity_identity(c[role]["text"], c[role]["type"], c[role]["normalized_id"])
    single = parsed.select(
        "id", identity("subject").alias("subject"), identity("object").alias("object"), textnorm.normalize_predicate(c["predicate"]).alias("predicate"), claimjson.canonical_qualifiers(c["qualifiers"]).alias("qualifiers"),
        claimjson.qualifiers_hash(c["qualifiers"]).alias("qualifiers_hash"), textnorm.clean_text(c["evidence"]["sentence"], "").alias("evidence_text"), c["confidence"].cast("float").alias("confidence"), c["negated"].alias("negated"), c["speculative"].alias("speculative"),
        claimjson.claim_fingerprint(identity("subject")["canonical_key"], c["predicate"], identity("object")["canonical_key"], c["qualifiers"], c["evidence"]["sentence"], c["negated"], c["speculative"]).alias("claim_fingerprint"),
    )
    want = sorted(single.collect())
    assert sorted(project.project_claims(parsed).select(single.columns).collect()) == want
    assert sorted(project.read_stored(claims).select(single.columns).collect()) == want


def test_stored_claims_are_parsed_once(spark):
    claim = json.dumps({"subject": {"text": "a"}, "predicate": "p", "object": {"text": "b"}, "evidence": {"sentence": "s"}, "confidence": 1})
    rows = [(1, 5, claim), (2, 5, f"{claim},{claim}"), (3, 5, None), (4, 5, "{"), (5, 5, claim), (6, None, claim), (7, None, claim), (8, 6, claim)]
    read = project.read_stored(spark.createDataFrame(rows, "id long, chunk_id long, claim_json string"))
    good, failed, counts = project.rebuilt(read)
    assert "Python" not in good._jdf.queryExecution().executedPlan().toString() + failed._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in good.collect()) == [1, 6, 8] and tuple(counts.first()) == (5, 3)
    assert [tuple(r) for r in failed.collect()] == [(2, rows[1][2]), (3, None), (4, "{")]


@pytest.mark.parametrize("name", ["rebuild_graph", "rebuild_projection"])
def test_query_and_sql(spark, small, name):
    assert oracle.difference(queries.QUERIES[name](spark, small), oracle.connect(small), queries.SQL[name]) is None
