"""Qualifiers in canonical JSON, fingerprints, and the JSON that extractors return."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache
from json.encoder import encode_basestring
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

from claimloom.functions import textnorm


def _walk(value: Any, on_text: Callable[[str], str], drop_null: bool) -> Any:
    """Rebuild a JSON value with its texts changed; null members of objects go if asked, nulls in lists stay."""
    match value:
        case str():
            return on_text(value)
        case dict():
            return {k: _walk(v, on_text, drop_null) for k, v in value.items() if v is not None or not drop_null}
        case list():
            return [_walk(v, on_text, drop_null) for v in value]
    return value


_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def dumps(value: Any) -> str:
    return _ENCODER.encode(value)


def _parsed(text: str | None) -> dict:
    return (json.loads(text) if text else None) or {}


@lru_cache(1 << 14)
def _canonical(text: str | None) -> str:
    return dumps(_walk(_parsed(text), textnorm.tidy, True))


@lru_cache(1 << 14)
def _caseless(text: str | None) -> str:
    return dumps(_walk(_walk(_parsed(text), textnorm.tidy, True), str.casefold, False))


@F.arrow_udf(StringType())
def canonical_qualifiers(s: pa.Array) -> pa.Array:
    """Sorted keys, cleaned texts, no null members; {} for null."""
    return pa.array(map(_canonical, s.to_pylist()), pa.string())


@F.arrow_udf(StringType())
def _folded(s: pa.Array) -> pa.Array:
    return pa.array(map(_caseless, s.to_pylist()), pa.string())


def qualifiers_hash(c: Column) -> Column:
    """Equal for qualifiers that differ in key order, null members, spacing or the case of texts."""
    return F.sha2(_folded(c), 256)


def _claim_text(subject: str | None, predicate: str | None, object_: str | None, qualifiers: str | None, alias: str, negated: bool, speculative: bool) -> str:
    """A claim as JSON with sorted keys, as dumps would write it; alias: its evidence as an alias."""
    text = lambda x: "null" if x is None else encode_basestring(x)
    yes = lambda x: "true" if x else "false"
    return (
        f'{{"evidence":{text(alias)},"negated":{yes(negated)},"object":{text(object_)},"predicate":{_predicate(predicate)},'
        f'"qualifiers":{_canonical(qualifiers)},"speculative":{yes(speculative)},"subject":{text(subject)}}}'
    )


@lru_cache(1 << 14)
def _predicate(predicate: str | None) -> str:
    return encode_basestring(textnorm.predicate_literal(predicate))


@F.arrow_udf(StringType())
def _payload(subject: pa.Array, predicate: pa.Array, object_: pa.Array, qualifiers: pa.Array, evidence: pa.Array, negated: pa.Array, speculative: pa.Array) -> pa.Array:
    aliases = map(textnorm.alias_of, values(evidence))
    return pa.array(map(_claim_text, *map(values, (subject, predicate, object_, qualifiers)), aliases, *map(values, (negated, speculative))), pa.string())


def claim_fingerprint(subject_key: Column, predicate: Column, object_key: Column, qualifiers: Column, evidence: Column, negated: Column, speculative: Column) -> Column:
    """Keeps the case of qualifiers, unlike their hash; evidence counts as an alias does."""
    no = F.lit(False)
    return F.sha2(_payload(subject_key, predicate, object_key, qualifiers, evidence, F.coalesce(negated, no), F.coalesce(speculative, no)), 256)


def values(c: pa.Array) -> list:
    """The values of an array, as to_pylist gives them, without an object between for each."""
    return c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(c.type) else c.to_pylist()


def remove_thinking(c: Column) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", "")
    return F.regexp_replace(F.regexp_replace(s, r"(?is)<analysis>.*?</analysis>", ""), f"^{textnorm.BLANK}+|{textnorm.BLANK}+$", "")


_THOUGHTS = re.compile(r"<think>.*?</think>", re.I | re.S | re.A), re.compile(r"<analysis>.*?</analysis>", re.I | re.S | re.A)
_BRACES = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def _first_object(text: str | None) -> str:
    """From the first brace to the one that closes it; braces inside strings do not count. Without an end, the rest."""
    text = text or ""
    if "```" in text:
        for fence in (r"(?i)^```json\s*", r"^```\s*", r"\s*```$"):
            text = re.sub(fence, "", text)
    start, depth = text.find("{"), 0
    if start < 0:
        return text.strip()
    for m in _BRACES.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            return text[start : m.end()]
    return text[start:].strip()


_DECODER = json.JSONDecoder()


def answered(answer: str | None) -> tuple[str, list[dict] | None]:
    """(first_json_object, validated_bundle of it) for one text. Where JSON begins with the first brace, it is parsed once, and ends where that brace is closed."""
    text = answer or ""
    if "<" in text:
        for thought in _THOUGHTS:
            text = thought.sub("", text)
    text = text.strip(textnorm.BLANK_CHARS)
    start = text.find("{")
    if start >= 0 and "```" not in text:
        try:
            data, end = _DECODER.raw_decode(text, start)
        except (ValueError, RecursionError):
            pass
        else:
            return text[start:end], _validated(data)
    found = _first_object(text)
    return found, validated_bundle(found)


@F.arrow_udf(StringType())
def _first_objects(s: pa.Array) -> pa.Array:
    return pa.array(map(_first_object, s.to_pylist()), pa.string())


def first_json_object(c: Column) -> Column:
    return _first_objects(remove_thinking(c))


def _text(value: Any, needed: bool) -> str | None:
    if isinstance(value, str):
        if not value.isascii():
            value.encode()  # raises for half of a surrogate pair, which no column can hold
        return value
    if value is None and not needed:
        return value
    raise ValueError("text expected")


def _boolean(value: Any) -> bool:
    if value is True or value is False:
        return value
    if isinstance(value, str):
        value = value.strip().lower()
    if value in (True, 1, "true", "1", "yes", "y", "on", "t"):
        return True
    if value in (False, 0, "false", "0", "no", "n", "off", "f"):
        return False
    raise ValueError("boolean expected")


def _entity(value: Any) -> dict:
    return {"text": _text(value["text"], True), "type": _text(value.get("type"), False), "normalized_id": _text(value.get("normalized_id"), False)}


def validated_claim(value: dict) -> dict:
    """A claim with defaults filled in; raises where a field is missing or of another kind."""
    evidence, qualifiers = value["evidence"], value.get("qualifiers", {})
    if not isinstance(qualifiers, dict):
        raise ValueError("object expected")
    confidence = float(value["confidence"])
    if not 0 <= confidence <= 1:
        raise ValueError("confidence out of range")
    page = None if evidence.get("page") is None else int(evidence["page"])
    if page is not None and not -(1 << 31) <= page < 1 << 31:
        raise ValueError("page out of range")
    return {
        "subject": _entity(value["subject"]), "predicate": _text(value["predicate"], True), "object": _entity(value["object"]), "qualifiers": _text(dumps(qualifiers), True) if qualifiers else "{}",
        "evidence": {"section": _text(evidence.get("section"), False), "sentence": _text(evidence["sentence"], True), "page": page, "table_or_figure": _text(evidence.get("table_or_figure"), False)},
        "confidence": confidence, "negated": _boolean(value.get("negated", False)), "speculative": _boolean(value.get("speculative", False)),
    }


def validated_bundle(text: str | None) -> list[dict] | None:
    """The claims of a bundle; None if it is no JSON or any claim is invalid (the bundle counts as a whole)."""
    try:
        data = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    return _validated(data)


def _validated(data: Any) -> list[dict] | None:
    try:
        claims = data.get("claims", [])
        return [validated_claim(c) for c in claims] if isinstance(claims, list) else None
    except (ValueError, KeyError, TypeError, AttributeError, OverflowError, RecursionError):
        return None


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_STRING, _ENTITY = StringType(), _struct(text=StringType(), type=StringType(), normalized_id=StringType())
#: The type of a validated claim; qualifiers are JSON text, since their values may be of any kind.
CLAIM = _struct(
    subject=_ENTITY, predicate=_STRING, object=_ENTITY, qualifiers=_STRING, evidence=_struct(section=_STRING, sentence=_STRING, page=IntegerType(), table_or_figure=_STRING),
    confidence=DoubleType(), negated=BooleanType(), speculative=BooleanType(),
)


@F.arrow_udf(ArrayType(CLAIM))
def _bundles(s: pa.Array) -> pa.Array:
    return pa.array(map(validated_bundle, s.to_pylist()), to_arrow_type(ArrayType(CLAIM)))


def claims_of(c: Column) -> Column:
    """The validated claims of a bundle's JSON; null where it is invalid."""
    return _bundles(c)


_TEXTS = ("canonical_key", "canonical_name", "entity_type", "normalized_id", "normalized_alias")
#: What a claim is stored as: identities of its ends, predicate, qualifiers, their caseless form, evidence, and the text of its fingerprint.
_PROJECTION = _struct(subject=_struct(**dict.fromkeys(_TEXTS, _STRING)), object=_struct(**dict.fromkeys(_TEXTS, _STRING)), **dict.fromkeys(("predicate", "qualifiers", "folded", "evidence_text", "payload"), _STRING))
_STORED_CLAIM = StructType([*_PROJECTION, StructField("confidence", DoubleType()), StructField("negated", BooleanType()), StructField("speculative", BooleanType()), StructField("readable", BooleanType())])


def projected(subject: tuple, predicate: str | None, object_: tuple, qualifiers: str | None, sentence: str | None, negated: bool | None, speculative: bool | None) -> tuple:
    """A claim's projection as one flat row of texts; ends are (text, type, normalized_id)."""
    s, o = textnorm.identity_of(*subject), textnorm.identity_of(*object_)
    evidence = textnorm.tidy(sentence or "")
    payload = _claim_text(s[0], predicate, o[0], qualifiers, textnorm.alias_of_tidy(evidence), negated, speculative)
    return (*s, *o, textnorm.predicate_literal(predicate), _canonical(qualifiers), _caseless(qualifiers), evidence, payload)


def projected_claim(claim: dict) -> tuple:
    """projected() of a validated claim."""
    s, o = claim["subject"], claim["object"]
    ends = (s["text"], s["type"], s["normalized_id"]), (o["text"], o["type"], o["normalized_id"])
    return projected(ends[0], claim["predicate"], ends[1], claim["qualifiers"], claim["evidence"]["sentence"], claim["negated"], claim["speculative"])


def projection_arrays(rows: list[tuple]) -> list[pa.Array]:
    """The columns of _PROJECTION from rows of projected()."""
    texts = [pa.array(c, pa.string()) for c in zip(*rows)] or [pa.array([], pa.string())] * 15
    ends = [pa.StructArray.from_arrays(texts[k : k + 5], names=list(_TEXTS)) for k in (0, 5)]
    return [*ends, *texts[10:]]


#: A claim of a chunk that is kept: the places in its answer that it comes from, first and last (position), its projection, and the last one's values.
KEPT = StructType([StructField("position", IntegerType()), StructField("first", IntegerType()), *_PROJECTION, *[StructField(c, k) for c, k in (("confidence", DoubleType()), ("negated", BooleanType()), ("speculative", BooleanType()))]])


def kept_claims(bundles: list[list[dict] | None]) -> pa.ListArray:
    """The projected claims of answers, one list (of KEPT) for each; of claims of an answer with one fingerprint the last stays, in its place. Null is an empty list."""
    rows, places, scores, ends = [], [], [], [0]
    for bundle in bundles:
        kept: dict[str, tuple[int, int, tuple]] = {}
        for k, claim in enumerate(bundle or ()):
            row = projected_claim(claim)
            first = kept.pop(row[-1], (k,))[0]
            kept[row[-1]] = first, k, row
        for first, k, row in kept.values():  # by the last place
            claim = bundle[k]
            rows.append(row)
            places.append((k, first))
            scores.append((claim["confidence"], claim["negated"], claim["speculative"]))
        ends.append(len(rows))
    column = lambda rows, k, kind: pa.array([r[k] for r in rows], kind)
    numbers = [column(places, k, pa.int32()) for k in (0, 1)]
    claims = pa.StructArray.from_arrays([*numbers, *projection_arrays(rows), *[column(scores, k, t) for k, t in enumerate((pa.float64(), pa.bool_(), pa.bool_()))]], names=KEPT.names)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), claims)


@F.arrow_udf(_PROJECTION)
def _projections(st: pa.Array, sk: pa.Array, si: pa.Array, predicate: pa.Array, ot: pa.Array, ok: pa.Array, oi: pa.Array, qualifiers: pa.Array, sentence: pa.Array, negated: pa.Array, speculative: pa.Array) -> pa.Array:
    ends = zip(*map(values, (st, sk, si))), zip(*map(values, (ot, ok, oi)))
    rows = list(map(projected, ends[0], values(predicate), ends[1], *map(values, (qualifiers, sentence, negated, speculative))))
    return pa.StructArray.from_arrays(projection_arrays(rows), names=_PROJECTION.names)


def projection(c: Column) -> Column:
    """struct (subject, object, predicate, qualifiers, folded, evidence_text, payload) of a validated claim, in one pass; tests hold it to the single forms."""
    end = lambda role: [c[role][x] for x in ("text", "type", "normalized_id")]
    return _projections(*end("subject"), c["predicate"], *end("object"), c["qualifiers"], c["evidence"]["sentence"], c["negated"], c["speculative"])


_NO_CLAIM = (None,) * 15


@F.arrow_udf(_STORED_CLAIM)
def _stored_claims(s: pa.Array) -> pa.Array:
    rows, confidence, negated, speculative = [], [], [], []
    for text in values(s):
        bundle = validated_bundle(f'{{"claims":[{text or ""}]}}')
        claim = bundle[0] if bundle is not None and len(bundle) == 1 else None
        rows.append(_NO_CLAIM if claim is None else projected_claim(claim))
        for column, name in ((confidence, "confidence"), (negated, "negated"), (speculative, "speculative")):
            column.append(None if claim is None else claim[name])
    readable = pc.is_valid(pa.array(negated, pa.bool_()))
    return pa.StructArray.from_arrays([*projection_arrays(rows), pa.array(confidence, pa.float64()), pa.array(negated, pa.bool_()), pa.array(speculative, pa.bool_()), readable], names=_STORED_CLAIM.names)


def stored_claim(claim_json: Column) -> Column:
    """projection() of a stored claim's JSON with confidence, negated, speculative, and readable: is it the JSON of one valid claim?"""
    return _stored_claims(claim_json)
