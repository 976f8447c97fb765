"""Normalised forms of names, types, predicates and identifiers, as column expressions.

Single forms are JVM-side but for two things Spark has no function for, NFKC and case folding; those are Arrow
batches, and a batch that is all ASCII is handed back or lowered without a loop. An entity's identity is five forms of three
texts, and its own forms take NFKC and folding one after the other, so it is made in one pass; tests hold it to the single forms.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from claimloom.schemas import ENTITY_TYPES

#: White space as Python has it, in Java's notation; dashes that become a hyphen; what an alias loses at its ends (fixed values).
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANK_CHARS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
DASHES = "‐‑‒–—−"
ALIAS_ENDS = r"[ \t\r\n\"'`.,;:]"


_TO_HYPHEN = dict.fromkeys(map(ord, DASHES), "-")
_IDENTITY = ("canonical_key", "canonical_name", "entity_type", "normalized_id", "normalized_alias")


def _all_ascii(s: pa.Array) -> bool:
    return pc.all(pc.string_is_ascii(s)).as_py() is not False


@F.arrow_udf(StringType())
def nfkc(s: pa.Array) -> pa.Array:
    return s if _all_ascii(s) else pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in s.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def casefold(s: pa.Array) -> pa.Array:
    return pc.ascii_lower(s) if _all_ascii(s) else pa.array([None if x is None else x.casefold() for x in s.to_pylist()], pa.string())


def clean_text(c: Column, fallback: str = "Unknown") -> Column:
    """NFKC, hyphens for dashes, single spaces, no blanks at the ends; fallback for null and empty."""
    s = F.translate(nfkc(F.coalesce(c, F.lit(""))), DASHES, "-" * len(DASHES))
    s = F.trim(F.regexp_replace(s, f"{BLANK}+", " "))
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def normalize_entity_type(c: Column) -> Column:
    """The vocabulary's spelling; an unknown type stays as cleaned."""
    raw = clean_text(c, "Other")
    key = casefold(F.regexp_replace(raw, "[ -]+", "_"))
    known = F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.replace(key, F.lit("_"), F.lit(""))), raw)


def normalize_alias(c: Column) -> Column:
    s = F.regexp_replace(clean_text(c), f"^{ALIAS_ENDS}+|{ALIAS_ENDS}+$", "")
    return casefold(F.regexp_replace(s, f"{BLANK}+", " "))


def normalize_external_id(c: Column) -> Column:
    """Cleaned, case kept; null for empty."""
    return F.nullif(clean_text(c, ""), F.lit(""))


def normalize_predicate(c: Column) -> Column:
    s = F.regexp_replace(clean_text(c, "RELATED_TO"), "[^0-9A-Za-z]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.upper(F.when(s == "", F.lit("RELATED_TO")).otherwise(s))


def tidy(text: str) -> str:
    """clean_text for one text, without a fallback."""
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text).translate(_TO_HYPHEN)).split())


def alias_of(text: str | None) -> str:
    """normalize_alias for one text."""
    return alias_of_tidy(tidy(text or ""))


def alias_of_tidy(text: str) -> str:
    return (text or "Unknown").strip(" \t\r\n\"'`.,;:").casefold()


@lru_cache(1 << 14)
def predicate_literal(value: str | None) -> str:
    """normalize_predicate for one text: on the driver, so that a filter is a constant and reaches the scan, and within fingerprints."""
    words = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in tidy(value or "")).split()
    return "_".join(words).upper() or "RELATED_TO"


@lru_cache(1 << 14)
def entity_type_literal(value: str | None) -> str:
    """normalize_entity_type for one text."""
    s = tidy(value or "") or "Other"
    key = re.sub("[ -]+", "_", s).casefold()
    return ENTITY_TYPES.get(key, ENTITY_TYPES.get(key.replace("_", ""), s))


@lru_cache(1 << 15)
def identity_of(text: str | None, entity_type: str | None, external: str | None) -> tuple[str | None, ...]:
    """entity_identity for one text, as a tuple."""
    kind, known_as, name = entity_type_literal(entity_type), tidy(external or "") or None, tidy(text or "")
    alias = alias_of_tidy(name)
    part = f"name:{alias}" if known_as is None else f"id:{known_as.casefold()}"
    return f"{kind.casefold()}|{part}", name or "Unknown", kind, known_as, alias


@F.arrow_udf(StructType([StructField(x, StringType()) for x in _IDENTITY]))
def _identities(text: pa.Array, entity_type: pa.Array, external: pa.Array) -> pa.Array:
    rows = map(identity_of, text.to_pylist(), entity_type.to_pylist(), external.to_pylist())
    columns = list(zip(*rows)) or [()] * len(_IDENTITY)
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=list(_IDENTITY))


def entity_identity(text: Column, entity_type: Column, normalized_id: Column) -> Column:
    """struct(canonical_key, canonical_name, entity_type, normalized_id, normalized_alias)."""
    return _identities(text, entity_type, normalized_id)
