"""Claims from chunks through an interchangeable extractor, with one round of repair."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from claimloom.functions import claimjson
from claimloom.schemas import ENTITY_TYPES
from claimloom.sources.pieces import pieces

#: prompt -> answer; a call of a language model, or the rules below
Extractor = Callable[[str], str]
#: What validated_bundle accepts, as a JSON schema.
_TERM = {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "type": {"type": ["string", "null"]}, "normalized_id": {"type": ["string", "null"]}}}
_EVIDENCE = {"type": "object", "required": ["sentence"], "properties": {"sentence": {"type": "string"}, "section": {"type": ["string", "null"]}, "page": {"type": ["integer", "null"]}, "table_or_figure": {"type": ["string", "null"]}}}
_CLAIM = {
    "type": "object", "required": ["subject", "predicate", "object", "evidence", "confidence"],
    "properties": {
        "subject": _TERM, "predicate": {"type": "string"}, "object": _TERM, "qualifiers": {"type": "object"}, "evidence": _EVIDENCE,
        "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "negated": {"type": "boolean"}, "speculative": {"type": "boolean"},
    },
}
SCHEMA = json.dumps({"type": "object", "required": ["claims"], "properties": {"claims": {"type": "array", "items": _CLAIM}}})
RULES = (
    "Work from the passage alone; add nothing from elsewhere.", "One claim for one relation between two named things.", "Copy into evidence.sentence the sentence that carries the claim.", "A finding that something has no effect is a claim with negated true.",
    "Guesses, background and plans are claims with speculative true.", "If it is unclear who acts on what, leave the claim out.", "Put doses, models, assays and other conditions into qualifiers.", "Fill normalized_id only from an identifier printed in the passage.",
    f"Use these types where one fits: {', '.join(sorted(set(ENTITY_TYPES.values())))}.", "Let confidence say how plainly the sentence states the claim, from 0 to 1.", "Name page, table or figure where the passage does.", 'Answer with JSON of the schema and nothing else; {"claims": []} if there is none.',
)
SYSTEM = "You read passages of papers and list relations between compounds, drugs, proteins, genes, pathways and diseases.\n" + "\n".join(f"{i}. {r}" for i, r in enumerate(RULES, 1)) + f"\nSchema: {SCHEMA}"
REPAIR = "The last answer is not valid JSON of the schema. Answer again with JSON alone.\nLast answer:\n"
INVALID = "The answer is not valid JSON of the schema"
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]?")
_FACT = re.compile(r"\b([A-Z][\w-]+) (?:(does not|may) )?(activates?|inhibits?|binds to|bind to) ([A-Z][\w-]+)")


def question(section: Column, text: Column) -> Column:
    return F.concat(F.lit("Section: "), F.coalesce(section, F.lit("")), F.lit("\nPassage:\n"), F.coalesce(text, F.lit("")))


def messages(section: Column, text: Column) -> Column:
    """[(role, content)]: the rules and the schema, then section and passage."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), question(section, text).alias("content")))


def prompt(section: Column, text: Column) -> Column:
    """The messages as one text, for services that take one."""
    return F.array_join(F.transform(messages(section, text), lambda m: m["content"]), "\n")


def rule_extractor(asked: str) -> str:
    """Sentences of the form `X inhibits Y`, for use without a service; the same answer each time."""
    passage, claims = asked.rpartition("\nPassage:\n")[2], []
    for sentence in _SENTENCE.findall(passage):
        for subject, how, verb, obj in _FACT.findall(sentence):
            claims.append({
                "subject": {"text": subject}, "predicate": verb.removesuffix("s") + "s" if " " not in verb else "binds to", "object": {"text": obj}, "confidence": 0.9,
                "evidence": {"sentence": sentence.strip()}, "negated": how == "does not", "speculative": how == "may",
            })
    return json.dumps({"claims": claims})


def answered(question: str, extractor: Extractor, repair: Extractor | None) -> tuple[str, str | None, list[dict] | None]:
    """(the JSON in the answer, error of a call that failed, validated claims or None). An invalid answer goes to repair once, with what was wrong about it."""

    def called(service: Extractor, text: str) -> tuple[str, str | None, list[dict] | None]:
        try:
            answer, error = service(text), None
        except Exception as e:  # a call that fails is this chunk's failure, not the job's
            answer, error = None, str(e) or type(e).__name__
        found, claims = claimjson.answered(answer)
        return found, error, claims

    got = called(extractor, f"{SYSTEM}\n{question}")
    return called(repair, REPAIR + got[0]) if repair is not None and got[1] is None and got[2] is None else got


def answers(chunks: DataFrame, extractor: Extractor = rule_extractor, repair: Extractor | None = None) -> DataFrame:
    """chunk_id, document_id, answer (the JSON in it), error (of a call that failed), claims (validated; null where any is invalid), valid: one row for a chunk. An invalid answer goes to repair once, with
    what was wrong about it. The rules, which are the same for all, join the question in the worker; call, parse and validation are one pass."""
    kind = to_arrow_type(ArrayType(claimjson.CLAIM))

    def asked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts, "question"):
            answer, error, claims = zip(*[answered(q, extractor, repair) for q in part.column("question").to_pylist()]) if part.num_rows else ((), (), ())
            valid = [e is None and c is not None for e, c in zip(error, claims)]
            columns = [part.column("chunk_id"), part.column("document_id"), pa.array(answer, pa.string()), pa.array(error, pa.string()), pa.array(claims, kind), pa.array(valid, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = StructType().add("chunk_id", "long").add("document_id", "long").add("answer", "string").add("error", "string").add("claims", ArrayType(claimjson.CLAIM)).add("valid", "boolean")
    return chunks.select(F.col("id").alias("chunk_id"), "document_id", question(F.col("section_title"), F.col("text")).alias("question")).mapInArrow(asked, schema)


def kept_claims(chunks: DataFrame, extractor: Extractor = rule_extractor, repair: Extractor | None = None) -> DataFrame:
    """chunks with error and valid as answers gives them, and their projected claims (claimjson.KEPT), one for a fingerprint: call, parse, projection and the choice within a chunk are one pass.

    task and before place them: the number of the task, and how many claims it gave before the chunk."""
    columns = chunks.columns

    def asked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        for part in pieces(parts, "question"):
            got = [answered(q, extractor, repair) for q in part.column("question").to_pylist()]
            error, valid = [e for _, e, _ in got], [e is None and c is not None for _, e, c in got]
            claims = claimjson.kept_claims([c if v else None for (_, _, c), v in zip(got, valid)])
            starts = pc.add(claims.offsets.slice(0, part.num_rows).cast(pa.int64()), before)
            before += len(claims.values)
            added = [pa.array(error, pa.string()), pa.array(valid, pa.bool_()), pa.array([task] * part.num_rows, pa.int32()), starts, claims]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *added], names=schema.names)

    schema = StructType(list(chunks.schema)).add("error", "string").add("valid", "boolean").add("task", "integer").add("before", "long").add("claims", ArrayType(claimjson.KEPT))
    return chunks.withColumn("question", question(F.col("section_title"), F.col("text"))).mapInArrow(asked, schema)


def chunk_states(answered: DataFrame) -> DataFrame:
    """id, document_id, status, error of chunks that were asked about: done where the answer is valid, else failed."""
    error = F.when(~F.col("valid"), F.coalesce("error", F.lit(INVALID)))
    return answered.select(F.col("chunk_id").alias("id"), "document_id", F.when(F.col("valid"), "done").otherwise("failed").alias("status"), error.alias("error"))


def extract(chunks: DataFrame, extractor: Extractor = rule_extractor, repair: Extractor | None = None) -> DataFrame:
    """chunks (id, document_id, section_title, text) -> chunk_id, document_id, position, claim. A chunk whose answer stays
    invalid after one repair has no claims. Repartition chunks first to bound the number of calls at a time."""

    rows = answers(chunks, extractor, repair)
    return rows.select("chunk_id", "document_id", F.posexplode(F.coalesce("claims", F.array())).alias("position", "claim"))
