"""Sections of documents: TEI from a parsing service, pages of PDF files or of plain text; parsers are interchangeable."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from claimloom.sources import pdf
from claimloom.sources.pieces import pieces

_TEI = "{http://www.tei-c.org/ns/1.0}"
LEAST_BODY_CHARS = 80
NO_SECTIONS = "No text sections extracted from PDF"
Sections = list[tuple[str, str]]
#: bytes -> (title, sections); raises where it cannot read the document
Parser = Callable[[bytes], tuple[str | None, Sections]]


def _texts(nodes: list[ET.Element]) -> str:
    lines = (re.sub(r"\s+", " ", " ".join(n.itertext())).strip() for n in nodes)
    return "\n".join(x for x in lines if x).strip()


def tei_sections(content: bytes) -> tuple[str | None, Sections]:
    """Title, abstract, and every division with its own paragraphs of more than 80 characters."""
    root = ET.fromstring(content)
    find = lambda top, *path: top.iterfind("/".join(_TEI + p if p.isalpha() else p for p in path))
    titles = [t for s in root.iter(f"{_TEI}titleStmt") for t in find(s, "title")]
    abstract = _texts([p for h in root.iter(f"{_TEI}profileDesc") for a in find(h, "abstract") for p in a.iter(f"{_TEI}p")])
    sections = [("Abstract", abstract)] if abstract else []
    for body in (b for t in root.iter(f"{_TEI}text") for b in find(t, "body")):
        for div in body.iter(f"{_TEI}div"):
            head, text = list(find(div, "head")), _texts(list(find(div, "p")))
            if len(text) > LEAST_BODY_CHARS:
                sections.append((_texts(head) if head else "Body", text))
    return (_texts(titles) if titles else None), sections


def pdf_sections(content: bytes) -> tuple[None, Sections]:
    """The pages of a PDF file, blank ones left out; raises where it is none."""
    return None, [(f"Page {i}", p) for i, p in enumerate(pdf.page_texts(content), 1) if p]


def page_sections(content: bytes) -> tuple[None, Sections]:
    """Pages of plain text, divided by form feeds, blank ones left out."""
    pages = (re.sub(r"\s+", " ", p).strip() for p in content.decode("utf-8", "replace").split("\f"))
    return None, [(f"Page {i}", p) for i, p in enumerate(pages, 1) if p]


def parse(documents: DataFrame, parser: Parser = tei_sections, fallback: Parser = pdf_sections) -> DataFrame:
    """documents (document_id, content) -> document_id, title, section_index, section_title, text, error.

    The fallback reads what the parser raises on. A document without sections, or that the fallback cannot read either, is one row with an error.
    """

    schema = pa.schema([("document_id", pa.int64()), ("title", pa.string()), ("section_index", pa.int32()), ("section_title", pa.string()), ("text", pa.string()), ("error", pa.string())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts, "content"):
            out = []
            for key, content in zip(part.column("document_id").to_pylist(), part.column("content")):
                data, error = content.as_py() or b"", NO_SECTIONS
                try:
                    title, sections = parser(data)
                except Exception:
                    try:
                        title, sections = fallback(data)
                    except Exception as e:
                        title, sections, error = None, [], str(e) or NO_SECTIONS
                out += [(key, title, i, t, x, None) for i, (t, x) in enumerate(sections)] or [(key, title, None, None, None, error)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return documents.select("document_id", "content").mapInArrow(rows, "document_id long, title string, section_index int, section_title string, text string, error string")


def binary_documents(spark, path: str) -> DataFrame:
    """position, filename, content of the files under a path. Only paths are numbered in one task; contents are joined to them."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").load(path)
    places = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("position"))
    return files.select("path", "content").join(places, "path").select("position", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
