"""Pages of PDF files: ways of writing them, damage, and the query over all documents."""

import random
import zlib

import oracle
import pytest

from claimloom.plans import queries
from claimloom.sources import pdf, pdfwriter, sections

PAGES = [["Aspirin (high) inhibits \\ COX-1.", "Ünïcödé – “quotes”", ""], [], ["日本語 🧬 second", "x" * 300]]


@pytest.mark.parametrize("kind", range(3))
def test_pages_come_back(kind):
    assert pdf.page_texts(pdfwriter.pdf_of(PAGES, kind)) == ["Aspirin (high) inhibits \\ COX-1. Ünïcödé – “quotes”", "", "日本語 🧬 second " + "x" * 300]
    latin = [["plain (text)", "naïve"]]
    assert pdf.page_texts(pdfwriter.pdf_of(latin, kind)) == ["plain (text) naïve"]


def file_of(content: bytes, font: bytes = b"<< /Subtype /Type1 >>", more: bytes = b"", head: bytes = b"") -> bytes:
    return (
        b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R] /Count 1 >> endobj 3 0 obj << /Type /Page /Contents [4 0 R 6 0 R] /Resources << /Font << /F 5 0 R >> /XObject << /X 7 0 R >> >> >> endobj\n"
        b"4 0 obj << /Length %d %s >> stream\r\n%s\nendstream endobj 5 0 obj %s endobj 6 0 obj << >> stream\n\nendstream endobj %s\ntrailer << /Root 1 0 R >>" % (len(content), head, content, font, more)
    )


def text(*a, **k):
    return pdf.page_texts(file_of(*a, **k))[0]


def test_operators_of_text():
    assert text(b"BT /F 10 Tf (a) Tj 0 -12 Td (b) Tj (c) ' ET % (no)\n") == "a b c"
    assert text(b"BT /F 10 Tf [(Hel) -20 (lo) -400 (wor) 30 (ld)] TJ ET") == "Hello world"
    assert text(b"BT /F 10 Tf 1 0 0 1 0 700 Tm (one) Tj 1 0 0 1 15 700 Tm (two) Tj 1 0 0 1 80 700 Tm (three) Tj ET") == "onetwo three"
    assert text(b"BT /F 10 Tf (\\101\\(\\)\\\\ \\\nx <41 4) Tj <4 14 2> Tj ET") == "A()\\ x <41 4AB"
    assert text(b"BT /F 10 Tf (a) Tj ET BI /W 2 ID \xff(zz) Tj\x00 EI BT (b) Tj ET") == "a b"


def test_fonts_and_forms():
    assert text(b"BT /F 9 Tf (a\x01\x02\x03) Tj ET", b"<< /Subtype /Type1 /Encoding << /Differences [1 /eacute /fi /uni00DF 97 /A] >> >>") == "Aéfiß"
    assert text(b"BT /F 9 Tf (\x8e) Tj ET", b"<< /Subtype /TrueType /Encoding /MacRomanEncoding >>") == "é"
    assert text(b"BT /F 9 Tf <00410042> Tj ET", b"<< /Subtype /Type0 /Encoding /Identity-H >>") == ""  # no way to know the characters
    form = b"7 0 obj << /Subtype /Form /Length 26 >> stream\nBT /F 9 Tf (in form) Tj ET\nendstream endobj"
    assert text(b"BT /F 9 Tf (out) Tj ET /X Do", more=form) == "out in form"
    loop = b"7 0 obj << /Subtype /Form /Length 5 >> stream\n/X Do\nendstream endobj"
    assert text(b"/X Do", more=loop) == ""


def test_what_cannot_be_read_is_an_error():
    good = file_of(b"BT /F 9 Tf (a) Tj ET")
    for bad, why in [
        (b"", "not a PDF"), (b"plain text", "not a PDF"), (b"%PDF-1.4", "no catalog"), (good.replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"), "encrypted"), (file_of(b"x", head=b"/Filter /JPXDecode"), "not known"),
        (file_of(b"not deflated", head=b"/Filter /FlateDecode"), "inflated"), (b"%PDF-1.4 1 0 obj " + b"[" * 100_000, "deeply"), (b"%PDF-1.4 1 0 obj << /Type /Catalog >> endobj", None), (good.replace(b"/Kids [3 0 R]", b"/Kids [2 0 R]"), "no pages"),
    ]:
        if why is None:
            assert "".join(pdf.page_texts(bad) if b"Pages" in bad else [""]) == ""
        else:
            with pytest.raises(pdf.Unreadable, match=why):
                pdf.page_texts(bad)


def test_damage_never_hangs_or_gives_other_errors():
    r = random.Random(4)
    files = [pdfwriter.pdf_of(PAGES, k) for k in range(3)]
    for n in range(300):
        data = bytearray(files[n % 3])
        for _ in range(r.randint(1, 6)):
            at = r.randrange(len(data))
            data[at : at + r.randint(0, 4)] = bytes(r.randrange(256) for _ in range(r.randint(0, 3)))
        try:
            assert all(isinstance(x, str) for x in pdf.page_texts(bytes(data)))
        except pdf.Unreadable:
            pass


def test_last_definition_counts_and_predictors_are_undone():
    good = file_of(b"BT /F 9 Tf (old) Tj ET")
    assert pdf.page_texts(good + b"\n4 0 obj << /Length 22 >> stream\nBT /F 9 Tf (new) Tj ET\nendstream endobj") == ["new"]
    rows = b"BT /F 9 Tf (up) Tj ET   "
    up = b"".join(bytes([2]) + bytes((b - (rows[i - 8 : i][k] if i else 0)) & 255 for k, b in enumerate(rows[i : i + 8])) for i in range(0, 24, 8))
    assert text(zlib.compress(up), head=b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 8 >>") == "up"


def test_documents_and_errors(spark):
    rows = [(1, bytearray(pdfwriter.pdf_of([["one"], [" "], ["three"]], 0))), (2, bytearray(b"%PDF-1.4 \xff\xfe")), (3, None), (4, bytearray(pdfwriter.pdf_of([[""]], 1)))]
    got = sorted((r.document_id, r.section_title, r.text, r.error) for r in sections.parse(spark.createDataFrame(rows, "document_id long, content binary")).collect())
    assert got == [(1, "Page 1", "one", None), (1, "Page 3", "three", None), (2, None, None, "the file has no catalog"), (3, None, None, "the file is not a PDF"), (4, None, None, sections.NO_SECTIONS)]


def test_query_and_sql(spark, small):
    assert oracle.difference(queries.QUERIES["pdf_sections"](spark, small), oracle.connect(small), queries.SQL["pdf_sections"]) is None
