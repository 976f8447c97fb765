"""Small PDF files from pages of lines, in several of the ways in which programs write them; for queries and tests of the reader."""

from __future__ import annotations

import zlib

#: A map that gives every two-byte code the character of that number.
_SAME = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap"
_TWO_BYTES = b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /%s /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /BaseFont /F /DW 500 >>] %s >>"


def _escaped(text: bytes) -> bytes:
    return b"(" + text.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def _stream(data: bytes, head: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data)


def pdf_of(pages: list[list[str]], kind: int) -> bytes:
    """A file of kind 0 (deflated, with a character map), 1 (plain strings where the code page has the characters) or 2 (objects in a stream, split words)."""
    codes = lambda s: s.encode("utf-16-be", "replace")
    plain = kind == 1 and all(x.isprintable() and x.encode("cp1252", "ignore").decode("cp1252") == x for lines in pages for x in lines)
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>" if plain else _TWO_BYTES % (b"UniGB-UCS2-H", b"") if kind == 1 else _TWO_BYTES % (b"Identity-H", b"/ToUnicode 4 0 R")
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: font}
    streams = {4: _stream(_SAME)}
    for n, lines in enumerate(pages):
        said = [b"BT /F1 10 Tf 12 TL 50 700 Td"]
        for x in lines:
            if plain:
                said.append(_escaped(x.encode("cp1252")) + b" Tj T*")
            elif kind == 2:  # a pair of characters has never its two code units in different strings
                half = len(x) // 2
                said.append(b"[<%s> -40 <%s>] TJ T*" % (codes(x[:half]).hex().encode(), codes(x[half:]).hex().encode()))
            else:
                said.append(b"<%s> Tj T*" % codes(x).hex().encode())
        body = b"\n".join([*said, b"ET"])
        page, content = 10 + 2 * n, 11 + 2 * n
        objects[page] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % content
        streams[content] = _stream(zlib.compress(body), b"/Filter /FlateDecode") if kind == 0 else _stream(body.hex().encode() + b">", b"/Filter /ASCIIHexDecode") if kind == 2 else _stream(body)
    kids = b" ".join(b"%d 0 R" % (10 + 2 * n) for n in range(len(pages)))
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), kids)
    out = [b"%PDF-1.7\n"]
    if kind == 2:
        bodies, heads, at = [], [], 0
        for number, body in objects.items():
            heads.append(b"%d %d" % (number, at))
            bodies.append(body)
            at += len(body) + 1
        head = b" ".join(heads) + b" "
        packed = _stream(zlib.compress(head + b" ".join(bodies)), b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(objects), len(head)))
        out += [b"5 0 obj\n%s\nendobj\n" % packed, b"6 0 obj\n%s\nendobj\n" % _stream(b"", b"/Type /XRef /Root 1 0 R")]
        objects = {}
    out += [b"%d 0 obj\n%s\nendobj\n" % x for x in (objects | streams).items()]
    return b"".join([*out, b"" if kind == 2 else b"trailer << /Root 1 0 R >>\n", b"%%EOF\n"])
