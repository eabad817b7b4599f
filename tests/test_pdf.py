"""PDF text from hand-made files."""

import base64
import random
import zlib

import pytest

from webquarry.sources import pdf


def made(objects, trailer=b"<< /Root 1 0 R >>"):
    """objects: number -> bytes, or (info, stream)."""
    out = b"%PDF-1.7\n%\xe2\xe3\n"
    for n, o in objects.items():
        body = o if isinstance(o, bytes) else o[0].replace(b">>", b" /Length %d >>" % len(o[1]), 1) + b"\nstream\n" + o[1] + b"\nendstream"
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    return out + b"trailer " + trailer + b"\nstartxref\n0\n%%EOF"


def simple(content, font=b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>", packed=True, **more):
    stream = (b"<< /Filter /FlateDecode >>", zlib.compress(content)) if packed else (b"<< >>", content)
    return made({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> /XObject << /X1 7 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: stream, 5: font} | {int(k[1:]): v for k, v in more.items()})


def test_operators_and_strings():
    content = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) wor\154d\041) Tj 0 -14 Td [(Ker) -50 (ned) -300 (gap)] TJ T* <436166E9> Tj (next) ' ET % (not) Tj" + b"\nBT (last \\\nline) Tj ET"
    for packed in (True, False):
        assert pdf.extract_text(simple(content, packed=packed)) == "Hello (big) world!\nKerned gap\nCafé\nnext\nlast line"


def test_maps_of_fonts():
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660066> <4E2D>] endbfrange endcmap"
    font = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 6 0 R >>"
    got = pdf.extract_text(simple(b"BT /F1 9 Tf <0001001000110012000200200021FFFF> Tj ET", font, _6=(b"<< /Filter /FlateDecode >>", zlib.compress(cmap))))
    assert got == "Habc\U0001f600ff中"
    named = b"<< /Type /Font /Subtype /Type1 /Encoding << /Type /Encoding /Differences [65 /eacute /fi 67 /uni0416 /quoteright] >> >>"
    assert pdf.extract_text(simple(b"BT /F1 9 Tf (xABCD) Tj ET", named)) == "xéfiЖ’"
    assert pdf.extract_text(simple(b"BT /F1 9 Tf <00010002> Tj ET", b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H >>")) is None


def test_forms_images_and_filters():
    form = (b"<< /Type /XObject /Subtype /Form >>", b"BT (inside) Tj ET")
    hexed = (b"<< /Filter [/ASCIIHexDecode /FlateDecode] >>", zlib.compress(b"BT /F1 9 Tf (one) Tj ET BI /W 1 ID (x) Tj EI \n /X1 Do").hex().encode() + b">")
    base = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 5 0 R >> /XObject << /X1 7 0 R >> >> >>", 3: b"<< /Type /Page /Contents [4 0 R 8 0 R] >>", 5: b"<< /Type /Font >>", 7: form}
    a85 = (b"<< /Filter /ASCII85Decode >>", base64.a85encode(b"BT (two) Tj ET") + b"~>")
    assert pdf.extract_text(made(base | {4: hexed, 8: a85})) == "one\ninside\ntwo"
    assert pdf.extract_text(made(base | {4: (b"<< /Filter /LZWDecode >>", b"xx"), 8: a85})) is None


def test_object_streams_and_order_of_pages():
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [9 0 R 3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 9: b"<< /Type /Page /Contents 10 0 R >>"}
    head, body = b"", b""
    for n, o in inner.items():
        head += b"%d %d " % (n, len(body))
        body += o + b" "
    packed = (b"<< /Type /ObjStm /N 4 /First %d /Filter /FlateDecode >>" % len(head), zlib.compress(head + body))
    assert pdf.extract_text(made({20: packed, 4: (b"<< >>", b"BT (second) Tj ET"), 10: (b"<< >>", b"BT (first) Tj ET")})) == "first\nsecond"


def test_predictors():
    rows = [bytes([1, 2, 3, 4]), bytes([5, 6, 7, 8])]
    up = bytes([0, *rows[0], 2, *[(b - a) % 256 for a, b in zip(*rows, strict=True)]])
    assert pdf._unpredicted(up, {"Predictor": 12, "Columns": 4}) == rows[0] + rows[1]


@pytest.mark.parametrize("data", [b"", b"no pdf", b"%PDF-1.4", b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj"])
def test_nothing_to_read(data):
    assert pdf.extract_text(data) is None


def test_damaged_files_never_raise():
    good, rng = simple(b"BT /F1 12 Tf (Some words in a row) Tj ET"), random.Random(1)
    assert pdf.extract_text(made({1: b"<< >>"}, b"<< /Encrypt 5 0 R >>")) is None
    for _ in range(300):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 12)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        pdf.extract_text(bytes(bad[: rng.randint(1, len(bad))]))


def test_ingest_finds_words_of_pdfs(spark, tmp_path):
    from test_archives import make, record

    from webquarry.operators import maintain
    from webquarry.plans import ingest
    from webquarry.plans import search as S

    body = simple(b"BT /F1 12 Tf (Notes on gabbro) Tj ET")
    make(str(tmp_path / "p.wacz"), 0, [("a.warc", record("response", "http://s.org/r.pdf", body, b"HTTP/1.1 200 OK\r\nContent-Type: application/pdf\r\n\r\n"))])
    ingest.ingest(spark, str(tmp_path / "h"), [str(tmp_path / "p.wacz")], "col")
    assert S.search(maintain.open_index(spark, str(tmp_path / "h")), "gabbro").hits.first()["title"] == "r.pdf"
