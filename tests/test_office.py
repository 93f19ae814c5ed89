"""PDF and DOCX files: literal files of other makes, refusals, round trips, broken files."""

import io
import time
import zipfile
import zlib

import pytest

from brindle.sources import office as O
from brindle.sources import pdf as P

W = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
STYLES = f"""<w:styles {W}><w:style w:type='paragraph' w:default='1' w:styleId='a'><w:name w:val='Normal'/></w:style><w:style w:type='paragraph' w:styleId='1'><w:name w:val='heading 1'/></w:style>
<w:style w:type='paragraph' w:styleId='b3'><w:name w:val='标题 3'/></w:style><w:style w:type='paragraph' w:styleId='lp'><w:name w:val='List Paragraph'/></w:style><w:style w:type='character' w:styleId='lp2'><w:name w:val='heading 9'/></w:style></w:styles>"""
BODY = f"""<?xml version='1.0' encoding='UTF-8'?><w:document {W} xmlns:r='urn:r'><w:body>
<w:p><w:pPr><w:pStyle w:val='1'/></w:pPr><w:r><w:t>E03 </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>drain</w:t></w:r></w:p>
<w:p><w:r><w:t xml:space='preserve'>  </w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val='b3'/></w:pPr><w:r><w:t>清洁</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val='restart'/></w:tcPr><w:p><w:r><w:t>tall</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr></w:tbl>
<w:p><w:pPr><w:pStyle w:val='lp'/></w:pPr><w:r><w:t>item</w:t><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val='lp2'/></w:pPr><w:r><w:t>see </w:t></w:r><w:hyperlink r:id='z'><w:r><w:t>link</w:t></w:r></w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t xml:space='preserve'> new</w:t></w:r></w:ins></w:p>
</w:body></w:document>"""


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(f"word/{name}.xml", data)
    return out.getvalue()


def rows(spark, files):
    found = O.parsed_files(spark.createDataFrame(files, "name string, content binary")).collect()
    return [(r["name"], r["page"], r["place"], r["kind"], r["text"], r["level"], r["error"]) for r in found]


def test_docx(spark):
    got = rows(spark, [("a manual.docx", archive(document=BODY, styles=STYLES)), ("plain.docx", archive(document=BODY.replace("w:val='1'/></w:pPr>", "w:val='none'/></w:pPr>")))])
    assert got[:6] == [
        ("a manual.docx", 1, 0, "heading", "E03 drain", 1, None),
        ("a manual.docx", 1, 1, "heading", "清洁", 3, None),
        ("a manual.docx", 1, 2, "list", "item\tx\ny", None, None),
        ("a manual.docx", 1, 3, "paragraph", "see link new", None, None),
        ("a manual.docx", 1, 4, "table", "wide | wide | tall\none\ntwo |  | tall", None, None),
        ("plain.docx", 1, 0, "paragraph", "E03 drain", None, None),
    ]


def test_refusals(spark):
    bomb = archive(document="<!DOCTYPE x [<!ENTITY a 'aaaaaaaaaa'>" + "".join(f"<!ENTITY a{k} '{f'&a{k - 1 if k else chr(0)};'.replace(chr(0), '') * 10}'>" for k in range(9)) + f"]><w:document {W}><w:body><w:p><w:r><w:t>&a8;</w:t></w:r></w:p></w:body></w:document>")
    whole = P.written_pdf([["text"]])
    files = [("a.docx", b"PK\x03\x04 torn"), ("b.docx", archive(other="<x/>")), ("c.docx", archive(document="<w:document")), ("d.docx", bomb), ("e.docx", b""), ("f.docx", None), ("g.pdf", b"%PDF-1.4"), ("h.pdf", b"no"), ("i.pdf", whole.replace(b"<</Size", b"<</Encrypt 9 0 R/Size")), ("j.pdf", whole.replace(b"/FlateDecode/", b"/LZWDecode/")), ("k.txt", b"text"), (None, b"x")]
    got = {r[0]: r[6] for r in rows(spark, files)}
    assert got == {"a.docx": "broken", "b.docx": "broken", "c.docx": "broken", "d.docx": "broken", "e.docx": "broken", "f.docx": "broken", "h.pdf": "broken", "i.pdf": "encrypted", "k.txt": "unsupported", "j.pdf": "unsupported", None: "unsupported"}


def stream(data, extra=b""):
    packed = zlib.compress(data)
    return b"<</Length %d/Filter/FlateDecode%s>>stream\r\n%s\nendstream" % (len(packed), extra, packed)


def test_pdf_of_another_make():
    """Simple fonts, kerned strings, escapes, forms, pictures, nested pages with shared resources, objects packed in a stream, an update."""
    packed = b"10 0 11 60 <</Type/Pages/Parent 2 0 R/Kids[4 0 R]/Count 1>>                       <</Type/Font/Subtype/TrueType/FirstChar 32/Widths[250 300]/Encoding<</Differences[1/uni6E05/x]>>>>"
    first = packed.index(b"<<")
    packed = packed.replace(b"11 60", b"11 %d" % (packed.index(b"<</Type/Font") - first), 1)
    text = rb"""q 1 0 0 1 0 0 cm BT /F1 12 Tf 72 700 Td (Kern) Tj [( an) -10 (d gap) -400 (word)] TJ 0 -14 Td (oct\141l \(in\) \
line) Tj T* ET BT /F1 12 Tf 1 0 0 1 72 600 Tm (far) Tj 60 0 Td (right) Tj 14 TL (next) ' ET Q /Im Do /Fm Do"""
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>",
        2: b"<</Type/Pages/Kids[10 0 R 5 0 R]/Count 2/Resources<</Font<</F1 3 0 R/F2 11 0 R>>/XObject<</Im 6 0 R/Fm 7 0 R>>>>>>",
        3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>",
        4: b"<</Type/Page/Parent 10 0 R/Contents[8 0 R]>>",
        5: b"<</Type/Page/Parent 2 0 R/Contents 9 0 R>>",
        6: b"<</Type/XObject/Subtype/Image/Width 1/Height 1/Length 3>>stream\nabc\nendstream",
        7: stream(b"BT /F1 12 Tf 72 300 Td (in a form\x92s) Tj ET", b"/Type/XObject/Subtype/Form"),
        8: stream(text),
        9: stream(b"BT /F1 10 Tf 0 0 Td (old) Tj ET"),
        12: stream(packed, b"/Type/ObjStm/N 2/First %d" % first),
    }
    data = b"%PDF-1.5\n%\xe2\xe3\n" + b"".join(b"%d 0 obj %s endobj\n" % kv for kv in objects.items())
    data += b"trailer <</Root 1 0 R>>\n9 0 obj %s endobj\ntrailer <</Root 1 0 R/Prev 1>>" % stream(b"BT /F2 10 Tf 10 10 Td (\x01\x02) Tj (new) Tj ET BI /W 1 ID \x00\xff EI")
    pages = list(P.pdf_pages(data))
    assert pages == [(["Kern and gap word\noctal (in) line", "far right\nnext", "in a form’s"], 1), (["清xnew"], 1)]


def test_pdf_blocks(spark):
    got = rows(spark, [("m.pdf", P.written_pdf([["E03 排水", "Close the tap.\nPull the plug", "A sentence ends."], [], ["𝔘 two"]]))])
    assert got == [("m.pdf", 1, 0, "heading", "E03 排水", 1, None), ("m.pdf", 1, 1, "paragraph", "Close the tap.\nPull the plug", None, None), ("m.pdf", 1, 2, "paragraph", "A sentence ends.", None, None), ("m.pdf", 3, 0, "heading", "𝔘 two", 1, None)]


def test_maps_of_a_file_are_not_spelled_out():
    m = P.CharMap(b"2 beginbfrange <0000><FFFF><0100> <0041><0043>[<0058><0059>] endbfrange 1 beginbfchar <0042><005A> endbfchar 1 beginbfrange <0043><0043><D835DD18> endbfrange")
    # later maps count first, a short list leaves its other codes to earlier ones, ends run round
    assert [m[bytes.fromhex(c)] for c in ("0041", "0042", "0043", "0044", "FFFF", "41")] == ["X", "Z", "𝔘", "\u0144", "\u00ff", None]
    with pytest.raises(ValueError):
        P.CharMap(b"1 beginbfrange <0000><00FF><D8350041DD> endbfrange")
    files = [P.written_pdf([[f"text {k}"]]) for k in range(200)]
    began = time.process_time()
    assert [list(P.pdf_pages(f)) for f in files] == [[([f"text {k}"], 0)] for k in range(200)]
    assert time.process_time() - began < 5


def test_predictors():
    facts = {"Predictor": 12, "Columns": 3}
    assert P._unpredicted(b"\x02\x01\x02\x03\x02\x01\x01\x01\x01\x05\x01\x01", facts) == bytes([1, 2, 3, 2, 3, 4, 5, 6, 7])


@pytest.mark.parametrize("piece", [b"<<", b"[", b"(", b"<", b"1 0 obj ", b"1 0 obj <<", b"%", b"stream\n", b"1 0 obj <</Length 5>> stream\n", b"BT (", b"/", b">>", b"1 0 R "])
def test_broken_files_end_soon(piece):
    began = time.time()
    for data in (b"%PDF-1.4\n" + piece * (400_000 // len(piece)), P.written_pdf([["x"]])[:-200] + piece * 20_000):
        try:
            list(P.pdf_pages(data))
        except (P.Refused, RecursionError, ValueError, TypeError):
            pass
    assert time.time() - began < 10


def test_folder(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(O.written_docx([("paragraph", "x", None)]))
    (tmp_path / "b.pdf").write_bytes(P.written_pdf([["y"]]))
    (tmp_path / "c.txt").write_text("z")
    assert sorted((r["title"], r["text"]) for r in O.read_office(spark, str(tmp_path)).collect()) == [("a", "x"), ("b", "y")]
