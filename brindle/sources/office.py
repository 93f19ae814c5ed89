"""Word-processor and PDF files as blocks, read in the tasks that hold them, and the writers of such files.

Files come as rows (name, content), as read_files() gives them; each is parsed by one task, and gives a row for every block: name,
title, page, place, kind (heading, paragraph, list, table, image), text, level. A file that cannot be read gives one row with the
reason in error: broken, encrypted, too-large, unsupported. Only the standard library is used.

Odd input: null or empty content is broken; a file without text gives no rows; a block of white space goes; parts of XML over
MOST_XML bytes are too-large, so that a small archive cannot fill a task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.files import KINDS, read_files, sniffed
from brindle.sources.pdf import Refused, pdf_pages, written_pdf

#: Bytes of one part of an archive, and blocks given back at once.
MOST_XML, BLOCKS = 256 << 20, 4096
#: Names of paragraph styles that make headings and lists, and the longest text of a heading without a style.
HEADING_STYLE, LIST_STYLES, HEADING_CHARS, SENTENCE_ENDS, PICTURE = re.compile(r"heading\s*(\d+)|标题\s*(\d+)"), ("list", "列表"), 80, "。.!?；;", "图片"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SCHEMA = "name string, title string, page int, place int, kind string, text string, level int, error string"

Block = tuple[str, str, int | None]


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if archive.getinfo(name).file_size > MOST_XML:
        raise Refused("too-large")
    return ElementTree.fromstring(archive.read(name))


def _styles(archive: zipfile.ZipFile) -> tuple[dict[str, str], str]:
    """Names of paragraph styles by id, and the name of the default one, in lower case."""
    if "word/styles.xml" not in archive.namelist():
        return {}, ""
    names, default = {}, ""
    for style in _part(archive, "word/styles.xml").iter(f"{_W}style"):
        name = style.find(f"{_W}name")
        if style.get(f"{_W}type") == "paragraph" and name is not None:
            names[style.get(f"{_W}styleId")] = name.get(f"{_W}val", "").lower()
            if style.get(f"{_W}default") in ("1", "true"):
                default = names[style.get(f"{_W}styleId")]
    return names, default


def _run_text(paragraph: ElementTree.Element) -> str:
    """Text of the runs and links of a paragraph; text boxes and deleted text are not part of it."""
    signs = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    out = []
    for child in paragraph:
        tag = child.tag.removeprefix(_W)
        if tag == "r":
            out += [(x.text or "") if x.tag == f"{_W}t" else signs.get(x.tag.removeprefix(_W), "") for x in child]
        elif tag in ("hyperlink", "ins", "smartTag"):
            out.append(_run_text(child))
    return "".join(out)


def _cells(row: ElementTree.Element, above: list[str]) -> list[str]:
    """Texts of a row by grid column: a wide cell stands in each of its columns, a tall one in each of its rows."""
    out: list[str] = []
    for cell in row.iter(f"{_W}tc"):
        facts = cell.find(f"{_W}tcPr")
        span, merge = (facts.find(f"{_W}{k}") if facts is not None else None for k in ("gridSpan", "vMerge"))
        width = int(span.get(f"{_W}val", "1")) if span is not None else 1
        goes_on = merge is not None and merge.get(f"{_W}val", "continue") == "continue" and len(out) < len(above)
        text = above[len(out)] if goes_on else "\n".join(_run_text(p) for p in cell.findall(f"{_W}p")).strip()
        out += [text] * width
    return out


def docx_blocks(content: bytes) -> Iterator[Block]:
    """Paragraphs by their styles, then tables: rows on lines, cells between bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = _part(archive, "word/document.xml").find(f"{_W}body")
        names, default = _styles(archive)
    if body is None:
        raise Refused("broken")
    for paragraph in body.findall(f"{_W}p"):
        text = _run_text(paragraph).strip()
        if not text:
            continue
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        name = names.get(style.get(f"{_W}val"), default) if style is not None else default
        if found := HEADING_STYLE.search(name):
            yield "heading", text, int(found[1] or found[2])
        else:
            yield ("list" if any(s in name for s in LIST_STYLES) else "paragraph"), text, None
    for table in body.findall(f"{_W}tbl"):
        rows, above = [], []
        for row in table.findall(f"{_W}tr"):
            above = _cells(row, above)
            rows.append(" | ".join(above))
        if rows:
            yield "table", "\n".join(rows), None


def _pdf_blocks(content: bytes) -> Iterator[tuple[int, Block]]:
    """Blocks of each page: a short single line without a sentence's end is a heading; each picture is a block behind the text."""
    for page, (texts, pictures) in enumerate(pdf_pages(content), 1):
        for text in texts:
            heading = len(text) <= HEADING_CHARS and "\n" not in text and text[-1] not in SENTENCE_ENDS
            yield page, ("heading" if heading else "paragraph", text, 1 if heading else None)
        for k in range(pictures):
            yield page, ("image", f"{PICTURE} {k + 1}", None)


def _file_rows(name: str | None, kind: str | None, content: bytes | None) -> Iterator[tuple]:
    title = re.sub(r"(.)\.[^.]+$", r"\1", name or "")
    try:
        if kind == KINDS["docx"]:
            found = ((1, b) for b in docx_blocks(content or b""))
        elif kind == KINDS["pdf"]:
            found = _pdf_blocks(content or b"")
        else:
            raise Refused("unsupported")
        places: dict[int, int] = {}
        for page, (what, text, level) in list(found):
            places[page] = places.get(page, -1) + 1
            yield name, title, page, places[page], what, text, level, None
    except Refused as why:
        yield name, title, None, None, None, None, None, str(why)
    except (zipfile.BadZipFile, KeyError, ValueError, TypeError, IndexError, ElementTree.ParseError, NotImplementedError, EOFError, RecursionError):
        yield name, title, None, None, None, None, None, "broken"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32()}
    columns = [c.split() for c in _SCHEMA.split(", ")]
    lists = zip(*rows, strict=True) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(list(x), kinds[k]) for x, (_, k) in zip(lists, columns, strict=True)], names=[n for n, _ in columns])


def parsed_files(files: DataFrame) -> DataFrame:
    """The blocks of files (name, content); what a file is goes by its first bytes and extension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                # one content at a time is a Python object
                for row in _file_rows(*(batch.column(c)[i].as_py() for c in ("name", "kind", "content"))):
                    rows.append(row)
                    if len(rows) >= BLOCKS:
                        yield _batch(rows)
                        rows = []
        yield _batch(rows)

    by_name = F.regexp_extract(F.lower("name"), r"\.(docx|pdf)$", 1)
    claimed = F.when(by_name == "docx", KINDS["docx"]).when(by_name == "pdf", KINDS["pdf"])
    # a broken file is reported as what its name says
    return files.select("name", F.coalesce(sniffed(F.col("name"), F.col("content")), claimed).alias("kind"), "content").mapInArrow(run, _SCHEMA)


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all PDF and DOCX files of a folder."""
    return parsed_files(read_files(spark, path).where(F.lower("name").rlike(r"\.(pdf|docx)$")))


_INVALID = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def written_docx(blocks: list[Block]) -> bytes:
    """A file with these blocks; characters that XML does not have go. A table's rows are its lines, its cells stand between bars."""
    text = lambda t: "</w:t><w:br/><w:t xml:space='preserve'>".join(escape(_INVALID.sub("", x)) for x in t.split("\n"))
    paragraph = lambda t, style: f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t xml:space='preserve'>{text(t)}</w:t></w:r></w:p>"
    body, levels = [], sorted({level for kind, _, level in blocks if kind == "heading"})
    for kind, t, level in blocks:
        if kind == "table":
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c, '')}</w:tc>" for c in row.split(" | ")) + "</w:tr>" for row in t.split("\n")) + "</w:tbl>")
        else:
            body.append(paragraph(t, {"heading": f"H{level}", "list": "L"}.get(kind, "")))
    name = _W[1:-1]
    styles = [("N", "Normal", " w:default='1'"), ("L", "List Bullet", ""), *((f"H{k}", f"heading {k}", "") for k in levels)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for part, data in (
            ("[Content_Types].xml", "<Types xmlns='http://schemas.openxmlformats.org/package/2006/content-types'><Default Extension='xml' ContentType='application/xml'/></Types>"),
            ("word/styles.xml", f"<w:styles xmlns:w='{name}'>" + "".join(f"<w:style w:type='paragraph' w:styleId='{i}'{d}><w:name w:val='{n}'/></w:style>" for i, n, d in styles) + "</w:styles>"),
            ("word/document.xml", f"<w:document xmlns:w='{name}'><w:body>{''.join(body)}</w:body></w:document>"),
        ):
            archive.writestr(zipfile.ZipInfo(part, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def as_files(docs: DataFrame, kind: str) -> DataFrame:
    """name and content of a file for each document (id, title, blocks: array of kind, text, level): docx, or pdf with a page for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blocks = [(b["kind"], b["text"] or "", b["level"]) for b in batch.column("blocks")[i].as_py() or []]
                content = written_docx(blocks) if kind == "docx" else written_pdf([[t] for _, t, _ in blocks])
                yield pa.RecordBatch.from_arrays([pa.array([f"{batch.column('id')[i].as_py()}.{kind}"]), pa.array([content], pa.binary())], names=["name", "content"])

    return docs.select(F.col("id").cast("string"), "blocks").mapInArrow(run, "name string, content binary")
