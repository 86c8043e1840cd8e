"""Office, e-book and mail documents as columns of bytes (SRC-07 to SRC-16, SNK-02, SNK-04).

The containers are zip archives of XML, so the standard library opens them. Each
helper handles one document; Spark spreads the documents.
"""

from __future__ import annotations

import email
import io
import re
import zipfile
from email import policy
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

SHEET_ROWS = ArrayType(
    StructType(
        [
            StructField("sheet", StringType()),
            StructField("row_no", LongType()),
            StructField("cells", ArrayType(StringType())),
        ]
    )
)


def _texts(element, tag: str) -> str:
    return "".join(node.text or "" for node in element.iter(tag))


def docx_paragraphs(content: bytes) -> str:
    """SRC-10: body paragraphs, one per line; tables are not read."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORD}body")
    return "\n".join(_texts(p, f"{WORD}t") for p in body.findall(f"{WORD}p"))


def pptx_slides(content: bytes) -> str:
    """SRC-11: a banner per slide, then its text shapes from top to bottom and left to right."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        parts = []
        for number, name in enumerate(sorted(names, key=lambda n: int(re.findall(r"\d+", n)[-1])), 1):
            shapes = []
            for shape in ElementTree.fromstring(archive.read(name)).iter(f"{SLIDE}sp"):
                offset = shape.find(f".//{DRAW}off")
                place = (0, 0) if offset is None else (int(offset.get("y")), int(offset.get("x")))
                lines = [_texts(p, f"{DRAW}t") for p in shape.iter(f"{DRAW}p")]
                if any(lines):
                    shapes.append((place, "\n".join(lines)))
            parts.append("\n".join([f"[--- Slide: {number} ---]", *(text for _, text in sorted(shapes))]))
    return "\n".join(parts)


def xlsx_rows(content: bytes) -> list[dict]:
    """SRC-07/08: non-blank rows of every sheet in order; empty cells are empty strings, zeros are kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            table = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
            shared = [_texts(item, f"{SHEET}t") for item in table.iter(f"{SHEET}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        found = []
        for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            target = links[sheet.get(LINK)].lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            for row in ElementTree.fromstring(archive.read(path)).iter(f"{SHEET}row"):
                cells: list[str] = []
                for cell in row.iter(f"{SHEET}c"):
                    column = 0
                    for letter in re.match(r"[A-Z]*", cell.get("r", "")).group():
                        column = column * 26 + ord(letter) - 64
                    cells += [""] * (column - 1 - len(cells))
                    value = cell.findtext(f"{SHEET}v") or ""
                    if cell.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = _texts(cell, f"{SHEET}t")
                    cells.append(value.strip())
                if any(cells):
                    found.append({"sheet": sheet.get("name"), "row_no": int(row.get("r", len(found) + 1)), "cells": cells})
    return found


def epub_text(content: bytes) -> str:
    """SRC-13: text of the content documents in reading order, tags as blanks."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        root = next(node.get("full-path") for node in container.iter() if node.tag.endswith("rootfile"))
        package = ElementTree.fromstring(archive.read(root))
        hrefs = {n.get("id"): n.get("href") for n in package.iter() if n.tag.endswith("}item")}
        base = root.rpartition("/")[0]
        pages = []
        for ref in (n.get("idref") for n in package.iter() if n.tag.endswith("}itemref")):
            name = f"{base}/{hrefs[ref]}" if base else hrefs[ref]
            pages.append(re.sub(r"<[^>]+>", " ", archive.read(name).decode("utf-8", "ignore")))
    return "\n".join(pages)


def fb2_text(content: bytes) -> str:
    """SRC-16: a banner and the text of every section that has any."""
    root = ElementTree.fromstring(content)
    sections = [s for s in root.iter() if s.tag.endswith("section")]
    texts = ["\n".join("".join(p.itertext()) for p in s.iter() if p.tag.endswith("}p")) for s in sections]
    return "".join(f"\n[--- Page: {n} ---]\n{text}\n" for n, text in enumerate(texts, 1) if text.strip())


def eml_text(content: bytes) -> str:
    """SRC-15: four header lines, a blank line, then the first plain body or else the first HTML one as text."""
    message = email.message_from_bytes(content, policy=policy.default)
    plain = markup = None
    for part in message.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        if part.get_content_type() == "text/plain" and plain is None:
            plain = part.get_content()
        elif part.get_content_type() == "text/html" and markup is None:
            bare = re.sub(r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " ", part.get_content())
            markup = re.sub(r"<[^>]+>", " ", bare)
    headers = [f"{name.title()}: {message.get(name, '')}" for name in ("subject", "from", "to", "date")]
    return "\n".join([*headers, "", plain or markup or ""])


def _zip(entries: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in entries.items():
            # a fixed time stamp keeps equal documents equal byte for byte
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return buffer.getvalue()


_RELS = (
    '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"'
    ' Target="word/document.xml"/></Relationships>'
)
_TYPES = (
    '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml"'
    ' ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
STYLES = {
    "heading1": "Heading1", "heading2": "Heading2", "heading3": "Heading3", "number": "ListNumber", "bullet": "ListBullet",
}
# XML 1.0 has no place for these characters.
_FORBIDDEN = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _xml(text: str) -> str:
    return escape(_FORBIDDEN.sub("", text))


def docx_document(lines) -> bytes:
    """SNK-02: lines of known kind as a word-processor document; neighbouring table lines form one table."""
    body, table = [], []

    def paragraph(text: str, style: str | None = None) -> str:
        look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{look}<w:r><w:t xml:space="preserve">{_xml(text)}</w:t></w:r></w:p>'

    def close_table() -> None:
        rows = [[cell.strip() for cell in line.strip().strip("|").split("|")] for line in table]
        if len(rows) > 1 and all(re.fullmatch(r":?-{3,}:?", cell) for cell in rows[1]):
            del rows[1]
        width = max((len(row) for row in rows), default=0)
        if rows:
            cells = ["".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row + [""] * (width - len(row))) for row in rows]
            body.append("<w:tbl>" + "".join(f"<w:tr>{row}</w:tr>" for row in cells) + "</w:tbl>")
        table.clear()

    for line in lines:
        if line["kind"] == "table":
            table.append(line["text"])
            continue
        close_table()
        if line["kind"] == "page_break":
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        elif line["kind"] != "blank":
            body.append(paragraph(line["text"], STYLES.get(line["kind"])))
    close_table()
    namespace = WORD.strip("{}")
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{namespace}"><w:body>{"".join(body)}</w:body></w:document>'
    return _zip({"[Content_Types].xml": _TYPES, "_rels/.rels": _RELS, "word/document.xml": document})


def epub_document(title: str, lang: str, chapters) -> bytes:
    """SNK-04: one content document per chapter."""
    names = [f"chap_{n}.xhtml" for n in range(1, len(chapters) + 1)]
    pages = {
        f"OEBPS/{name}": f"<html lang=\"{lang}\"><head><title>{_xml(c['title'])}</title></head><body><h1>{c['title']}</h1><div>{c['content']}</div></body></html>"
        for name, c in zip(names, chapters)
    }
    items = "".join(f'<item id="c{n}" href="{name}" media-type="application/xhtml+xml"/>' for n, name in enumerate(names))
    spine = "".join(f'<itemref idref="c{n}"/>' for n in range(len(names)))
    package = (
        '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata'
        f' xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{_xml(title)}</dc:title><dc:language>{lang}</dc:language></metadata>'
        f"<manifest>{items}</manifest><spine>{spine}</spine></package>"
    )
    container = (
        '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles>'
        '<rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    )
    return _zip({"mimetype": "application/epub+zip", "META-INF/container.xml": container, "OEBPS/content.opf": package, **pages})


def _column(fn, returns):
    @F.pandas_udf(returns)
    def udf(content: pd.Series) -> pd.Series:
        return content.map(lambda value: None if value is None else fn(value))

    return udf


docx_text_of = _column(docx_paragraphs, StringType())
xlsx_rows_of = _column(xlsx_rows, SHEET_ROWS)
epub_text_of = _column(epub_text, StringType())
eml_text_of = _column(eml_text, StringType())
READERS = {".docx": docx_paragraphs, ".pptx": pptx_slides, ".epub": epub_text, ".fb2": fb2_text, ".eml": eml_text, ".xlsx": xlsx_rows}


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("rows", SHEET_ROWS), StructField("problem", StringType())]))
def read_of(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
    """Text or sheet rows of packaged files by extension; one damaged file gives its problem and stops no other."""
    out = []
    for kind, value in zip(ext, content):
        text = rows = problem = None
        if value is not None:
            try:
                got = READERS[kind](value)
                text, rows = (None, got) if kind == ".xlsx" else (got, None)
            except Exception as damage:  # noqa: BLE001 whatever a damaged file sets off belongs to that file
                problem = f"cannot be read: {type(damage).__name__}"
        out.append((text, rows, problem))
    return pd.DataFrame(out, columns=["text", "rows", "problem"])


docx_bytes_of = _column(docx_document, BinaryType())


@F.pandas_udf(BinaryType())
def epub_bytes_of(title: pd.Series, lang: pd.Series, chapters: pd.Series) -> pd.Series:
    return pd.Series([epub_document(t, code, list(cs)) for t, code, cs in zip(title, lang, chapters)])

