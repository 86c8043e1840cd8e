from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quirekit.sources import delimited, files, office

NS = {"s": office.SHEET.strip("{}"), "a": office.DRAW.strip("{}"), "p": office.SLIDE.strip("{}")}
REL = office.LINK.split("}")[0].strip("{")


def pack(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, content in entries.items():
            archive.writestr(name, content)
    return buffer.getvalue()


def workbook():
    sheet = (
        f'<worksheet xmlns="{NS["s"]}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row>'
        '<row r="2"><c r="A2"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c></row></sheetData></worksheet>'
    )
    return pack({
        "xl/workbook.xml": f'<workbook xmlns="{NS["s"]}" xmlns:r="{REL}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{NS["s"]}"><si><t>head</t></si><si><t> </t></si></sst>',
        "xl/worksheets/sheet1.xml": sheet,
    })


def slides():
    def shape(x, y, text):
        return f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'

    body = f'<p:sld xmlns:p="{NS["p"]}" xmlns:a="{NS["a"]}">' + shape(5, 9, "low") + shape(9, 1, "right") + shape(1, 1, "left") + "</p:sld>"
    return pack({"ppt/slides/slide1.xml": body, "ppt/slides/slide10.xml": body.replace("low", "ten"), "ppt/slides/slide2.xml": body})


MAIL = (
    b"Subject: Hi\nFrom: a@x\nTo: b@x\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>html</p>\n"
    b"--B\nContent-Type: text/plain\n\nplain\n--B\nContent-Type: text/plain\nContent-Disposition: attachment\n\nno\n--B--\n"
)


def test_workbook_rows():
    assert office.xlsx_rows(workbook()) == [
        {"sheet": "One", "row_no": 1, "cells": ["head", "", "n"]}, {"sheet": "One", "row_no": 2, "cells": ["0"]},
    ]


def test_slides_in_reading_order():
    text = office.pptx_slides(slides()).split("\n")
    assert text[:4] == ["[--- Slide: 1 ---]", "left", "right", "low"] and text[-1] == "ten"


def test_mail_prefers_plain_text():
    assert office.eml_text(MAIL).split("\n")[:6] == ["Subject: Hi", "From: a@x", "To: b@x", "Date: ", "", "plain"]


def test_fb2_and_epub():
    book = b'<FictionBook xmlns="x"><body><section><p>One</p></section><section/></body></FictionBook>'
    assert office.fb2_text(book) == "\n[--- Page: 1 ---]\nOne\n"
    made = office.epub_document("T", "en", [{"title": "A", "content": "<p>hello</p>"}, {"title": "B", "content": "there"}])
    words = office.epub_text(made).split()
    assert words.index("hello") < words.index("there")


def test_docx_tables_are_not_paragraphs():
    lines = [{"kind": "heading1", "text": "T"}, {"kind": "table", "text": "| a | b |"}, {"kind": "table", "text": "|---|---|"}, {"kind": "paragraph", "text": "x & y"}]
    assert office.docx_paragraphs(office.docx_document(lines)) == "T\nx & y"


def test_narration(spark):
    raw = spark.createDataFrame([(0, "a;b\n1;long cell\n2;\n3;z\n"), (1, " ")], "i int, raw string")
    rows = raw.select("i", delimited.rows_of("raw").alias("rows"))
    got = [r.t for r in rows.select("i", delimited.narrate(F.col("rows"), max_rows=2, max_cell=3).alias("t")).orderBy("i").collect()]
    assert got[0].split("\n") == [
        "[CSV INPUT]", "Columns (2): a | b", "Rows:", "Row 1: a=1 | b=lon...", "Row 2: a=2 | b=", "[Truncated: showing first 2 data rows of 3]",
    ]
    assert got[1] == ""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("mixed")
    (root / "sub").mkdir()
    (root / "a.txt").write_text("plain")
    (root / "b.html").write_text("<script>x</script><p>web</p>")
    (root / "sub" / "c.csv").write_text("h,i\n1,2\n")
    (root / "d.eml").write_bytes(MAIL)
    (root / "e.xlsx").write_bytes(workbook())
    (root / "f.pdf").write_bytes(b"%PDF")
    (root / ".hidden.txt").write_text("no")
    (root / "g.zzz").write_text("no")
    return str(root)


def test_folder_scan_and_texts(spark, folder):
    found = files.scan_folder(spark, folder)
    names = {r.path.rsplit("/", 1)[1]: r.family for r in found.select("path", "family").collect()}
    assert names == {
        "a.txt": "source_text", "b.html": "source_text", "c.csv": "source_text", "d.eml": "source_text", "e.xlsx": "source_text", "f.pdf": "pdf",
    }
    texts = {r.path.rsplit("/", 1)[1]: (r.text, r.problem) for r in files.read_texts(found).collect()}
    assert texts["a.txt"] == ("plain", None) and texts["b.html"][0].split() == ["web"]
    assert "Row 1: h=1 | i=2" in texts["c.csv"][0] and texts["e.xlsx"][0] == "\n[--- Tab: One ---]\nhead |  | n\n0\n"
    assert texts["f.pdf"] == (None, "needs an external decoder")
    sheet = files.sheet_datasets(found).first()
    assert (sheet.sheet, sheet.headers, sheet.rows) == ("One", ["head", "", "n"], [["0"]])


def test_flat_scan(spark, folder):
    assert files.scan_folder(spark, folder, recursive=False).filter("ext = '.csv'").count() == 0


def test_outputs(spark, tmp_path):
    rows = spark.createDataFrame([("txt", "/a", "x", 2), ("md", "/b", "y", 1)], "fmt string, path string, text string, ordinal int")
    files.write_outputs(rows, str(tmp_path / "out"))
    assert sorted(r.fmt for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["md", "txt"]
    files.write_merged(rows, str(tmp_path / "merged"))
    parts = sorted((tmp_path / "merged").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == ["y", "x"]


def test_config_defaults(spark):
    raw = spark.createDataFrame([('{"k": 3}',), ("{oops",)], "raw string")
    got = raw.select(files.config_column(F.col("raw"), "k int, m string", {"k": 1, "m": "auto"}).alias("c")).collect()
    assert [(r.c.k, r.c.m) for r in got] == [(3, "auto"), (1, "auto")]


def test_damaged_files_are_rows_of_their_own(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"caf\xe9 ok")
    (tmp_path / "good.txt").write_text("fine \u00e9", encoding="utf-8")
    (tmp_path / "broken.docx").write_bytes(b"PK no archive")
    (tmp_path / "broken.xlsx").write_bytes(workbook()[:40])
    (tmp_path / "table.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    frame = files.read_texts(files.scan_folder(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.problem) for r in frame.collect()}
    assert got["bad.txt"] == ("caf ok", None) and got["good.txt"] == ("fine \u00e9", None)
    assert got["broken.docx"][0] is None and got["broken.docx"][1].startswith("cannot be read")
    assert got["broken.xlsx"][0] is None and got["broken.xlsx"][1].startswith("cannot be read")
    assert "a=1" in got["table.csv"][0] and got["table.csv"][1] is None
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan binaryFile") == 1


def test_long_rows_go_to_python_in_small_batches(spark, tmp_path):
    """Rows of tables are sent to Python workers by bytes, not by a number of rows whatever their length."""
    from pyspark.sql import functions as F

    from quirekit.sources.tables import read_table

    @F.pandas_udf("long", F.PandasUDFType.SCALAR)
    def batch_rows(text):
        return text.map(lambda _: len(text))

    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(conf)
    spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = read_table(spark, str(tmp_path), "documents").coalesce(1).select(batch_rows("text").alias("n"))
    row = got.agg(F.count("*").alias("rows"), F.max("n").alias("most")).first()
    assert row.rows == 300 and row.most <= 60
