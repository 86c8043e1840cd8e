"""Folders of mixed files and their outputs (SRC-01 to SRC-03, SRC-25, SRC-26, SNK-08, SNK-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.functions import fixed
from quirekit.functions.models import literal_map
from quirekit.functions.text import base_name, file_extension
from quirekit.sources import delimited, office

SUPPORTED = {e: family for family, extensions in fixed.EXTENSION_FAMILIES.items() for e in extensions}
# Formats whose decoding needs software outside Spark and the standard library.
EXTERNAL = [".pdf", ".xls", ".ppt", ".mobi", *fixed.EXTENSION_FAMILIES["image"], *fixed.EXTENSION_FAMILIES["renderable"]]


def scan_folder(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """SRC-01: supported files below a folder. Contents are not read until ``content`` is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder).withColumn("ext", file_extension(F.col("path")))
    visible = ~base_name(F.col("path")).startswith(".")
    return files.filter(visible & F.col("ext").isin(list(SUPPORTED))).withColumn("family", literal_map(SUPPORTED)[F.col("ext")])


def read_texts(files: DataFrame) -> DataFrame:
    """SRC-03..16: text of every readable file, and the problem of each that is not; the files are read once.

    Only packaged and delimited formats go to a Python worker, with their own bytes; the rest stays in the engine.
    Bytes that are no UTF-8 are dropped. A damaged file has a null text and says why, as do formats in ``EXTERNAL``.
    """
    from quirekit.functions.text import source_html_text

    ext = F.col("ext")
    plain = [e for e in fixed.EXTENSION_FAMILIES["source_text"] if e not in office.READERS and e not in (".csv", ".tsv") and e not in EXTERNAL]
    text_like = utf8_text(F.col("content"))
    raw = F.when(ext == ".csv", text_like).when(ext == ".tsv", delimited.tsv_as_csv(text_like))
    packaged = office.read_of(ext, F.when(ext.isin(list(office.READERS)), F.col("content")))
    read = files.select("path", "ext", "family", "content", packaged.alias("_read"), delimited.rows_of(raw).alias("_rows"))
    text = (
        F.when(ext.isin(".csv", ".tsv"), delimited.narrate(F.col("_rows")))
        .when(ext == ".xlsx", sheet_text(F.col("_read.rows")))
        .when(ext.isin(list(office.READERS)), F.col("_read.text"))
        .when(ext.isin(".html", ".htm"), source_html_text(text_like))
        .when(ext.isin(plain), text_like)
    )
    problem = F.coalesce(F.col("_read.problem"), F.when(ext.isin(EXTERNAL), "needs an external decoder"))
    return read.select("path", "ext", "family", F.when(problem.isNull(), text).alias("text"), problem.alias("problem"))


def utf8_text(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 is dropped."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def sheet_text(rows: Column) -> Column:
    """SRC-07: a banner per sheet, then its rows with cells joined by bars."""
    from quirekit.functions.lines import with_previous

    told = with_previous(
        rows,
        lambda cur, prev: F.concat(
            F.when(prev.isNull() | (prev["sheet"] != cur["sheet"]), F.concat(F.lit("\n[--- Tab: "), cur["sheet"], F.lit(" ---]\n"))).otherwise(""),
            F.array_join(cur["cells"], " | "), F.lit("\n"),
        ),
    )
    return F.array_join(told, "")


def sheet_datasets(files: DataFrame) -> DataFrame:
    """SRC-08: one row per sheet: ``path, sheet, headers, rows``; the first row holds the headers."""
    books = files.filter(F.col("ext") == ".xlsx").select("path", office.xlsx_rows_of("content").alias("book"))
    names = F.array_distinct(F.transform("book", lambda r: r["sheet"]))
    # a workbook is one row already, so its sheets are taken apart inside it
    sheets = books.select("path", "book", F.explode(names).alias("sheet"))
    cells = F.transform(F.filter("book", lambda r: r["sheet"] == F.col("sheet")), lambda r: r["cells"])
    taken = sheets.select("path", "sheet", cells.alias("cells"))
    return taken.select(
        "path", "sheet", F.col("cells")[0].alias("headers"), F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))).alias("rows")
    )


def changed_files(files: DataFrame, before: DataFrame, started: Column) -> DataFrame:
    """SRC-25: files that are new, or were touched since just before a scan started."""
    known = before.select("path").distinct().withColumn("_known", F.lit(True))
    touched = F.col("modificationTime") >= started - F.expr("INTERVAL 1 SECOND")
    return files.join(known, "path", "left").filter(F.col("_known").isNull() | touched).drop("_known")


def config_column(raw: Column, schema: str, defaults: dict[str, object]) -> Column:
    """SRC-26: JSON settings with a default for every missing field; unreadable JSON gives all defaults."""
    parsed = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    return F.struct(*[F.coalesce(parsed[name], F.lit(value)).alias(name) for name, value in defaults.items()])


def write_outputs(frame: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """SNK-08/09: texts by format. Spark's commit protocol publishes a task's files only when it has finished,
    so a lost executor leaves nothing half-written; ``mode`` carries the collision policy."""
    frame.select("fmt", "path", "text").write.partitionBy("fmt").mode(mode).parquet(folder)


def write_merged(frame: DataFrame, folder: str, order: str = "ordinal") -> None:
    """SNK-12: one merged text as ordered part files; no single task ever holds it all."""
    frame.repartitionByRange(F.col(order)).sortWithinPartitions(order).select("text").write.text(folder)
