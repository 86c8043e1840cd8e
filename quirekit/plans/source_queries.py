"""Readers and writers exercised on bytes and texts made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.functions import sinks
from quirekit.functions.lines import content_lines
from quirekit.functions.rewrite import squash
from quirekit.plans.html_queries import DOC_HTML_SQL, doc_html
from quirekit.plans.line_queries import DOCX_LINES
from quirekit.plans.registry import inject, query, sql_inject, sql_squash, sql_strip, table, text_table
from quirekit.sources import delimited, files, office

_L = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql_strip('l')}), lambda l: l <> '')"


def _csv_text(spark, sf_dir):
    """Each document as a small quoted CSV file: line number, line, first word."""
    docs = text_table(spark, sf_dir, "documents", "doc_id").filter("text <> ''")
    cell = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    rows = F.transform(
        content_lines(F.col("text")),
        lambda line, i: F.concat((i + 1).cast("string"), F.lit(","), cell(line), F.lit(","), cell(F.substring_index(line, " ", 1))),
    )
    return docs.select("doc_id", F.concat(F.lit("no,line,first\n"), F.array_join(rows, "\n"), F.lit("\n")).alias("raw"))


_NARRATED = f"""SELECT doc_id, '[CSV INPUT]' || chr(10) || 'Columns (3): no | line | first' || chr(10) || 'Rows:' || coalesce(chr(10) || nullif(array_to_string(list_transform({_L},
  lambda l, i: 'Row ' || i || ': no=' || i || ' | line=' || l || ' | first=' || split_part(l, ' ', 1)), chr(10)), ''), '') AS result FROM documents WHERE text <> ''"""


@query("src_06_csv_narration", _NARRATED)
def csv_narration(spark, sf_dir):
    # The dialect is known here, so lines are parsed as plain CSV.
    raw = _csv_text(spark, sf_dir)
    return raw.select("doc_id", delimited.narrate(rows_with_commas(F.col("raw"))).alias("result"))


def rows_with_commas(raw):
    """Quoted comma-separated lines as rows, without leaving the JVM."""
    parsed = F.transform(
        F.filter(F.split(raw, "\n"), lambda line: line != ""),
        lambda line: F.transform(
            F.regexp_extract_all(line, F.lit(r'(?:\A|,)("[^"]*(?:""[^"]*)*"|[^,"]*)'), F.lit(1)),
            lambda cell: F.replace(F.regexp_replace(cell, r'\A"|"\z', ""), F.lit('""'), F.lit('"')),
        ),
    )
    return parsed


@query("src_04_sniffed_csv_rows", f"SELECT doc_id, len({_L})::BIGINT + 1 AS row_count FROM documents WHERE text <> ''")
def sniffed_csv_rows(spark, sf_dir):
    raw = _csv_text(spark, sf_dir).select("doc_id", F.regexp_replace("raw", '"', "'").alias("raw"))
    return raw.select("doc_id", F.size(delimited.rows_of("raw")).cast("bigint").alias("row_count"))


@query(
    "src_05_tsv_cells",
    """SELECT c_custkey, len(string_split(c_name || ',x,' || c_mktsegment || ',1,5', ','))::BIGINT AS compat_cells, 3::BIGINT AS cells FROM customer""",
)
def tsv_cells(spark, sf_dir):
    raw = F.concat("c_name", F.lit(",x\t"), "c_mktsegment", F.lit("\t1,5"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    width = lambda text: F.size(rows_with_commas(text)[0]).cast("bigint")
    return customers.select(
        "c_custkey",
        width(delimited.tsv_as_csv(F.col("raw"))).alias("compat_cells"),
        width(delimited.tsv_as_csv(F.col("raw"), compat=False)).alias("cells"),
    )


_S = sql_strip("l")


@query(
    "src_10_docx_round_trip",
    f"""SELECT doc_id, array_to_string(list_transform(list_filter(string_split({sql_inject('text', 'doc_id', DOCX_LINES)}, chr(10)), lambda l: {_S} <> '' AND NOT ({_S} LIKE '|%|' AND length({_S}) >= 2)),
      lambda l: CASE WHEN {_S} = '[[PAGE BREAK]]' THEN '' ELSE regexp_replace({_S}, '^(#{{1,3}} |[0-9]+\\.\\s+|[-*] )', '') END), chr(10)) AS text FROM documents""",
)
def docx_round_trip(spark, sf_dir):
    """SNK-02 writes word-processor files, SRC-10 reads them back."""
    docs = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", inject(F.col("text"), F.col("doc_id"), DOCX_LINES).alias("text"))
    lines = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            sinks.line_kind(line).alias("kind"),
            F.when(sinks.line_kind(line) == "table", line).otherwise(sinks.line_text(line)).alias("text"),
        ),
    )
    return docs.select("doc_id", office.docx_text_of(office.docx_bytes_of(lines)).alias("text"))


@query(
    "src_13_epub_round_trip",
    f"SELECT doc_id, {sql_squash(chr(39) + 'Untitled' + chr(39))} || '' AS first_title, length(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[^a-z]', '', 'g')) > 0 AS has_text FROM {DOC_HTML_SQL}",
)
def epub_round_trip(spark, sf_dir):
    """SNK-04 writes an e-book per document, SRC-13 reads its text back."""
    books = doc_html(spark, sf_dir).select("doc_id", "html", sinks.chapters(F.lit("Untitled"), F.col("html")).alias("chapters"))
    read = books.select(
        "doc_id", "html", F.col("chapters")[0]["title"].alias("first"),
        office.epub_text_of(office.epub_bytes_of(F.lit("Book"), F.lit("en"), F.col("chapters"))).alias("text"),
    )
    letters = lambda c: F.regexp_replace(c, "[^a-z]", "")
    whole = F.contains(letters(F.col("text")), letters(F.regexp_replace(F.substring_index("html", "</p>", 1), "<[^>]+>", " ")))
    return read.select(
        "doc_id", F.when(F.col("first").isNotNull(), "Untitled").alias("first_title"), (whole & (F.length(letters(F.col("text"))) > 0)).alias("has_text")
    )


@query(
    "src_15_mail_texts",
    f"""SELECT conv_id, turn, 'Subject: Turn ' || turn || chr(10) || 'From: ' || role || '@example.org' || chr(10) || 'To: all@example.org' || chr(10) || 'Date: ' || chr(10) || chr(10)
      || {sql_squash("CASE WHEN turn % 2 = 1 THEN ' ' || text || ' ' ELSE text END")} AS mail FROM conversations""",
)
def mail_texts(spark, sf_dir):
    """Conversation turns as mail, plain or HTML, read back by the mail reader."""
    turns = table(spark, sf_dir, "conversations")
    head = F.concat(F.lit("Subject: Turn "), F.col("turn").cast("string"), F.lit("\nFrom: "), "role", F.lit("@example.org\nTo: all@example.org\n"))
    markup = F.concat(F.lit("Content-Type: text/html; charset=utf-8\n\n<script>x()</script><p>"), F.replace("text", F.lit("<"), F.lit("(")), F.lit("</p>"))
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\n\n"), "text")
    raw = F.encode(F.concat(head, F.when(F.col("turn") % 2 == 1, markup).otherwise(plain)), "UTF-8")
    read = turns.select("conv_id", "turn", office.eml_text_of(raw).alias("mail"))
    body = F.substring_index("mail", "\n\n", 1)
    rest = squash(F.expr("substring(mail, length(substring_index(mail, '\n\n', 1)) + 3)"))
    return read.select("conv_id", "turn", F.concat(body, F.lit("\n\n"), rest).alias("mail"))


@query(
    "src_25_changed_files",
    """SELECT event_id FROM events WHERE event_id % 3 <> 0 OR ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY - INTERVAL 1 SECOND""",
)
def changed_files(spark, sf_dir):
    """Events stand in for files: a third is known from before, those of the last seven days were touched since."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("path"), F.col("ts").alias("modificationTime"))
    started = events.select(F.max("modificationTime") - F.expr("INTERVAL 7 DAYS")).scalar()
    listed = events.withColumn("started", started)
    known = events.filter(F.col("event_id") % 3 == 0)
    return files.changed_files(listed, known, F.col("started")).select("event_id")


@query(
    "src_26_config_defaults",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE json_extract(props, '$.k')::BIGINT END AS k, 'auto' AS mode FROM events""",
)
def config_defaults(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, "{broken").otherwise(F.col("props"))
    settings = files.config_column(raw, "k bigint, mode string", {"k": 0, "mode": "auto"})
    return table(spark, sf_dir, "events").select("event_id", settings.alias("s")).select("event_id", F.col("s.k").cast("bigint").alias("k"), "s.mode")


ARTICLES = [
    (2, 0, '<div class="x articleFromDB" data-a="1" id="article12">a</div><div class="articleFromDB" id="article7">b</div><div class="articleFromDB" id="article12">c</div>'),
    (3, 0, "<a href='/newspaper/article/55'>x</a><a href='/newspaper/article/3'>y</a><a href='/newspaper/article/55'>z</a>"),
]
_BY_CLASS = "regexp_extract_all(h, '(?i)class=\"[^\"]*articleFromDB[^\"]*\"[^>]*id=\"article([0-9]+)\"', 1)"
_BY_URL = "regexp_extract_all(h, '/newspaper/article/([0-9]+)', 1)"


@query(
    "joi_10_page_articles",
    f"""WITH p AS (SELECT page_id, {sql_inject('html', 'page_id', ARTICLES)} AS h FROM pages), a AS (SELECT page_id, CASE WHEN len({_BY_CLASS}) > 0 THEN {_BY_CLASS} ELSE {_BY_URL} END AS ids FROM p),
    e AS (SELECT page_id, unnest(ids) AS article, generate_subscripts(ids, 1) AS pos FROM a)
    SELECT page_id, article, (row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1)::BIGINT AS place FROM e GROUP BY page_id, article""",
)
def page_articles(spark, sf_dir):
    """SRC-24: article ids a page lists, distinct in order; ids by class win over ids in links."""
    pages = text_table(spark, sf_dir, "pages", "page_id").select("page_id", inject(F.col("html"), F.col("page_id"), ARTICLES).alias("html"))
    by_class = F.regexp_extract_all("html", F.lit('(?i)class="[^"]*articleFromDB[^"]*"[^>]*id="article([0-9]+)"'), F.lit(1))
    by_url = F.regexp_extract_all("html", F.lit("/newspaper/article/([0-9]+)"), F.lit(1))
    ids = F.array_distinct(F.when(F.size(by_class) > 0, by_class).otherwise(by_url))
    found = pages.select("page_id", F.posexplode(ids).alias("place", "article"))
    return found.select("page_id", F.col("place").cast("bigint"), "article")
