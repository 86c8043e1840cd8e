"""Text repair queries over ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.functions import fixed, text
from quirekit.plans.registry import (
    inject, query, quote, re2, sql_inject, sql_replace, sql_rewrite, sql_squash, sql_strip, text_table,
)

# Fragments appended to the given texts, so that every rule has something to rewrite.
ARTIFACTS = [
    (3, 0, " Itâ€™s â€œquotedâ€ – and — ‘so’ “on” Âten"),
    (5, 1, " plain’s end"),
]
PUNCTUATION = [
    (2, 0, " Met at Main-road.- Then left,-right. Old Bay-Street,- and x.- 9"),
    (7, 3, " along the Sea-parade.-"),
]
CURRENCY = [(2, 1, " Paid £3/10/- and 7/- or 3d. for £12, £15/- in 3days"), (9, 0, " only £4")]
QUOTES = [
    (2, 0, "\n'Don't go,' he said. 'Tis the boys' turn, 'round the 'bend'."),
    (5, 2, "\nrock 'n' roll ''twas' 'em"),
]
WRAPS = [(3, 1, " He was walk-ing to the settle-ments, well-known, re-ed and govern-ance")]
NOISE = [(4, 0, '\n"12" - 34"\nsay "12 ok"\n" 9 "')]
BOOK = [
    (3, 0, "\nChapter 1: Dawn\n12\n[Original Page Number: 12]\n[Original Page Number: 15]\n\n\n\nEnd"),
    (2, 1, "x## Heading walk-ing 'hello there' it's"),
    (5, 0, "\n\"34\" 5\nlast one...Books by A Writer\n[Original Page Number: 3]\n[Original Page Number: 3]"),
]
IMAGES = [
    (3, 0, ' <img alt="a" src="data:image/png;base64,' + "QUJD" * 12 + '"> tail'),
    (4, 1, " <p>x</p><img src='data:image/gif;base64,AAAA' class=\"b\">"),
    (5, 2, ' about:blank"' + "abcd" * 9),
]
WRAPPER = [(3, 0, "\n<!-- page note -->\n## Page 12\nPage 7\nkeep Page 8 here\n\n\n\nend"), (4, 1, "\n  page 3  \nrest")]
MARKDOWN = [(2, 0, "\n# Title & more\n### Deep  <b>\nnot # heading\n####### seven\n#\n")]
PLACEHOLDERS = [
    (3, 0, ' <figure><img alt="z" src="IMAGE_PLACEHOLDER_2"/></figure> kept <img src="ok.png">'),
    (4, 2, " <IMG SRC=''><img class='q' src=' ' /> <figure> <figcaption> </figcaption></figure>"),
]
LABELS = [
    (2, 0, "\n[Gemini PDF] sent page 3\n[ Cache ] hit\nEngine Note: kept\nSource page 4, strip 2\nSource page 9\n"),
    (3, 1, "\n<p>[Throttle] wait</p><h2>Source page 12</h2><p data-strip=\"1\" data-source-page='2'>strip 3</p>"),
    (5, 0, " text layer fallback [[PROGRESS_STATE::abc]] [Engine Audit Flag: odd]"),
]
SANITIZE = [
    (2, 0, "\n```html\n<div class='a'><b>kept</b></div>\n```\n== Start of OCR for page 3 ==\n"),
    (3, 1, "\ndata:image/png;base64,QUJDREVGRw==\n\n\n\nI cannot provide a transcription because the image is completely blank."),
    (5, 2, "\n[Original Page Number: 7]\n7\nnext <table><tr><td>1</td></tr></table>"),
]
SECRETS = [
    (3, 0, " AIzaABCDEFGHIJKLMNOPQRSTUV sk-abcdefghijklmnopqrstuvwx"),
    (4, 1, " Authorization: Bearer abcdef0123456789 api_key = 0123456789abcdef"),
    (5, 2, " key=abcdefghijklmnop xoxb-1234567890-abc ghp_aaaaaaaaaaaaaaaaaaaaaaaa"),
    (6, 3, " -----BEGIN RSA PRIVATE KEY-----\nMII\nabc\n-----END RSA PRIVATE KEY----- x-goog-api-key: abcdefghijklmnop"),
]
DATELINES = [
    (3, 0, " SYDNEY, MONDAY, MARCH 4, 1912. News"),
    (3, 1, " on Tuesday, June 14, 1921 it"),
]


def _docs(spark, sf_dir, fragments, *extra):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    return docs.select("doc_id", *extra, inject(F.col("text"), F.col("doc_id"), fragments).alias("text"))


def _over_docs(fn, fragments):
    def run(spark, sf_dir):
        return _docs(spark, sf_dir, fragments).select("doc_id", fn(F.col("text")).alias("result"))

    return run


def _docs_sql(fragments, extra=""):
    return f"(SELECT doc_id{extra}, {sql_inject('text', 'doc_id', fragments)} AS text FROM documents)"


def _doc_query(name, fn, fragments, sql_expr):
    query(name, f"SELECT doc_id, {sql_expr} AS result FROM {_docs_sql(fragments)}")(_over_docs(fn, fragments))


_doc_query("str_01_clean_artifacts", text.clean_artifacts, ARTIFACTS, sql_replace("text", fixed.TEXT_ARTIFACTS))
_doc_query("str_03_latin1_fold", text.fold_latin1, ARTIFACTS, "regexp_replace(text, '[^\\x00-\\x{FF}]', '?', 'g')")
_doc_query("str_04_modern_punctuation", text.modernize_punctuation, PUNCTUATION, sql_rewrite("text", text.PUNCTUATION_RULES))
_doc_query(
    "str_05_modern_currency",
    text.modernize_currency,
    CURRENCY,
    sql_rewrite(
        "text",
        [
            (r"£(\d+)/(\d+)/-", r"\1 pounds, \2 shillings"),
            (r"£(\d)(\d+)/-", r"£\1\2 shillings"),
            (r"(^|[^£0-9])(\d+)/-", r"\1\2 shillings"),
            (r"(\d+)d\.?", r"\1 pence"),
            (r"£(\d+)", r"\1 pounds"),
        ],
    ),
)
_ELISION = "^(?i)(?:" + "|".join(fixed.LEADING_ELISIONS) + r")(?:[^\p{L}\p{N}_]|$)"
_doc_query(
    "str_06_dialogue_quotes",
    text.dialogue_quotes,
    QUOTES,
    f"""(SELECT list_aggregate(list_transform(p, lambda piece, i: CASE
          WHEN i = 1 THEN piece
          WHEN regexp_matches(p[i - 1], '[\\p{{L}}\\p{{N}}]$') AND regexp_matches(piece, '^[\\p{{L}}\\p{{N}}]') THEN '''' || piece
          WHEN ((i = 2 AND p[1] = '') OR regexp_matches(p[i - 1], '\\s$')) AND regexp_matches(piece, {quote(_ELISION)}) THEN '''' || piece
          ELSE '"' || piece END), 'string_agg', '') FROM (SELECT string_split(text, '''') AS p))""",
)
_doc_query("str_07_scan_wraps", text.repair_scan_wraps, WRAPS, sql_rewrite("text", text.WRAP_RULE))
_doc_query(
    "str_08_numeric_quote_noise",
    text.numeric_quote_noise,
    NOISE,
    f"""array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE
        WHEN regexp_matches({sql_strip('l')}, {quote(text.NUMERIC_NOISE_LINE)}) THEN replace(l, '"', '') ELSE l END), chr(10))""",
)
query("str_10_book_text")(_over_docs(lambda c: text.book_text(c, preserve_pages=True), BOOK))
_IMAGE_SQL = [
    text.IMAGE_PAYLOAD_RULES[0],
    (
        r"(?is)<img\b[^>]*\s+src\s*=\s*[\"'](?:data:image\/[a-z0-9.+-]+;base64,|about:blank)[^<]{32,}(>|</|\z)",
        r'<img src="about:blank">\1',
    ),
    *text.IMAGE_PAYLOAD_RULES[2:5],
    (r"(?is)(<img\b[^>]*\s+src\s*=\s*[\"']about:blank)(</)", r'\1">\2'),
    *text.IMAGE_PAYLOAD_RULES[6:],
]
_doc_query("str_11_collapse_image_payloads", text.collapse_image_payloads, IMAGES, sql_rewrite("text", _IMAGE_SQL))
_doc_query("str_12_page_wrapper_noise", text.strip_page_wrapper_noise, WRAPPER, sql_rewrite("text", text.WRAPPER_NOISE_RULES))
_HEAD = sql_replace(sql_squash("regexp_replace(l, '^#{1,6}\\s+', '')"), fixed.HTML_ESCAPES)
_LEVEL = "length(regexp_extract(l, '^(#{1,6})\\s', 1))::VARCHAR"
_doc_query(
    "str_13_markdown_headings",
    text.markdown_headings_to_html,
    MARKDOWN,
    f"""array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE
        WHEN regexp_matches(l, '^#{{1,6}}\\s+\\S') THEN '<h' || {_LEVEL} || '>' || {_HEAD} || '</h' || {_LEVEL} || '>'
        ELSE l END), chr(10))""",
)
_PLACE_SQL = [
    (rf"(?i)<img\b([^>]*?)\s+src=({q})(?:IMAGE_PLACEHOLDER(?:_\d+)?|IMAGE_URL(?:_\d+)?|){q}([^>]*)/?>", "") for q in "\"'"
] + [(rf"(?i)<img\b([^>]*?)\s+src=({q})\s*{q}([^>]*)/?>", "") for q in "\"'"]
_doc_query(
    "str_14_placeholder_images",
    text.strip_placeholder_images,
    PLACEHOLDERS,
    sql_rewrite("text", _PLACE_SQL + text.PLACEHOLDER_IMAGE_RULES[2:]),
)


def _label_sql(expr, markup):
    base = sql_rewrite(
        expr,
        [
            (r"\[\[PROGRESS_STATE::[^\]]*\]\]\s*", ""),
            text.LABEL_LINE_RULE,
            (r"(?i)\bEngine Note:\s*", "Note: "),
            (r"(?i)\[Engine NOTE:\s*", "[Note: "),
            (r"(?i)\[Engine AUDIT FLAG:\s*", "[Audit flag: "),
        ],
    )
    if not markup:
        return sql_rewrite(base, [*text.LABEL_TEXT_RULES, text.BLANK_RUNS])
    rules = [text.LABEL_HTML_RULES[0]]
    for attribute in ("strip", "source-page"):
        rules += [(rf"(?is)\sdata-{attribute}={q}.*?{q}", "") for q in "\"'"]
    strips = r"(?i)<h{n}\b([^>]*)>\s*Source\s+page\s+(\d+)\s*,\s*(?:strip|stripe)\s+\d+\s*</h{n}>\s*"
    rules += [(strips.format(n=n), "") for n in range(1, 7)]
    pages = r"(?i)<h{n}\b([^>]*)>\s*Source\s+page\s+(\d+)(?:\s*,\s*text\s+layer\s+fallback)?\s*</h{n}>"
    rules += [(pages.format(n=n), rf"<h{n}\1>Page \2</h{n}>") for n in range(1, 7)]
    return sql_rewrite(base, rules + text.LABEL_HTML_RULES[5:] + [text.BLANK_RUNS])


@query(
    "str_15_internal_labels",
    f"""SELECT doc_id, fmt, CASE WHEN fmt = 'html' THEN {_label_sql('text', True)} ELSE {_label_sql('text', False)} END AS result
    FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'txt' ELSE 'html' END AS fmt FROM {_docs_sql(LABELS)})""",
)
def internal_labels(spark, sf_dir):
    docs = _docs(spark, sf_dir, LABELS).withColumn("fmt", F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("html"))
    return docs.select("doc_id", "fmt", text.scrub_internal_labels(F.col("text"), F.col("fmt")).alias("result"))


_SANITIZE_RULES = text.REFUSAL_RULES[:3] + [(r"(\[Original Page Number:\s*7\])\s*\n\s*7\s*(\n)", r"\1\2"), text.BLANK_RUNS]


@query(
    "str_16_sanitize_plain",
    f"SELECT doc_id, {_label_sql(sql_rewrite(sql_rewrite(_label_sql('text', False), _SANITIZE_RULES), text.PLAIN_PAYLOAD_RULES), False)} AS result"
    f" FROM {_docs_sql(SANITIZE)}",
)
def sanitize_plain(spark, sf_dir):
    return _docs(spark, sf_dir, SANITIZE).select("doc_id", text.sanitize_plain(F.col("text"), F.lit("txt")).alias("result"))


@query("str_18_visible_text", f"SELECT page_id, {sql_squash(sql_rewrite('html', text.VISIBLE_HTML_RULES))} AS result FROM pages")
def page_visible_text(spark, sf_dir):
    return text_table(spark, sf_dir, "pages", "page_id").select("page_id", text.visible_text(F.col("html")).alias("result"))


@query(
    "str_02_strip_tags",
    "SELECT page_id, "
    + sql_replace(sql_squash(sql_replace(sql_rewrite("html", text.TAG_STRIP_RULES), fixed.HTML_ENTITIES)), fixed.TEXT_ARTIFACTS)
    + " AS result FROM pages",
)
def page_strip_tags(spark, sf_dir):
    return text_table(spark, sf_dir, "pages", "page_id").select("page_id", text.strip_tags(F.col("html")).alias("result"))


@query(
    "src_14_html_source_text",
    "SELECT page_id, "
    + sql_rewrite(
        "html",
        [(rf"(?is)<{t}\b[^>]*>.*?</{t}>", " ") for t in ("script", "style", "noscript")] + [text.SOURCE_HTML_RULES[1]],
    )
    + " AS result FROM pages",
)
def html_source_text(spark, sf_dir):
    return text_table(spark, sf_dir, "pages", "page_id").select("page_id", text.source_html_text(F.col("html")).alias("result"))


_doc_query("str_19_audit_key", text.audit_key, ARTIFACTS, "regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')")


@query(
    "str_20_fail_safe_units",
    f"""WITH t AS (SELECT doc_id, {sql_strip("text")} AS raw FROM documents),
    s AS (SELECT doc_id, unnest(string_split(regexp_replace(raw, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS part,
                 generate_subscripts(string_split(regexp_replace(raw, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM t),
    u AS (SELECT doc_id, pos, unnest(range(0, greatest(length({sql_strip('part')}), 1), 120)) AS start, {sql_strip('part')} AS part FROM s),
    v AS (SELECT doc_id, pos, start, {sql_strip('substring(part, (start + 1)::BIGINT, 120)')} AS unit FROM u)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, start) - 1)::BIGINT AS unit_no, unit FROM v WHERE unit <> ''""",
)
def fail_safe_units(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    units = docs.select("doc_id", F.posexplode(text.fail_safe_units(F.col("text"), 120)).alias("unit_no", "unit"))
    return units.withColumn("unit_no", F.col("unit_no").cast("bigint"))


@query(
    "str_22_page_sequence",
    "SELECT doc_id, TRY_CAST(nullif(regexp_extract(name, '(?i)(?:^|[^A-Za-z0-9_])page[\\s._-]*0*([0-9]{1,6})(?:[^0-9]|$)', 1), '') AS BIGINT) AS seq"
    " FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Page_00' || doc_id || '.jpg' WHEN 1 THEN 'scan page-' || (doc_id % 50) || '.pdf'"
    " WHEN 2 THEN 'letter' || doc_id || '.txt' ELSE 'homepage ' || doc_id || '.png' END AS name FROM documents)",
)
def page_sequence(spark, sf_dir):
    key = F.col("doc_id")
    name = (
        F.when(key % 4 == 0, F.concat(F.lit("Page_00"), key.cast("string"), F.lit(".jpg")))
        .when(key % 4 == 1, F.concat(F.lit("scan page-"), (key % 50).cast("string"), F.lit(".pdf")))
        .when(key % 4 == 2, F.concat(F.lit("letter"), key.cast("string"), F.lit(".txt")))
        .otherwise(F.concat(F.lit("homepage "), key.cast("string"), F.lit(".png")))
    )
    docs = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.concat(F.lit("/in/"), name).alias("path"))
    return docs.select("doc_id", text.page_sequence(F.col("path")).alias("seq"))


SYNTHETIC = [(2, 0, "\n## page 012.jpg\npage_3.PNG\nkeep page 4.jpg here"), (3, 0, "\n<h2>Page 7.tiff</h2><p>page-2.webp</p><cite>File scan.jpg</cite>")]


@query(
    "str_23_synthetic_headings",
    f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {sql_rewrite('text', text.SYNTHETIC_HTML_RULES)}
      ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, {quote(text.SYNTHETIC_LINE)})), chr(10)) END AS result
      FROM {_docs_sql(SYNTHETIC)}""",
)
def synthetic_headings(spark, sf_dir):
    fmt = F.when(F.col("doc_id") % 3 == 0, "html").otherwise("txt")
    return _docs(spark, sf_dir, SYNTHETIC).select("doc_id", text.strip_synthetic_headings(F.col("text"), fmt).alias("result"))


_PLACED = re2(text.DATELINE_WITH_PLACE)
_DATE_FOUND = (
    f"CASE WHEN regexp_extract(text, {quote(_PLACED)}, 1) <> '' THEN regexp_extract(text, {quote(_PLACED)}, 1)"
    f" ELSE regexp_extract(text, {quote(re2(text.DATELINE))}, 1) END"
)
_doc_query("str_27_publication_date", text.publication_date, DATELINES, f"rtrim({sql_squash(_DATE_FOUND)}, ' .,:;')")
_SECRET_SQL = [(p, "[redacted]") for p in fixed.BARE_SECRETS] + [(p, r"\1[redacted]") for p in fixed.LABELLED_SECRETS]
_doc_query(
    "sec_01_redact_secrets",
    text.redact_secrets,
    SECRETS,
    sql_rewrite("text", [*_SECRET_SQL, (fixed.PRIVATE_KEY_BLOCK, "[redacted]")]),
)
