"""HTML queries over ``pages`` and over documents wrapped as HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.functions import fixed, html, qa, text
from quirekit.functions.lines import content_lines
from quirekit.functions.rewrite import squash
from quirekit.operators.documents import normalize_documents, staged
from quirekit.plans.inputs import pick, sql_pick
from quirekit.plans.registry import (
    inject, query, quote, re2, sql_case, sql_inject, sql_replace, sql_rewrite, sql_squash, sql_strip, table, text_table,
)

# Openings that give each promotion rule documents it applies to.
OPENINGS = [
    "<p>Section 12</p>",
    "<p>PART OF THE RECORD</p><p>LATER PART</p>",
    "<p>Steps to follow</p><p>1. Open. the door</p><p>2. Close. it again</p>",
    "<p>Chapter 3 Overview</p><h2>Body</h2>",
    "<h2>INDEX</h2>",
    "<p>Topics</p><ul><li><strong>Alpha &amp; co</strong> x</li><li><strong>Beta</strong></li></ul>",
    "<p><b>First line</b><br>text a</p><p><strong>Second</strong><br/>text b</p>",
    "<p>Terms</p><dl><dt>Alpha</dt><dd>x</dd></dl>",
    "<h1>Title</h1><p><b>Sub title</b></p><p><strong>12A Objects of this Part</strong></p>",
    "<figure><img src=\"a.png\"></figure>\nA Loose Caption Heading\n",
    "<p>A Good Heading</p><p>Second Heading Words</p>",
    "<h2>Short Head</h2><p>text</p><h2>More</h2><h3>Deep</h3>",
    "<p>Sept. 1914 WAR DIARY entries of the day 12</p>",
    "<h3>Only deep</h3><p>x</p><h3>Again</h3>",
    "<h2>Short</h2><p><strong>Bold follow</strong></p>",
    "Bare title here\n\n<p>1. Load. it first</p><p>2. Aim. well</p>",
    "<p>Checklist</p><ol><li>First thing<br>detail</li></ol>",
    "<p>The National Archives' reference WO-95/1</p>\n1. Move at dawn<br>2. Hold the line",
]
# Closing parts with repeats, forms, furniture and page heads.
CLOSINGS = [
    (2, 0, "<p>one</p><p>two</p><p>one</p><p>two</p><p>end</p><p>end</p>"),
    (3, 1, '<input type="checkbox" checked> Yes <input type=checkbox> No <input type="text"/><textarea a>b</textarea><input type="radio">[Text input]'),
    (4, 2, "<p>page 12</p><p>No. 4, 2023</p><footer>Privacy Act 1988 12</footer><section>xiv</section><p>1</p><p>2</p><p>3</p><p>4</p>"),
    (5, 3, "<hr><header><h1>The Age</h1></header><h2>One</h2><hr><header><h1>The Age</h1></header><h2>Two</h2><hr><header><h1>The Age</h1></header><h2>Three</h2>"),
    (7, 0, "<h2>One<br/>more</h2><h2>one more</h2><h3>2023</h3><h2>One &lt;more&gt; Part</h2>"),
]


def doc_html(spark, sf_dir):
    """Documents as HTML: an opening, one paragraph per line, and a closing part."""
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    key = F.col("doc_id")
    body = F.array_join(F.transform(content_lines(F.col("text")), lambda line: html.tag("p", text.escape_html(line))), "\n")
    page = F.concat(F.lit("<main>"), pick(OPENINGS, key), F.lit("\n"), inject(body, key, CLOSINGS), F.lit("</main>"))
    return docs.select("doc_id", page.alias("html"))


_LINE = sql_strip("l")
DOC_HTML_SQL = f"""(SELECT doc_id, '<main>' || {sql_pick(OPENINGS, 'doc_id')} || chr(10) || {sql_inject(
    f"array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: {_LINE} <> ''), lambda l: '<p>' || {sql_replace(_LINE, fixed.HTML_ESCAPES)} || '</p>'), chr(10))",
    'doc_id', CLOSINGS)} || '</main>' AS html FROM documents)"""


def main_pages(spark, sf_dir):
    """Web pages whose article body is the main landmark."""
    pages = text_table(spark, sf_dir, "pages", "page_id")
    body = F.replace(F.replace("html", F.lit("<article>"), F.lit("<main>")), F.lit("</article>"), F.lit("</main>"))
    return pages.select("page_id", body.alias("html"))


MAIN_PAGES_SQL = "(SELECT page_id, replace(replace(html, '<article>', '<main>'), '</article>', '</main>') AS html FROM pages)"


def _on_docs(name, fn, sql_expr=None):
    oracle = None if sql_expr is None else f"SELECT doc_id, {sql_expr} AS result FROM {DOC_HTML_SQL}"

    @query(name, oracle)
    def run(spark, sf_dir):
        return doc_html(spark, sf_dir).select("doc_id", fn(F.col("html")).alias("result"))

    return run


_PAGE_RULES = sql_rewrite("html", text.VISIBLE_HTML_RULES)
_LANG = "regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1)"


def _qa_sql(content, markup, profile):
    """The QA rules as a list of warnings; adjacent headings are compared by position."""
    heads = (
        f"list_transform(regexp_extract_all({content}, {quote(qa.HEADING)}, 1), lambda h: "
        f"lower({sql_squash('regexp_replace(h, ' + quote('<[^>]+>') + ', ' + quote(' ') + ', ' + quote('g') + ')')}))"
    )
    if not markup:
        rules = [
            (f"regexp_matches({content}, {quote(qa.LEAKED_TAG)})", "HTML tag leaked into non-HTML output"),
            (f"regexp_matches({content}, {quote(qa.BASE64_IMAGE)})", "base64 image payload"),
        ]
    else:
        rules = [
            (f"regexp_matches({content}, {quote(qa.EMPTY_HEADING)})", "empty heading"),
            (f"len(regexp_extract_all({content}, {quote(qa.WRAPPER_TAG)})) > 1", "nested document wrapper"),
            (f"regexp_matches({content}, {quote(qa.PLACEHOLDER)})", "image placeholder token"),
            (f"regexp_matches({content}, {quote(qa.EMPTY_SOURCE)})", "empty image source"),
            (f"regexp_matches({content}, {quote(re2(qa.LEAKED_MARKDOWN))})", "markdown heading leaked into HTML"),
            (
                f"(SELECT len(list_filter(hs, lambda h, i: i > 1 AND h <> '' AND h = hs[i - 1])) > 0 FROM (SELECT {heads} AS hs))",
                "adjacent duplicate heading",
            ),
            (
                f"{profile} = 'legal' AND (SELECT coalesce(list_filter(hs, lambda h: regexp_matches(h, {quote(qa.DATE_HEADING)}) OR regexp_matches(h, {quote(qa.CROSS_REFERENCE)}))[1], '') FROM (SELECT {heads} AS hs)) <> ''"
                f" AND (SELECT regexp_matches(list_filter(hs, lambda h: regexp_matches(h, {quote(qa.DATE_HEADING)}) OR regexp_matches(h, {quote(qa.CROSS_REFERENCE)}))[1], {quote(qa.DATE_HEADING)}) FROM (SELECT {heads} AS hs))",
                "date-only legal heading",
            ),
            (
                f"{profile} = 'legal' AND (SELECT coalesce(list_filter(hs, lambda h: regexp_matches(h, {quote(qa.DATE_HEADING)}) OR regexp_matches(h, {quote(qa.CROSS_REFERENCE)}))[1], '') FROM (SELECT {heads} AS hs)) <> ''"
                f" AND (SELECT regexp_matches(list_filter(hs, lambda h: regexp_matches(h, {quote(qa.DATE_HEADING)}) OR regexp_matches(h, {quote(qa.CROSS_REFERENCE)}))[1], {quote(qa.CROSS_REFERENCE)}) FROM (SELECT {heads} AS hs))",
                "legal cross-reference promoted as heading",
            ),
        ]
    items = ", ".join(f"CASE WHEN {test} THEN {quote(name)} END" for test, name in rules)
    return f"list_filter([{items}], lambda w: w IS NOT NULL)"


@query(
    "flagship_page_qa",
    f"""WITH p AS (SELECT {_LANG} AS lang, {_qa_sql('html', True, "'standard'")} AS warnings, {sql_squash(_PAGE_RULES)} AS visible FROM pages)
    SELECT lang, count(*) AS pages, count_if(len(warnings) = 0)::BIGINT AS passing, sum(length(visible))::BIGINT AS visible_chars FROM p GROUP BY lang""",
)
def flagship_page_qa(spark, sf_dir):
    """Per language: pages, pages that pass output QA, and visible characters.

    Everything but three numbers per page is worked out before the shuffle.
    """
    pages = text_table(spark, sf_dir, "pages", "page_id")
    checked = pages.select(
        F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("lang"),
        (F.size(qa.quality_warnings(F.col("html"), F.lit("html"), F.lit("standard"))) == 0).alias("ok"),
        F.length(text.visible_text(F.col("html"))).alias("chars"),
    )
    return checked.groupBy("lang").agg(
        F.count("*").alias("pages"), F.count_if("ok").alias("passing"), F.sum("chars").alias("visible_chars")
    )


QA_FAULTS = [
    (3, 0, "<h2> </h2><img src=''>"),
    (4, 1, "<h1>Same</h1><p>x</p><h2>same </h2>"),
    (5, 2, "\n## leaked\n<html><body>IMAGE_URL data:image/png;base64,AA"),
    (6, 3, "<h3>12 March 1999</h3><h2>Part 3 of that Act</h2>"),
    (7, 4, "<h2>Section 4 of the other Act</h2><h3>1 May 2001.</h3>"),
]
_FMT = "CASE WHEN doc_id % 5 = 4 THEN 'txt' ELSE 'html' END"
_PROFILE = "CASE WHEN doc_id % 2 = 1 THEN 'legal' ELSE 'book' END"


@query(
    "cls_07_output_qa",
    f"""WITH d AS (SELECT doc_id, {sql_inject('html', 'doc_id', QA_FAULTS)} AS html, {_FMT} AS fmt, {_PROFILE} AS profile FROM {DOC_HTML_SQL}),
    w AS (SELECT doc_id, CASE WHEN fmt = 'html' THEN {_qa_sql('html', True, 'profile')} ELSE {_qa_sql('html', False, 'profile')} END AS warnings FROM d)
    SELECT doc_id, len(warnings) = 0 AS ok, array_to_string(warnings, '; ') AS warnings,
      CASE WHEN len(warnings) = 0 THEN 'Output QA passed.' ELSE 'Output QA flagged: ' || array_to_string(warnings, '; ') END AS summary FROM w""",
)
def output_qa(spark, sf_dir):
    key = F.col("doc_id")
    docs = doc_html(spark, sf_dir).select("doc_id", inject(F.col("html"), key, QA_FAULTS).alias("html"))
    fmt = F.when(key % 5 == 4, "txt").otherwise("html")
    profile = F.when(key % 2 == 1, "legal").otherwise("book")
    checked = docs.select("doc_id", qa.quality_warnings(F.col("html"), fmt, profile).alias("found"))
    joined = F.array_join("found", "; ")
    return checked.select(
        "doc_id",
        (F.size("found") == 0).alias("ok"),
        joined.alias("warnings"),
        F.when(F.size("found") == 0, "Output QA passed.").otherwise(F.concat(F.lit("Output QA flagged: "), joined)).alias("summary"),
    )


@query(
    "cls_08_health_summary",
    f"""SELECT doc_id, 'File: ' || source || chr(10) || 'Output: /out/' || doc_id || '.html' || chr(10) || 'Format: HTML' || chr(10) || 'Preset: ' || {sql_pick(fixed.PROFILES, 'doc_id')}
    || chr(10) || 'Engine: GPT-4o' || CASE WHEN doc_id % 4 > 0 THEN chr(10) || 'Work units: ' || (doc_id % 4) ELSE '' END
    || CASE WHEN doc_id % 3 > 0 THEN chr(10) || 'Recovered from previous session: ' || (doc_id % 3) ELSE '' END || chr(10) || 'Output QA passed.' AS summary FROM documents""",
)
def health_summary(spark, sf_dir):
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        qa.health_summary(
            F.col("source"), F.concat(F.lit("/out/"), key.cast("string"), F.lit(".html")), F.lit("html"), pick(fixed.PROFILES, key),
            F.lit("GPT-4o"), key % 4, key % 3, F.lit("Output QA passed."),
        ).alias("summary"),
    )


@query(
    "win_01_adjacent_headings",
    f"""WITH h AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(html, {quote(qa.HEADING)}, 1), lambda x: lower({sql_squash("regexp_replace(x, '<[^>]+>', ' ', 'g')")}))) AS head,
      unnest(range(1, len(regexp_extract_all(html, {quote(qa.HEADING)}, 1)) + 1)) AS pos FROM (SELECT doc_id, {sql_inject('html', 'doc_id', QA_FAULTS)} AS html FROM {DOC_HTML_SQL})),
    p AS (SELECT *, lag(head) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM h)
    SELECT doc_id, count_if(head <> '' AND head = before)::BIGINT AS repeats FROM p GROUP BY doc_id HAVING count_if(head <> '' AND head = before) > 0""",
)
def adjacent_headings(spark, sf_dir):
    docs = doc_html(spark, sf_dir).select("doc_id", inject(F.col("html"), F.col("doc_id"), QA_FAULTS).alias("html"))
    return docs.select("doc_id", qa.adjacent_duplicate_headings(F.col("html")).cast("bigint").alias("repeats")).filter("repeats > 0")


@query(
    "agg_07_heading_frequency",
    f"""WITH h AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(html, {quote(qa.HEADING)}, 1), lambda x: lower({sql_squash("regexp_replace(x, '<[^>]+>', ' ', 'g')")}))) AS head FROM {DOC_HTML_SQL})
    SELECT doc_id, head, count(*) AS times FROM h WHERE head <> '' GROUP BY ALL HAVING count(*) >= 3""",
)
def heading_frequency(spark, sf_dir):
    heads = doc_html(spark, sf_dir).select("doc_id", F.explode(qa.heading_texts(F.col("html"))).alias("head")).filter("head <> ''")
    return heads.groupBy("doc_id", "head").agg(F.count("*").alias("times")).filter("times >= 3")


_WRAP = "'<!DOCTYPE html><html lang=\"x\"><head><title>t</title></head><body><main>' || html || '</main></body></html>'"


def _wrapped(col):
    return F.concat(F.lit('<!DOCTYPE html><html lang="x"><head><title>t</title></head><body><main>'), col, F.lit("</main></body></html>"))


def _leaked_sql(expr):
    for _ in range(3):
        expr = sql_rewrite(expr, html.LEAKED_WRAPPERS)
    return sql_rewrite(expr, [text.BLANK_RUNS])


_on_docs("htm_02_leaked_wrappers", lambda c: html.strip_leaked_wrappers(_wrapped(c)), _leaked_sql(_WRAP))
_on_docs(
    "htm_03_nested_main",
    lambda c: html.collapse_nested_main(_wrapped(c)),
    f"""(SELECT replace(regexp_replace(regexp_replace(w, '(?i)<main\\b[^>]*>', chr(1)), '(?i)<main\\b[^>]*>', '', 'g'), chr(1), '<main>') FROM
      (SELECT regexp_replace(regexp_replace({_WRAP}, '(?is)^(.*)(</main\\s*>)', '\\1' || chr(2)), '(?i)</main\\s*>', '', 'g') AS w0) , LATERAL (SELECT replace(w0, chr(2), '</main>') AS w))""",
)
# Toc: the SQL keeps the same rules over unnested headings.
_T = sql_replace(sql_squash(sql_replace(sql_rewrite("h", text.TAG_STRIP_RULES), fixed.HTML_ENTITIES)), fixed.TEXT_ARTIFACTS)


@query(
    "htm_04_toc_rows",
    f"""WITH d AS (SELECT doc_id, regexp_extract_all(html, {quote(html.TOC_BLOCK)}) AS hs FROM {DOC_HTML_SQL}),
    h AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS place FROM d),
    t AS (SELECT doc_id, place, substring(h, 3, 1)::BIGINT AS level, {_T} AS title FROM h),
    k AS (SELECT *, {sql_squash("regexp_replace(regexp_replace(lower(title), '[-–—]+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s]', '', 'g')")} AS key,
      length(regexp_replace(title, '[^A-Za-z]', '', 'g')) AS letters FROM t
      WHERE regexp_matches(title, '[A-Za-z]') AND length(title) <= 180 AND NOT regexp_full_match(title, '(18|19|20)[0-9]{{2}}')),
    b AS (SELECT doc_id, key, min(place) AS first, arg_max(struct_pack(p := place, l := level, t := title), struct_pack(a := letters, b := length(title), c := -place)) AS best
      FROM k WHERE key <> '' GROUP BY ALL)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::BIGINT AS entry, best.l AS level, best.t AS title FROM b""",
)
def toc_rows(spark, sf_dir):
    rows = doc_html(spark, sf_dir).select("doc_id", F.posexplode(html.toc_rows(F.col("html"))).alias("entry", "row"))
    return rows.select(
        "doc_id", F.col("entry").cast("bigint").alias("entry"), F.col("row.level").cast("bigint").alias("level"), "row.title"
    )


@query("htm_04_toc_injected")
def toc_injected(spark, sf_dir):
    staged = doc_html(spark, sf_dir).withColumn("toc", html.toc_rows(F.col("html")))
    return staged.select("doc_id", html.inject_toc(F.col("html"), F.col("toc")).alias("result"))


_on_docs("htm_05_dedupe_paragraphs", html.dedupe_paragraphs)


@query(
    "htm_05_adjacent_paragraphs",
    f"""WITH d AS (SELECT page_id, regexp_extract_all(html, '(?is)<p\\b[^>]*>.*?</p>') AS ps FROM {MAIN_PAGES_SQL}),
    p AS (SELECT page_id, unnest(ps) AS block, generate_subscripts(ps, 1) AS pos FROM d),
    r AS (SELECT *, lag(block) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM p)
    SELECT page_id, count(*) AS paragraphs, coalesce(count_if(block = before), 0)::BIGINT AS repeated FROM r GROUP BY page_id""",
)
def adjacent_paragraphs(spark, sf_dir):
    from quirekit.functions.lines import consecutive_pairs

    blocks = html.paragraphs(F.col("html"))
    repeats = consecutive_pairs(blocks, lambda prev, cur: prev == cur)
    counted = main_pages(spark, sf_dir).select("page_id", F.size(blocks).cast("bigint").alias("paragraphs"), repeats.cast("bigint").alias("repeated"))
    return counted.filter("paragraphs > 0")


# The head occurs three times, each time after a rule and before another heading.
_on_docs("htm_06_running_head_h1s", html.strip_running_head_h1s, "replace(html, '<header><h1>The Age</h1></header>', '')")
_CHECKED = r"(?i)<input\b[^>]*\btype\s*=\s*[\"']?{kind}[^>]*\bchecked\b[^>]*>"
_on_docs(
    "htm_07_form_semantics",
    html.form_semantics,
    sql_rewrite(
        "html",
        html.FORM_RULES
        + [(_CHECKED.format(kind="checkbox"), "[Checkbox: Selected]"), (html.CHECKBOX, "[Checkbox: Empty]")]
        + [(_CHECKED.format(kind="radio"), "[Radio Button: Selected]"), (html.RADIO, "[Radio Button: Empty]")]
        + [(html.YES_NO, r"[Radio Button: \1] \2")],
    ),
)
_on_docs("htm_08_page_furniture", html.strip_page_furniture)
_H = {n: f"regexp_matches(html, '(?i)<h{n}\\b')" for n in (1, 2, 3)}


def _first_sql(expr, old, new):
    return f"regexp_replace(regexp_replace({expr}, '(?i)<h{old}\\b', '<h{new}'), '(?i)</h{old}\\s*>', '</h{new}>')"


def _all_sql(expr):
    return sql_rewrite(expr, [(r"(?i)<h3\b", "<h2"), (r"(?i)</h3\s*>", "</h2>")])


_on_docs(
    "htm_09_heading_hierarchy",
    html.heading_hierarchy,
    f"CASE WHEN NOT {_H[1]} AND {_H[2]} AND {_H[3]} THEN {_all_sql(_first_sql('html', 2, 1))} WHEN NOT {_H[1]} AND {_H[3]} THEN {_all_sql(_first_sql('html', 3, 1))}"
    f" WHEN {_H[1]} AND NOT {_H[2]} AND {_H[3]} THEN {_all_sql('html')} ELSE html END",
)
# What each promotion does to the opening made for it, under the rule's own condition on the rest of the page.
_NO_HEADING = "NOT regexp_matches(html, '(?i)<h[1-6]\\b')"


def _promoted(number, new, condition=_NO_HEADING):
    return f"CASE WHEN {condition} THEN {sql_replace('html', [(OPENINGS[number], new)])} ELSE html END"


_on_docs("htm_10_sparse_blocks", html.promote_sparse_blocks)
_on_docs("htm_11_leading_paragraphs", html.promote_leading_paragraphs)
_on_docs("htm_12_list_section", html.promote_list_section, _promoted(5, "<h1>Topics</h1>\n<ul><li><h2>Alpha &amp; co</h2> x</li><li><strong>Beta</strong></li></ul>"))
_on_docs("htm_13_numbered_instructions", html.promote_numbered_instructions, _promoted(2, "<h1>Steps to follow</h1><h2>1. Open</h2>\n<p>the door</p><p>2. Close. it again</p>"))
_on_docs("htm_14_context_paragraph", html.promote_context_paragraph)
_on_docs("htm_15_index", html.promote_index, "CASE WHEN regexp_matches(html, '(?i)<h1\\b') OR NOT contains(html, '<h2>INDEX</h2>') THEN html ELSE replace(html, '<h2>INDEX</h2>', '<h1>INDEX</h1>' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE chr(10) || '<h2>Index Entries</h2>' END) END")
_on_docs("htm_17_bold_after_h1", html.promote_bold_after_h1, _promoted(8, OPENINGS[8].replace("<p><b>Sub title</b></p>", "<h2>Sub title</h2>"), "NOT regexp_matches(html, '(?i)<h2\\b')"))
_on_docs("htm_17_short_h2", html.promote_short_h2, "CASE WHEN NOT regexp_matches(html, '(?i)<h1\\b') AND contains(html, '<h2>') AND (len(string_split(html, '<h2>')) > 2 OR regexp_matches(split_part(html, '<h2>', 1), '(?i)<(figure|table|p|section|article|blockquote)\\b')) THEN regexp_replace(html, '(?is)<h2>(.*?)</h2>', '<h1>\\1</h1>') ELSE html END")
_on_docs("htm_16_war_diary", html.promote_war_diary, _promoted(17, "<h1>Military Diary Continuation</h1>\n<h2>Operational Orders</h2>\n" + OPENINGS[17]))
_on_docs("htm_17_bold_followup", html.promote_bold_followup, _promoted(14, "<h1>Short</h1><h2>Bold follow</h2>", "NOT regexp_matches(html, '(?i)<h1\\b')"))
_on_docs("htm_18_bare_instruction", html.promote_bare_instruction, _promoted(15, "\n<h1>Bare title here</h1>\n<h2>1. Load</h2><p>2. Aim. well</p>"))
_on_docs("htm_18_ordered_list", html.promote_ordered_list, _promoted(16, "<h1>Checklist</h1>\n<ol><li><h2>First thing</h2><br>detail</li></ol>"))
_on_docs(
    "str_31_escaped_html",
    lambda c: text.unescape_html(text.escape_html(c)),
    sql_replace(sql_replace("html", fixed.HTML_ESCAPES), fixed.HTML_ENTITIES),
)


@query("htm_23_pages_as_html")
def pages_as_html(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    numbered = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "\nPart 2 Orders\nSHORT HEAD\n12 Objects of it\n17").otherwise(""))
    return docs.select("doc_id", html.page_as_html(content_lines(numbered)).alias("result"))


_on_docs("htm_18_strong_paragraphs", html.promote_strong_paragraphs, _promoted(6, "<h1>First line</h1>\n<p>text a</p><h2>Second</h2>\n<p>text b</p>"))
_on_docs("htm_18_definition_list", html.promote_definition_list, _promoted(7, "<h1>Terms</h1>\n<dl><h2>Alpha</h2><dd>x</dd></dl>"))
_on_docs("htm_19_figure_followup", html.promote_figure_followup, _promoted(9, OPENINGS[9].replace("A Loose Caption Heading\n", "<h1>A Loose Caption Heading</h1>\n\n"), "NOT regexp_matches(html, '(?i)<h1\\b')"))
_on_docs("htm_20_numbered_clauses", html.promote_numbered_clauses, sql_rewrite("html", [(r"(?i)<p\b[^>]*>\s*<(?:strong|b)>\s*(12A Objects of this Part)\s*</(?:strong|b)>\s*</p>", r"<h3>\1</h3>")]))


@query("htm_01_normalized_document")
def normalized_document(spark, sf_dir):
    return normalize_documents(doc_html(spark, sf_dir)).withColumnRenamed("html", "result")


@query("str_16_sanitize_html")
def sanitized_html(spark, sf_dir):
    return staged(doc_html(spark, sf_dir).withColumnRenamed("html", "result"), "result", html.SANITIZE_PASSES)


_on_docs(
    "str_17_heading_breaks",
    html.flatten_heading_breaks,
    sql_rewrite("html", [(r"(?i)(<h2>[^<]*)<br\s*/?>\s*([^<]*</h2>)", r"\1 \2")]),
)


_COVER = "'<h1>' || name || '</h1>' || chr(10)"


@query(
    "htm_19_title_cover",
    f"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<main> </main>' WHEN 1 THEN '<main><figure><img src=''a''></figure>' || html || '</main>' ELSE html END AS body,
      CASE doc_id % 5 WHEN 0 THEN 'Scan Of Report' WHEN 1 THEN 'Zoom manual' WHEN 2 THEN '' WHEN 3 THEN 'MIXED report' ELSE 'Daily News' END AS name FROM {DOC_HTML_SQL})
    SELECT doc_id, CASE WHEN name = '' THEN body WHEN doc_id % 3 = 0 THEN '<main>' || {_COVER} || '<h2>Cover Page</h2>' || chr(10) || '</main>'
      WHEN NOT starts_with(body, '<main><figure>') OR regexp_matches(body, '(?i)<h1\\b') THEN body
      WHEN regexp_matches(body, '(?i)<h2\\b') THEN '<main>' || {_COVER} || substring(body, 7)
      ELSE '<main>' || {_COVER} || '<h2>Cover Page</h2>' || chr(10) || substring(body, 7) END AS result FROM d""",
)
def title_cover(spark, sf_dir):
    key = F.col("doc_id")
    title = pick(["scan_of-report", "Zoom manual_page_12", "document", "MIXED report", "daily news"], key)
    body = F.when(key % 3 == 0, "<main> </main>").when(key % 3 == 1, F.concat(F.lit("<main><figure><img src='a'></figure>"), "html", F.lit("</main>"))).otherwise(F.col("html"))
    return doc_html(spark, sf_dir).select("doc_id", html.title_cover(body, title).alias("result"))


@query("htm_21_profile_headings")
def profile_headings(spark, sf_dir):
    profile = pick(["comic", "medical", "handwritten", "archival", "legal"], F.col("doc_id"))
    return doc_html(spark, sf_dir).select("doc_id", profile.alias("profile"), html.enforce_profile_headings(F.col("html"), profile).alias("result"))


@query(
    "htm_22_tabular_fragment",
    f"""WITH n AS (SELECT n_regionkey, list(struct_pack(k := n_nationkey, cells := [CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE n_name END, CAST(n_nationkey AS VARCHAR), 'a & b']) ORDER BY n_nationkey) AS rows FROM nation GROUP BY n_regionkey)
    SELECT r_regionkey AS region, '<main id="content" role="main">' || chr(10) || '<h1>Nations of ' || lower(r_name) || '</h1>' || chr(10) || '<h2>' || r_name || '</h2>' || chr(10)
      || '<p>This table contains ' || len(rows) || ' rows and 3 columns: name, key, note.</p>' || chr(10)
      || '<table><thead><tr><th scope="col">name</th><th scope="col">key</th><th scope="col">note</th></tr></thead><tbody>'
      || array_to_string(list_transform(rows, lambda r: CASE WHEN r.cells[1] = '' THEN '<tr aria-label="Subtotal row ' || r.cells[2] || '">' ELSE '<tr>' END
         || '<th scope="row">' || CASE WHEN r.cells[1] = '' THEN ' ' ELSE r.cells[1] END || '</th><td>' || r.cells[2] || '</td><td>a &amp; b</td></tr>'), '') || '</tbody></table>' || chr(10) || '</main>' AS result
    FROM n JOIN region ON r_regionkey = n_regionkey""",
)
def tabular_fragment(spark, sf_dir):
    """One table per region. Rendering needs all rows of a table in one row, as a file does."""
    nations = table(spark, sf_dir, "nation").select(
        "n_regionkey",
        F.struct(
            "n_nationkey",
            F.array(F.when(F.col("n_nationkey") % 6 == 0, "").otherwise(F.col("n_name")), F.col("n_nationkey").cast("string"), F.lit("a & b")).alias("cells"),
        ).alias("row"),
    )
    grouped = nations.groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["cells"]).alias("rows"))
    regions = table(spark, sf_dir, "region").join(grouped, F.col("r_regionkey") == F.col("n_regionkey"))
    fragment = html.tabular_fragment(
        F.concat(F.lit("nations_of-"), F.lower("r_name")), F.col("r_name"), F.array(F.lit("name"), F.lit("key"), F.lit("note")), F.col("rows")
    )
    return regions.select(F.col("r_regionkey").alias("region"), fragment.alias("result"))


@query(
    "str_36_newspaper_simplified",
    f"""WITH s AS (SELECT page_id, {sql_rewrite('html', [(r'(?i)<div\b[^>]*>', '<section>'), (r'(?i)</div\s*>', '</section>'), (r'(?i)<section>\s*</section>', ''), text.BLANK_RUNS])} AS html FROM {MAIN_PAGES_SQL})
    SELECT page_id, length(html) > 4000 AS noticed, regexp_replace(html, '(?is)<figure\\b[^>]*>.*?</figure>', '', 'g') AS body FROM s""",
)
def newspaper_simplified(spark, sf_dir):
    notice = r'(?s)<div class="audit-note".*?</div>\n'
    simplified = main_pages(spark, sf_dir).select("page_id", html.newspaper_simplified(F.col("html"), 4000).alias("html"))
    return simplified.select(
        "page_id", F.col("html").rlike(notice).alias("noticed"), F.regexp_replace("html", notice, "").alias("body")
    )


TITLES = ["scan_of-report_page_12", "DAILY NEWS", "transcription", "Mixed Case-title", " the_annual--report ", "1234"]


@query(
    "str_24_clean_titles",
    f"SELECT doc_id, {sql_case(sql_pick(TITLES, 'doc_id'), {'scan_of-report_page_12': 'Scan Of Report', 'DAILY NEWS': 'Daily News', 'Mixed Case-title': 'Mixed Case title', ' the_annual--report ': 'The Annual Report'}, quote(''))} AS title,"
    f" CASE WHEN {sql_pick(TITLES, 'doc_id')} IN ('transcription', '1234') THEN '' ELSE 'Cover Page' END AS subheading FROM documents",
)
def clean_titles(spark, sf_dir):
    title = pick(TITLES, F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_title(title).alias("title"), text.cover_subheading(title).alias("subheading"))


_FIRST_H1 = "regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)"
_H1_TEXT = sql_replace(sql_squash(sql_replace(sql_rewrite(_FIRST_H1, text.TAG_STRIP_RULES), fixed.HTML_ENTITIES)), fixed.TEXT_ARTIFACTS)


@query("str_26_first_heading", f"SELECT page_id, rtrim({_H1_TEXT}, ' .,:;') AS heading FROM pages")
def first_heading(spark, sf_dir):
    return text_table(spark, sf_dir, "pages", "page_id").select("page_id", text.first_heading(F.col("html")).alias("heading"))


@query(
    "str_28_page_numbers",
    """SELECT page_id, coalesce(CAST(CAST(nullif(coalesce(nullif(regexp_extract(url, '(?i)\\bpage[-_ ]?([0-9]{1,4})\\b', 1), ''), regexp_extract(CASE WHEN page_id % 3 = 0 THEN 'see Page 0' || (page_id % 90) ELSE '' END, '(?i)\\bpage[-_ ]?([0-9]{1,4})\\b', 1)), '') AS INT) AS VARCHAR), '') AS page_number FROM pages""",
)
def page_numbers(spark, sf_dir):
    sample = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("see Page 0"), (F.col("page_id") % 90).cast("string"))).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", text.page_number(F.col("url"), sample).alias("page_number"))


AUTHORS = ["", "A. Writer", "Library staff", ""]
SAMPLES = ["at https://example.org/a.)", "from nla.gov.au archive", "no link", "see https://archive.org/x here"]
STEMS = ["gazette_123456_subset_3pages", "plain", "other"]


@query(
    "str_29_source_attribution",
    f"""WITH a AS (SELECT page_id, {sql_pick(AUTHORS, 'page_id')} AS author, {sql_pick(SAMPLES, 'page_id')} AS sample, {sql_pick(STEMS, 'page_id')} AS stem FROM pages),
    b AS (SELECT *, rtrim(regexp_extract(sample, '(?i)https?://[^\\s<>()]+', 0), '.,);]') AS url FROM a)
    SELECT page_id, CASE WHEN contains(sample, 'nla.gov.au') THEN 'National Library of Australia' WHEN contains(sample, 'archive.org') OR starts_with(stem, 'gazette') THEN 'Internet Archive' ELSE author END AS label,
      CASE WHEN contains(sample, 'nla.gov.au') OR contains(sample, 'archive.org') THEN url WHEN starts_with(stem, 'gazette') THEN 'https://archive.org/details/gazette_123456' WHEN author <> '' THEN url ELSE '' END AS url FROM b""",
)
def source_attribution(spark, sf_dir):
    key = F.col("page_id")
    found = text.source_attribution(pick(AUTHORS, key), F.lit(""), F.lit(""), pick(SAMPLES, key), pick(STEMS, key))
    return table(spark, sf_dir, "pages").select("page_id", found.alias("a")).select("page_id", "a.*")


@query(
    "str_33_header_citation",
    f"""WITH c AS (SELECT page_id, html, concat_ws(', ', nullif(rtrim({_H1_TEXT}, ' .,:;'), ''), CASE WHEN page_id % 2 = 0 THEN 'MONDAY, MARCH 4, 1912' END, 'Page ' || (page_id % 30 + 1)) AS cite FROM {MAIN_PAGES_SQL})
    SELECT page_id, regexp_replace(html, '(?i)(<main\\b[^>]*>\\s*)', '\\1' || chr(1)) LIKE '%' || chr(1) || '%' AS placed,
      replace(regexp_replace(html, '(?i)(<main\\b[^>]*>\\s*)', '\\1' || chr(1)), chr(1), '<header><cite>' || {sql_replace('cite', fixed.HTML_ESCAPES)} || '</cite></header>' || chr(10)) AS result FROM c""",
)
def header_citation(spark, sf_dir):
    dateline = F.when(F.col("page_id") % 2 == 0, "on MONDAY, MARCH 4, 1912. x").otherwise("")
    number = F.concat(F.lit("page "), (F.col("page_id") % 30 + 1).cast("string"))
    cited = main_pages(spark, sf_dir).withColumn("cite", citation(F.col("html"), dateline, number))
    result = html.rewrite_first(F.col("html"), r"(?i)(<main\b[^>]*>)", header_block(F.col("html"), F.col("cite")))
    return cited.select("page_id", F.lit(True).alias("placed"), result.alias("result"))


def citation(page, sample, number):
    """STR-33: first heading, dateline and page number joined into a citation."""
    parts = [text.first_heading(page), text.publication_date(sample)]
    page_no = text.page_number(number)
    return F.concat_ws(", ", *[F.when(p != "", p) for p in parts], F.when(page_no != "", F.concat(F.lit("Page "), page_no)))


def header_block(page, cite):
    opened = F.regexp_extract(page, r"(?i)<main\b[^>]*>", 0)
    return F.concat(opened, F.lit("<header><cite>"), text.escape_html(cite), F.lit("</cite></header>\n"))


@query(
    "str_34_source_footer",
    f"""SELECT page_id, regexp_replace(html, '(?i)</main\\s*>', '<footer><cite>' || {sql_replace("'A. Writer & co'", fixed.HTML_ESCAPES)} || '</cite></footer>' || chr(10) || '</main>') AS result FROM {MAIN_PAGES_SQL}""",
)
def source_footer(spark, sf_dir):
    footer = F.concat(F.lit("<footer><cite>"), text.escape_html(F.lit("A. Writer & co")), F.lit("</cite></footer>\n</main>"))
    return main_pages(spark, sf_dir).select("page_id", html.rewrite_first(F.col("html"), r"(?i)</main\s*>", footer).alias("result"))


@query(
    "str_39_ocr_lines",
    f"""WITH l AS (SELECT doc_id, trim({sql_squash('line')}, '*# ') AS line, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE {sql_squash('line')} <> '')
    SELECT doc_id, pos, CASE WHEN len(string_split(line, ' ')) <= 8 AND regexp_matches(line, '\\p{{L}}') AND (NOT regexp_matches(line, '[\\p{{Ll}}]') OR ends_with(line, ':'))
      THEN '<h3>' || rtrim({sql_replace('line', fixed.HTML_ESCAPES)}, ':') || '</h3>' ELSE '<p>' || {sql_replace('line', fixed.HTML_ESCAPES)} || '</p>' END AS html FROM l""",
)
def ocr_lines(spark, sf_dir):
    from quirekit.functions.classify import ocr_line_html

    docs = text_table(spark, sf_dir, "documents", "doc_id")
    found = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(squash(F.col("line")) != "")
    return found.select("doc_id", F.col("pos").cast("bigint").alias("pos"), ocr_line_html(F.col("line")).alias("html"))


@query(
    "cls_19_accessibility_score",
    f"""WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'newspaper' WHEN 1 THEN 'comic' ELSE 'manual' END AS profile, html FROM {DOC_HTML_SQL}),
    s AS (SELECT doc_id, profile, 100 - CASE WHEN regexp_matches(html, '<html[^>]*lang=') THEN 0 ELSE 10 END - CASE WHEN contains(html, '<main') THEN 0 ELSE 10 END
      - CASE WHEN contains(html, '<h1') THEN 0 ELSE 10 END - CASE WHEN contains(html, '<h2') THEN 0 ELSE 10 END
      - CASE WHEN profile = 'newspaper' AND NOT contains(html, '<header>') THEN 20 ELSE 0 END - CASE WHEN profile = 'newspaper' AND NOT contains(html, '<footer>') THEN 20 ELSE 0 END
      - CASE WHEN profile <> 'manual' AND NOT contains(html, '<img') THEN 15 ELSE 0 END - CASE WHEN profile = 'comic' AND contains(html, '<section>') THEN 15 ELSE 0 END AS score FROM c)
    SELECT doc_id, profile, score::DOUBLE AS score, CASE WHEN score >= 97 THEN 'A+' WHEN score >= 93 THEN 'A' WHEN score >= 90 THEN 'A-' WHEN score >= 87 THEN 'B+' WHEN score >= 83 THEN 'B'
      WHEN score >= 80 THEN 'B-' WHEN score >= 77 THEN 'C+' WHEN score >= 73 THEN 'C' WHEN score >= 70 THEN 'C-' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""",
)
def accessibility_score(spark, sf_dir):
    from quirekit.functions.routing import accessibility_score as scored

    page = F.col("html")
    profile = pick(["newspaper", "comic", "manual"], F.col("doc_id"))
    checks = {
        "has_lang_dir_root": page.rlike("<html[^>]*lang="),
        "has_main_landmark": page.contains("<main"),
        "has_h1": page.contains("<h1"),
        "has_h2": page.contains("<h2"),
        "has_page_header_cite": page.contains("<header>"),
        "has_source_footer_cite": page.contains("<footer>"),
        "has_image_description": page.contains("<img"),
        "no_empty_panel_sections": ~page.contains("<section>"),
    }
    graded = doc_html(spark, sf_dir).select("doc_id", profile.alias("profile"), scored(profile, checks).alias("s"))
    return graded.select("doc_id", "profile", "s.*")
