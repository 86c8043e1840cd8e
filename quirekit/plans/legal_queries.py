"""Classifier queries over document lines and legal block rewrites over documents as HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.functions import classify, fixed, labels as label_rules, legal, text
from quirekit.functions.html import tag
from quirekit.functions.lines import content_lines
from quirekit.functions.rewrite import squash
from quirekit.operators.documents import staged
from quirekit.plans.inputs import pick, sql_pick
from quirekit.plans.registry import (
    inject, query, quote, re2, sql_inject, sql_list, sql_replace, sql_rewrite, sql_squash, sql_strip, text_table,
)

# Labels put after each document's own lines, so that every class has members.
LABELS = [
    "Chapter 1 Preliminary", "Part 2-3 Powers of officers 14", "12 12 Objects of Act", "Division 3-Enforcement of orders", "Section 14",
    "Section 14A the officer must act", "Privacy Act 1988", "Privacy Act 1988 No. 4, 1988", "No. 12, 2003 Crimes Rules 2003 xii", "xiv",
    "page 23", "Page 23 of 40", "Crimes Bill 1999 Part 3", "see section 4 and 12.", "Chapter or Part", "1999.", "3 March 1999.",
    "Part 2 of Chapter 3", "Part 4 Powers of the", "under Part 3 and Division 2 Orders", "14A Review of decisions", "notes", "Commencement information",
    "and the functions of the body", "Complaints about carers", "(a) something small", "SYDNEY MORNING HERALD", "The officer walked slowly.",
    "Sept. 1914 WAR DIARY of the unit 12", "A Short Title Here", "Objects &amp; purposes", "10 20 Chapter 4 Orders", "Contents ..... 12",
    "FIRST ACT", "SCENE: a garden", "HAMLET (cont'd)", "Ham: To be or not", "*aside* : softly now", "(Exit all)", "LEAR II-14", "KING LEAR",
    "Part 3 Offences against this Division 2 Example", "This Act may be cited", "12A. Payment", "ordinary words without end",
]


def labels(spark, sf_dir):
    """One row per line of every document, plus two labels per document."""
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    key = F.col("doc_id")
    body = F.concat("text", F.lit("\n"), pick(LABELS, key), F.lit("\n"), pick(LABELS, key * 3 + 1))
    found = docs.select("doc_id", F.posexplode(content_lines(body)).alias("pos", "line"))
    return found.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


_BODY = f"text || chr(10) || {sql_pick(LABELS, 'doc_id')} || chr(10) || {sql_pick(LABELS, '(doc_id * 3 + 1)')}"
_LINES = f"list_filter(list_transform(string_split({_BODY}, chr(10)), lambda l: {sql_strip('l')}), lambda l: l <> '')"


def _label_sql(chars):
    return sql_squash(sql_replace(sql_replace("line", fixed.HTML_ENTITIES), fixed.TEXT_ARTIFACTS), chars)


LABELS_SQL = f"""WITH l0 AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) - 1 AS pos FROM documents),
  l1 AS (SELECT *, {_label_sql(' -|:')} AS plain, {_label_sql(' -|')} AS bare FROM l0),
  l2 AS (SELECT *, {label_rules.sql_columns('plain')[0]}, {label_rules.sql_columns('bare')[0]} FROM l1),
  l AS MATERIALIZED (SELECT *, {label_rules.sql_columns('plain')[1]}, {label_rules.sql_columns('bare')[1]} FROM l2)"""


def rx(expr, pattern):
    return f"regexp_matches({expr}, {quote(re2(pattern))})"


def _on_labels(name, tests, sql):
    columns = ", ".join(f"{expr} AS {alias}" for alias, expr in sql.items())

    @query(name, f"{LABELS_SQL} SELECT doc_id, pos, {columns} FROM l")
    def run(spark, sf_dir):
        return labels(spark, sf_dir).select("doc_id", "pos", *[fn(F.col("line")).alias(alias) for alias, fn in tests.items()])


def _title(plain="plain"):
    rest = f"regexp_replace(regexp_extract({plain}, {quote(classify.RUNNING_HEADER)}, 1), '\\s+[0-9]{{1,4}}$', '')"
    return f"trim(regexp_extract({rest}, {quote(classify.CAPITAL_TITLE)}, 1))", f"trim(regexp_extract({rest}, {quote(classify.CAPITAL_TITLE)}, 2))"


_WORDS = f"regexp_extract_all(plain, {quote(classify.HEADING_WORD)})"
_LETTERS = "length(regexp_replace(plain, '[^\\p{L}]', '', 'g'))"
_CAPITALS = "length(regexp_replace(plain, '[^\\p{Lu}]', '', 'g'))"
_HEADING_SQL = f"""(plain <> '' AND length(plain) <= 180 AND {_LETTERS} > 0 AND NOT regexp_matches(plain, '[.?!]$') AND (
  {rx('plain', classify.SECTION_LABEL)} OR {_title()[0]} <> '' OR {_CAPITALS} >= 0.7 * {_LETTERS}
  OR (length(plain) <= 90 AND len({_WORDS}) BETWEEN 2 AND 10 AND len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^[A-Z0-9]'))) >= 0.6 * len({_WORDS}))
  OR {rx('plain', classify.NUMBERED_SENTENCE)} OR {rx('plain', classify.SENTENCE_LABEL)}))"""
_on_labels("cls_01_heading_likeness", {"heading": classify.looks_like_heading}, {"heading": _HEADING_SQL})
_on_labels(
    "cls_02_running_headers",
    {"title": lambda c: classify.running_header_parts(c)["title"], "rest": lambda c: classify.running_header_parts(c)["rest"]},
    {"title": _title()[0], "rest": _title()[1]},
)
_BARE, _PLAIN = label_rules.sql_rules("bare"), label_rules.sql_rules("plain")
_RUNNING_SQL = f"(bare <> '' AND length(bare) <= 120 AND NOT {rx('bare', classify.ORIGINAL_PAGE)} AND {_BARE['title']})"
_on_labels(
    "cls_03_page_furniture",
    {"furniture": classify.is_page_furniture},
    {
        "furniture": f"(bare <> '' AND length(bare) <= 180 AND ({rx('bare', classify.PAGE_NUMBER_ONLY)} OR {rx('bare', classify.SERIES_NUMBER)}"
        f" OR {_RUNNING_SQL}))"
    },
)
_on_labels(
    "cls_04_running_heads",
    {"title": classify.is_running_title, "legal": classify.is_legal_running_head},
    {"title": _RUNNING_SQL, "legal": f"(bare <> '' AND ({_BARE['series']} OR {_BARE['paged']}))"},
)
_PREFIX = f"trim(regexp_extract(plain, {quote(re2(classify.REORDERED_HEAD))}, 1))"
_REORDERED = f"(length(plain) <= 180 AND {_PREFIX} <> '' AND NOT {rx(_PREFIX, classify.STRUCTURE_WORD)} AND NOT {rx(_PREFIX, classify.PUNCTUATION_ONLY)})"
_on_labels("cls_05_reordered_heads", {"reordered": classify.is_reordered_head}, {"reordered": _REORDERED})
_SPLIT = f"(plain <> '' AND {_PLAIN['loose']})"
_INCOMPLETE = f"(plain <> '' AND {_PLAIN['unfinished']})"
_CONTINUES = f"(plain <> '' AND NOT contains(line, '<') AND {_PLAIN['carries']})"
_on_labels(
    "cls_06_fragments",
    {
        "split_fragment": classify.is_split_fragment,
        "breadcrumb": classify.is_breadcrumb,
        "complete": classify.is_complete_reference,
        "incomplete": classify.is_incomplete_heading,
        "continuation": classify.is_continuation,
    },
    {
        "split_fragment": _SPLIT,
        "breadcrumb": f"(plain <> '' AND ({rx('plain', classify.BREADCRUMB)} OR {_REORDERED}))",
        "complete": f"(plain <> '' AND {_PLAIN['cited']})",
        "incomplete": _INCOMPLETE,
        "continuation": _CONTINUES,
    },
)
# The repeated clause number is compared token by token, since the oracle has no back-references.
_STEP1 = f"regexp_replace(plain, {quote(re2(classify.FUSED_STRUCTURE))}, '\\1 \\2 \\3')"
_TWO = f"regexp_extract(f1, '^({classify.CLAUSE})\\s+({classify.CLAUSE})(\\s+[A-Z].*)$', ['a', 'b', 'c'])"
_NORMAL_SQL = f"""n AS (SELECT *, CASE WHEN {_REORDERED} THEN plain ELSE trim(regexp_replace(regexp_replace(CASE WHEN ({_TWO}).a <> '' AND ({_TWO}).a = ({_TWO}).b
    THEN ({_TWO}).a || ({_TWO}).c ELSE f1 END, {quote(re2(classify.LEADING_NUMBERS))}, '\\1'), {quote(re2(classify.TRAILING_NUMBER))}, '\\1')) END AS head
  FROM (SELECT *, {_STEP1} AS f1 FROM l))"""
_TAG_SQL = f"""CASE WHEN plain = '' OR {_REORDERED} OR {_INCOMPLETE} OR {_SPLIT} OR regexp_full_match(plain, '(?i)Section\\s+{classify.REFERENCE}') THEN NULL
  WHEN regexp_full_match(plain, '(?i)Chapter\\s+{classify.REFERENCE}(\\s+.+)?') THEN 'h2' WHEN regexp_full_match(plain, '(?i)Part\\s+{classify.REFERENCE}(\\s+.+)?') THEN 'h3'
  WHEN regexp_full_match(plain, '(?i)(Division|Subdivision)\\s+{classify.REFERENCE}(\\s+.+)?') THEN 'h4'
  WHEN regexp_full_match(plain, '{classify.CLAUSE}\\s+[A-Z].*') AND NOT regexp_matches(plain, '[.?!]$') THEN 'h4'
  WHEN lower(plain) IN ({sql_list(classify.NAMED_HEADINGS)}) THEN 'h5' END"""


@query("leg_03_heading_candidates", f"{LABELS_SQL}, {_NORMAL_SQL} SELECT doc_id, pos, head FROM n")
def heading_candidates(spark, sf_dir):
    return labels(spark, sf_dir).select("doc_id", "pos", classify.legal_heading(F.col("line")).alias("head"))


@query("leg_04_heading_levels", f"""{LABELS_SQL}, {_NORMAL_SQL}, m AS (SELECT doc_id, pos, head AS plain FROM n), m2 AS (SELECT *, {label_rules.sql_columns('plain')[0]} FROM m), m3 AS MATERIALIZED (SELECT *, {label_rules.sql_columns('plain')[1]} FROM m2) SELECT doc_id, pos, {_TAG_SQL} AS level FROM m3""")
def heading_levels(spark, sf_dir):
    return labels(spark, sf_dir).select("doc_id", "pos", classify.legal_heading_tag(F.col("line")).alias("level"))


@query(
    "leg_05_extractors",
    f"""{LABELS_SQL}, {_NORMAL_SQL} SELECT doc_id, pos, regexp_extract(head, '^({classify.CLAUSE})\\s+[A-Z]', 1) AS clause, regexp_extract(head, '(?i)^Section\\s+({classify.REFERENCE})$', 1) AS section,
    regexp_extract(head, '(?i)^Section\\s+({classify.REFERENCE})\\s+(.+)$', 1) AS prefixed, trim(regexp_extract(head, '(?i)^Section\\s+({classify.REFERENCE})\\s+(.+)$', 2)) AS rest,
    lower(regexp_extract(head, '(?i)^({classify.STRUCTURE})\\s+{classify.REFERENCE}(\\s+.+)?$', 1)) AS kind FROM n""",
)
def extractors(spark, sf_dir):
    # The heading is worked out once a line, in a projection of its own.
    heads = labels(spark, sf_dir).select("doc_id", "pos", classify.legal_heading(F.col("line")).alias("head"))
    head = F.col("head")
    return heads.select(
        "doc_id",
        "pos",
        classify.clause_of(head).alias("clause"),
        classify.section_of(head).alias("section"),
        classify.prefix_of(head)["number"].alias("prefixed"),
        classify.prefix_of(head)["rest"].alias("rest"),
        classify.kind_of(head).alias("kind"),
    )


_COMPACT = sql_squash("line")
_on_labels(
    "str_38_line_headings",
    {"heading": classify.is_heading_line, "section": classify.is_section_line},
    {
        "heading": f"""(length({_COMPACT}) <= 120 AND (regexp_matches({_COMPACT}, '^(Chapter |Part |Division |Schedule |Contents)')
          OR regexp_matches({_COMPACT}, '^[A-Z][A-Za-z ,.&''()/:-]{{0,120}}\\b(Bill|Act|Rules|Regulations)\\s+[0-9]{{4}}$')
          OR (len(string_split({_COMPACT}, ' ')) <= 10 AND NOT regexp_matches({_COMPACT}, '[\\p{{Ll}}]') AND regexp_matches({_COMPACT}, '\\p{{L}}'))))""",
        "section": f"(length({_COMPACT}) <= 140 AND NOT regexp_matches({_COMPACT}, '^(Chapter |Part |Division |Schedule |Contents|[(\\[])') AND regexp_matches({_COMPACT}, '^[0-9]+\\.* \\p{{Lu}}'))",
    },
)
_UP = f"upper({_COMPACT})"
_SPEAKER = f"trim(regexp_extract({_COMPACT}, '^([^:]*):', 1))"
_on_labels(
    "str_37_transcript_lines",
    {"kind": classify.transcript_kind},
    {
        "kind": f"""CASE WHEN {_UP} IN ({sql_list(fixed.TRANSCRIPT_ACTS)}) OR regexp_matches({_UP}, '^ACT\\s+[IVXLCDM0-9]+$') OR regexp_matches({_UP}, '^(SCENE:|SCENE |THE PERSONS IN THE PLAY|THE SCENES OF THE PLAY|TIME:)') THEN 'heading'
        WHEN regexp_matches({_COMPACT}, '^.+?\\s+[IVXLCDM]+-[0-9]+$') AND length({_COMPACT}) <= 90 THEN 'page'
        WHEN regexp_matches({_COMPACT}, '^\\*[^*]{{2,}}\\*\\s*:\\s*\\S.*$') THEN 'staged_speech'
        WHEN length({_COMPACT}) >= 3 AND regexp_matches({_COMPACT}, '^(\\*.*\\*|\\(.*\\)|\\[.*\\])$') THEN 'direction'
        WHEN regexp_matches({_COMPACT}, '^[^:]+:\\s*\\S') AND {_SPEAKER} <> '' AND length({_SPEAKER}) <= 80 AND NOT regexp_matches({_SPEAKER}, '^[*(\\[]') AND regexp_matches({_SPEAKER}, '\\p{{L}}') THEN 'speech'
        WHEN length({_COMPACT}) <= 50 AND NOT regexp_matches({_COMPACT}, '[0-9:;?!]') AND (NOT regexp_matches({_COMPACT}, '[\\p{{Ll}}]') OR regexp_matches({_COMPACT}, '^[A-Z][A-Z .''\\-]+\\s+\\((cont''d|CONT''D)\\)$'))
          AND regexp_matches({_COMPACT}, '\\p{{L}}') AND len(string_split_regex(trim(regexp_replace({_COMPACT}, '\\((cont''d|CONT''D)\\)', '', 'g')), '\\s+')) <= 5 THEN 'cue'
        ELSE 'text' END"""
    },
)


@query(
    "leg_02_legal_documents",
    f"""WITH d AS (SELECT doc_id, {sql_squash(_BODY)} AS plain FROM documents)
    SELECT doc_id, (({rx('plain', classify.LEGAL_CUES)} AND ({rx('plain', rf'(?i){chr(92)}b(?:Chapter|Part|Division|Subdivision|Section){chr(92)}s+{classify.REFERENCE}{chr(92)}b')} OR {rx('plain', classify.CLAUSE_CUE)}))
      OR ({rx('plain', rf'(?i){chr(92)}bPart{chr(92)}s+{classify.REFERENCE}{chr(92)}b')} AND {rx('plain', rf'(?i){chr(92)}b(?:Chapter|Section){chr(92)}s+{classify.REFERENCE}{chr(92)}b')})) AS legal FROM d""",
)
def legal_documents(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    key = F.col("doc_id")
    body = F.concat("text", F.lit("\n"), pick(LABELS, key), F.lit("\n"), pick(LABELS, key * 3 + 1))
    return docs.select("doc_id", squash(body).alias("plain")).select("doc_id", classify.looks_legal(F.col("plain")).alias("legal"))


# --- Block rewrites ----------------------------------------------------------------------

# Each part starts with a closed sentence, so that parts do not run into each other.
_CLOSED = "<p>Z.</p>"
LEGAL_PARTS = [
    (2, 0, _CLOSED + "<p>as set out in sections 4 and</p><h3>12.</h3><h2>14</h2><p>Crimes Bill 1999 Part 3</p>"),
    (3, 0, _CLOSED + "<h2>Chapter 1 Preliminary</h2><p>matters of the day</p><h3>3 March 1999</h3><h3>Part 2 of Chapter 3</h3>"),
    (3, 1, _CLOSED + "<h4>12 Review of decisions (1) A person may apply</h4><p>Z.</p><h3>Part 2</h3><h3>Part 2 Powers of officers</h3>"),
    (4, 2, _CLOSED + "<h2>Chapter 4 Orders</h2><h3>Part 1 Who</h3><p>x</p><h2>Chapter 4 Orders</h2><h3>Part 1 Who</h3><p>y</p>"),
    (5, 3, _CLOSED + "<p>[Original Page Number: 12]</p><p>Part 3 Orders</p><p>Division 2 Fines</p><h4>14 Fines</h4><p>Section 14 (a) the first</p>"),
    (
        5, 4,
        _CLOSED + "<h1>Contents</h1><h2>Chapter 1 ...... 1</h2><h3>Part 1 ..... 2</h3><h3>Part 2 ...... 3</h3><p>a ..... 4</p><p>b ..... 5</p><p>c ..... 6</p>"
        "<h4>1 Short title</h4><h4>Section 2</h4><ol start=\"2\"><li>x</li></ol><footer><p>[Original Page Number: 3]</p></footer>",
    ),
]


def legal_html(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    body = F.array_join(F.transform(content_lines(F.col("text")), lambda line: tag("p", text.escape_html(line))), "\n")
    return docs.select("doc_id", inject(body, F.col("doc_id"), LEGAL_PARTS).alias("html"))


_STRIPPED = sql_strip("l")
_PARAGRAPHS = (
    f"array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: {_STRIPPED} <> ''),"
    f" lambda l: '<p>' || {sql_replace(_STRIPPED, fixed.HTML_ESCAPES)} || '</p>'), chr(10))"
)
LEGAL_HTML_SQL = f"(SELECT doc_id, {sql_inject(_PARAGRAPHS, 'doc_id', LEGAL_PARTS)} AS html FROM documents)"


def _on_legal(name, fn, sql_expr=None):
    oracle = None if sql_expr is None else f"SELECT doc_id, {sql_expr} AS result FROM {LEGAL_HTML_SQL}"

    @query(name, oracle)
    def run(spark, sf_dir):
        return legal_html(spark, sf_dir).select("doc_id", fn(F.col("html")).alias("result"))


# The oracle for each rewrite states what the rule does to the fragments that were put in.
_on_legal(
    "leg_06_split_references", legal.merge_split_references,
    "replace(html, '<p>as set out in sections 4 and</p><h3>12.</h3>', '<p>as set out in sections 4 and 12.</p>')",
)
_on_legal(
    "leg_07_front_contents", legal.strip_front_contents,
    f"replace(html, {quote(LEGAL_PARTS[5][2].removeprefix(_CLOSED).split('<h4>1 ')[0])}, '<h1>Contents</h1>' || chr(10))",
)
_on_legal("leg_08_reordered_heads", legal.strip_reordered_heads, "replace(html, '<p>Crimes Bill 1999 Part 3</p>', '')")
_on_legal(
    "leg_09_continuations", legal.merge_continuations,
    # A fragment that starts in lower case carries on the structure heading before it, however short it is;
    # a trailing page number is not part of a heading.
    sql_replace(
        "html",
        [
            ("<h2>Chapter 1 Preliminary</h2><p>matters of the day</p>", "<h2>Chapter 1 Preliminary matters of the day</h2>"),
            ("<h3>Part 1 Who</h3><p>x</p>", "<h3>Part 1 Who x</h3>"),
            ("<h3>Part 1 Who</h3><p>y</p>", "<h3>Part 1 Who y</h3>"),
            ("<h3>Part 2 ...... 3</h3><p>a ..... 4</p>", "<h3>Part 2 ...... 3 a .....</h3>"),
        ],
    ),
)
_on_legal(
    "leg_10_demotions", legal.demote_fragments,
    # dates, cross-references, bare numbers with a stop and contents lines with leaders
    sql_replace(
        "html",
        [
            ("<h3>12.</h3>", "<p>12.</p>"),
            ("<h3>3 March 1999</h3>", "<p>3 March 1999</p>"),
            ("<h3>Part 2 of Chapter 3</h3>", "<p>Part 2 of Chapter 3</p>"),
            ("<h2>Chapter 1 ...... 1</h2>", "<p>Chapter 1 ...... 1</p>"),
            ("<h3>Part 1 ..... 2</h3>", "<p>Part 1 ..... 2</p>"),
            ("<h3>Part 2 ...... 3</h3>", "<p>Part 2 ...... 3</p>"),
        ],
    ),
)
_on_legal(
    "leg_11_same_structure", legal.dedupe_same_structure,
    "replace(html, '<h3>Part 2</h3><h3>Part 2 Powers of officers</h3>', '<h3>Part 2 Powers of officers</h3>')",
)
_on_legal(
    "leg_12_spliced_subsections", legal.split_spliced_subsections,
    "replace(html, '<h4>12 Review of decisions (1) A person may apply</h4>', '<h4>12 Review of decisions</h4><p>(1) A person may apply</p>')",
)
_on_legal(
    "leg_13_restart_blocks", legal.dedupe_restart_blocks,
    "replace(html, '<p>x</p><h2>Chapter 4 Orders</h2><h3>Part 1 Who</h3><p>y</p>', '<p>x</p><p>y</p>')",
)
_on_legal("leg_14_restart_sections", legal.strip_restart_sections, "replace(html, '<h4>Section 2</h4><ol', '<ol')")
_on_legal(
    "leg_15_breadcrumb_runs", legal.strip_breadcrumb_runs,
    "replace(html, '<p>[Original Page Number: 12]</p><p>Part 3 Orders</p><p>Division 2 Fines</p>', '<p>[Original Page Number: 12]</p>')",
)
_on_legal("leg_16_fused_prefixes", legal.strip_fused_prefixes, "replace(html, '<p>Section 14 (a) the first</p>', '<p>(a) the first</p>')")
_on_legal("leg_17_numeric_headings", legal.strip_numeric_headings, sql_rewrite("html", [(rf"(?i)<h{n}\b[^>]*>\s*[0-9]{{1,4}}\s*</h{n}>", "") for n in range(1, 7)]))
_on_legal("htm_24_footer_markers", legal.unwrap_footer_markers, sql_rewrite("html", [legal.FOOTER_MARKER]))


@query("leg_01_integrity_contract")
def integrity_contract(spark, sf_dir):
    return staged(legal_html(spark, sf_dir), "html", legal.CONTRACT).withColumnRenamed("html", "result")
