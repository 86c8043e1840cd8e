"""Look-back rules of the legal contract over documents as HTML, with SQL over the unnested blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.functions import classify, fixed, labels as label_rules, legal, text
from quirekit.functions.html import tag
from quirekit.functions.lines import content_lines
from quirekit.plans.legal_queries import _INCOMPLETE, _NORMAL_SQL, _PARAGRAPHS, _REORDERED, _label_sql, rx
from quirekit.plans.registry import inject, query, sql_inject, text_table

# Each part begins with a closed sentence, so that parts do not run into each other.
PARTS = [
    (2, 0, "<p>Z.</p><h2>Chapter 1 Preliminary</h2><h4>1 Short title</h4><p>text a</p><p>Section 1 (a) first words</p><p>Section 1</p><h2>Chapter 1 Preliminary</h2>"),
    (3, 1, "<p>Z.</p><p>Section 7 (b) before its clause</p><h4>7 Meaning of terms</h4><p>b</p><h3>Part 2 Powers</h3><p>c</p><h3>Part 2 Powers</h3><p>Section 7</p>"),
    (5, 2, "<p>Z.</p><p>[Original Page Number: 9]</p><p>Section 12</p><h4>12 Fines</h4><p>Chapter 3 Orders</p><p>Part 1 Who</p><h4>13 Payment</h4><p>Part 1 Who</p><h4>14 Costs</h4>"),
    (4, 3, "<p>Z.</p><h4>20 Appeals</h4>" + "<p>w.</p>" * 10 + "<p>Section 20</p><p>Section 21 (c) another number</p><h3>Division 2 Fines</h3><p>Section 22</p>"),
    (3, 2, "<p>Z.</p><p>Section 30</p>" + "<p>w.</p>" * 7 + "<h4>30 Far behind</h4><p>Section 31</p><h4>31A Not the same</h4><h3>Section 32</h3><h4>32 Heading of its own</h4>"),
    (7, 3, "<p>Z.</p><p>Division 4 Costs<br>Section 40</p><h4>40 Interest</h4><p>Section 40 (a) one</p><p>Section 41 (b) two</p><h4>41 Tax</h4><p>Section 40 (c) three</p>"),
]
_PIECE = r"\s*<(?:p|h[1-6])[^>]*>(?:[^<]|<br>)*</(?:p|h[1-6])>"


def documents(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    body = F.array_join(F.transform(content_lines(F.col("text")), lambda line: tag("p", text.escape_html(line))), "\n")
    return docs.select("doc_id", inject(body, F.col("doc_id"), PARTS).alias("html"))


_HTML = f"(SELECT doc_id, {sql_inject(_PARAGRAPHS, 'doc_id', PARTS)} AS html FROM documents)"
_RULES = label_rules.sql_columns
#: Blocks of each document with the facts of their labels: one row a paragraph or heading.
_FACTS = f"""WITH p0 AS (SELECT doc_id, unnest(regexp_extract_all(html, '{_PIECE}')) AS piece, generate_subscripts(regexp_extract_all(html, '{_PIECE}'), 1) AS pos FROM {_HTML}),
  l0 AS (SELECT *, regexp_extract(piece, '<(p|h[1-6])', 1) AS name, regexp_replace(piece, '<[^>]*>', ' ', 'g') AS line FROM p0),
  l1 AS (SELECT *, {_label_sql(' -|:')} AS plain FROM l0), l2 AS (SELECT *, {_RULES('plain')[0]} FROM l1), l AS MATERIALIZED (SELECT *, {_RULES('plain')[1]} FROM l2), {_NORMAL_SQL},
  f AS MATERIALIZED (SELECT doc_id, pos, piece, name, plain, head, regexp_extract(head, '^({classify.CLAUSE})\\s+[A-Z]', 1) AS clause, regexp_extract(head, '(?i)^Section\\s+({classify.REFERENCE})$', 1) AS section,
    lower(regexp_extract(head, '(?i)^({classify.STRUCTURE})\\s+{classify.REFERENCE}(\\s+.+)?$', 1)) AS kind, regexp_full_match(plain, '(?i)\\[Original Page Number:\\s*\\d+\\]') AS marker,
    name = 'p' AND NOT contains(piece, '<br>') AND plain <> '' AND ({rx('plain', classify.BREADCRUMB)} OR {_REORDERED}) AS crumb FROM n)"""


def _on_blocks(name: str, rule, kept: str, piece: str = "piece", extra: str = "") -> None:
    """``kept`` says which rows of the facts (or of ``extra``'s table g) stay, ``piece`` what they become."""
    source = "g" if extra else "f"
    oracle = f"{_FACTS}{extra} SELECT doc_id, string_agg({piece}, '' ORDER BY pos) AS result FROM {source} WHERE {kept} GROUP BY doc_id"

    @query(name, oracle)
    def run(spark, sf_dir):
        return documents(spark, sf_dir).select("doc_id", legal.on_blocks(rule)(F.col("html")).alias("result"))


_on_blocks(
    "leg_14_repeated_structures", legal.repeated_structures, "kind = '' OR nth = 1",
    extra=", g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind <> '', lower(head) ORDER BY pos) AS nth FROM f)")
_on_blocks(
    "leg_14_known_sections", legal.known_sections,
    "section = '' OR NOT EXISTS (SELECT 1 FROM f AS o WHERE o.doc_id = f.doc_id AND o.clause = f.section AND o.pos <= f.pos + 6)")
_on_blocks(
    "leg_15_clause_trails", legal.clause_trails, "NOT gone",
    # A label that breaks off, or is followed by text that is no label, is no trail; a trail is two labels or more.
    extra=f""", t AS (SELECT *, first_value(CASE WHEN crumb THEN NULL ELSE name <> 'p' AND clause <> '' END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead,
        coalesce(lag(crumb) OVER (PARTITION BY doc_id ORDER BY pos), false) OR coalesce(lead(crumb) OVER (PARTITION BY doc_id ORDER BY pos), false) AS beside FROM f),
      g AS (SELECT *, coalesce(ahead, false) AND ((crumb AND beside) OR contains(piece, '<br>')) AS gone FROM t)""")
_on_blocks(
    "leg_16_redundant_sections", legal.redundant_sections,
    "section = '' OR NOT (coalesce(after_marker, false) OR coalesce(next_name <> 'p' AND next_clause <> '' AND starts_with(next_clause, section)"
    " AND regexp_extract(next_clause, '^[0-9]+') = regexp_extract(section, '^[0-9]+'), false))",
    extra=""", g AS (SELECT *, lag(marker) OVER w AS after_marker, lead(name) OVER w AS next_name, lead(clause) OVER w AS next_clause FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos))""")
_PREFIX = rf"(?i)^Section\s+({classify.CLAUSE})\s+(\(.+)$"
_on_blocks(
    "joi_11_nearest_clause", legal.prefixed_sections, "true",
    f"""CASE WHEN name = 'p' AND section = '' AND coalesce(before, behind) = regexp_extract(plain, '{_PREFIX}', 1)
      THEN regexp_extract(piece, '^\\s*') || '<p>' || regexp_extract(plain, '{_PREFIX}', 2) || '</p>' ELSE piece END""",
    extra=""", g AS (SELECT *, last_value(nullif(clause, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      first_value(nullif(clause, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS behind FROM f)""")
