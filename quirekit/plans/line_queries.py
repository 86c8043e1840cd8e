"""Line, batching, glossary, output and state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.functions import fixed, flow, glossary, lines, models, prompt, sinks, state, text
from quirekit.operators import documents as doc_ops
from quirekit.operators import jobs as job_ops
from quirekit.operators import running
from quirekit.operators.running import running_total
from quirekit.plans.html_queries import DOC_HTML_SQL, doc_html
from quirekit.plans.inputs import JOBS_SQL, SQL_STATUS, jobs, pick, sql_pick
from quirekit.plans.legal_queries import LABELS, _LINES, classify
from quirekit.plans.registry import (
    inject, query, quote, re2, sql_inject, sql_list, sql_replace, sql_rewrite, sql_strip, table, text_table,
)

MARKERS = [
    (2, 0, "\n[Original Page Number: 12]\nbody\n[Original Page Number: 15]\nmore\n[Original Page Number: 16]"),
    (3, 1, "\n[Original Page Number: 40]\n[Original Page Number: 40]\nlast\n[Original Page Number: 42]\nend"),
]
_MARK = "regexp_extract(line, '^\\[Original Page Number:\\s*([0-9]+)\\]\\s*$', 1)"


def _docs(spark, sf_dir, fragments=()):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    return docs.select("doc_id", inject(F.col("text"), F.col("doc_id"), fragments).alias("text"))


@query(
    "win_03_page_marker_gaps",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
      FROM (SELECT doc_id, {sql_inject('text', 'doc_id', MARKERS)} AS text FROM documents)),
    m AS (SELECT *, TRY_CAST(nullif({_MARK}, '') AS INT) AS num FROM l),
    k AS (SELECT * FROM (SELECT *, lag(num) OVER (PARTITION BY doc_id ORDER BY pos) AS above FROM m) WHERE num IS NULL OR above IS NULL OR num <> above),
    p AS (SELECT *, last_value(num IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
    SELECT doc_id, string_agg(CASE WHEN num - before > 1 THEN array_to_string(list_transform(range(before + 1, num), lambda n: '[Original Page Number: ' || n || ']'), chr(10)) || chr(10) ELSE '' END || line, chr(10) ORDER BY pos) AS result
    FROM p GROUP BY doc_id""",
)
def page_marker_gaps(spark, sf_dir):
    return _docs(spark, sf_dir, MARKERS).select("doc_id", lines.fill_page_markers(F.col("text")).alias("result"))


@query(
    "win_04_compact_scopes",
    """WITH p AS (SELECT doc_id, unnest(range(1, (n_chars // 200) + 6)) AS page FROM documents),
    q AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS grp FROM p WHERE (doc_id + page * page) % 5 <> 0),
    r AS (SELECT doc_id, min(page) AS a, max(page) AS b FROM q GROUP BY doc_id, grp)
    SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS scope FROM r GROUP BY doc_id""",
)
def compact_scopes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    every = F.sequence(F.lit(1).cast("bigint"), F.floor(F.col("n_chars") / 200) + 5)
    pages = F.filter(every, lambda page: (F.col("doc_id") + page * page) % 5 != 0)
    return docs.select("doc_id", lines.compact_scope(pages).alias("scope"))


# Two full slices never fit one batch; only the last, shorter slice can join the one before it.
@query(
    "win_05_text_batches",
    f"""WITH d AS (SELECT doc_id, {sql_replace('text', fixed.TEXT_ARTIFACTS)} AS text FROM documents WHERE text <> ''),
    n AS (SELECT doc_id, text, length(text) AS size, (length(text) + 9999) // 10000 AS slices FROM d),
    b AS (SELECT *, CASE WHEN slices >= 2 AND size - (slices - 1) * 10000 <= 8000 THEN slices - 1 ELSE slices END AS batches FROM n),
    u AS (SELECT *, unnest(range(0, batches)) AS batch_no FROM b)
    SELECT doc_id, batch_no, md5(substring(text, (batch_no * 10000 + 1)::BIGINT, 10000) || CASE WHEN batch_no = batches - 1 AND batches < slices
      THEN chr(10) || substring(text, ((batch_no + 1) * 10000 + 1)::BIGINT, 10000) ELSE '' END) AS batch_md5 FROM u""",
)
def text_batches(spark, sf_dir):
    slices = lines.fixed_slices(text.clean_artifacts(F.col("text")))
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    batches = docs.select("doc_id", F.posexplode(lines.greedy_batches(slices)).alias("batch_no", "batch"))
    return batches.select("doc_id", F.col("batch_no").cast("bigint"), F.md5("batch").alias("batch_md5"))


@query(
    "win_06_line_chunks",
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    f AS (SELECT doc_id, pos, length(line) + 1 AS held, 1 AS chunk FROM l WHERE pos = 1
      UNION ALL SELECT l.doc_id, l.pos, CASE WHEN held > 0 AND held + length(line) > 3000 THEN length(line) + 1 ELSE held + length(line) + 1 END,
        CASE WHEN held > 0 AND held + length(line) > 3000 THEN chunk + 1 ELSE chunk END FROM f JOIN l ON l.doc_id = f.doc_id AND l.pos = f.pos + 1)
    SELECT f.doc_id, (chunk - 1)::BIGINT AS chunk_no, md5(string_agg(line, chr(10) ORDER BY f.pos) || chr(10)) AS chunk_md5 FROM f JOIN l ON l.doc_id = f.doc_id AND l.pos = f.pos GROUP BY f.doc_id, chunk""",
)
def line_chunks(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    chunks = docs.select("doc_id", F.posexplode(lines.line_chunks(F.col("text"), 3000)).alias("chunk_no", "chunk"))
    return chunks.select("doc_id", F.col("chunk_no").cast("bigint"), F.md5("chunk").alias("chunk_md5"))


@query(
    "win_07_first_occurrence",
    """SELECT doc_id, key FROM (SELECT doc_id, sha256(text) AS key, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def first_occurrence(spark, sf_dir):
    """First document per text: an aggregate on a short digest, combined before the shuffle."""
    keyed = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", text.sha256_key(F.col("text")).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"))


@query(
    "win_08_best_per_key",
    f"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS pos FROM documents),
    k AS (SELECT line, lower(split_part(line, ' ', 1)) AS key, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters, doc_id, pos FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY letters DESC, length(line) DESC, doc_id, pos) AS place,
      row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS seen, count(*) OVER (PARTITION BY key) AS lines FROM k)
    SELECT b.key, b.line, b.letters, b.lines, b.doc_id AS best_doc_id, b.pos AS best_pos, f.doc_id AS first_doc_id, f.pos AS first_pos
    FROM r b JOIN r f ON b.key = f.key WHERE b.place = 1 AND f.seen = 1""",
)
def best_per_key(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    body = F.concat("text", F.lit("\n"), pick(LABELS, F.col("doc_id")), F.lit("\n"), pick(LABELS, F.col("doc_id") * 3 + 1))
    found = docs.select("doc_id", F.posexplode(lines.content_lines(body)).alias("at", "line"))
    keyed = found.select("doc_id", (F.col("at") + 1).cast("long").alias("pos"), "line", F.lower(F.substring_index("line", " ", 1)).alias("key"))
    return running.best_per_key(keyed, "key", "line", "doc_id", "pos")


NEIGHBOURS = [
    (2, 0, "\n[Original Page Number: 4]\nPart 2 Orders\nDivision 1 Fines\n14 Fines\n"),
    (3, 0, "\nSection 14\nsome text\n14 Review of fines\nother\nSection 99\n"),
    (5, 1, "\n[Original Page Number: 5]\nplain text here\nPart 3 Rest\n"),
]
_N_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql_strip('l')}), lambda l: l <> '')"
_N_SQL = f"""WITH d AS (SELECT doc_id, {sql_inject('text', 'doc_id', NEIGHBOURS)} AS text FROM documents),
  l AS (SELECT doc_id, unnest({_N_LINES}) AS line, generate_subscripts({_N_LINES}, 1) AS pos FROM d)"""


@query(
    "win_09_marker_behind",
    f"""{_N_SQL}, f AS (SELECT doc_id, pos, regexp_full_match(line, '\\[Original Page Number:\\s*[0-9]+\\]') AS m,
      regexp_matches(line, {quote(re2(classify.BREADCRUMB))}) OR regexp_matches(line, '(?i)^.+\\s+(Chapter|Part|Division|Subdivision)\\s+{classify.REFERENCE}$') AS s FROM l),
    w AS (SELECT *, lag(m) OVER x AS m1, lag(m, 2) OVER x AS m2, lag(m, 3) OVER x AS m3, lag(s) OVER x AS s1, lag(s, 2) OVER x AS s2 FROM f WINDOW x AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, pos - 1 AS pos FROM w WHERE m1 OR (s1 AND m2) OR (s1 AND s2 AND m3)""",
)
def marker_behind(spark, sf_dir):
    flagged = flow.marker_behind(lines.content_lines(F.col("text")))
    found = _docs(spark, sf_dir, NEIGHBOURS).select("doc_id", F.posexplode(flagged).alias("pos", "hit"))
    return found.filter("hit").select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@query(
    "win_10_nearby_clause",
    f"""{_N_SQL}, f AS (SELECT doc_id, pos, regexp_extract(line, '(?i)^Section\\s+({classify.REFERENCE})$', 1) AS section, regexp_extract(line, '^({classify.CLAUSE})\\s+[A-Z]', 1) AS clause FROM l),
    w AS (SELECT *, list(clause) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS around FROM f)
    SELECT doc_id, pos - 1 AS pos FROM w WHERE section <> '' AND list_contains(around, section)""",
)
def nearby_clause(spark, sf_dir):
    flagged = flow.nearby_clause(lines.content_lines(F.col("text")))
    found = _docs(spark, sf_dir, NEIGHBOURS).select("doc_id", F.posexplode(flagged).alias("pos", "hit"))
    return found.filter("hit").select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@query("win_11_reflowed_paragraphs")
def reflowed_paragraphs(spark, sf_dir):
    docs = _docs(spark, sf_dir, [(2, 0, "\nshort,\nnext line\nAND MORE\n(carried on)\n12\nEnd. Here")])
    wrapped = F.regexp_replace("text", r"(\S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+) ", "$1\n")
    found = docs.select("doc_id", F.posexplode(flow.reflow(lines.content_lines(wrapped))).alias("pos", "paragraph"))
    return found.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "paragraph")


# --- Glossaries and prompts -----------------------------------------------------------------

ABBREVIATIONS = [
    (2, 0, ' Lt. Smith, Capt Jones and GEN. Lee of H.Q and HQ. met <b title="Gen Lt">Sgt. Gen</b> at St. John Rd, Qld.'),
    (3, 1, " The R.A.A.F. and RAF; M.P., MP and Hon. Rev. Gray; the 3rd Bn. inst. W.H.O BP E.C.G. U.S. Maj.Gen"),
    (5, 2, " Genau Gen Gen. St.  George"),
]


def _expand_sql(profile):
    """Letters beyond ASCII are fenced with ASCII letters, so that word boundaries agree; fences go afterwards."""
    rules = [(re2(glossary.pattern_of(a)), w) for a, w in glossary.entries_for(profile)]
    pieces = "string_split_regex(fenced, '<[^>]+>')"
    tags = "list_append(regexp_extract_all(fenced, '<[^>]+>'), '')"
    return f"array_to_string(list_transform({pieces}, lambda x, i: {sql_rewrite('x', rules)} || ({tags})[i]), '')"


_EXPAND_PROFILES = ["military", "newspaper", "medical", "archival", "legal"]


@query(
    "str_30_abbreviations",
    f"""WITH d AS (SELECT doc_id, {sql_pick(_EXPAND_PROFILES, 'doc_id')} AS profile, regexp_replace({sql_inject('text', 'doc_id', ABBREVIATIONS)}, '([\\x{{C0}}-\\x{{24F}}])', 'qzq\\1qzq', 'g') AS fenced FROM documents)
    SELECT doc_id, profile, replace(CASE profile {' '.join(f'WHEN {quote(p)} THEN {_expand_sql(p)}' for p in _EXPAND_PROFILES)} END, 'qzq', '') AS result FROM d""",
)
def abbreviations(spark, sf_dir):
    profile = pick(_EXPAND_PROFILES, F.col("doc_id"))
    docs = _docs(spark, sf_dir, ABBREVIATIONS).withColumn("profile", profile)
    return docs.select("doc_id", "profile", glossary.expand_abbreviations(F.col("text"), F.col("profile")).alias("result"))


_GLOSSARY_ROWS = ", ".join(f"({quote(name)}, {quote(a)}, {quote(w)})" for name, entries in glossary.GLOSSARIES.items() for a, w in entries)
_PROFILE_ROWS = ", ".join(f"({quote(p)}, {i}, {quote(n)})" for p, names in fixed.PROFILE_GLOSSARIES.items() for i, n in enumerate(names))
_DEFAULT_ROWS = ", ".join(f"({i}, {quote(n)})" for i, n in enumerate(fixed.DEFAULT_GLOSSARIES))


@query(
    "joi_06_profile_glossaries",
    f"""WITH g(name, abbreviation, wording) AS (VALUES {_GLOSSARY_ROWS}), pg(profile, rank, name) AS (VALUES {_PROFILE_ROWS}), dg(rank, name) AS (VALUES {_DEFAULT_ROWS}),
    j AS (SELECT profile, count(*) AS jobs FROM {JOBS_SQL} GROUP BY profile),
    u AS (SELECT j.profile, jobs, rank, pg.name FROM j JOIN pg ON pg.profile = j.profile UNION ALL SELECT j.profile, jobs, rank, dg.name FROM j, dg WHERE j.profile NOT IN (SELECT profile FROM pg))
    SELECT profile, jobs, abbreviation, arg_min(wording, rank) AS wording FROM u JOIN g USING (name) GROUP BY ALL""",
)
def profile_glossaries(spark, sf_dir):
    """Jobs per profile joined to the entries of the profile's glossaries, each abbreviation once, by the first glossary that has it."""
    counts = jobs(spark, sf_dir).groupBy("profile").agg(F.count("*").alias("jobs"))
    known = F.when(F.col("profile").isin(list(fixed.PROFILE_GLOSSARIES)), F.col("profile"))
    used = glossary.profile_table(spark).withColumnRenamed("profile", "known")
    listed = counts.withColumn("asked", known).join(used, F.col("asked").eqNullSafe(F.col("known")))
    entries = listed.join(glossary.glossary_table(spark), "glossary")
    return entries.groupBy("profile", "jobs", "abbreviation").agg(F.min_by("wording", "rank").alias("wording"))


_RULE_ROWS = ", ".join(
    f"({i}, {'NULL' if p is None else '[' + sql_list(p) + ']'}, {'NULL' if f is None else '[' + sql_list(f) + ']'}, {quote(r)})"
    for i, (p, f, r) in enumerate(prompt.RULES)
)


@query(
    "str_41_prompts",
    f"""WITH r(ord, profiles, formats, rule) AS (VALUES {_RULE_ROWS}), j AS (SELECT job_id, profile, fmt, CASE WHEN job_id % 5 = 0 THEN 'French' ELSE '' END AS target, CASE WHEN job_id % 7 = 0 THEN 'Mind the margins.' ELSE '' END AS extra FROM {JOBS_SQL}),
    a AS (SELECT job_id, target, extra, string_agg(rule, chr(10) ORDER BY ord) AS rules FROM j JOIN r ON (profiles IS NULL OR list_contains(profiles, profile)) AND (formats IS NULL OR list_contains(formats, fmt)) GROUP BY ALL)
    SELECT job_id, rules || CASE WHEN target <> '' THEN chr(10) || 'Translate into ' || target || '.' ELSE '' END || CASE WHEN extra <> '' THEN chr(10) || extra ELSE '' END AS prompt FROM a""",
)
def prompts(spark, sf_dir):
    key = F.col("job_id")
    target, extra = F.when(key % 5 == 0, "French").otherwise(""), F.when(key % 7 == 0, "Mind the margins.").otherwise("")
    return jobs(spark, sf_dir).select("job_id", prompt.build_prompt(F.col("profile"), F.col("fmt"), target, extra).alias("prompt"))


CLEANUP = [(2, 0, " Met at Main-road.- Then £3 and 7/-"), (3, 1, " Sgt. Gray paid 3d. at Bay-Street")]
_PUNCT = sql_rewrite("x", text.PUNCTUATION_RULES)
_MONEY = [(r"£(\d+)/(\d+)/-", r"\1 pounds, \2 shillings"), (r"(^|[^£0-9])(\d+)/-", r"\1\2 shillings"), (r"(\d+)d\.?", r"\1 pence"), (r"£(\d+)", r"\1 pounds")]


@query(
    "str_43_cleanup_by_format",
    f"""WITH d AS (SELECT doc_id, {sql_pick(['txt', 'md', 'json'], 'doc_id')} AS fmt, {sql_inject('text', 'doc_id', CLEANUP)} AS x FROM documents),
    p AS (SELECT doc_id, fmt, CASE WHEN fmt <> 'json' AND doc_id % 2 = 0 THEN {_PUNCT} ELSE x END AS x FROM d)
    SELECT doc_id, fmt, CASE WHEN fmt <> 'json' THEN {sql_rewrite('x', _MONEY)} ELSE x END AS result FROM p""",
)
def cleanup_by_format(spark, sf_dir):
    fmt = pick(["txt", "md", "json"], F.col("doc_id"))
    docs = _docs(spark, sf_dir, CLEANUP).withColumn("fmt", fmt)
    flags = {
        "modernize_punctuation": F.col("doc_id") % 2 == 0, "unit_conversion": F.lit(True), "abbrev_expansion": F.lit(False),
    }
    return doc_ops.cleanup_output(docs, "text", F.col("fmt"), F.lit("book"), flags, pages=False).select("doc_id", "fmt", F.col("text").alias("result"))


@query("snk_07_prepared_saves")
def prepared_saves(spark, sf_dir):
    docs = _docs(spark, sf_dir, CLEANUP + ABBREVIATIONS).withColumn("fmt", pick(["txt", "md"], F.col("doc_id")))
    on = F.lit(True)
    flags = {"modernize_punctuation": on, "unit_conversion": on, "abbrev_expansion": on, "merge_files": F.col("doc_id") % 2 == 0}
    return doc_ops.prepare_save(docs, "text", F.col("fmt"), F.lit("military"), flags, pages=False).select("doc_id", F.col("text").alias("result"))


@query("snk_07_saved_pages")
def saved_pages(spark, sf_dir):
    """HTML saved its own way: structure stays, legal documents go through the contract, wrappers and styles go."""
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    body = F.concat(
        F.lit('```html\n<html><body><main style="x">'), F.lit("<p>"), F.replace(text.escape_html(F.col("text")), F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>"),
        F.lit("<h2>Chapter 1 Orders</h2><h4>1 Fees</h4><p>Section 1 (a) £3 at Main-road.- Then.</p></main></body></html>\n```"))
    pages = docs.select("doc_id", body.alias("page"), F.when(F.col("doc_id") % 2 == 0, "legal").otherwise("standard").alias("profile"))
    on = F.lit(True)
    flags = {"modernize_punctuation": on, "unit_conversion": on, "abbrev_expansion": F.lit(False), "merge_files": F.lit(False)}
    return doc_ops.prepare_save(pages, "page", F.lit("html"), F.col("profile"), flags).select("doc_id", F.col("page").alias("result"))


# --- Outputs -----------------------------------------------------------------------------------


@query(
    "snk_01_document_texts",
    f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<!DOCTYPE html>' || chr(10) || '<html lang="' || lang || '" dir="auto">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>' || source || ' &amp; co</title>' || chr(10)
      || '</head>' || chr(10) || '<body>' || chr(10) || '<main id="content" role="main">' || chr(10) || text || chr(10) || '</main>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)
      WHEN 1 THEN '# ' || source || ' & co' || chr(10) || chr(10) || text ELSE text END AS output FROM documents""",
)
def document_texts(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    fmt = pick(["html", "md", "txt"], F.col("doc_id"))
    output = sinks.document_text(F.concat("source", F.lit(" & co")), F.col("text"), fmt, F.col("lang"), F.lit("auto"))
    return docs.select("doc_id", output.alias("output"))


DOCX_LINES = [(2, 0, "\n# Title\n## Sub\n### Deep\n1. first\n- dot\n* star\n| a | b |\n|---|---|\n[[PAGE BREAK]]\n\n#none"), (3, 1, "\n  12.  spaced\n|x|\n")]


@query(
    "snk_02_docx_line_kinds",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM (SELECT doc_id, {sql_inject('text', 'doc_id', DOCX_LINES)} AS t FROM documents)), s AS (SELECT doc_id, {sql_strip('line')} AS s FROM l)
    SELECT doc_id, CASE WHEN s = '[[PAGE BREAK]]' THEN 'page_break' WHEN s LIKE '|%|' AND length(s) >= 2 THEN 'table' WHEN starts_with(s, '### ') THEN 'heading3' WHEN starts_with(s, '## ') THEN 'heading2' WHEN starts_with(s, '# ') THEN 'heading1'
      WHEN regexp_matches(s, '^[0-9]+\\.\\s+') THEN 'number' WHEN starts_with(s, '- ') OR starts_with(s, '* ') THEN 'bullet' WHEN s <> '' THEN 'paragraph' ELSE 'blank' END AS kind, count(*) AS lines FROM s GROUP BY ALL""",
)
def docx_line_kinds(spark, sf_dir):
    found = _docs(spark, sf_dir, DOCX_LINES).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return found.groupBy("doc_id", sinks.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("lines"))


@query(
    "snk_04_chapters",
    f"""WITH d AS (SELECT doc_id, string_split_regex(html, '(?i)<h2.*?>.*?</h2>') AS pieces, list_prepend('', regexp_extract_all(html, '(?i)<h2.*?>.*?</h2>')) AS heads FROM {DOC_HTML_SQL}),
    c AS (SELECT doc_id, generate_subscripts(pieces, 1) AS place, unnest(heads) AS head, unnest(pieces) AS piece FROM d)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::BIGINT AS chapter, CASE WHEN place = 1 THEN 'Untitled' ELSE regexp_replace(head, '<[^>]+>', '', 'g') END AS title, md5(head || piece) AS content_md5
    FROM c WHERE {sql_strip('head || piece')} <> ''""",
)
def chapters(spark, sf_dir):
    found = doc_html(spark, sf_dir).select("doc_id", F.posexplode(sinks.chapters(F.lit("Untitled"), F.col("html"))).alias("chapter", "c"))
    return found.select("doc_id", F.col("chapter").cast("bigint"), "c.title", F.md5("c.content").alias("content_md5"))


@query(
    "snk_05_json_payloads",
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '{"extracted_content":"not json ' || event_id || '"}' ELSE props END AS payload FROM events""",
)
def json_payloads(spark, sf_dir):
    key = F.col("event_id")
    content = (
        F.when(key % 3 == 0, F.col("props"))
        .when(key % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .otherwise(F.concat(F.lit(" not json "), key.cast("string")))
    )
    return table(spark, sf_dir, "events").select("event_id", sinks.json_payload(content).alias("payload"))


@query("snk_06_csv_payloads", f"SELECT doc_id, {sql_strip('text')} AS payload FROM documents")
def csv_payloads(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```csv\n"), "text", F.lit("\n```\n"))).otherwise(F.col("text"))
    return docs.select("doc_id", sinks.csv_payload(fenced).alias("payload"))


_SEQ = "TRY_CAST(nullif(regexp_extract(regexp_extract(path, '[^/]*$', 0), '(?i)\\bpage[\\s._-]*0*([0-9]{1,6})(?:[^0-9]|$)', 1), '') AS BIGINT)"


@query(
    "snk_12_merged_output",
    f"""WITH j AS (SELECT job_id, path FROM {JOBS_SQL} WHERE merge_files), o AS (SELECT job_id, row_number() OVER (ORDER BY {_SEQ} IS NULL, {_SEQ}, lower(regexp_extract(path, '[^/]*$', 0)), job_id) - 1 AS ordinal FROM j)
    SELECT ordinal, doc_id, md5(text) AS text_md5 FROM o JOIN documents ON doc_id = job_id""",
)
def merged_output(spark, sf_dir):
    """SET-01: texts of the merge jobs with their place in the merged output.

    The merged output is written as range-partitioned parts in this order; it is never
    gathered into one value. Only keys are ordered; texts join afterwards.
    """
    queue = jobs(spark, sf_dir).filter("merge_files").select("job_id", "path")
    placed = job_ops.global_ordinal(queue, job_ops.merge_order_keys(), "job_id").select("job_id", "ordinal")
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    return docs.join(placed, F.col("doc_id") == F.col("job_id")).select("ordinal", "doc_id", F.md5("text").alias("text_md5"))


@query(
    "set_04_output_diff",
    """WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(10)), chr(10))) AS line FROM documents),
    x AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), y AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS only_left, coalesce(m, 0)::BIGINT AS only_right FROM (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id) FULL JOIN (SELECT doc_id, count(*) AS m FROM y GROUP BY doc_id) USING (doc_id)""",
)
def output_diff(spark, sf_dir):
    """STR-42: line differences of two outputs as bags: one aggregate instead of two set operations."""
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    left = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"), F.lit(1).alias("side"))
    right = docs.select("doc_id", F.explode(F.split(F.replace("text", F.lit(". "), F.lit("\n")), "\n")).alias("line"), F.lit(-1).alias("side"))
    balance = left.unionAll(right).groupBy("doc_id", "line").agg(F.sum("side").alias("net"))
    sums = balance.groupBy("doc_id").agg(
        F.sum(F.greatest("net", F.lit(0))).alias("only_left"), F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("only_right")
    )
    return sums.filter("only_left + only_right > 0")


# --- State and scalars ----------------------------------------------------------------------------


@query(
    "hsh_02_cache_keys",
    f"SELECT doc_id, 'gpt-4o|text|' || sha256({quote('Read it.')}) || '|' || sha256(text) AS cache_key FROM documents",
)
def cache_keys(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    return docs.select("doc_id", text.cache_key(F.lit("gpt-4o"), F.lit("text"), F.lit("Read it."), F.col("text")).alias("cache_key"))


@query("hsh_01_sha256", "SELECT page_id, sha256(html) AS digest FROM pages")
def sha256_digests(spark, sf_dir):
    return text_table(spark, sf_dir, "pages", "page_id").select("page_id", text.sha256_key(F.col("html")).alias("digest"))


@query(
    "sec_02_redacted_maps",
    """SELECT event_id, '{"api_key":"' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '[redacted]' END || '","note":"' || CASE WHEN event_id % 2 = 0 THEN 'key=[redacted]' ELSE event_type END || '","userToken":"[redacted]"}' AS fields FROM events""",
)
def redacted_maps(spark, sf_dir):
    key = F.col("event_id")
    fields = F.create_map(
        F.lit("api_key"), F.when(key % 3 == 0, "").otherwise(F.md5(key.cast("string"))),
        F.lit("note"), F.when(key % 2 == 0, F.concat(F.lit("key="), F.md5(key.cast("string")))).otherwise(F.col("event_type")),
        F.lit("userToken"), F.col("event_type"),
    )
    return table(spark, sf_dir, "events").select("event_id", state.canonical_json(text.redact_map(fields)).alias("fields"))


@query(
    "map_01_settings_overlay",
    f"""SELECT job_id, '{{"doc_profile":"' || profile || '","format_type":"' || CASE WHEN job_id % 2 = 0 THEN fmt ELSE 'html' END || '","merge":"' || CASE WHEN job_id % 3 = 0 THEN 'yes' ELSE 'no' END || '"}}' AS settings FROM {JOBS_SQL}""",
)
def settings_overlay(spark, sf_dir):
    key = F.col("job_id")
    base = F.create_map(F.lit("format_type"), F.lit("html"), F.lit("doc_profile"), F.lit("standard"), F.lit("merge"), F.lit("no"))
    controls = F.create_map(F.lit("doc_profile"), F.col("profile"))
    row = F.map_filter(
        F.create_map(F.lit("format_type"), F.when(key % 2 == 0, F.col("fmt")), F.lit("merge"), F.when(key % 3 == 0, "yes")),
        lambda _k, v: v.isNotNull(),
    )
    return jobs(spark, sf_dir).select("job_id", state.canonical_json(state.overlay(base, controls, row)).alias("settings"))


@query("jsn_01_canonical_json", """SELECT c_custkey, '{"key":"' || c_custkey || '","nation":"' || c_nationkey || '","segment":"' || c_mktsegment || '"}' AS doc FROM customer""")
def canonical_json(spark, sf_dir):
    values = F.create_map(
        F.lit("segment"), F.col("c_mktsegment"), F.lit("key"), F.col("c_custkey").cast("string"), F.lit("nation"), F.col("c_nationkey").cast("string")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", state.canonical_json(values).alias("doc"))


@query("jsn_02_progress_headers", f"SELECT job_id, 8192 AS header_size, '{{\"completed_units\":' || completed_units || ',\"total_units\":' || total_pages || '}}' AS payload FROM {JOBS_SQL}")
def progress_headers(spark, sf_dir):
    payload = F.to_json(F.struct("completed_units", F.col("total_pages").alias("total_units")))
    encoded = jobs(spark, sf_dir).select("job_id", state.progress_header(payload).alias("header"))
    return encoded.select("job_id", F.length("header").alias("header_size"), state.progress_payload(F.col("header")).alias("payload"))


@query("dat_01_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp")
    )


@query(
    "src_22_strip_geometry",
    """WITH s AS (SELECT p_partkey, p_partkey % 2400 AS width, CASE WHEN p_partkey % 2400 >= 1800 THEN 4 WHEN p_partkey % 2400 >= 1450 THEN 3 ELSE 2 END AS n FROM part WHERE p_partkey % 2400 > 0),
    u AS (SELECT *, unnest(range(0, n)) AS strip FROM s)
    SELECT p_partkey, strip, greatest(0, CAST(floor(width * strip / n - width * 0.025) AS BIGINT)) AS left_px, least(width, CAST(floor(width * (strip + 1) / n + width * 0.025) AS BIGINT)) AS right_px FROM u""",
)
def strip_geometry(spark, sf_dir):
    """Vertical strips of a page by width, overlapping by 2.5 %; parts stand in for page widths."""
    width = F.col("p_partkey") % 2400
    count = F.when(width >= 1800, 4).when(width >= 1450, 3).otherwise(2)
    parts = table(spark, sf_dir, "part").filter(width > 0).select("p_partkey", width.alias("width"), count.alias("n"))
    strips = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("strip"))
    left = F.greatest(F.floor(F.col("width") * F.col("strip") / F.col("n") - F.col("width") * 0.025), F.lit(0))
    right = F.least(F.floor(F.col("width") * (F.col("strip") + 1) / F.col("n") + F.col("width") * 0.025), F.col("width"))
    return strips.select("p_partkey", F.col("strip").cast("bigint").alias("strip"), left.cast("bigint").alias("left_px"), right.cast("bigint").alias("right_px"))


@query(
    "stm_06_cache_reuse",
    """WITH k AS (SELECT doc_id, sha256(text) AS key, length(text) AS size FROM documents), f AS (SELECT key, min(doc_id) AS first, count(*) AS uses, max(size) AS size FROM k GROUP BY key)
    SELECT count(*) AS requests, sum(uses)::BIGINT AS uses, sum(uses - 1) FILTER (size >= 1)::BIGINT AS hits FROM f""",
)
def cache_reuse(spark, sf_dir):
    """Requests, uses and cache hits. Digests are counted per task first, so a text that makes up a third of all rows costs one row per task."""
    keyed = text_table(spark, sf_dir, "documents", "doc_id").select(text.sha256_key(F.col("text")).alias("key"), F.length("text").alias("size"))
    used = keyed.groupBy("key").agg(F.count("*").alias("uses"), F.max("size").alias("size"))
    stored = F.col("size") >= 1
    return used.agg(F.count("*").alias("requests"), F.sum("uses").alias("uses"), F.sum(F.when(stored, F.col("uses") - 1)).alias("hits"))


@query(
    "stm_04_newspaper_cap",
    """WITH c AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS emitted FROM conversations)
    SELECT conv_id, turn, emitted::BIGINT AS emitted FROM c WHERE emitted - length(text) < 800""",
)
def newspaper_cap(spark, sf_dir):
    """Chunks emitted until a stream's character budget is spent; the chunk that spends it is the last."""
    sizes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    totals = running_total(sizes, "conv_id", "turn", "size", "emitted")
    return totals.filter(F.col("emitted") - F.col("size") < 800).select("conv_id", "turn", "emitted")


@query(
    "stm_10_resume_by_checkpoint",
    f"""WITH j AS {JOBS_SQL} SELECT job_id, CASE WHEN completed_units >= total_pages THEN 'complete' WHEN completed_units > 0 THEN 'partial' ELSE 'fresh' END AS state,
      least(completed_units, total_pages) AS resume_from, CASE WHEN completed_units >= total_pages THEN '' WHEN total_pages - completed_units = 1 THEN total_pages::VARCHAR ELSE (completed_units + 1) || '-' || total_pages END AS scope FROM j""",
)
def resume_by_checkpoint(spark, sf_dir):
    done, total = F.col("completed_units"), F.col("total_pages")
    rest = F.when(done < total, F.sequence(done + 1, total)).otherwise(F.array().cast("array<bigint>"))
    return jobs(spark, sf_dir).select(
        "job_id",
        F.when(done >= total, "complete").when(done > 0, "partial").otherwise("fresh").alias("state"),
        F.least(done, total).alias("resume_from"),
        lines.compact_scope(rest).alias("scope"),
    )


# Fixed order of recovery steps and what each costs a page's score.
LADDER = [("halve chunk", 0.14), ("escalate model", 0.08), ("dense recheck", 0.10), ("text layer", 0.24), ("error", 1.0)]


@query(
    "stm_12_degrade_ladder",
    """WITH e AS (SELECT event_id, event_id % 2 = 0 AS can_halve, event_id % 3 = 0 AS can_escalate, event_id % 5 = 0 AS dense, event_id % 7 = 0 AS layer FROM events)
    SELECT CASE WHEN can_halve THEN 'halve chunk' WHEN can_escalate THEN 'escalate model' WHEN dense THEN 'dense recheck' WHEN layer THEN 'text layer' ELSE 'error' END AS step, count(*) AS pages FROM e GROUP BY 1""",
)
def degrade_ladder(spark, sf_dir):
    """First recovery step open to a failed page; events stand in for page failures."""
    tests = [F.col("event_id") % m == 0 for m in (2, 3, 5, 7)]
    step = F.coalesce(*[F.when(test, name) for test, (name, _) in zip(tests, LADDER)], F.lit(LADDER[-1][0]))
    return table(spark, sf_dir, "events").groupBy(step.alias("step")).agg(F.count("*").alias("pages"))


@query(
    "stm_19_status_changes",
    f"""WITH j AS {JOBS_SQL}, s AS (SELECT {SQL_STATUS} AS before, CASE WHEN {SQL_STATUS} = 'Processing' AND completed_units >= total_pages THEN 'Done' WHEN {SQL_STATUS} = 'Processing' AND job_id % 4 = 1 THEN 'Error' ELSE {SQL_STATUS} END AS after FROM j)
    SELECT before, after, after <> before AS changed, count(*) AS jobs FROM s GROUP BY ALL""",
)
def status_changes(spark, sf_dir):
    before = job_ops.status_of()
    running = before == "Processing"
    after = (
        F.when(running & (F.col("completed_units") >= F.col("total_pages")), "Done").when(running & (F.col("job_id") % 4 == 1), "Error").otherwise(before)
    )
    pairs = jobs(spark, sf_dir).select(before.alias("before"), after.alias("after"))
    return pairs.groupBy("before", "after", (F.col("after") != F.col("before")).alias("changed")).agg(F.count("*").alias("jobs"))
