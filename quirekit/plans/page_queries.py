"""Page-text queries: metrics, routing, audits and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.functions import classify, fixed, lines, models, routing, text
from quirekit.functions.rewrite import squash
from quirekit.operators import pages as ops
from quirekit.plans.inputs import JOBS_SQL, PAGE_TEXT_SQL, SQL_EXT, jobs, page_text, pick, sql_model, sql_pick
from quirekit.plans.registry import (
    inject, query, quote, sql_case, sql_inject, sql_list, sql_replace, sql_squash, sql_strip, table, text_table,
)

_COMPACT = sql_squash("text")
_METRICS = f"""SELECT *, length(compact) AS chars, length(regexp_replace(compact, '[^\\p{{L}}]', '', 'g')) AS alpha_chars,
  length(regexp_replace(compact, '[^0-9]', '', 'g')) AS digit_chars,
  len(list_filter(string_split(text, chr(10)), lambda l: {sql_strip('l')} <> '')) AS line_count
  FROM (SELECT *, {_COMPACT} AS compact FROM pt)"""


def _with_pages(body: str) -> str:
    return f"WITH pt AS {PAGE_TEXT_SQL}, pages_m AS ({_METRICS}) {body}"


@query("flt_d6_page_metrics", _with_pages("SELECT doc_id, page_no, chars, alpha_chars, digit_chars, line_count FROM pages_m"))
def page_metrics(spark, sf_dir):
    pages = ops.with_metrics(page_text(spark, sf_dir))
    return pages.select("doc_id", "page_no", "metrics.*")


# First 18 distinct entries of: the nine spread positions in order, then every stride-th page.
_POSITIONS = """CASE WHEN total_pages <= 18 THEN range(0, total_pages) ELSE (SELECT list(v ORDER BY place)[1:18] FROM (
    SELECT v, min(place) AS place FROM (
      SELECT unnest(spread) AS v, generate_subscripts(spread, 1) AS place FROM (SELECT list_sort([0, least(total_pages - 1, 1), least(total_pages - 1, 2),
        total_pages // 4, total_pages // 3, total_pages // 2, 2 * total_pages // 3, 3 * total_pages // 4, total_pages - 1]) AS spread)
      UNION ALL SELECT unnest(range(0, total_pages, greatest(1, total_pages // 18))), 100 + generate_subscripts(range(0, total_pages, greatest(1, total_pages // 18)), 1)
    ) GROUP BY v)) END"""


@query(
    "win_13_sampled_pages",
    f"""WITH pt AS {PAGE_TEXT_SQL}, d AS (SELECT DISTINCT doc_id, total_pages * 3 AS total_pages FROM pt)
    SELECT doc_id, unnest({_POSITIONS}) AS page_index FROM d""",
)
def sampled_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / 1500) + 1).alias("pages")
    )
    return docs.select("doc_id", F.explode(routing.sample_positions(F.col("pages") * 3).cast("array<bigint>")).alias("page_index"))


_DOC_METRICS = f"""d AS (SELECT doc_id, any_value(profile) AS profile, any_value(size_mb) AS size_mb, any_value(total_pages) AS total_pages,
  count(*) AS sampled, count_if(chars > 0)::BIGINT AS textful, count_if(chars >= 1200 AND alpha_chars >= 500)::BIGINT AS strong, sum(chars)::BIGINT AS chars
  FROM pages_m GROUP BY doc_id)"""


def _document_metrics(spark, sf_dir):
    return ops.document_metrics(page_text(spark, sf_dir), "doc_id", "profile", "size_mb", "total_pages")


@query("agg_06_document_metrics", _with_pages(f", {_DOC_METRICS} SELECT doc_id, sampled, textful, strong, chars FROM d"))
def document_metrics(spark, sf_dir):
    return _document_metrics(spark, sf_dir).select("doc_id", "sampled", "textful", "strong", "chars")


_DIFFICULTY = f"""CASE WHEN profile IN ({sql_list(fixed.FORCE_DEEP_PROFILES)}) THEN 'hard'
  WHEN profile IN ({sql_list(fixed.SPECIALTY_PROFILES)}) THEN 'specialty'
  WHEN total_pages >= 120 AND size_mb / total_pages >= 0.75 AND textful <= 1 THEN 'hard'
  WHEN textful = sampled AND chars / sampled >= 1400 AND size_mb / total_pages <= 0.35 AND profile IN ({sql_list(fixed.ADAPTIVE_PROFILES)}) THEN 'easy'
  WHEN textful >= greatest(1, sampled - 1) AND chars / sampled >= 700 AND size_mb / total_pages <= 0.55 AND profile IN ({sql_list(fixed.ADAPTIVE_PROFILES)}) THEN 'mixed'
  ELSE 'hard' END"""


def _graded(spark, sf_dir):
    metrics = _document_metrics(spark, sf_dir)
    return metrics.withColumn(
        "difficulty",
        routing.difficulty(
            F.col("profile"), F.col("total_pages"), F.col("size_mb") / F.col("total_pages"), F.col("sampled"),
            F.col("textful"), F.col("chars") / F.col("sampled"),
        ),
    )


@query("cls_09_pdf_difficulty", _with_pages(f", {_DOC_METRICS} SELECT doc_id, profile, {_DIFFICULTY} AS difficulty FROM d"))
def pdf_difficulty(spark, sf_dir):
    return _graded(spark, sf_dir).select("doc_id", "profile", "difficulty")


@query(
    "cls_10_strong_text",
    _with_pages(
        f""", {_DOC_METRICS} SELECT doc_id, textful > 0 AND textful >= greatest(1, sampled - 1) AND strong >= greatest(1, least(2, sampled))
        AND chars / greatest(textful, 1) >= 1200 AND size_mb / total_pages <= 0.45 AS strong_text FROM d"""
    ),
)
def strong_text(spark, sf_dir):
    test = ops.is_strong_text(
        F.col("sampled"), F.col("textful"), F.col("strong"), F.col("chars"), F.col("size_mb") / F.col("total_pages")
    )
    return _document_metrics(spark, sf_dir).select("doc_id", test.alias("strong_text"))


_ROUTED = f"""r AS (SELECT d.*, override, ext, base, CASE WHEN override = '' AND ext = '.pdf' THEN {_DIFFICULTY} ELSE 'baseline' END AS difficulty
  FROM d JOIN (SELECT job_id, coalesce(trim(model_override), '') AS override, {SQL_EXT} AS ext, {sql_model('model_name')} AS base FROM jobs) ON job_id = doc_id)"""
_LIGHTER = f"base = {quote(fixed.PRO_MODEL)} AND difficulty IN ('easy', 'mixed') AND profile IN ({sql_list([*fixed.ADAPTIVE_PROFILES, 'legal'])})"


def _routed(spark, sf_dir):
    queue = jobs(spark, sf_dir).select(
        F.col("job_id").alias("doc_id"), "model_override", "model_name", text.file_extension(F.col("path")).alias("ext")
    )
    choice = routing.route(F.col("model_name"), F.col("model_override"), F.col("ext"), F.col("profile"), F.col("difficulty"))
    return _graded(spark, sf_dir).join(queue, "doc_id").withColumn("route", choice)


@query(
    "cls_11_model_routing",
    _with_pages(
        f""", jobs AS {JOBS_SQL}, {_DOC_METRICS}, {_ROUTED}
        SELECT doc_id, CASE WHEN {_LIGHTER} THEN {quote(fixed.FLASH_MODEL)}
          WHEN difficulty = 'hard' AND base IN ({sql_list([fixed.FLASH_MODEL, fixed.PRO_MODEL])}) THEN {quote(fixed.PRO_MODEL)} ELSE base END AS model_name,
        CASE WHEN override = '' THEN 'automatic' ELSE 'manual' END AS routing_mode,
        CASE WHEN {_LIGHTER} THEN {quote(fixed.PRO_MODEL)} END AS auto_escalation_model, difficulty FROM r"""
    ),
)
def model_routing(spark, sf_dir):
    return _routed(spark, sf_dir).select("doc_id", "route.*")


@query(
    "cls_18_preflight_report",
    _with_pages(
        f""", jobs AS {JOBS_SQL}, {_DOC_METRICS}, {_ROUTED},
        m AS (SELECT *, CASE WHEN {_LIGHTER} THEN {quote(fixed.FLASH_MODEL)}
          WHEN difficulty = 'hard' AND base IN ({sql_list([fixed.FLASH_MODEL, fixed.PRO_MODEL])}) THEN {quote(fixed.PRO_MODEL)} ELSE base END AS model FROM r),
        e AS (SELECT *, total_pages + CASE WHEN profile IN ({sql_list(fixed.HEAVY_PROFILES)}) THEN 8 ELSE 0 END
          + CASE WHEN model = {quote(fixed.PRO_MODEL)} OR contains(model, 'claude') OR contains(model, 'gpt') THEN 6 ELSE 0 END AS score FROM m)
        SELECT difficulty, model, CASE WHEN score >= 70 THEN 'very long' WHEN score >= 25 THEN 'long' WHEN score >= 8 THEN 'medium' ELSE 'small' END AS effort,
          count(*) AS files, sum(total_pages)::BIGINT AS pages FROM e GROUP BY ALL"""
    ),
)
def preflight_report(spark, sf_dir):
    model = F.col("route.model_name")
    run = routing.effort(F.col("profile"), model, F.col("total_pages"), F.col("size_mb"))
    return (
        _routed(spark, sf_dir)
        .groupBy(F.col("route.difficulty").alias("difficulty"), model.alias("model"), run.alias("effort"))
        .agg(F.count("*").alias("files"), F.sum("total_pages").alias("pages"))
    )


@query(
    "cls_12_chunk_pages",
    f"""WITH jobs AS {JOBS_SQL}, j AS (SELECT *, {sql_model('model_name')} AS m, total_pages * 9 AS n FROM jobs)
    SELECT job_id, CASE WHEN profile IN ({sql_list(fixed.PERIODICAL_PROFILES)}) AND (size_mb / n >= 0.9 OR (n >= 30 AND (contains(m, 'claude') OR contains(m, 'gpt')))) THEN 1
      WHEN profile IN ('legal', 'government') AND n >= 150 THEN 1 WHEN profile = 'comic' THEN 1 ELSE 2 END::BIGINT AS chunk_pages FROM j""",
)
def chunk_pages(spark, sf_dir):
    pages = F.col("total_pages") * 9
    size = routing.chunk_pages(F.col("model_name"), F.col("profile"), pages, F.col("size_mb"))
    return jobs(spark, sf_dir).select("job_id", size.cast("bigint").alias("chunk_pages"))


@query(
    "cls_13_run_effort",
    f"""WITH jobs AS {JOBS_SQL}, j AS (SELECT job_id, work_units + CASE WHEN profile IN ({sql_list(fixed.HEAVY_PROFILES)}) THEN 8 ELSE 0 END
      + CASE WHEN {sql_model('model_name')} <> {quote(fixed.FLASH_MODEL)} THEN 6 ELSE 0 END + CASE WHEN size_mb >= 100 THEN 10 ELSE 0 END AS score FROM jobs)
    SELECT job_id, CASE WHEN score >= 70 THEN 'very long' WHEN score >= 25 THEN 'long' WHEN score >= 8 THEN 'medium' ELSE 'small' END AS effort FROM j""",
)
def run_effort(spark, sf_dir):
    level = routing.effort(F.col("profile"), F.col("model_name"), F.col("work_units"), F.col("size_mb"))
    return jobs(spark, sf_dir).select("job_id", level.alias("effort"))


@query(
    "cls_14_speed_warnings",
    f"""WITH jobs AS {JOBS_SQL}, j AS (SELECT profile, {sql_model('model_name')} AS model FROM jobs)
    SELECT profile, model, {sql_case('model', fixed.MODEL_LABELS, 'model')} AS engine,
      CASE WHEN profile IN ({sql_list(fixed.SLOW_PROFILES)}) THEN 'profile' WHEN model = {quote(fixed.PRO_MODEL)} THEN 'deep engine'
      WHEN model <> {quote(fixed.FLASH_MODEL)} THEN 'other vendor' ELSE '' END AS warning, count(*) AS jobs FROM j GROUP BY ALL""",
)
def speed_warnings(spark, sf_dir):
    model = models.model_name(F.col("model_name"))
    counts = jobs(spark, sf_dir).groupBy("profile", model.alias("model")).agg(F.count("*").alias("jobs"))
    return counts.withColumn("engine", F.coalesce(models.literal_map(fixed.MODEL_LABELS)[F.col("model")], F.col("model"))).withColumn(
        "warning", routing.speed_warning_kind(F.col("profile"), F.col("model"))
    )


_PENALTY = {"error": 3, "escalated": 4, "recheck": 5, "text_layer": 7, "fallback": 11}
_PENALTY_SQL = " + ".join(f"CASE WHEN (doc_id + page_no) % {m} = 0 THEN {fixed.PAGE_PENALTIES[k]} ELSE 0 END" for k, m in _PENALTY.items())


@query(
    "cls_15_page_confidence",
    f"""WITH pt AS {PAGE_TEXT_SQL}, s AS (SELECT doc_id, round(greatest(1.0, least(1.0, greatest(0.0, 1.0 - ({_PENALTY_SQL}))) * 10.0), 6)::DOUBLE AS score FROM pt)
    SELECT doc_id, CASE WHEN score >= 8.5 THEN 'Clear page quality.' WHEN score >= 7.0 THEN 'Good quality with minor degradation.'
      WHEN score >= 5.0 THEN 'Moderate degradation; some text may be difficult.' ELSE 'Heavy degradation; risk of missed text.' END AS band,
      count(*) AS pages, min(score) AS lowest FROM s GROUP BY ALL""",
)
def page_confidence(spark, sf_dir):
    mark = F.col("doc_id") + F.col("page_no")
    penalty = sum((F.when(mark % m == 0, fixed.PAGE_PENALTIES[k]).otherwise(0.0) for k, m in _PENALTY.items()), F.lit(0.0))
    scored = page_text(spark, sf_dir).select("doc_id", F.round(routing.page_score(penalty), 6).alias("score"))
    return scored.groupBy("doc_id", routing.quality_band(F.col("score")).alias("band")).agg(
        F.count("*").alias("pages"), F.min("score").alias("lowest")
    )


@query(
    "cls_16_image_quality",
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity AS contrast, l_extendedprice % 256 AS luma, l_extendedprice % 170 AS blur, l_discount AS stain FROM lineitem),
    s AS (SELECT *, 9.5 - (CASE WHEN contrast < 34 THEN 1.8 ELSE 0 END + CASE WHEN luma > 205 THEN 1.1 ELSE 0 END + CASE WHEN blur < 85 THEN 1.3 ELSE 0 END
        + CASE WHEN stain > 0.09 THEN 1.7 ELSE 0 END) AS score,
      concat_ws('; ', CASE WHEN contrast < 34 THEN 'possible faded writing' END, CASE WHEN luma > 205 THEN 'washed background / low ink separation' END,
        CASE WHEN blur < 85 THEN 'soft/blurred text edges' END, CASE WHEN stain > 0.09 THEN 'possible water damage or staining artifacts' END) AS notes FROM m)
    SELECT CASE WHEN notes = '' THEN 'Clear page quality.' ELSE upper(notes[1]) || substring(notes, 2) || '.' END AS summary,
      round(greatest(1.0, least(10.0, score)), 4)::DOUBLE AS score, count(*) AS images FROM s GROUP BY ALL""",
)
def image_quality(spark, sf_dir):
    """Quality rules over numeric statistics; line items stand in for measured images."""
    items = table(spark, sf_dir, "lineitem")
    rated = items.select(
        routing.image_quality(
            F.col("l_quantity"), F.col("l_extendedprice") % 256, F.col("l_extendedprice") % 170, F.col("l_discount")
        ).alias("q")
    )
    return rated.groupBy(F.col("q.summary").alias("summary"), F.round("q.score", 4).alias("score")).agg(F.count("*").alias("images"))


STRUCTURED = [
    (6, 0, "\nlast words\n17"),
    (11, 1, "\nnote\n18\nend"),
    (3, 0, "\nContents\nChapter 1 ..... 3\nPart 2 ..... 9\nDivision 3 .. 11\nSchedule 4 .... 20\nPart 5 .. 31\n"),
    (4, 1, "\n1\n2\n3\n4\n5\n6\n7\nshort\n12 Objects of Act\n(a) first thing\n(b) next\n"),
    (5, 2, "\nChapter 2 General\nPart 3 Powers\nDivision 1\nPart 4 More\na\nb\nc\nd\ne\nf\ng\nh\ni\nj\n"),
    (7, 3, "\n1  The person\n2  must not\n3  act so\n4  unless\n5  allowed\n6  by law\n7  or rule\n"),
]


def _structured_pages(spark, sf_dir):
    mark = F.col("doc_id") + F.col("page_no")
    legal = (F.col("doc_id") % 2 == 0).alias("legal")
    return page_text(spark, sf_dir).select("doc_id", "page_no", legal, inject(F.col("text"), mark, STRUCTURED).alias("text"))


_LINES_SQL = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql_strip('l')}), lambda l: l <> '')"
_STRUCT_SQL = f"""sp AS (SELECT doc_id, page_no, doc_id % 2 = 0 AS legal, {sql_inject('text', '(doc_id + page_no)', STRUCTURED)} AS text FROM pt),
  ls AS (SELECT doc_id, page_no, legal, unnest({_LINES_SQL}) AS line, generate_subscripts({_LINES_SQL}, 1) AS pos FROM sp)"""


@query(
    "cls_17_page_structure",
    f"""WITH pt AS {PAGE_TEXT_SQL}, {_STRUCT_SQL},
    t AS (SELECT *, CASE WHEN regexp_full_match(line, '[0-9]{{1,4}}') OR (legal AND regexp_matches(line, '^[0-9]{{1,3}}\\s{{2,}}\\S'))
        THEN CAST(regexp_extract(line, '^([0-9]{{1,4}})', 1) AS INT) END AS token FROM ls),
    q AS (SELECT *, CASE WHEN token IS NOT NULL THEN lag(token) OVER (PARTITION BY doc_id, page_no, token IS NOT NULL ORDER BY pos) END AS before FROM t),
    c AS (SELECT doc_id, page_no, legal, count(*) AS total, count_if(length(line) <= 60) AS short, count_if(regexp_full_match(line, '[0-9]{{1,4}}')) AS alone,
      count(token) AS tokens, count_if(token = before + 1) AS seq,
      count_if((contains(line, '..') OR contains(line, ' .')) AND regexp_matches(right(line, 8), '[0-9]')) AS leaders,
      count_if(regexp_matches(line, '^(Chapter |Part |Division |Schedule )')) AS majors,
      count_if(regexp_matches(line, '^[0-9]{{1,3}}[A-Za-z]?(\\([A-Za-z0-9]+\\))?\\s+[A-Z]')) AS clauses,
      count_if(regexp_matches(line, '^\\([a-z]{{1,2}}\\)\\s+\\S')) AS alphas,
      count_if(regexp_matches(line, '^(Chapter |Part |Division |Schedule )') OR (contains(line, '..') AND regexp_matches(right(line, 8), '[0-9]'))) AS signals,
      bool_or(lower(line) = 'contents' OR starts_with(lower(line), 'contents ')) AS titled FROM q GROUP BY ALL),
    k AS (SELECT *, titled OR (signals >= 5 AND leaders >= 3) AS contents FROM c),
    d AS (SELECT *, legal AND ((contents AND leaders >= 3) OR (NOT contents AND (clauses >= 1 OR alphas >= 2) AND (seq >= 3 OR alone >= 2 OR majors >= 2))) AS direct,
      CASE WHEN contents THEN 'contents' WHEN leaders >= 4 THEN 'leader lines' WHEN majors >= 4 AND short >= greatest(10, total // 2) THEN 'many headings'
        WHEN alone >= 3 AND short >= greatest(10, total // 2) THEN 'scattered layout'
        WHEN legal AND tokens >= 6 AND seq >= 4 AND short >= greatest(6, total // 2) THEN 'line numbering' END AS reason FROM k)
    SELECT doc_id, page_no, NOT direct AND reason IS NOT NULL AS hard, direct, reason FROM d""",
)
def page_structure(spark, sf_dir):
    pages = _structured_pages(spark, sf_dir)
    found = pages.withColumn("s", classify.page_structure(F.col("text"), F.col("legal")))
    return found.filter(F.size(lines.content_lines(F.col("text"))) > 0).select("doc_id", "page_no", "s.*")


@query(
    "win_02_sequential_numbers",
    f"""WITH pt AS {PAGE_TEXT_SQL}, {_STRUCT_SQL}, n AS (SELECT doc_id, page_no, pos, CAST(line AS INT) AS v FROM ls WHERE regexp_full_match(line, '[0-9]{{1,4}}')),
    p AS (SELECT doc_id, page_no, v, lag(v) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS before FROM n)
    SELECT doc_id, page_no, count_if(v = before + 1)::BIGINT AS hits FROM p GROUP BY ALL HAVING count_if(v = before + 1) > 0""",
)
def sequential_numbers(spark, sf_dir):
    numbers = F.transform(
        F.filter(lines.content_lines(F.col("text")), lambda s: s.rlike(r"\A\d{1,4}\z")), lambda s: s.cast("int")
    )
    hits = lines.consecutive_pairs(numbers, lambda prev, cur: cur == prev + 1).cast("bigint")
    return _structured_pages(spark, sf_dir).select("doc_id", "page_no", hits.alias("hits")).filter("hits > 0")


@query(
    "win_12_edge_page_marker",
    f"""WITH pt AS {PAGE_TEXT_SQL}, {_STRUCT_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_no) AS n,
      count_if(regexp_full_match(line, '[0-9]{{1,4}}')) OVER (PARTITION BY doc_id, page_no) AS numbers FROM ls),
    m AS (SELECT doc_id, page_no, line, CASE WHEN legal AND pos = n THEN 1 WHEN legal AND pos = n - 1 THEN 2 WHEN legal AND pos = 1 AND numbers <= 1 THEN 3
      WHEN legal THEN NULL WHEN pos <= 4 THEN pos WHEN pos > n - 4 THEN 5 + n - pos END AS rank FROM c WHERE regexp_full_match(line, '[0-9]{{1,4}}'))
    SELECT doc_id, page_no, arg_min(line, rank) AS marker FROM m WHERE rank IS NOT NULL GROUP BY ALL""",
)
def edge_page_marker(spark, sf_dir):
    marker = classify.edge_page_marker(lines.content_lines(F.col("text")), F.col("legal"))
    return _structured_pages(spark, sf_dir).select("doc_id", "page_no", marker.alias("marker")).filter("marker IS NOT NULL")


_FAST = f"""profile IN ({sql_list(fixed.TEXT_FAST_PROFILES)}) AND size_mb / total_pages <= 0.45 AND chars >= 220 AND alpha_chars >= 180
  AND line_count >= 8 AND digit_chars / greatest(chars, 1) <= 0.45"""


@query("flt_18_text_fast_path", _with_pages(f"SELECT doc_id, page_no, {_FAST} AS fast FROM pages_m"))
def text_fast_path(spark, sf_dir):
    m = F.col("metrics")
    fast = (
        F.col("profile").isin(fixed.TEXT_FAST_PROFILES)
        & (F.col("size_mb") / F.col("total_pages") <= 0.45)
        & (m["chars"] >= 220)
        & (m["alpha_chars"] >= 180)
        & (m["line_count"] >= 8)
        & (m["digit_chars"] / F.greatest(m["chars"], F.lit(1)) <= 0.45)
    )
    return ops.with_metrics(page_text(spark, sf_dir)).select("doc_id", "page_no", fast.alias("fast"))


@query(
    "flt_19_scanned_image_pages",
    _with_pages("SELECT doc_id, page_no FROM pages_m WHERE profile IN ('archival', 'handwritten', 'military', 'medical', 'legal') AND size_mb / total_pages >= 0.75 AND chars <= 220"),
)
def scanned_image_pages(spark, sf_dir):
    pages = ops.with_metrics(page_text(spark, sf_dir))
    scanned = F.col("profile").isin("archival", "handwritten", "military", "medical", "legal")
    heavy = F.col("size_mb") / F.col("total_pages") >= 0.75
    return pages.filter(scanned & heavy & (F.col("metrics.chars") <= 220)).select("doc_id", "page_no")


@query(
    "flt_20_dense_newspapers",
    f"""WITH pt AS {PAGE_TEXT_SQL} SELECT doc_id, max(total_pages) AS pages FROM pt WHERE profile = 'newspaper' AND size_mb / total_pages >= 0.9 GROUP BY doc_id""",
)
def dense_newspapers(spark, sf_dir):
    pages = page_text(spark, sf_dir)
    dense = (F.col("profile") == "newspaper") & (F.col("size_mb") / F.col("total_pages") >= 0.9)
    return pages.filter(dense).groupBy("doc_id").agg(F.max("total_pages").alias("pages"))


@query(
    "src_19_text_layer_probe",
    f"""WITH pt AS {PAGE_TEXT_SQL} SELECT doc_id, avg(length({sql_strip('text')})) > 200 AS has_text_layer FROM pt WHERE page_no <= 3 GROUP BY doc_id""",
)
def text_layer_probe(spark, sf_dir):
    from quirekit.functions.rewrite import strip

    first = page_text(spark, sf_dir).filter("page_no <= 3")
    return first.groupBy("doc_id").agg((F.avg(F.length(strip(F.col("text")))) > 200).alias("has_text_layer"))


@query("src_18_page_slice", f"WITH pt AS {PAGE_TEXT_SQL} SELECT doc_id, page_no, text FROM pt WHERE page_no BETWEEN 2 AND 4")
def page_slice(spark, sf_dir):
    return page_text(spark, sf_dir).filter(F.col("page_no").between(2, 4)).select("doc_id", "page_no", "text")


# --- Audits ------------------------------------------------------------------------------

# Outputs that lose part of their source: every fourth line gone, or cut short, or whole.
def _audited(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    source_lines = F.split("text", "\n")
    thinned = F.array_join(F.filter(source_lines, lambda line, i: i % 4 != 0), "\n")
    cut = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") * (F.col("doc_id") % 10) / 10).cast("int"))
    output = F.when(F.col("doc_id") % 3 == 0, thinned).when(F.col("doc_id") % 3 == 1, cut).otherwise(F.replace("text", F.lit(" "), F.lit("  ")))
    return docs.withColumn("output", output)


_AUDIT_SQL = f"""o AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda l, i: (i - 1) % 4 <> 0), chr(10))
    WHEN 1 THEN substring(text, 1, CAST(floor(length(text) * (doc_id % 10) / 10) AS INT)) ELSE replace(text, ' ', '  ') END AS output FROM documents),
  k AS (SELECT *, length(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS source_chars, length(regexp_replace(lower(output), '[^a-z0-9]+', '', 'g')) AS output_chars,
    {sql_squash('lower(output)')} AS haystack FROM o),
  l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, haystack FROM k),
  m AS (SELECT doc_id, count(*) AS missing FROM l WHERE length({sql_squash('line')}) >= {fixed.AUDIT_MIN_LINE_CHARS} AND NOT contains(haystack, lower({sql_squash('line')})) GROUP BY doc_id),
  a AS (SELECT k.doc_id, source_chars, output_chars, least(1.0, output_chars::DOUBLE / greatest(source_chars, 1)) AS coverage, coalesce(missing, 0)::BIGINT AS missing
    FROM k LEFT JOIN m USING (doc_id))"""


@query(
    "agg_08_text_layer_audit",
    f"WITH {_AUDIT_SQL} SELECT doc_id, source_chars, output_chars, round(coverage, 6)::DOUBLE AS length_coverage, missing FROM a",
)
def text_layer_audit(spark, sf_dir):
    audited = _audited(spark, sf_dir).select("doc_id", ops.text_layer_audit(F.col("text"), F.col("output")).alias("a"))
    return audited.select(
        "doc_id", "a.source_chars", "a.output_chars", F.round("a.length_coverage", 6).alias("length_coverage"), "a.missing"
    )


@query(
    "joi_09_missing_lines",
    f"""WITH {_AUDIT_SQL} SELECT doc_id, {sql_squash('line')} AS line, count(*) AS copies FROM l
    WHERE length({sql_squash('line')}) >= {fixed.AUDIT_MIN_LINE_CHARS} AND NOT contains(haystack, lower({sql_squash('line')})) GROUP BY ALL""",
)
def missing_lines(spark, sf_dir):
    # The row's own lines are tested against the row's own output: a filter, never a join.
    lost = ops.missing_lines(F.col("text"), F.col("output"))
    return _audited(spark, sf_dir).select("doc_id", F.explode(lost).alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("copies"))


@query(
    "agg_09_appendix_policy",
    f"""WITH {_AUDIT_SQL} SELECT CASE WHEN coverage < 0.60 AND missing > 0 THEN 'full' WHEN coverage < 0.72 AND missing > 0 THEN 'lines' ELSE 'none' END AS appendix,
    count(*) AS docs FROM a GROUP BY 1""",
)
def appendix_policy(spark, sf_dir):
    audited = _audited(spark, sf_dir).select(ops.text_layer_audit(F.col("text"), F.col("output")).alias("a"))
    return audited.groupBy(ops.appendix_kind(F.col("a")).alias("appendix")).agg(F.count("*").alias("docs"))


@query(
    "agg_08_token_coverage",
    f"""WITH {_AUDIT_SQL}, w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS words,
      string_split_regex(lower(output), '[^a-z0-9]+') AS got FROM o)
    SELECT doc_id, CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda x: list_contains(got, x))) / len(words), 6) END::DOUBLE AS token_coverage FROM w""",
)
def token_coverage(spark, sf_dir):
    return _audited(spark, sf_dir).select("doc_id", F.round(ops.token_coverage(F.col("text"), F.col("output")), 6).alias("token_coverage"))


_ESC = lambda e: sql_replace(e, fixed.HTML_ESCAPES)


@query(
    "snk_16_audit_appendix",
    f"""SELECT doc_id, CASE WHEN {sql_squash('text')} = '' THEN '' WHEN doc_id % 3 = 0 THEN chr(10) || '<section>' || chr(10) || '<h2>Audit &amp; text</h2>' || chr(10) || '<pre>' || {_ESC('text')} || '</pre>' || chr(10) || '</section>' || chr(10)
      WHEN doc_id % 3 = 1 THEN chr(10) || chr(10) || '## Audit & text' || chr(10) || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10)
      ELSE chr(10) || chr(10) || '[Audit & text]' || chr(10) || text || chr(10) END AS appendix FROM documents""",
)
def audit_appendix(spark, sf_dir):
    fmt = pick(["html", "md", "txt"], F.col("doc_id"))
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    return docs.select("doc_id", ops.render_appendix(fmt, F.lit("Audit & text"), F.col("text")).alias("appendix"))


@query(
    "flt_21_shrink_guard",
    f"""WITH r AS (SELECT doc_id, repeat(text || ' ', 12) AS raw, substring(repeat(text || ' ', 12), 1, CAST(floor(length(text || ' ') * 12 * ({sql_pick(['0.5', '0.71', '0.73', '0.9'], 'doc_id')})::DOUBLE) AS INT)) AS cleaned FROM documents),
    v AS (SELECT *, length({sql_squash('raw')}) AS a, length({sql_squash('cleaned')}) AS b FROM r)
    SELECT doc_id, a >= 1 AND b < 0.72::DOUBLE * a AS rejected, md5(CASE WHEN a >= 1 AND b < 0.72::DOUBLE * a THEN raw ELSE cleaned END) AS kept FROM v""",
)
def shrink_guard(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.repeat(F.concat("text", F.lit(" ")), 12).alias("raw"))
    ratio = pick(["0.5", "0.71", "0.73", "0.9"], F.col("doc_id")).cast("double")
    pair = docs.withColumn("cleaned", F.substring(F.col("raw"), F.lit(1), F.floor(F.length("raw") * ratio).cast("int")))
    kept = ops.keep_unless_shrunk(F.col("raw"), F.col("cleaned"), squash(F.col("raw")), squash(F.col("cleaned")))
    return pair.withColumn("kept", kept).select(
        "doc_id", ((F.col("kept") != F.col("cleaned"))).alias("rejected"), F.md5("kept").alias("kept")
    )


@query(
    "flt_15_archive_markers",
    f"""WITH i AS (SELECT doc_id, {sql_inject('text', 'doc_id', [(4, 0, ' See nla.gov.au/nla.news-page123 <b>National</b>'), (5, 1, ' National  Library of Australia')])} AS text FROM documents)
    SELECT doc_id, contains(lower(text), 'national library of australia') OR contains(lower(text), 'nla.news-page') AS marked FROM i""",
)
def archive_markers(spark, sf_dir):
    fragments = [(4, 0, " See nla.gov.au/nla.news-page123 <b>National</b>"), (5, 1, " National  Library of Australia")]
    docs = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", inject(F.col("text"), F.col("doc_id"), fragments).alias("text"))
    return docs.select("doc_id", ops.has_archive_marker(F.col("text")).alias("marked"))


@query(
    "flt_17_large_profile_skip",
    f"""WITH i AS (SELECT doc_id, {sql_pick(fixed.PROFILES, 'doc_id')} AS profile, '<html><main>' || text || '</main>' AS html FROM documents)
    SELECT doc_id, profile IN ('archival', 'military') AND contains(lower(html), '<html') AND contains(lower(html), '<main') AS skip FROM i""",
)
def large_profile_skip(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", pick(fixed.PROFILES, F.col("doc_id")).alias("profile"), F.concat(F.lit("<html><main>"), "text", F.lit("</main>")).alias("html")
    )
    return docs.select("doc_id", ops.skips_cleanup(F.col("profile"), F.col("html")).alias("skip"))


@query(
    "flt_22_handwriting_flags",
    f"""WITH i AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'archival' WHEN doc_id % 5 = 1 THEN 'handwritten' ELSE 'legal' END AS profile,
      {sql_inject('text', 'doc_id', [(6, 0, ' [Unclear word]')])} AS text FROM documents)
    SELECT doc_id, profile, profile <> 'legal' AND length({sql_squash(sql_replace('text', fixed.HTML_ENTITIES))}) >= 200 AND NOT contains(lower(text), '[unclear') AS flagged FROM i""",
)
def handwriting_flags(spark, sf_dir):
    key = F.col("doc_id")
    profile = F.when(key % 2 == 0, "archival").when(key % 5 == 1, "handwritten").otherwise("legal")
    docs = text_table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", profile.alias("profile"), inject(F.col("text"), key, [(6, 0, " [Unclear word]")]).alias("text")
    )
    return docs.select("doc_id", "profile", needs_handwriting_flag(F.col("text"), F.lit("txt"), F.col("profile")).alias("flagged"))


def needs_handwriting_flag(content, fmt, profile, min_chars=200):
    """FLT-22: a long handwritten transcription without one uncertainty mark is suspicious."""
    from quirekit.functions.rewrite import rewrite

    markup = rewrite(content, [(r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", " ")])
    plain = squash(text.unescape_html(F.when(fmt.isin("html", "epub"), markup).otherwise(content)))
    return profile.isin("archival", "handwritten") & (F.length(plain) >= min_chars) & ~F.lower(plain).contains("[unclear")


@query(
    "str_35_handwriting_note",
    f"""WITH i AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'archival' ELSE 'handwritten' END AS profile, {sql_inject('text', 'doc_id', [(6, 0, ' [Unclear word]')])} AS text FROM documents)
    SELECT doc_id, CASE WHEN length({sql_squash(sql_replace('text', fixed.HTML_ENTITIES))}) >= 200 AND NOT contains(lower(text), '[unclear') THEN
      '[Audit flag: Suspiciously fluent handwriting transcription. Review for potential automated guesses.]' || chr(10) || chr(10) ELSE '' END || text AS result FROM i""",
)
def handwriting_note(spark, sf_dir):
    # Fixed wording of the note put before plain-text transcriptions.
    note = "[Audit flag: Suspiciously fluent handwriting transcription. Review for potential automated guesses.]\n\n"
    key = F.col("doc_id")
    docs = text_table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", F.when(key % 2 == 0, "archival").otherwise("handwritten").alias("profile"),
        inject(F.col("text"), key, [(6, 0, " [Unclear word]")]).alias("text"),
    )
    flagged = needs_handwriting_flag(F.col("text"), F.lit("txt"), F.col("profile")) & ~F.col("text").startswith("[Audit flag:")
    return docs.select("doc_id", F.when(flagged, F.concat(F.lit(note), "text")).otherwise(F.col("text")).alias("result"))


ERRORS = [
    "401 Unauthorized", "429 Too Many Requests", "quota exhausted", "ConnectError: refused", "connection refused by host",
    "503 Service Unavailable", "Bad request", "Invalid API key", "read TIMEOUT", "getaddrinfo failed",
]


@query(
    "stm_17_error_actions",
    f"""WITH e AS (SELECT event_id, {sql_pick(ERRORS, 'event_id')} AS message FROM events)
    SELECT message, CASE WHEN regexp_matches(lower(message), '401|unauthorized|invalid api key|authentication') THEN 'fail: authentication'
      WHEN regexp_matches(lower(message), {quote('|'.join(fixed.CONNECTION_ERRORS))}) THEN 'fail: connection'
      WHEN regexp_matches(lower(message), {quote('|'.join(fixed.RETRYABLE_ERRORS))}) THEN 'retry' ELSE 'raise' END AS action, count(*) AS errors FROM e GROUP BY ALL""",
)
def error_actions(spark, sf_dir):
    errors = table(spark, sf_dir, "events").select(pick(ERRORS, F.col("event_id")).alias("message"))
    return errors.groupBy("message", routing.error_action(F.col("message")).alias("action")).agg(F.count("*").alias("errors"))


@query(
    "stm_08_backoff_schedule",
    "SELECT user_id, event_id % 6 AS attempt, least(90.0, 8.0 * power(2, event_id % 6))::DOUBLE AS wait_sec, count(*) AS events FROM events GROUP BY ALL",
)
def backoff_schedule(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % fixed.RETRY_ATTEMPTS).alias("attempt"))
    counts = attempts.groupBy("user_id", "attempt").agg(F.count("*").alias("events"))
    return counts.withColumn("wait_sec", routing.backoff_seconds(F.col("attempt")))


@query(
    "str_40_translation_settings",
    f"""WITH t AS (SELECT doc_id, {sql_pick(['French', ' german ', 'Klingon', 'Spanish'], 'doc_id')} AS target, doc_id % 3 <> 0 AS translating FROM documents)
    SELECT doc_id, CASE WHEN NOT translating THEN 'und' ELSE CASE lower(trim(target)) WHEN 'french' THEN 'fr' WHEN 'german' THEN 'de' WHEN 'spanish' THEN 'es' ELSE 'en' END END AS lang_code,
      CASE WHEN NOT translating THEN 'auto' ELSE 'ltr' END AS direction FROM t""",
)
def translation_settings(spark, sf_dir):
    target = pick(["French", " german ", "Klingon", "Spanish"], F.col("doc_id"))
    on = F.col("doc_id") % 3 != 0
    return table(spark, sf_dir, "documents").select(
        "doc_id", routing.language_code(target, on).alias("lang_code"), routing.text_direction(target, on).alias("direction")
    )
