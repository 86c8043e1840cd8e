"""Job-queue queries over one job per document."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.functions import fixed, lines, models, text
from quirekit.operators import jobs as ops
from quirekit.plans.inputs import (
    JOBS_SQL, SQL_BASE, SQL_EXT, SQL_STATUS, SQL_TERMINAL, jobs, pick, sql_model, sql_pick, sql_scope, sql_vendor,
)
from quirekit.plans.registry import query, quote, sql_case, sql_list, table



def _with_jobs(body: str) -> str:
    return f"WITH jobs AS {JOBS_SQL} {body}"


@query("flt_01_pending_jobs", _with_jobs(f"SELECT job_id, path FROM jobs WHERE {SQL_STATUS} = 'Queued'"))
def pending_jobs(spark, sf_dir):
    return ops.pending(jobs(spark, sf_dir)).select("job_id", "path")


@query("flt_02_has_incomplete", _with_jobs(f"SELECT coalesce(bool_or(NOT ({SQL_TERMINAL})), false) AS has_incomplete FROM jobs"))
def has_incomplete(spark, sf_dir):
    return ops.has_incomplete(jobs(spark, sf_dir))


@query(
    "flt_03_setting_targets",
    _with_jobs(
        f"""SELECT job_id, path FROM jobs WHERE CASE
        WHEN (SELECT bool_or(job_id % 7 = 0 AND {SQL_STATUS} IN ('Queued', 'Paused')) FROM jobs)
          THEN job_id % 7 = 0 AND {SQL_STATUS} IN ('Queued', 'Paused')
        WHEN (SELECT bool_or(job_id % 7 = 0) FROM jobs) THEN job_id % 7 = 0
        ELSE {SQL_STATUS} IN ('Queued', 'Paused') END"""
    ),
)
def setting_targets(spark, sf_dir):
    return ops.setting_targets(jobs(spark, sf_dir), F.col("job_id") % 7 == 0).select("job_id", "path")


@query(
    "flt_04_settings_projection",
    _with_jobs(
        f"""SELECT job_id, fmt AS format_type, profile AS doc_profile, {sql_model('model_name')} AS model_name,
        coalesce(model_override, '') AS model_override, merge_files, trim(coalesce(page_scope, '')) AS pdf_page_scope,
        {sql_case('(' + sql_model('model_name') + ')', fixed.MODEL_LABELS, 'NULL')} AS engine FROM jobs"""
    ),
)
def settings_projection(spark, sf_dir):
    model = models.model_name(F.col("model_name"))
    return jobs(spark, sf_dir).select(
        "job_id",
        F.col("fmt").alias("format_type"),
        F.col("profile").alias("doc_profile"),
        model.alias("model_name"),
        F.coalesce("model_override", F.lit("")).alias("model_override"),
        "merge_files",
        F.trim(F.coalesce("page_scope", F.lit(""))).alias("pdf_page_scope"),
        models.literal_map(fixed.MODEL_LABELS)[model].alias("engine"),
    )


@query(
    "flt_05_status_transitions",
    _with_jobs(
        f"""SELECT status, {SQL_STATUS} AS before,
        CASE WHEN {SQL_STATUS} IN ('Queued', 'Paused') THEN 'Stopped' ELSE {SQL_STATUS} END AS stopped,
        CASE WHEN {SQL_STATUS} IN ('Queued', 'Processing') THEN 'Paused' ELSE {SQL_STATUS} END AS paused,
        CASE WHEN status = 'Paused' THEN 'Queued' ELSE status END AS resumed, count(*) AS jobs FROM jobs GROUP BY ALL"""
    ),
)
def status_transitions(spark, sf_dir):
    status = F.col("status")
    return (
        jobs(spark, sf_dir)
        .groupBy("status")
        .agg(F.count("*").alias("jobs"))
        .select(
            "status",
            ops.status_of().alias("before"),
            ops.stop_status(status).alias("stopped"),
            ops.pause_status(status).alias("paused"),
            ops.resume_status(status).alias("resumed"),
            "jobs",
        )
    )


@query(
    "flt_06_restore_session",
    _with_jobs(
        f"""SELECT job_id, path, CASE WHEN {SQL_STATUS} IN ('Processing', 'Paused') THEN 'Queued' ELSE {SQL_STATUS} END AS status
        FROM jobs WHERE job_id % 17 <> 0 AND job_id % 19 <> 0"""
    ),
)
def restore_session(spark, sf_dir):
    """Rows come back from session JSON; rows that do not parse or have no path are dropped."""
    saved = jobs(spark, sf_dir).select(
        F.when(F.col("job_id") % 17 == 0, "{broken")
        .when(F.col("job_id") % 19 == 0, F.to_json(F.struct("job_id", "status")))
        .otherwise(F.to_json(F.struct("job_id", "path", "status")))
        .alias("line")
    )
    row = F.from_json("line", "job_id bigint, path string, status string", {"mode": "PERMISSIVE"})
    rows = saved.select(row.alias("row")).select("row.*").filter("path IS NOT NULL AND path <> ''")
    return rows.select("job_id", "path", ops.restore_status(F.col("status")).alias("status"))


@query(
    "flt_07_start_statuses",
    _with_jobs(
        """SELECT status, CASE WHEN status IN ('Processing', 'Paused') THEN 'Queued' ELSE status END AS on_resume,
        CASE WHEN status = 'Paused' THEN status ELSE 'Queued' END AS on_fresh_start, count(*) AS jobs FROM jobs GROUP BY ALL"""
    ),
)
def start_statuses(spark, sf_dir):
    status = F.col("status")
    counts = jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("jobs"))
    return counts.select(
        "status",
        ops.start_status(status, resume=True).alias("on_resume"),
        ops.start_status(status, resume=False).alias("on_fresh_start"),
        "jobs",
    )


@query(
    "flt_08_missing_credential",
    _with_jobs(
        f"""SELECT job_id, vendor, model_name FROM (SELECT job_id, status, model_name, {sql_vendor('model_name')} AS vendor FROM jobs)
        WHERE {SQL_STATUS} = 'Queued' AND vendor NOT IN ('gemini') ORDER BY job_id LIMIT 1"""
    ),
)
def missing_credential(spark, sf_dir):
    return ops.first_missing_credential(jobs(spark, sf_dir), ["gemini"])


@query(
    "flt_09_destination_problems",
    _with_jobs(
        """SELECT job_id, CASE WHEN job_id % 2 = 1 AND trim(coalesce(source_root, '')) = ''
          THEN 'Please choose a custom output folder or select ''Same folder as source file''.'
          WHEN job_id % 2 = 1 AND NOT output_exists THEN 'Custom output folder does not exist.' END AS problem FROM jobs"""
    ),
)
def destination_problems(spark, sf_dir):
    problem = ops.destination_problem(F.col("job_id") % 2, F.col("source_root"), F.col("output_exists"))
    return jobs(spark, sf_dir).select("job_id", problem.alias("problem"))


@query(
    "flt_10_future_timestamps",
    """SELECT event_id, CASE WHEN TRY_CAST(raw AS DOUBLE) > 50 THEN TRY_CAST(raw AS DOUBLE) END AS scheduled
    FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'soon' ELSE CAST(event_id % 100 AS VARCHAR) || '.5' END AS raw FROM events)""",
)
def future_timestamps(spark, sf_dir):
    key = F.col("event_id")
    raw = F.when(key % 5 == 0, "soon").otherwise(F.concat((key % 100).cast("string"), F.lit(".5")))
    return table(spark, sf_dir, "events").select("event_id", ops.future_timestamp(raw, F.lit(50.0)).alias("scheduled"))


@query(
    "flt_11_progress_log_thinning",
    _with_jobs(
        """SELECT job_id, page FROM (SELECT job_id, total_pages * 9 AS total, unnest(range(1, total_pages * 9 + 1)) AS page FROM jobs)
        WHERE total <= 20 OR page = 1 OR page = total OR page <= 20 OR page % 2 = 0"""
    ),
)
def progress_log_thinning(spark, sf_dir):
    pages = jobs(spark, sf_dir).select(
        "job_id", (F.col("total_pages") * 9).alias("total"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total_pages") * 9)).alias("page")
    )
    return pages.filter(ops.logs_progress(F.col("page"), F.col("total"))).select("job_id", "page")


LOG_MESSAGES = [
    "[Page] 3 of 9 done", "[Confidence] page 2: 8.0/10", "[Memory] peak 300 MB", "plain line", "[Cache] hit for page 7", "[Limit]  waiting 9s",
    "[Unknown] label", "[Save] wrote 3 parts", "no [Cache] label in front", "[cache] lower case", "[Save]", "",
]
# What the query puts for each label; a run gives its own.
LOG_LABELS = {"Cache": "From the cache: ", "Limit": "Slowed down: ", "Save": "Saved: "}


@query(
    "flt_12_log_echo",
    _with_jobs(
        f"""SELECT job_id, message FROM (SELECT job_id, {sql_pick(LOG_MESSAGES, 'job_id')} AS message FROM jobs)
        WHERE job_id % 4 = 0 OR NOT regexp_matches(message, '^\\[(Page|Confidence|Memory)\\]')"""
    ),
)
def log_echo(spark, sf_dir):
    logs = jobs(spark, sf_dir).select("job_id", pick(LOG_MESSAGES, F.col("job_id")).alias("message"))
    return logs.filter(ops.echoes_log(F.col("message"), F.col("job_id") % 4 != 0))


_LABEL_ROWS = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in LOG_LABELS.items())


@query(
    "str_32_humanized_log",
    _with_jobs(
        f""", logs AS (SELECT job_id, {sql_pick(LOG_MESSAGES, 'job_id')} AS message FROM jobs), labels(label, wording) AS (VALUES {_LABEL_ROWS})
        SELECT job_id, CASE WHEN wording IS NULL THEN message ELSE wording || ltrim(substring(message, length(label) + 3)) END AS shown
        FROM logs LEFT JOIN labels ON starts_with(message, '[' || label || ']')"""
    ),
)
def humanized_log(spark, sf_dir):
    logs = jobs(spark, sf_dir).select("job_id", pick(LOG_MESSAGES, F.col("job_id")).alias("message"))
    return logs.select("job_id", ops.humanize_log(F.col("message"), LOG_LABELS).alias("shown"))


@query(
    "flt_13_protected_paths",
    _with_jobs(
        """SELECT job_id, lower(path) = '/in/inbox' OR starts_with(lower(path), '/in/inbox/') OR starts_with(lower(path), '/in/src3/') AS protected FROM jobs"""
    ),
)
def protected_paths(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", ops.in_protected_dir(F.col("path"), "/in", ["inbox", "SRC3"]).alias("protected"))


@query(
    "flt_14_scope_validity",
    _with_jobs(
        f""", s AS (SELECT job_id, {sql_scope('page_scope')} AS scope FROM jobs)
        SELECT job_id, scope, scope <> '' AND NOT list_contains(list_transform(string_split(scope, ','), lambda p: CASE
          WHEN regexp_full_match(p, '[0-9]+') THEN CAST(p AS BIGINT) >= 1
          WHEN regexp_full_match(p, '[0-9]+-[0-9]+') THEN CAST(split_part(p, '-', 1) AS BIGINT) >= 1
            AND CAST(split_part(p, '-', 2) AS BIGINT) >= CAST(split_part(p, '-', 1) AS BIGINT)
          ELSE false END), false) AS valid FROM s"""
    ),
)
def scope_validity(spark, sf_dir):
    scoped = jobs(spark, sf_dir).select("job_id", text.normalize_scope(F.col("page_scope")).alias("scope"))
    return scoped.withColumn("valid", lines.scope_is_valid(F.col("scope")))


@query("str_21_scope_text", _with_jobs(f"SELECT job_id, {sql_scope('page_scope')} AS scope FROM jobs"))
def scope_text(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", text.normalize_scope(F.col("page_scope")).alias("scope"))


@query(
    "flt_16_audit_needed",
    _with_jobs(
        f"""SELECT job_id, {SQL_EXT} = '.pdf' AND job_id % 3 <> 0 AND NOT (profile = 'newspaper' AND job_id % 2 = 0)
        AND NOT (job_id % 5 = 1 AND size_mb >= {fixed.LOW_MEMORY_AUDIT_MB}) AS needs_audit FROM jobs"""
    ),
)
def audit_needed(spark, sf_dir):
    path = F.when((F.col("job_id") % 2 == 0) & (F.col("profile") == "newspaper"), F.concat(F.lit("/in/nla.news-"), text.base_name(F.col("path")))).otherwise(F.col("path"))
    needed = ops.needs_audit(
        text.file_extension(F.col("path")), F.col("job_id") % 3 != 0, F.col("profile"), path, F.col("job_id") % 5 == 1, F.col("size_mb")
    )
    return jobs(spark, sf_dir).select("job_id", needed.alias("needs_audit"))


_FAMILY_ROWS = ", ".join(f"({quote(e)}, {quote(f)})" for f, es in fixed.EXTENSION_FAMILIES.items() for e in es)


@query(
    "flt_23_job_outcomes",
    _with_jobs(
        f""", ext(e, family) AS (VALUES {_FAMILY_ROWS})
        SELECT job_id, CASE WHEN job_id % 23 = 0 THEN 'Missing' WHEN family IS NULL THEN 'Unsupported'
          WHEN output_exists AND collision_mode = 'skip' THEN 'Skipped'
          WHEN completed_units >= work_units AND output_exists THEN 'Done'
          WHEN job_id % 4 = 0 OR (completed_units > 0 AND completed_units < work_units) THEN 'Resume' ELSE 'Run' END AS outcome
        FROM jobs LEFT JOIN ext ON e = {SQL_EXT}"""
    ),
)
def job_outcomes(spark, sf_dir):
    frame = jobs(spark, sf_dir).select(
        "job_id", "output_exists", "collision_mode", "completed_units",
        (F.col("job_id") % 23 != 0).alias("source_exists"),
        ops.extension_family(text.file_extension(F.col("path"))).alias("ext_family"),
        F.col("work_units").alias("total_units"),
        (F.col("job_id") % 4 == 0).alias("resume"),
    )
    return ops.job_outcome(frame).select("job_id", "outcome")


@query(
    "flt_24_first_scope_error",
    _with_jobs(
        f""", s AS (SELECT job_id, {SQL_BASE} AS filename, total_pages, {sql_scope('page_scope')} AS scope FROM jobs
               WHERE {SQL_STATUS} = 'Queued' AND {SQL_EXT} = '.pdf'),
        p AS (SELECT job_id, filename, total_pages, pos, parts[pos] AS part FROM (SELECT *, string_split(scope, ',') AS parts,
               unnest(range(1, len(string_split(scope, ',')) + 1)) AS pos FROM s WHERE scope NOT IN ('', 'all', '*'))),
        e AS (SELECT job_id, filename, pos, CASE
          WHEN contains(part, '-') AND NOT regexp_full_match(part, '[0-9]+-[0-9]+') THEN 'Invalid page range ''' || part || '''. Only numbers and commas are allowed.'
          WHEN contains(part, '-') AND CAST(split_part(part, '-', 2) AS INT) < CAST(split_part(part, '-', 1) AS INT)
            THEN 'Invalid page range ''' || part || '''. The end page must be greater than or equal to the start page.'
          WHEN contains(part, '-') AND CAST(split_part(part, '-', 2) AS INT) > total_pages
            THEN 'Page range ''' || part || ''' exceeds this PDF''s length of ' || total_pages || ' pages.'
          WHEN contains(part, '-') THEN NULL
          WHEN NOT regexp_full_match(part, '[0-9]+') THEN 'Invalid page value ''' || part || '''. Use numbers like 1,3,5-7.'
          WHEN CAST(part AS INT) > total_pages THEN 'Page ' || part || ' exceeds this PDF''s length of ' || total_pages || ' pages.' END AS details FROM p)
        SELECT job_id, filename, details FROM e WHERE details IS NOT NULL ORDER BY job_id, pos LIMIT 1"""
    ),
)
def first_scope_error(spark, sf_dir):
    return ops.first_scope_error(jobs(spark, sf_dir))


@query(
    "flt_25_run_context",
    _with_jobs(
        f"""SELECT coalesce(trim(model_override), '') = '' AS automatic_engine, count(*) AS jobs,
        sum(CASE WHEN {SQL_STATUS} = 'Queued' THEN 1 ELSE 0 END)::BIGINT AS queued,
        'Extraction started: ' || sum(CASE WHEN {SQL_STATUS} = 'Queued' THEN 1 ELSE 0 END)::BIGINT || ' queued file(s).' AS status_text FROM jobs GROUP BY 1"""
    ),
)
def run_context(spark, sf_dir):
    automatic = F.trim(F.coalesce("model_override", F.lit(""))) == ""
    counts = jobs(spark, sf_dir).groupBy(automatic.alias("automatic_engine")).agg(
        F.count("*").alias("jobs"), F.count_if(ops.status_of() == "Queued").alias("queued")
    )
    return counts.withColumn("status_text", F.concat(F.lit("Extraction started: "), F.col("queued").cast("string"), F.lit(" queued file(s).")))


@query(
    "joi_01_add_new_paths",
    _with_jobs(
        "SELECT path, min(job_id) AS job_id FROM jobs WHERE job_id % 3 <> 0 AND path NOT IN (SELECT path FROM jobs WHERE job_id % 3 = 0) GROUP BY path"
    ),
)
def add_new_paths(spark, sf_dir):
    frame = jobs(spark, sf_dir)
    return ops.add_new_paths(frame.filter(F.col("job_id") % 3 == 0), frame.filter(F.col("job_id") % 3 != 0))


@query("joi_02_rows_for_paths", _with_jobs("SELECT job_id, path FROM jobs WHERE path IN (SELECT path FROM jobs WHERE job_id % 13 = 5 OR job_id % 4 = 1)"))
def rows_for_paths(spark, sf_dir):
    frame = jobs(spark, sf_dir).select("job_id", "path")
    return ops.rows_for_paths(frame, frame.filter((F.col("job_id") % 13 == 5) | (F.col("job_id") % 4 == 1)))


@query(
    "joi_03_resume_remaining",
    _with_jobs("SELECT job_id, path FROM jobs WHERE path NOT IN (SELECT path FROM jobs WHERE status = 'Done' AND job_id % 13 <> 5)"),
)
def resume_remaining(spark, sf_dir):
    frame = jobs(spark, sf_dir).select("job_id", "path", "status")
    done = frame.filter((F.col("status") == "Done") & (F.col("job_id") % 13 != 5))
    return ops.resume_remaining(frame, done).select("job_id", "path")


@query(
    "joi_04_filled_settings",
    _with_jobs(
        """SELECT job_id, coalesce(CASE WHEN job_id % 2 = 0 THEN fmt END, 'html') AS format_type,
        coalesce(CASE WHEN job_id % 3 = 0 THEN profile END, 'standard') AS doc_profile,
        coalesce(CASE WHEN job_id % 5 = 0 THEN merge_files END, false) AS merge_files FROM jobs"""
    ),
)
def filled_settings(spark, sf_dir):
    settings = F.struct(
        F.when(F.col("job_id") % 2 == 0, F.col("fmt")).alias("format_type"),
        F.when(F.col("job_id") % 3 == 0, F.col("profile")).alias("doc_profile"),
        F.when(F.col("job_id") % 5 == 0, F.col("merge_files")).alias("merge_files"),
    )
    frame = jobs(spark, sf_dir).select("job_id", settings.alias("settings"))
    return ops.fill_settings(frame, {"format_type": "html", "doc_profile": "standard", "merge_files": False}).drop("settings")


_PRESET_ROWS = ", ".join(
    f"({quote(p)}, {quote(fixed.PRESET_MODEL_EXCEPTIONS.get(p, fixed.PRO_MODEL))}, {p in fixed.PRESET_PUNCTUATION}, {p in fixed.PRESET_UNITS},"
    f" {p in fixed.PRESET_ABBREVIATIONS}, {p not in fixed.PRESET_NO_IMAGES}, {p in fixed.PRESET_PAGE_NUMBERS}, {p in fixed.PRESET_MERGE})"
    for p in fixed.PROFILES
)
PRESET_SQL = (
    "preset(key, model_name, modernize_punctuation, unit_conversion, abbrev_expansion, image_descriptions,"
    f" preserve_original_page_numbers, merge_files) AS (VALUES {_PRESET_ROWS})"
)
_ODD_PROFILE = "CASE WHEN job_id % 6 = 1 THEN 'unheard of' ELSE profile END"


@query(
    "joi_05_profile_presets",
    _with_jobs(
        f""", {PRESET_SQL}, j AS (SELECT job_id, {_ODD_PROFILE} AS profile FROM jobs)
        SELECT job_id, profile, p.* EXCLUDE (key) FROM j JOIN preset p
          ON p.key = CASE WHEN profile IN (SELECT key FROM preset) THEN profile ELSE 'standard' END"""
    ),
)
def profile_presets(spark, sf_dir):
    profile = F.when(F.col("job_id") % 6 == 1, "unheard of").otherwise(F.col("profile"))
    frame = jobs(spark, sf_dir).select("job_id", profile.alias("profile"))
    return frame.select("job_id", "profile", models.preset(F.col("profile")).alias("preset")).select("job_id", "profile", "preset.*")


_RANK_ROWS = ", ".join(f"({quote(m)}, {i}, {quote(b)})" for m, backups in fixed.MODEL_FALLBACKS.items() for i, b in enumerate(backups))


@query(
    "joi_07_available_model",
    _with_jobs(
        f""", fallback(wanted, rank, candidate) AS (VALUES {_RANK_ROWS}),
        j AS (SELECT job_id, {sql_model('model_name')} AS model FROM jobs)
        SELECT job_id, coalesce(arg_min(candidate, rank) FILTER (contains(candidate, 'gpt') OR contains(candidate, 'claude')), any_value(model)) AS model
        FROM j LEFT JOIN fallback ON wanted = model GROUP BY job_id"""
    ),
)
def available_model(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", models.available_model(F.col("model_name"), ["openai", "claude"]).alias("model"))


# Whether every part of a scope names pages the document has.
_SCOPE_OK = """NOT list_contains(list_transform(string_split(scope, ','), lambda p: CASE
    WHEN regexp_full_match(p, '[0-9]+') THEN CAST(p AS BIGINT) BETWEEN 1 AND total
    WHEN regexp_full_match(p, '[0-9]+-[0-9]+') THEN CAST(split_part(p, '-', 1) AS BIGINT) >= 1
      AND CAST(split_part(p, '-', 2) AS BIGINT) BETWEEN CAST(split_part(p, '-', 1) AS BIGINT) AND total
    ELSE false END), false)"""


@query(
    "joi_08_scope_pages",
    _with_jobs(
        f""", s AS (SELECT job_id, {sql_scope('page_scope')} AS scope, total_pages * 3 AS total FROM jobs),
        parts AS (SELECT job_id, pos, string_split(scope, ',')[pos] AS part FROM
          (SELECT *, unnest(range(1, len(string_split(scope, ',')) + 1)) AS pos FROM s WHERE scope NOT IN ('', 'all') AND {_SCOPE_OK})),
        pages AS (SELECT job_id, pos, unnest(range(CAST(split_part(part, '-', 1) AS BIGINT),
            CAST(CASE WHEN contains(part, '-') THEN split_part(part, '-', 2) ELSE part END AS BIGINT) + 1)) AS page FROM parts),
        firsts AS (SELECT job_id, page, min(pos * 1000000 + page) AS place FROM pages GROUP BY job_id, page)
        SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY place) - 1)::BIGINT AS place, page::BIGINT AS page FROM firsts
        UNION ALL SELECT job_id, p - 1, p FROM (SELECT job_id, unnest(range(1, total + 1)) AS p FROM s WHERE scope IN ('', 'all'))"""
    ),
)
def scope_pages(spark, sf_dir):
    pages = lines.scope_pages(text.normalize_scope(F.col("page_scope")), F.col("total_pages") * 3)
    exploded = jobs(spark, sf_dir).select("job_id", F.posexplode(pages).alias("place", "page"))
    return exploded.select("job_id", F.col("place").cast("bigint"), F.col("page").cast("bigint"))


@query(
    "joi_12_extension_family",
    _with_jobs(
        f""", ext(e, family) AS (VALUES {_FAMILY_ROWS})
        SELECT coalesce(family, 'Unsupported') AS family, coalesce(family, '') IN ({sql_list(fixed.RESUMABLE_FAMILIES)}) AS resumable, count(*) AS jobs
        FROM jobs LEFT JOIN ext ON e = {SQL_EXT} GROUP BY ALL"""
    ),
)
def extension_family(spark, sf_dir):
    family = F.coalesce(ops.extension_family(text.file_extension(F.col("path"))), F.lit("Unsupported"))
    counts = jobs(spark, sf_dir).groupBy(family.alias("family")).agg(F.count("*").alias("jobs"))
    return counts.withColumn("resumable", F.col("family").isin(fixed.RESUMABLE_FAMILIES))


_ORDER_ROWS = ", ".join(f"({quote(s)}, {i})" for i, s in enumerate(fixed.STATUS_DISPLAY_ORDER, 1))


@query(
    "agg_01_status_histogram",
    _with_jobs(
        f""", o(label, ord) AS (VALUES {_ORDER_ROWS})
        SELECT {SQL_STATUS} AS status, coalesce(any_value(ord), 1000)::BIGINT AS display_order, count(*) AS jobs
        FROM jobs LEFT JOIN o ON label = {SQL_STATUS} GROUP BY 1"""
    ),
)
def status_histogram(spark, sf_dir):
    return ops.status_histogram(jobs(spark, sf_dir))


_DONE_SQL = f"CASE WHEN {SQL_TERMINAL} THEN work_units WHEN job_id = 1 THEN least(work_units, 2) ELSE 0 END"


@query(
    "agg_02_progress_summary",
    _with_jobs(
        f"""SELECT count(*) AS files, count_if(status = 'Done')::BIGINT AS done, count_if(status = 'Error')::BIGINT AS error,
        count_if(status = 'Paused')::BIGINT AS paused, count_if(status = 'Stopped')::BIGINT AS stopped, count_if(status = 'Queued')::BIGINT AS queued,
        count_if(status = 'Processing')::BIGINT AS processing, count_if(status = 'Done' AND review_recommended)::BIGINT AS review,
        count_if({SQL_TERMINAL})::BIGINT AS terminal, sum(work_units)::BIGINT AS total_units, sum({_DONE_SQL})::BIGINT AS completed_units,
        CAST(floor(sum({_DONE_SQL}) * 100.0 / sum(work_units)) AS BIGINT) AS percent FROM jobs"""
    ),
)
def progress_summary(spark, sf_dir):
    return ops.progress_summary(jobs(spark, sf_dir), F.col("job_id") == 1, F.lit(2))


@query(
    "agg_03_unit_totals",
    _with_jobs(f"SELECT profile, sum(work_units)::BIGINT AS total_units, sum({_DONE_SQL})::BIGINT AS completed_units FROM jobs GROUP BY profile"),
)
def unit_totals(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("profile").agg(*ops.unit_totals(F.col("job_id") == 1, F.lit(2)))


@query("agg_04_saved_items", _with_jobs(f"SELECT greatest(count_if(NOT ({SQL_TERMINAL})), 1)::BIGINT AS items FROM jobs"))
def saved_items(spark, sf_dir):
    return ops.saved_items(jobs(spark, sf_dir))


@query(
    "agg_05_merge_plan",
    _with_jobs(
        f"""SELECT count(DISTINCT fmt) AS formats, count(DISTINCT fmt) <= 1 AS merge_mode,
        CASE WHEN count(DISTINCT fmt) <= 1 THEN coalesce(min(fmt), 'html') ELSE 'html' END AS merge_fmt,
        CASE WHEN count(DISTINCT fmt) <= 1 THEN coalesce(min(fmt), 'html') ELSE 'html' END IN ('html', 'txt', 'md') AS streamable
        FROM jobs WHERE {SQL_STATUS} = 'Queued'"""
    ),
)
def merge_plan(spark, sf_dir):
    return ops.merge_plan(jobs(spark, sf_dir))


@query(
    "agg_10_resume_summary",
    _with_jobs(
        f"""SELECT job_id, {SQL_BASE} || ' (' || {SQL_STATUS} || ')' AS label, (SELECT count(*) FROM jobs) AS saved,
        (SELECT count_if({SQL_TERMINAL})::BIGINT FROM jobs) AS terminal, (SELECT count_if(NOT ({SQL_TERMINAL}))::BIGINT FROM jobs) AS recoverable
        FROM jobs WHERE NOT ({SQL_TERMINAL}) ORDER BY job_id LIMIT 20"""
    ),
)
def resume_summary(spark, sf_dir):
    return ops.resume_summary(jobs(spark, sf_dir))


@query(
    "agg_11_work_units",
    _with_jobs(
        f""", ext(e, family) AS (VALUES {_FAMILY_ROWS}), s AS (SELECT j.*, total_pages AS total, family, {sql_scope('page_scope')} AS scope FROM jobs j LEFT JOIN ext ON e = {SQL_EXT})
        SELECT job_id, coalesce(family, '') AS family, CASE
          WHEN family = 'pdf' AND scope IN ('', 'all') THEN total_pages
          WHEN family = 'pdf' AND {_SCOPE_OK} THEN len(list_distinct(flatten(list_transform(string_split(scope, ','), lambda p:
            range(CAST(split_part(p, '-', 1) AS BIGINT), CAST(CASE WHEN contains(p, '-') THEN split_part(p, '-', 2) ELSE p END AS BIGINT) + 1)))))
          WHEN family IN ('source_text', 'epub', 'page_text', 'presentation', 'renderable') THEN work_units ELSE 1 END::BIGINT AS units FROM s"""
    ),
)
def work_units(spark, sf_dir):
    family = ops.extension_family(text.file_extension(F.col("path")))
    selected = F.size(lines.scope_pages(text.normalize_scope(F.col("page_scope")), F.col("total_pages")))
    units = (
        F.when(family == "pdf", F.greatest(selected, F.lit(1)))
        .when(family.isin(fixed.RESUMABLE_FAMILIES), F.col("work_units"))
        .otherwise(1)
    )
    return jobs(spark, sf_dir).select("job_id", F.coalesce(family, F.lit("")).alias("family"), units.cast("bigint").alias("units"))


@query(
    "agg_12_provider_matrix",
    _with_jobs(
        f"""SELECT vendor, vendor IN ('gemini', 'openai') AS configured, count(*) AS jobs FROM (SELECT {sql_vendor('model_name')} AS vendor FROM jobs) GROUP BY 1"""
    ),
)
def provider_matrix(spark, sf_dir):
    counts = jobs(spark, sf_dir).groupBy(models.model_vendor(F.col("model_name")).alias("vendor")).agg(F.count("*").alias("jobs"))
    return counts.withColumn("configured", F.col("vendor").isin("gemini", "openai"))


@query("win_14_queue_ordinal", _with_jobs("SELECT job_id, path, row_number() OVER (ORDER BY path, job_id) - 1 AS ordinal FROM jobs"))
def queue_ordinal(spark, sf_dir):
    return ops.global_ordinal(jobs(spark, sf_dir).select("job_id", "path"), [F.col("path").asc()], "job_id")


_SEQ = f"TRY_CAST(nullif(regexp_extract({SQL_BASE}, '(?i)\\bpage[\\s._-]*0*([0-9]{{1,6}})(?:[^0-9]|$)', 1), '') AS BIGINT)"


@query(
    "srt_01_merge_order",
    _with_jobs(
        f"""SELECT job_id, row_number() OVER (ORDER BY {_SEQ} IS NULL, {_SEQ}, lower({SQL_BASE}), job_id) - 1 AS ordinal FROM jobs"""
    ),
)
def merge_order(spark, sf_dir):
    frame = jobs(spark, sf_dir).select("job_id", "path")
    return ops.global_ordinal(frame, ops.merge_order_keys(), "job_id").select("job_id", "ordinal")


@query(
    "set_02_extension_sets",
    _with_jobs(
        f"""SELECT {SQL_EXT} AS ext, count(*) AS jobs FROM jobs WHERE {SQL_EXT} IN ({sql_list(e for es in fixed.EXTENSION_FAMILIES.values() for e in es)})
        AND {SQL_EXT} NOT IN ('.xls', '.ppt') GROUP BY 1"""
    ),
)
def extension_sets(spark, sf_dir):
    every = F.array(*[F.lit(e) for es in fixed.EXTENSION_FAMILIES.values() for e in es])
    allowed = F.array_except(every, F.array(F.lit(".xls"), F.lit(".ppt")))
    ext = text.file_extension(F.col("path"))
    return jobs(spark, sf_dir).select(ext.alias("ext")).filter(F.array_contains(allowed, F.col("ext"))).groupBy("ext").agg(F.count("*").alias("jobs"))


@query(
    "set_03_new_paths",
    _with_jobs("SELECT path FROM jobs WHERE job_id % 2 = 0 EXCEPT SELECT path FROM jobs WHERE job_id % 2 = 1"),
)
def new_paths(spark, sf_dir):
    frame = jobs(spark, sf_dir)
    return frame.filter(F.col("job_id") % 2 == 0).select("path").subtract(frame.filter(F.col("job_id") % 2 == 1).select("path"))


@query(
    "set_05_expanded_scopes",
    _with_jobs(
        f""", s AS (SELECT job_id, {SQL_EXT} AS ext, merge_files, page_scope, {sql_scope('page_scope')} AS scope FROM jobs)
        SELECT job_id, generate_subscripts(parts, 1)::BIGINT - 1 AS part_no, unnest(parts) AS page_scope FROM (SELECT job_id, CASE
          WHEN ext = '.pdf' AND NOT merge_files AND contains(scope, ',') THEN string_split(scope, ',') ELSE [page_scope] END AS parts FROM s)"""
    ),
)
def expanded_scopes(spark, sf_dir):
    frame = jobs(spark, sf_dir).select("job_id", "path", "merge_files", "page_scope")
    return ops.expand_scopes(frame).select("job_id", F.col("part_no").cast("bigint"), "page_scope")


_DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"
_STEM = f"regexp_replace({SQL_BASE}, '\\.[^.]*$', '')"


@query(
    "snk_10_target_dirs",
    _with_jobs(
        f"""SELECT job_id, CASE WHEN job_id % 2 = 0 THEN {_DIR}
          WHEN job_id % 7 <> 0 AND source_root IS NOT NULL AND starts_with({_DIR}, source_root || '/') THEN '/out/' || substring({_DIR}, length(source_root) + 2)
          ELSE '/out' END AS folder FROM jobs"""
    ),
)
def target_dirs(spark, sf_dir):
    folder = ops.target_dir(F.col("path"), F.col("source_root"), F.lit("/out"), F.col("job_id") % 2, F.col("job_id") % 7 != 0)
    return jobs(spark, sf_dir).select("job_id", folder.alias("folder"))


@query(
    "snk_11_output_names",
    _with_jobs(
        f""", s AS (SELECT job_id, {_STEM} AS stem, {SQL_EXT} AS ext, {sql_scope('page_scope')} AS scope FROM jobs)
        SELECT job_id, CASE WHEN ext = '.pdf' AND scope NOT IN ('', 'all') THEN stem || '_pages_' || trim(regexp_replace(scope, '[^0-9A-Za-z_-]+', '_', 'g'), '_')
          ELSE stem END AS name FROM s"""
    ),
)
def output_names(spark, sf_dir):
    stem = F.regexp_replace(text.base_name(F.col("path")), r"\.[^.]*$", "")
    return jobs(spark, sf_dir).select("job_id", ops.output_base(stem, text.file_extension(F.col("path")), F.col("page_scope")).alias("name"))


@query(
    "snk_09_collisions",
    _with_jobs(
        f"""SELECT job_id, {_DIR} || '/' || {_STEM} || CASE WHEN output_exists AND collision_mode = 'auto' THEN '_1700000000' ELSE '' END || '.' || fmt AS output_path,
        output_exists AND collision_mode = 'skip' AS should_skip FROM jobs"""
    ),
)
def collisions(spark, sf_dir):
    stem = F.regexp_replace(text.base_name(F.col("path")), r"\.[^.]*$", "")
    plan = ops.collision_plan(stem, F.col("fmt"), ops.parent_dir(F.col("path")), F.col("output_exists"), F.col("collision_mode"), F.lit(1700000000))
    return jobs(spark, sf_dir).select("job_id", plan.alias("plan")).select("job_id", "plan.*")


@query(
    "snk_21_fallback_names",
    _with_jobs(
        f"""SELECT job_id, CASE WHEN NOT output_exists THEN root || '_finalized_20240101_000000' || ext WHEN completed_units <= 1
          THEN root || '_finalized_20240101_000000_2' || ext ELSE root || '_finalized_20240101_000000_' || (completed_units + 1) || ext END AS path
        FROM (SELECT job_id, output_exists, completed_units, {_DIR} || '/' || {_STEM} AS root, {SQL_EXT} AS ext FROM jobs)"""
    ),
)
def fallback_names(spark, sf_dir):
    """Next free numbered name, given how many numbered copies exist already."""
    root = F.concat(ops.parent_dir(F.col("path")), F.lit("/"), F.regexp_replace(text.base_name(F.col("path")), r"\.[^.]*$", ""), F.lit("_finalized_20240101_000000"))
    ext = text.file_extension(F.col("path"))
    number = F.greatest(F.col("completed_units") + 1, F.lit(2)).cast("string")
    return jobs(spark, sf_dir).select(
        "job_id", F.when(~F.col("output_exists"), F.concat(root, ext)).otherwise(F.concat(root, F.lit("_"), number, ext)).alias("path")
    )


@query(
    "flt_26_preset_overlay",
    _with_jobs(
        f""", {PRESET_SQL} SELECT job_id, CASE WHEN job_id % 2 = 0 AND trim(coalesce(j.model_name, '')) <> '' THEN j.model_name ELSE p.model_name END AS model_name,
        p.modernize_punctuation, p.merge_files, profile = 'academic' AS academic_mode,
        CASE {sql_scope('page_scope')} WHEN '' THEN 'All Pages' WHEN '1' THEN 'Page 1' WHEN '1-5' THEN 'Pages 1-5' ELSE {sql_scope('page_scope')} END AS scope_label
        FROM jobs j JOIN preset p ON p.key = profile"""
    ),
)
def preset_overlay(spark, sf_dir):
    """A preset laid over the configuration, keeping the chosen model where one was chosen."""
    chosen = F.trim(F.coalesce("model_name", F.lit("")))
    scope = text.normalize_scope(F.col("page_scope"))
    label = F.when(scope == "", "All Pages").when(scope == "1", "Page 1").when(scope == "1-5", "Pages 1-5").otherwise(scope)
    framed = jobs(spark, sf_dir).withColumn("preset", models.preset(F.col("profile")))
    keeps = (F.col("job_id") % 2 == 0) & (chosen != "")
    return framed.select(
        "job_id",
        F.when(keeps, F.col("model_name")).otherwise(F.col("preset.model_name")).alias("model_name"),
        "preset.modernize_punctuation",
        "preset.merge_files",
        (F.col("profile") == "academic").alias("academic_mode"),
        label.alias("scope_label"),
    )


@query(
    "snk_14_redacted_log",
    _with_jobs(
        f"""SELECT job_id, {sql_pick(LOG_MESSAGES, 'job_id')} || ' key=[redacted]' AS line FROM jobs"""
    ),
)
def redacted_log(spark, sf_dir):
    line = F.concat(pick(LOG_MESSAGES, F.col("job_id")), F.lit(" key="), F.md5(F.col("path")))
    return jobs(spark, sf_dir).select("job_id", text.redact_secrets(line).alias("line"))
