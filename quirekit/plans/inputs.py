"""Inputs the queries share, derived from the given tables the same way in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.functions import fixed
from quirekit.functions.lines import slices_of
from quirekit.functions.models import literal_array
from quirekit.plans.registry import quote, table, text_table

EXTENSIONS = [".pdf", ".docx", ".txt", ".pdf", ".csv", ".xlsx", ".html", ".epub", ".pptx", ".png", ".pdf", ".xyz"]
STATUSES = ["Queued", "Processing", "Paused", "Done", "Error", "Skipped", "Unsupported", "Missing", "Stopped", None, "Queued"]
OVERRIDES = ["gpt-4o", "", "", "claude-3-5-sonnet-20241022", "", None]
SCOPES = ["", "1,3,5-7", "all", " 2 - 4 ; 6", "3-1", "1 2 3", "2,x"]
FORMATS = ["html", "txt", "docx", "html"]
COLLISIONS = ["skip", "auto", "overwrite"]
PAGE_CHARS = 1500


def pick(values: list, key: Column) -> Column:
    return literal_array(values)[(key % len(values)).cast("int")]


def sql_pick(values: list, key: str) -> str:
    items = ", ".join("NULL" if v is None else quote(v) for v in values)
    return f"([{items}])[({key} % {len(values)}) + 1]"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One processing job per document; every thirteenth shares one much-repeated path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    key = F.col("doc_id")
    stem = F.when(key % 2 == 0, F.concat(F.lit("page_"), (key % 50).cast("string"))).otherwise(
        F.concat(F.lit("letter_"), key.cast("string"))
    )
    path = F.when(key % 13 == 5, "/in/inbox/page_7.pdf").otherwise(
        F.concat(F.lit("/in/"), F.col("source"), F.lit("/b"), F.floor(key / 50).cast("string"), F.lit("/"), stem, pick(EXTENSIONS, key))
    )
    return docs.select(
        key.alias("job_id"),
        path.alias("path"),
        pick(STATUSES, key).alias("status"),
        F.greatest(F.ceil(F.col("n_chars") / PAGE_CHARS), F.lit(1)).cast("bigint").alias("work_units"),
        F.greatest(F.ceil(F.col("n_chars") / PAGE_CHARS), F.lit(1)).cast("bigint").alias("total_pages"),
        pick(fixed.PROFILES, key).alias("profile"),
        pick(OVERRIDES, key).alias("model_override"),
        pick([*fixed.MODEL_LABELS, "claude-3-5-sonnet-20241022", None], key).alias("model_name"),
        pick(SCOPES, key).alias("page_scope"),
        pick(FORMATS, key).alias("fmt"),
        (key % 10 == 3).alias("merge_files"),
        (key % 40 * 2.75).alias("size_mb"),
        (key % 4 == 3).alias("review_recommended"),
        F.when(key % 3 != 0, F.concat(F.lit("/in/"), F.col("source"))).alias("source_root"),
        pick(COLLISIONS, key).alias("collision_mode"),
        (key % 5 == 0).alias("output_exists"),
        (key % 7).cast("bigint").alias("completed_units"),
    )


JOBS_SQL = f"""(SELECT doc_id AS job_id,
  CASE WHEN doc_id % 13 = 5 THEN '/in/inbox/page_7.pdf' ELSE '/in/' || source || '/b' || (doc_id // 50) || '/' ||
    CASE WHEN doc_id % 2 = 0 THEN 'page_' || (doc_id % 50) ELSE 'letter_' || doc_id END || {sql_pick(EXTENSIONS, 'doc_id')} END AS path,
  {sql_pick(STATUSES, 'doc_id')} AS status,
  greatest(CAST(ceil(n_chars / {PAGE_CHARS}.0) AS BIGINT), 1) AS work_units,
  greatest(CAST(ceil(n_chars / {PAGE_CHARS}.0) AS BIGINT), 1) AS total_pages,
  {sql_pick(fixed.PROFILES, 'doc_id')} AS profile,
  {sql_pick(OVERRIDES, 'doc_id')} AS model_override,
  {sql_pick([*fixed.MODEL_LABELS, 'claude-3-5-sonnet-20241022', None], 'doc_id')} AS model_name,
  {sql_pick(SCOPES, 'doc_id')} AS page_scope,
  {sql_pick(FORMATS, 'doc_id')} AS fmt,
  doc_id % 10 = 3 AS merge_files,
  CAST((doc_id % 40) * 2.75 AS DOUBLE) AS size_mb,
  doc_id % 4 = 3 AS review_recommended,
  CASE WHEN doc_id % 3 <> 0 THEN '/in/' || source END AS source_root,
  {sql_pick(COLLISIONS, 'doc_id')} AS collision_mode,
  doc_id % 5 = 0 AS output_exists,
  doc_id % 7 AS completed_units
  FROM documents)"""

SQL_STATUS = "coalesce(status, 'Queued')"
SQL_TERMINAL = f"coalesce(status, 'Queued') IN ({', '.join(map(quote, fixed.TERMINAL_STATUSES))})"
SQL_BASE = "regexp_extract(path, '[^/]*$', 0)"
SQL_EXT = "lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1))"


def sql_model(expr: str) -> str:
    old, new = next(iter(fixed.MODEL_ALIASES.items()))
    return (
        f"CASE WHEN trim(coalesce({expr}, '')) = '' THEN {quote(fixed.FLASH_MODEL)}"
        f" WHEN trim({expr}) = {quote(old)} THEN {quote(new)} ELSE trim({expr}) END"
    )


def sql_vendor(expr: str) -> str:
    name = f"lower({sql_model(expr)})"
    return f"CASE WHEN contains({name}, 'claude') THEN 'claude' WHEN contains({name}, 'gpt') THEN 'openai' ELSE 'gemini' END"


def sql_scope(expr: str) -> str:
    """Canonical page scope. Three rounds of the digit-gap rule cover runs of numbers."""
    text = f"trim(coalesce({expr}, ''))"
    canon = f"regexp_replace({text}, '[\\r\\n;]+', ',', 'g')"
    for _ in range(3):
        canon = f"regexp_replace({canon}, '([0-9])\\s+([0-9])', '\\1,\\2', 'g')"
    for pattern, to in (("\\s*-\\s*", "-"), ("\\s*,\\s*", ","), (",+", ",")):
        canon = f"regexp_replace({canon}, '{pattern}', '{to}', 'g')"
    return f"CASE WHEN lower({text}) IN ('all', '*') THEN {text} ELSE trim({canon}, ', ') END"


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into pages of fixed length, with the file's profile and size."""
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    last = F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / PAGE_CHARS).cast("int")
    pages = slices_of(F.col("text"), PAGE_CHARS)
    return docs.select(
        "doc_id",
        pick(fixed.PROFILES, F.col("doc_id")).alias("profile"),
        (F.col("doc_id") % 7 * 0.25).alias("size_mb"),
        (last + 1).cast("bigint").alias("total_pages"),
        F.posexplode(pages).alias("page_index", "text"),
    ).select("doc_id", "profile", "size_mb", "total_pages", (F.col("page_index") + 1).cast("bigint").alias("page_no"), "text")


PAGE_TEXT_SQL = f"""(SELECT doc_id, {sql_pick(fixed.PROFILES, 'doc_id')} AS profile,
  CAST((doc_id % 7) * 0.25 AS DOUBLE) AS size_mb, n AS total_pages, p AS page_no,
  substring(text, ((p - 1) * {PAGE_CHARS} + 1)::BIGINT, {PAGE_CHARS}) AS text
  FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM
    (SELECT *, (greatest(length(text), 1) - 1) // {PAGE_CHARS} + 1 AS n FROM documents)))"""
