"""Streaming queries: each runs over everything available and gives its published result."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirekit.functions import fixed, html, text
from quirekit.operators.running import gaps
from quirekit.plans.registry import query, sql_replace, sql_rewrite, sql_squash, table
from quirekit.streaming import chunks, requests, runs


@query(
    "stm_01_assembled_chunks",
    f"SELECT page_id AS doc_id, {sql_rewrite('html', html.LEAKED_WRAPPERS)} AS result FROM pages",
)
def assembled_chunks(spark, sf_dir):
    stream = chunks.to_chunks(runs.read_stream(spark, sf_dir, "pages"), "page_id", F.col("html"), 512)
    whole = chunks.assemble(stream)
    cleaned = whole.select("doc_id", html.rewrite(F.col("text"), html.LEAKED_WRAPPERS).alias("result"))
    return runs.run_available(cleaned, runs.work_folder(spark))


@query("stm_02_stateless_clean", f"SELECT page_id, {sql_squash(sql_rewrite('html', text.VISIBLE_HTML_RULES))} AS result FROM pages")
def stateless_clean(spark, sf_dir):
    pages = runs.read_stream(spark, sf_dir, "pages")
    return runs.run_available(pages.select("page_id", text.visible_text(F.col("html")).alias("result")), runs.work_folder(spark))


@query("stm_03_suppressed_images")
def suppressed_images(spark, sf_dir):
    docs = runs.read_stream(spark, sf_dir, "documents")
    image = F.concat(F.lit(' <img src="data:image/png;base64,'), F.base64(F.encode("text", "UTF-8")), F.lit('" alt="x"> after'))
    stream = chunks.to_chunks(docs, "doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, image).otherwise("")), 4096)
    return runs.run_available(chunks.suppress_images(stream), runs.work_folder(spark))


@query(
    "stm_03_suppressed_texts",
    """SELECT doc_id, md5(text || CASE WHEN doc_id % 3 = 0 THEN ' <img src="about:blank" alt="x"> after' ELSE '' END) AS text_md5 FROM documents""",
)
def suppressed_texts(spark, sf_dir):
    """The suppressed chunks put together again: payloads cut by many chunk borders are gone, all else is there."""
    parts = suppressed_images(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("parts"))
    return parts.select("doc_id", F.md5(F.array_join(F.col("parts.chunk"), "")).alias("text_md5"))


_LINE = f"trim({sql_squash('line')}, '*# ')"


@query(
    "stm_05_line_buffered_html",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    c AS (SELECT doc_id, line_no, {_LINE} AS line FROM l)
    SELECT doc_id, line_no, CASE WHEN len(string_split(line, ' ')) <= 8 AND regexp_matches(line, '\\p{{L}}') AND (NOT regexp_matches(line, '[\\p{{Ll}}]') OR ends_with(line, ':'))
      THEN '<h3>' || rtrim({sql_replace('line', fixed.HTML_ESCAPES)}, ':') || '</h3>' ELSE '<p>' || {sql_replace('line', fixed.HTML_ESCAPES)} || '</p>' END AS html FROM c WHERE line <> ''""",
)
def line_buffered_html(spark, sf_dir):
    stream = chunks.to_chunks(runs.read_stream(spark, sf_dir, "documents"), "doc_id", F.col("text"), 1024)
    return runs.run_available(chunks.lines_as_html(stream), runs.work_folder(spark))


@query("stm_06_stream_cache_keys", "SELECT DISTINCT sha256(text) AS cache_key FROM documents WHERE length(text) >= 1")
def stream_cache_keys(spark, sf_dir):
    """Requests that have to be made: the first use of every key. Only digests are kept as state."""
    docs = runs.read_stream(spark, sf_dir, "documents")
    stored = docs.filter(F.length("text") >= 1)
    keys = stored.select(text.sha256_key(F.col("text")).alias("cache_key")).dropDuplicates(["cache_key"])
    return runs.run_available(keys, runs.work_folder(spark))


@query("stm_16_progress_counts", "SELECT event_type, count(*) AS events, max(event_id) AS latest FROM events GROUP BY event_type")
def progress_counts(spark, sf_dir):
    events = runs.read_stream(spark, sf_dir, "events")
    totals = events.groupBy("event_type").agg(F.count("*").alias("events"), F.max("event_id").alias("latest"))
    return runs.run_totals(totals, runs.work_folder(spark))


@query(
    "stm_09_stalls",
    """WITH g AS (SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events)
    SELECT user_id, count(*) AS stalls, max(gap / 1000000.0)::DOUBLE AS longest_sec FROM g WHERE gap >= 120000000 GROUP BY user_id""",
)
def stalls(spark, sf_dir):
    """Waits of 120 seconds or more between a user's events."""
    waited = gaps(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "gap")
    return waited.filter("gap >= 120").groupBy("user_id").agg(F.count("*").alias("stalls"), F.max("gap").alias("longest_sec"))


@query(
    "stm_09_given_up_requests",
    """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM e),
    s AS (SELECT *, count(*) FILTER (gap IS NULL OR gap >= 120000) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM g),
    r AS (SELECT user_id, n, min(t) AS started, max(t) AS last, count(*) AS chunks FROM s GROUP BY user_id, n)
    SELECT user_id, started::BIGINT AS started_ms, (last + 120000)::BIGINT AS given_up_ms, chunks FROM r WHERE last + 120000 <= (SELECT max(t) FROM e)""",
)
def given_up_requests(spark, sf_dir):
    """Each user's runs of events that ended with 120 seconds of silence, by timers in event time."""
    events = runs.read_stream(spark, sf_dir, "events").select("user_id", "ts")
    ended = runs.run_available(requests.given_up(events, "user_id", "ts", wall_ms=None), runs.work_folder(spark), settle=True)
    return ended.select(
        F.col("key").cast("bigint").alias("user_id"), F.unix_millis("started").alias("started_ms"), F.unix_millis("at").alias("given_up_ms"), "chunks")


@query(
    "stm_06_lru_cache",
    """WITH k AS (SELECT doc_id, sha256(text) AS key, substring(sha256(text), 1, 1) AS shard FROM documents WHERE length(text) BETWEEN 1 AND 2000),
    p AS (SELECT *, lag(doc_id) OVER (PARTITION BY key ORDER BY doc_id) AS before FROM k),
    h AS (SELECT p.doc_id, p.before IS NOT NULL AND (SELECT count(DISTINCT o.key) FROM k AS o WHERE o.shard = p.shard AND o.doc_id > p.before AND o.doc_id < p.doc_id) < 20 AS hit FROM p)
    SELECT d.doc_id, coalesce(h.hit, false) AS hit FROM documents AS d LEFT JOIN h USING (doc_id)""",
)
def lru_cache(spark, sf_dir):
    """Whether a document's answer is still in a cache of 20 entries a shard; answers over 2,000 characters are not kept."""
    docs = runs.read_stream(spark, sf_dir, "documents")
    asked = docs.select("doc_id", text.sha256_key(F.col("text")).alias("key"), F.length("text").alias("size"))
    answered = requests.cached(asked, F.col("doc_id"), F.col("key"), F.col("size"), entries=20, longest=2000, shard=F.substring("key", 1, 1))
    return runs.run_available(answered, runs.work_folder(spark)).select(F.col("place").alias("doc_id"), "hit")
