"""Job-queue operators: filters, joins, summaries and orderings over a jobs frame.

A jobs frame has one row per file to process. Its useful columns are
``job_id, path, status, work_units, settings...``; see ``quirekit.schemas``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirekit.functions import fixed
from quirekit.functions.lines import scope_error
from quirekit.functions.models import literal_map, model_vendor
from quirekit.functions.text import base_name, file_extension, normalize_scope, page_sequence
from quirekit.session import ensure_checkpoint_dir


def status_of(col: str | Column = "status") -> Column:
    """A missing status counts as queued."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("Queued"))


def is_terminal(col: str | Column = "status") -> Column:
    return status_of(col).isin(fixed.TERMINAL_STATUSES)


# --- Filters and state changes ---------------------------------------------------------


def pending(jobs: DataFrame) -> DataFrame:
    """FLT-01."""
    return jobs.filter(status_of() == "Queued")


def has_incomplete(jobs: DataFrame) -> DataFrame:
    """FLT-02: one row telling whether any job still has to run."""
    return jobs.agg(F.coalesce(F.bool_or(~is_terminal()), F.lit(False)).alias("has_incomplete"))


def setting_targets(jobs: DataFrame, selected: Column) -> DataFrame:
    """FLT-03: rows a setting change applies to.

    Assignable selected rows if there are any, else the selection, else every
    assignable row. The two facts are one scalar subquery.
    """
    assignable = status_of().isin("Queued", "Paused")
    facts = jobs.select(
        F.struct(
            F.coalesce(F.bool_or(selected), F.lit(False)).alias("selected"),
            F.coalesce(F.bool_or(selected & assignable), F.lit(False)).alias("assignable"),
        )
    ).scalar()
    marked = jobs.withColumn("_facts", facts)
    wanted = (
        F.when(F.col("_facts.assignable"), selected & assignable)
        .when(F.col("_facts.selected"), selected)
        .otherwise(assignable)
    )
    return marked.filter(wanted).drop("_facts")


def stop_status(status: Column) -> Column:
    """FLT-05."""
    return F.when(status_of(status).isin("Queued", "Paused"), "Stopped").otherwise(status_of(status))


def pause_status(status: Column) -> Column:
    return F.when(status_of(status).isin("Queued", "Processing"), "Paused").otherwise(status_of(status))


def resume_status(status: Column) -> Column:
    return F.when(status == "Paused", "Queued").otherwise(status)


def restore_status(status: Column) -> Column:
    """FLT-06: work interrupted by a restart goes back to the queue."""
    return F.when(status_of(status).isin("Processing", "Paused"), "Queued").otherwise(status_of(status))


def start_status(status: Column, resume: bool) -> Column:
    """FLT-07: statuses when a run starts, resumed or fresh."""
    if resume:
        return F.when(status.isin("Processing", "Paused"), "Queued").otherwise(status)
    return F.when(status == "Paused", status).otherwise("Queued")


def first_missing_credential(jobs: DataFrame, available: list[str]) -> DataFrame:
    """FLT-08: the earliest pending job whose vendor has no key. Pre-aggregated, no sort."""
    vendor = model_vendor(F.col("model_name"))
    lacking = pending(jobs).withColumn("vendor", vendor).filter(~F.col("vendor").isin(available))
    first = lacking.agg(F.min_by(F.struct("job_id", "vendor", "model_name"), "job_id").alias("row"))
    return first.filter(F.col("row").isNotNull()).select("row.*")


def destination_problem(mode: Column, folder: Column, exists: Column) -> Column:
    """FLT-09."""
    return F.when(
        (mode == 1) & (F.trim(F.coalesce(folder, F.lit(""))) == ""),
        "Please choose a custom output folder or select 'Same folder as source file'.",
    ).when((mode == 1) & ~exists, "Custom output folder does not exist.")


def future_timestamp(value: Column, now: Column) -> Column:
    """FLT-10: a schedule counts only while it lies ahead."""
    parsed = value.try_cast("double")
    return F.when(parsed > now, parsed)


def logs_progress(done: Column, total: Column) -> Column:
    """FLT-11."""
    return (total <= 20) | (done == 1) | (done == total) | (done <= 20) | (done % 2 == 0)


def echoes_log(message: Column, engine_event: Column) -> Column:
    """FLT-12."""
    noisy = reduce(lambda a, b: a | b, [message.startswith(p) for p in fixed.NOISY_LOG_PREFIXES])
    return ~engine_event | ~noisy


def humanize_log(message: Column, labels: dict[str, str]) -> Column:
    """STR-32: a log line's bracketed label in a reader's words; lines with an unknown label or none stay."""
    wording = literal_map(labels)[F.regexp_extract(message, r"\A\[([^\]]+)\]", 1)]
    rest = F.ltrim(F.regexp_replace(message, r"\A\[[^\]]+\]", ""))
    return F.coalesce(F.concat(wording, rest), message)


def in_protected_dir(path: Column, root: str, names: list[str] | None = None) -> Column:
    """FLT-13."""
    folders = [f"{root}/{name}".lower() for name in names or fixed.PROTECTED_DIR_NAMES]
    lowered = F.lower(path)
    return reduce(lambda a, b: a | b, [(lowered == f) | lowered.startswith(f + "/") for f in folders])


def needs_audit(ext: Column, enabled: Column, profile: Column, path: Column, low_memory: Column, size_mb: Column) -> Column:
    """FLT-16."""
    name = F.lower(base_name(path))
    archive = (F.lower(profile) == "newspaper") & (name.startswith("nla.news-") | name.startswith("nla.news_"))
    return (ext == ".pdf") & enabled & ~archive & ~(low_memory & (size_mb >= fixed.LOW_MEMORY_AUDIT_MB))


def first_scope_error(jobs: DataFrame) -> DataFrame:
    """FLT-24: the earliest pending PDF whose page scope cannot be read."""
    scope = normalize_scope(F.col("page_scope"))
    bad = (
        pending(jobs)
        .filter(file_extension(F.col("path")) == ".pdf")
        .withColumn("details", scope_error(scope, F.col("total_pages")))
        .filter("details IS NOT NULL")
    )
    first = bad.agg(F.min_by(F.struct("job_id", "path", "details"), "job_id").alias("row"))
    return first.filter(F.col("row").isNotNull()).select(
        "row.job_id", base_name(F.col("row.path")).alias("filename"), "row.details"
    )


def job_outcome(jobs: DataFrame) -> DataFrame:
    """FLT-23: which of the competing outcomes decides a job, in precedence order.

    Expects ``source_exists, ext_family, output_exists, collision_mode, completed_units,
    total_units, resume`` next to the job columns.
    """
    finished = (F.col("total_units") > 0) & (F.col("completed_units") >= F.col("total_units"))
    partial = (F.col("completed_units") > 0) & ~finished
    outcome = (
        F.when(~F.col("source_exists"), "Missing")
        .when(F.col("ext_family").isNull(), "Unsupported")
        .when(F.col("output_exists") & (F.col("collision_mode") == "skip"), "Skipped")
        .when(finished & F.col("output_exists"), "Done")
        .when(F.col("resume") | partial, "Resume")
        .otherwise("Run")
    )
    return jobs.withColumn("outcome", outcome)


# --- Joins ------------------------------------------------------------------------------


def add_new_paths(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """JOI-01: incoming rows whose path is not queued yet, first mention of each path.

    The first mention is an aggregate (combined before the shuffle), not a window,
    so a path repeated millions of times costs one row per task.
    """
    firsts = incoming.groupBy("path").agg(F.min("job_id").alias("job_id"))
    return firsts.join(queue.select("path").distinct(), "path", "left_anti")


def rows_for_paths(queue: DataFrame, paths: DataFrame) -> DataFrame:
    """JOI-02."""
    return queue.join(paths.select("path").distinct(), "path", "left_semi")


def resume_remaining(queue: DataFrame, completed: DataFrame) -> DataFrame:
    """JOI-03: drop jobs whose path a previous run finished."""
    return queue.join(completed.select("path").distinct(), "path", "left_anti")


def fill_settings(jobs: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """JOI-04: missing settings take the run's defaults (literals, so no join)."""
    return jobs.select(
        "*", *[F.coalesce(F.col(f"settings.{key}"), F.lit(value)).alias(key) for key, value in defaults.items()]
    )


def extension_family(ext: Column) -> Column:
    """SRC-02 / JOI-12: family of an extension, null when it is not supported."""
    pairs = {e: family for family, extensions in fixed.EXTENSION_FAMILIES.items() for e in extensions}
    return literal_map(pairs)[ext]


# --- Aggregates ---------------------------------------------------------------------------


def status_histogram(jobs: DataFrame) -> DataFrame:
    """AGG-01: rows per status in display order, unknown ones after by name."""
    order = F.array_position(F.array(*map(F.lit, fixed.STATUS_DISPLAY_ORDER)), F.col("status"))
    counts = jobs.groupBy(status_of().alias("status")).agg(F.count("*").alias("jobs"))
    return counts.withColumn("display_order", F.when(order == 0, 1000).otherwise(order).cast("bigint")).orderBy(
        "display_order", "status"
    )


def unit_totals(active: Column, done_in_active: Column) -> list[Column]:
    """AGG-03: total and finished work units; the job in flight counts what it has done."""
    units = F.greatest(F.coalesce(F.col("work_units"), F.lit(1)), F.lit(1))
    done = (
        F.when(is_terminal(), units)
        .when(active, F.greatest(F.least(units, F.coalesce(done_in_active, F.lit(0))), F.lit(0)))
        .otherwise(0)
    )
    return [F.sum(units).alias("total_units"), F.sum(done).alias("completed_units")]


def progress_summary(jobs: DataFrame, active: Column, done_in_active: Column) -> DataFrame:
    """AGG-02: one pass over the queue."""
    counts = [
        F.count_if(F.col("status") == name).alias(name.lower())
        for name in ("Done", "Error", "Paused", "Stopped", "Queued", "Processing")
    ]
    summary = jobs.agg(
        F.count("*").alias("files"),
        *counts,
        F.count_if((F.col("status") == "Done") & F.col("review_recommended")).alias("review"),
        F.count_if(F.col("status").isin(fixed.TERMINAL_STATUSES)).alias("terminal"),
        *unit_totals(active, done_in_active),
    )
    percent = F.floor(F.try_divide(F.col("completed_units") * 100, F.col("total_units"))).cast("bigint")
    return summary.withColumn("percent", F.coalesce(percent, F.lit(0).cast("bigint")))


def saved_items(jobs: DataFrame) -> DataFrame:
    """AGG-04: jobs still worth saving, at least one."""
    return jobs.agg(F.greatest(F.count_if(~is_terminal()), F.lit(1)).alias("items"))


def merge_plan(jobs: DataFrame, merge: bool = True, low_memory: bool = False) -> DataFrame:
    """AGG-05: whether the queued jobs can be merged, and into which format."""
    queued = pending(jobs).agg(F.countDistinct("fmt").alias("formats"), F.min("fmt").alias("first_fmt"))
    allowed = F.lit(merge) & (F.col("formats") <= 1) & ~F.lit(low_memory)
    fmt = F.when(allowed, F.coalesce(F.col("first_fmt"), F.lit("html"))).otherwise("html")
    return queued.select(
        F.col("formats"), allowed.alias("merge_mode"), fmt.alias("merge_fmt"), fmt.isin(fixed.STREAMABLE_FORMATS).alias("streamable")
    )


def resume_summary(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """AGG-10: the first recoverable jobs with queue totals; a top-k, never a full sort."""
    first = (
        jobs.filter(~is_terminal())
        .select("job_id", F.concat(base_name(F.col("path")), F.lit(" ("), status_of(), F.lit(")")).alias("label"))
        .orderBy("job_id")
        .limit(limit)
    )
    totals = jobs.select(
        F.struct(
            F.count("*").alias("saved"),
            F.count_if(is_terminal()).alias("terminal"),
            F.count_if(~is_terminal()).alias("recoverable"),
        )
    ).scalar()
    return first.withColumn("_totals", totals).select("job_id", "label", "_totals.*")


# --- Orderings ----------------------------------------------------------------------------


def global_ordinal(frame: DataFrame, keys: list[Column], unique: str, name: str = "ordinal") -> DataFrame:
    """WIN-14: position of every row in a total order, without a one-task window.

    Rows are range-partitioned on the keys plus a unique column (so equal keys can
    be split), sorted inside partitions and checkpointed; partition sizes are then
    summed to offsets. Only one row per partition is ever brought together.
    """
    ensure_checkpoint_dir(frame.sparkSession)
    order = [*keys, F.col(unique)]
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # one row per partition: bounded by the partition count, not by the data
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_offset") + row).drop("_at", "_part", "_offset")


def merge_order_keys() -> list[Column]:
    """SRT-01: numbered pages first by number, then the rest by lower-case name."""
    sequence = page_sequence(F.col("path"))
    return [sequence.asc_nulls_last(), F.lower(base_name(F.col("path"))).asc()]


def expand_scopes(jobs: DataFrame) -> DataFrame:
    """SET-05: a PDF with several page ranges becomes one job per range, unless merging."""
    scope = normalize_scope(F.col("page_scope"))
    splits = (file_extension(F.col("path")) == ".pdf") & ~F.col("merge_files") & F.contains(scope, F.lit(","))
    parts = F.when(splits, F.filter(F.split(scope, ","), lambda p: F.trim(p) != "")).otherwise(F.array(F.col("page_scope")))
    return jobs.select(*[c for c in jobs.columns if c != "page_scope"], F.posexplode(parts).alias("part_no", "page_scope"))


# --- Output planning -------------------------------------------------------------------------


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def target_dir(path: Column, source_root: Column, custom: Column, mode: Column, keep_structure: Column) -> Column:
    """SNK-10: next to the source, or a custom folder keeping the tree below the source root."""
    folder = parent_dir(path)
    inside = F.substring(folder, F.length(source_root) + 2, F.length(folder))
    below = keep_structure & source_root.isNotNull() & folder.startswith(F.concat(source_root, F.lit("/")))
    return F.when(mode == 0, folder).when(F.coalesce(below, F.lit(False)), F.concat(custom, F.lit("/"), inside)).otherwise(custom)


def output_base(stem: Column, ext: Column, scope: Column) -> Column:
    """SNK-11: page scopes show in the output name."""
    plain = normalize_scope(scope)
    safe = F.btrim(F.regexp_replace(plain, r"[^0-9A-Za-z_-]+", "_"), F.lit("_"))
    scoped = (ext == ".pdf") & (plain != "") & ~F.lower(plain).isin("all", "*") & (safe != "")
    return F.when(scoped, F.concat(stem, F.lit("_pages_"), safe)).otherwise(stem)


def collision_plan(base: Column, fmt: Column, folder: Column, exists: Column, mode: Column, stamp: Column) -> Column:
    """SNK-09: ``struct(output_path, should_skip)``."""
    plain = F.concat(folder, F.lit("/"), base, F.lit("."), fmt)
    stamped = F.concat(folder, F.lit("/"), base, F.lit("_"), stamp.cast("string"), F.lit("."), fmt)
    return F.struct(
        F.when(exists & (mode == "auto"), stamped).otherwise(plain).alias("output_path"),
        (exists & (mode == "skip")).alias("should_skip"),
    )
