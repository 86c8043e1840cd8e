"""Page and document assessments built on page text (AGG-06, AGG-08, CLS-09, CLS-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.functions import fixed
from quirekit.functions.classify import page_metrics
from quirekit.functions.lines import content_lines
from quirekit.functions.rewrite import let, squash
from quirekit.functions.routing import sample_positions
from quirekit.functions.text import audit_key


def with_metrics(pages: DataFrame) -> DataFrame:
    return pages.withColumn("metrics", page_metrics(F.col("text")))


def sampled(pages: DataFrame) -> DataFrame:
    """WIN-13 as a filter: each page knows from its number whether it is sampled, so no join."""
    return pages.filter(F.array_contains(sample_positions(F.col("total_pages")), (F.col("page_no") - 1).cast("int")))


def document_metrics(pages: DataFrame, *keys: str) -> DataFrame:
    """AGG-06: page metrics summed up per document. Only narrow numbers are shuffled."""
    chars = F.col("metrics.chars")
    return (
        with_metrics(pages)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("sampled"),
            F.count_if(chars > 0).alias("textful"),
            F.count_if((chars >= 1200) & (F.col("metrics.alpha_chars") >= 500)).alias("strong"),
            F.sum(chars).alias("chars"),
        )
    )


def is_strong_text(sampled: Column, textful: Column, strong: Column, chars: Column, avg_mb: Column) -> Column:
    """CLS-10: almost every sampled page has text, and enough of it."""
    return (
        (textful > 0)
        & (textful >= F.greatest(sampled - 1, F.lit(1)))
        & (strong >= F.greatest(F.least(sampled, F.lit(2)), F.lit(1)))
        & (F.try_divide(chars, textful) >= 1200)
        & (avg_mb <= 0.45)
    )


def missing_lines(source: Column, output: Column) -> Column:
    """JOI-09: source lines of some length that the output does not contain, in order.

    Most lines of a good output stand in it as lines, so they are looked up in the set
    of output lines first; only the rest are searched for in the whole text.
    """
    candidates = F.filter(
        F.transform(content_lines(source), lambda line: squash(line)),
        lambda line: F.length(line) >= fixed.AUDIT_MIN_LINE_CHARS,
    )
    held = F.transform(content_lines(output), lambda line: squash(F.lower(line)))

    def search(wanted: Column) -> Column:
        absent = F.array_except(F.transform(wanted, lambda line: F.lower(line)), held)
        lost = let(squash(F.lower(output)), lambda text: F.filter(absent, lambda line: ~F.contains(text, line)))
        return let(lost, lambda gone: F.when(F.size(gone) == 0, F.slice(wanted, 1, 0)).otherwise(
            F.filter(wanted, lambda line: F.array_contains(gone, F.lower(line)))
        ))

    return let(candidates, search)


def text_layer_audit(source: Column, output: Column, max_listed: int | None = None) -> Column:
    """AGG-08: how much of a source text an output covers.

    ``length_coverage`` compares normalised lengths; ``missing_lines`` lists source
    lines of some length that the output does not contain (JOI-09). Both stay inside
    the row, and both sides are read whole. ``max_listed`` bounds the list only;
    ``missing`` counts all lines.
    """

    def report(keys: Column) -> Column:
        return F.struct(
            F.least(keys["output"] / F.greatest(keys["source"], F.lit(1)), F.lit(1.0)).alias("length_coverage"),
            keys["source"].cast("bigint").alias("source_chars"),
            keys["output"].cast("bigint").alias("output_chars"),
            F.size(keys["missing"]).cast("bigint").alias("missing"),
            (keys["missing"] if max_listed is None else F.slice(keys["missing"], 1, max_listed)).alias("missing_lines"),
        )

    measured = F.struct(
        F.length(audit_key(source)).alias("source"),
        F.length(audit_key(output)).alias("output"),
        missing_lines(source, output).alias("missing"),
    )
    return let(measured, report)


def token_coverage(source: Column, output: Column) -> Column:
    """Share of a source's distinct words that the output has too."""
    words = F.array_distinct(F.filter(F.split(F.lower(source), r"[^a-z0-9]+"), lambda w: w != ""))
    held = F.split(F.lower(output), r"[^a-z0-9]+")
    return let(words, lambda known: F.try_divide(F.size(F.array_intersect(known, held)), F.size(known)))


def appendix_kind(audit: Column) -> Column:
    """AGG-09: what to append after an audit: nothing, the missing lines, or the whole text layer."""
    low = (audit["length_coverage"] < fixed.AUDIT_WARN_COVERAGE) & (audit["missing"] > 0)
    return F.when(low & (audit["length_coverage"] < fixed.AUDIT_FULL_COVERAGE), "full").when(low, "lines").otherwise("none")


def render_appendix(fmt: Column, heading: Column, body: Column) -> Column:
    """SNK-16."""
    from quirekit.functions.text import escape_html

    markup = F.concat(
        F.lit("\n<section>\n<h2>"), escape_html(heading), F.lit("</h2>\n<pre>"), escape_html(body), F.lit("</pre>\n</section>\n")
    )
    marked = F.concat(F.lit("\n\n## "), heading, F.lit("\n\n```\n"), body, F.lit("\n```\n"))
    plain = F.concat(F.lit("\n\n["), heading, F.lit("]\n"), body, F.lit("\n"))
    return F.when(squash(body) == "", "").when(fmt == "html", markup).when(fmt == "md", marked).otherwise(plain)


def keep_unless_shrunk(
    raw: Column, cleaned: Column, raw_visible: Column, cleaned_visible: Column, min_chars: int = 1
) -> Column:
    """FLT-21: a clean-up that loses too much visible text is not taken; ``min_chars`` exempts short texts."""
    lost = let(F.length(raw_visible), lambda n: (n >= min_chars) & (F.length(cleaned_visible) < fixed.SHRINK_MIN_RATIO * n))
    return F.when(lost, raw).otherwise(cleaned)


def has_archive_marker(text: Column) -> Column:
    """FLT-15: the text names the newspaper archive it comes from."""
    held = F.lower(text)
    return F.exists(F.array(*map(F.lit, fixed.ARCHIVE_MARKERS)), lambda marker: F.contains(held, marker))


def skips_cleanup(profile: Column, html: Column, min_chars: int = 0) -> Column:
    """FLT-17: outputs of two profiles that already carry their wrapper are left alone; ``min_chars`` limits it to large ones."""
    held = F.lower(html)
    return profile.isin("archival", "military") & (F.length(html) >= min_chars) & held.contains("<html") & held.contains("<main")
