"""Whole-document clean-up chains (HTM-01, STR-43, SNK-07)."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.functions import html, legal, text
from quirekit.functions.classify import looks_legal, may_be_legal
from quirekit.functions.glossary import expand_abbreviations
from quirekit.functions.rewrite import let
from quirekit.operators.pages import keep_unless_shrunk

# What leaks into a body goes first, then furniture, so that the rules for headings see content only.
CLEANING_PASSES = [
    html.drop_presentation,
    html.strip_leaked_wrappers,
    html.collapse_nested_main,
    html.flatten_heading_breaks,
    legal.unwrap_footer_markers,
    html.strip_page_furniture,
]
HEADING_PASSES = [
    html.form_semantics,
    html.promote_sparse_blocks,
    html.promote_leading_paragraphs,
    html.promote_list_section,
    html.promote_numbered_instructions,
    html.promote_bare_instruction,
    html.promote_ordered_list,
    html.promote_definition_list,
    html.promote_numbered_clauses,
    html.promote_strong_paragraphs,
    html.promote_context_paragraph,
    html.promote_index,
    html.promote_war_diary,
    html.promote_figure_followup,
    html.promote_short_h2,
    html.promote_bold_followup,
    html.promote_bold_after_h1,
    html.heading_hierarchy,
    html.dedupe_paragraphs,
]


def staged(frame: DataFrame, column: str, steps: list) -> DataFrame:
    """Apply rewriting steps to a column one after the other, in one pass over the row.

    Each step's result goes through a one-element explode. It gives back the same row,
    but the optimizer can neither nest all steps into one tree too deep to plan nor copy
    them into a filter on the result.
    """
    others = [name for name in frame.columns if name != column]
    for step in steps:
        frame = frame.select(*others, F.explode(F.array(step(F.col(column)))).alias(column))
    return frame


def staged_pages(frame: DataFrame, column: str, steps: list) -> DataFrame:
    """``staged`` for rules on pages: neighbouring rules for the inside of main share one cut of the page.

    A ``bare`` rule leaves an inside with headings alone, so those that have one when the page is cut skip all such rules.
    """
    names, cut, bare = frame.columns, "_main", "_bare"
    for inside, group in groupby(steps, key=lambda step: hasattr(step, "inside")):
        if not inside:
            frame = staged(frame, column, list(group))
            continue
        parts = frame.withColumn(cut, F.explode(F.array(html.main_parts(F.col(column)))))
        others = [n for n in names if n != column]
        parts = parts.select(*others, F.col(f"{cut}.before").alias(f"{cut}_before"), F.col(f"{cut}.after").alias(f"{cut}_after"), F.col(f"{cut}.inner").alias(column))
        parts = parts.withColumn(bare, F.explode(F.array(F.col(column).isNotNull() & ~html.has_heading(F.col(column)))))

        def only(step):
            wanted = F.col(bare) if step.bare else F.col(column).isNotNull()
            return lambda inner: F.when(wanted, step.inside(inner)).otherwise(inner)

        parts = staged(parts, column, [only(step) for step in group])
        whole = F.concat(F.col(f"{cut}_before"), F.coalesce(column, F.lit("")), F.col(f"{cut}_after"))
        frame = parts.withColumn(column, whole).select(*names)
    return frame


def apply_contract(frame: DataFrame, column: str, only: Column | None = None) -> DataFrame:
    """LEG-01: the legal contract on a column, for rows where ``only`` holds; other rows are not cut."""
    held = "_blocks"
    before, rules = legal.CONTRACT[: len(legal.BEFORE_CUT)], legal.CONTRACT[len(legal.BEFORE_CUT) + 1 : -1]
    wanted = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    frame = frame.withColumn("_wanted", wanted)
    frame = staged(frame, column, [lambda body, step=step: F.when(F.col("_wanted"), step(body)).otherwise(body) for step in before])
    # Rows without blocks have a null array, which every rule passes on.
    cut = frame.withColumn(held, F.when(F.col("_wanted"), legal.cut(F.col(column))))
    ruled = staged(cut, held, rules)
    return ruled.withColumn(column, F.coalesce(legal.render(F.col(held)), F.col(column))).drop(held, "_wanted").select(*frame.drop("_wanted").columns)


def with_contents(body: Column) -> Column:
    return let(html.toc_rows(body), lambda rows: html.inject_toc(body, rows))


def normalize_documents(frame: DataFrame, column: str = "html", title: Column | None = None, contents: bool = False) -> DataFrame:
    """HTM-01: the document clean-up chain, on bodies of every length; legal documents also go through the contract.

    With ``title``, a cover without a heading gets one of it; with ``contents``, main gets a table of contents.
    """
    cleaned = staged(frame, column, CLEANING_PASSES)
    legal_body = F.when(may_be_legal(F.col(column)), looks_legal(text.visible_text(F.col(column))))
    cover = [lambda body: html.title_cover(body, title)] if title is not None else []
    late = [*HEADING_PASSES[-2:], html.strip_running_head_h1s, *([with_contents] if contents else [])]
    return staged_pages(apply_contract(cleaned, column, legal_body), column, [*HEADING_PASSES[:-2], *cover, *late])


def sanitize_output(frame: DataFrame, column: str, fmt: Column, profile: Column, preserve_pages: Column | None = None, pages: bool = True) -> DataFrame:
    """STR-16: a model's output cleaned by format and profile.

    HTML and EPUB keep their structure and, for legal documents, go through the contract; other formats lose all tags, and
    books get the plain-text pass. ``pages`` says whether the frame holds HTML or EPUB at all; without, the plan is short.
    """
    markup = F.lower(fmt).isin("html", "epub")
    kept = F.coalesce(preserve_pages, F.lit(False)) if preserve_pages is not None else F.lit(False)
    plain = lambda body: text.sanitize_plain(body, fmt)
    passes = [lambda body, step=step: F.when(markup, step(body)).otherwise(body) for step in html.SANITIZE_PASSES]
    cleaned = staged(frame, column, [*passes, lambda body: F.when(markup, body).otherwise(plain(body))] if pages else [plain])
    ruled = apply_contract(cleaned, column, markup & (F.lower(profile) == "legal")) if pages else cleaned
    book = ~markup & (F.lower(profile) == "book")
    return staged(ruled, column, [lambda body: F.when(book & kept, text.book_text(body, True)).when(book, text.book_text(body)).otherwise(body)])


def cleanup_output(frame: DataFrame, column: str, fmt: Column, profile: Column, flags: dict[str, Column], pages: bool = True) -> DataFrame:
    """STR-43: clean-up by format and settings.

    HTML is normalised first and gets its profile's headings last; HTML and plain formats have punctuation, currency and
    abbreviations brought up to date if the settings say so. Other formats pass. ``pages`` as in ``sanitize_output``.
    """
    markup = fmt == "html"
    done = frame
    if pages:
        # Rows of other formats would only lose by the chain, so it runs on a column that is null for them.
        page = frame.withColumn("_page", F.when(markup, F.col(column)))
        done = normalize_documents(page, "_page").withColumn(column, F.coalesce(F.col("_page"), F.col(column))).drop("_page")
    steps = [
        ("modernize_punctuation", text.modernize_punctuation),
        ("unit_conversion", text.modernize_currency),
        ("abbrev_expansion", lambda body: expand_abbreviations(body, profile)),
    ]

    def when_on(flag: Column, step):
        return lambda body: F.when(flag & fmt.isin("html", "txt", "md"), step(body)).otherwise(body)

    headed = lambda body: F.when(markup, html.enforce_profile_headings(body, profile)).otherwise(body)
    return staged(done, column, [*(when_on(flags[name], step) for name, step in steps), *([headed] if pages else [])])


def prepare_save(frame: DataFrame, column: str, fmt: Column, profile: Column, flags: dict[str, Column], pages: bool = True) -> DataFrame:
    """SNK-07: sanitise and bring up to date a text for saving, HTML its own way; a result that lost too much is not taken."""
    raw = frame.withColumn("_raw", F.col(column))
    clean = sanitize_output(raw, column, fmt, profile, flags.get("preserve_pages"), pages)
    steps = [
        lambda body: F.when(flags["modernize_punctuation"], text.modernize_punctuation(body)).otherwise(body),
        lambda body: F.when(flags["unit_conversion"], text.modernize_currency(body)).otherwise(body),
        lambda body: F.when(flags["abbrev_expansion"], expand_abbreviations(body, profile)).otherwise(body),
        lambda body: F.when(flags["merge_files"], text.strip_synthetic_headings(body, fmt)).otherwise(body),
    ]
    merged = staged(clean, column, steps)
    kept = keep_unless_shrunk(
        F.col("_raw"), F.col(column), text.visible_text(F.col("_raw")), text.visible_text(F.col(column))
    )
    return merged.withColumn(column, kept).drop("_raw")
