"""Ordered-sequence logic inside one row: lines, page markers, slices and batches.

A text already sits in one row, so its lines are handled with array functions:
no explode, no shuffle, and no group that could outgrow a task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirekit.functions import fixed
from quirekit.functions.rewrite import let, rewrite, strip

PAGE_MARKER = r"\[Original Page Number:\s*(\d+)\]"
_MARKER_LINE = rf"(?md)^{PAGE_MARKER}[ \t]*$"
_REPEATED_MARKER = rf"(?md)^({PAGE_MARKER})(?:\s*\n\s*\[Original Page Number:\s*\2\])+$"


def lines(col: Column) -> Column:
    return F.split(col, "\n")


def content_lines(col: Column) -> Column:
    """Stripped, non-empty lines in order."""
    return F.filter(F.transform(lines(col), lambda line: strip(line)), lambda line: line != "")


def with_previous(items: Column, fn) -> Column:
    """``fn(item, previous)`` over an array; ``previous`` is null for the first."""
    return let(
        items,
        lambda held: F.zip_with(
            held, F.concat(F.array(F.lit(None)), F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))), fn
        ),
    )


def count_where(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def consecutive_pairs(items: Column, test) -> Column:
    """How many neighbours satisfy ``test(previous, current)``."""
    return count_where(
        with_previous(items, lambda cur, prev: F.coalesce(test(prev, cur), F.lit(False))), lambda hit: hit
    )


def fill_page_markers(col: Column, widest: int = 10_000) -> Column:
    """WIN-03: collapse repeated page markers, then insert the missing numbers between two.

    A step of over ``widest`` numbers is a misread number, not that many missing pages, and is left open.
    """

    def marker(number: Column) -> Column:
        return F.concat(F.lit("[Original Page Number: "), number.cast("string"), F.lit("]"))

    def filled(cur: Column, prev: Column) -> Column:
        gap = F.transform(F.sequence(prev + 1, cur - 1), marker)
        missing = F.when((cur - prev > 1) & (cur - prev <= widest), F.concat(F.array_join(gap, "\n"), F.lit("\n"))).otherwise("")
        return F.coalesce(missing, F.lit(""))

    def run(text: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(text, F.lit(_MARKER_LINE), F.lit(1)), lambda n: n.cast("int"))
        found = F.regexp_extract_all(text, F.lit(_MARKER_LINE), F.lit(0))
        inserts = F.zip_with(with_previous(numbers, filled), found, lambda gap, m: F.concat(gap, m))
        joined = F.zip_with(
            F.split(text, _MARKER_LINE, -1), F.concat(inserts, F.array(F.lit(""))), lambda piece, m: F.concat(piece, m)
        )
        return F.when(F.size(found) >= 2, F.array_join(joined, "")).otherwise(text)

    return let(rewrite(col, [(_REPEATED_MARKER, r"\1")]), run)


def compact_scope(pages: Column) -> Column:
    """WIN-04: ascending page numbers as ``1-3,5``: first and last pages of spans side by side."""

    def spans(held: Column) -> Column:
        first = F.array_compact(with_previous(held, lambda cur, prev: F.when(prev.isNull() | (cur != prev + 1), cur)))
        last = F.reverse(F.array_compact(with_previous(F.reverse(held), lambda cur, after: F.when(after.isNull() | (after != cur + 1), cur))))
        return F.array_join(F.zip_with(first, last, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))), ",")

    return let(pages.cast("array<int>"), spans)


def scope_pages(scope: Column, total: Column) -> Column:
    """JOI-08: page numbers a normalised scope selects, first mention first.

    A scope with a problem selects nothing (``scope_error`` names the problem). Each
    range is clipped to the document before it is expanded, so no array can outgrow
    the document.
    """
    every = F.when(total > 0, F.sequence(F.lit(1), total.cast("int"))).otherwise(F.array().cast("array<int>"))
    parts = F.split(scope, ",")

    def expand(part: Column) -> Column:
        bounds = F.split(part, "-", 2)
        start = bounds[0].try_cast("int")
        end = F.coalesce(F.try_element_at(bounds, F.lit(2)), bounds[0]).try_cast("int")
        first, last = F.greatest(start, F.lit(1)), F.least(end, total.cast("int"))
        readable = start.isNotNull() & end.isNotNull() & (first <= last)
        return F.when(readable, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    picked = F.array_distinct(F.flatten(F.transform(parts, expand)))
    none = F.array().cast("array<int>")
    return (
        F.when((scope == "") | F.lower(scope).isin("all", "*"), every)
        .when(scope_error(scope, total).isNotNull(), none)
        .otherwise(picked)
    )


def scope_error(scope: Column, total: Column) -> Column:
    """FLT-24: first problem in a normalised scope, null when it is fine."""

    def problem(part: Column) -> Column:
        bounds = F.split(part, "-", 2)
        first, last = bounds[0], F.try_element_at(bounds, F.lit(2))
        low, high = first.try_cast("bigint"), last.try_cast("bigint")
        digits = r"\A\d+\z"
        as_range = (
            F.when((first == "") | (last == ""), F.concat(F.lit("Invalid page range '"), part, F.lit("'. Use start-end, for example 2-5.")))
            .when(
                ~first.rlike(digits) | ~last.rlike(digits),
                F.concat(F.lit("Invalid page range '"), part, F.lit("'. Only numbers and commas are allowed.")),
            )
            .when((low < 1) | (high < 1), "Page numbers must start at 1.")
            .when(
                high < low,
                F.concat(
                    F.lit("Invalid page range '"), part,
                    F.lit("'. The end page must be greater than or equal to the start page."),
                ),
            )
            .when(
                high > total,
                F.concat(
                    F.lit("Page range '"), part, F.lit("' exceeds this PDF's length of "), total.cast("string"), F.lit(" pages."),
                ),
            )
        )
        single = (
            F.when(
                ~part.rlike(digits),
                F.concat(F.lit("Invalid page value '"), part, F.lit("'. Use numbers like 1,3,5-7.")),
            )
            .when(first.try_cast("bigint") < 1, "Page numbers must start at 1.")
            .when(
                first.try_cast("bigint") > total,
                F.concat(F.lit("Page "), part, F.lit(" exceeds this PDF's length of "), total.cast("string"), F.lit(" pages.")),
            )
        )
        return F.when(F.contains(part, F.lit("-")), as_range).otherwise(single)

    found = F.filter(F.transform(F.split(scope, ","), problem), lambda e: e.isNotNull())
    return F.when((scope == "") | F.lower(scope).isin("all", "*"), F.lit(None).cast("string")).otherwise(
        F.try_element_at(found, F.lit(1))
    )


def scope_is_valid(scope: Column) -> Column:
    """FLT-14: a non-empty list of pages and ascending ranges from 1 up."""

    def valid(part: Column) -> Column:
        bounds = F.split(part, "-", 2)
        low, high = bounds[0].try_cast("bigint"), F.try_element_at(bounds, F.lit(2)).try_cast("bigint")
        in_range = part.rlike(r"\A\d+-\d+\z") & (low >= 1) & (high >= low)
        single = part.rlike(r"\A\d+\z") & (low >= 1)
        return F.coalesce(in_range | single, F.lit(False))

    return (scope != "") & F.forall(F.split(scope, ","), valid)


def fixed_slices(col: Column, size: int = fixed.TEXT_SLICE_CHARS) -> Column:
    """Fixed-size slices of a text, cut in one pass; the empty text has none."""
    return F.regexp_extract_all(col, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def slices_of(col: Column, size: int) -> Column:
    """Fixed-size slices of a text; the empty text is one empty slice."""
    return let(fixed_slices(col, size), lambda cut: F.when(F.size(cut) > 0, cut).otherwise(F.array(F.lit(""))))


def greedy_batches(chunks: Column, target: int = fixed.TEXT_BATCH_CHARS) -> Column:
    """WIN-05: join neighbouring chunks with newlines while their sizes stay within ``target``."""
    state = "struct<size:bigint,open:array<string>,done:array<string>>"
    empty = F.array().cast("array<string>")
    zero = F.struct(F.lit(0).alias("size"), empty.alias("open"), empty.alias("done")).cast(state)

    def step(acc: Column, chunk: Column) -> Column:
        fits = (F.size(acc["open"]) == 0) | (acc["size"] + F.length(chunk) <= target)
        return F.when(
            fits,
            F.struct(
                (acc["size"] + F.length(chunk)).alias("size"),
                F.array_append(acc["open"], chunk).alias("open"),
                acc["done"].alias("done"),
            ),
        ).otherwise(
            F.struct(
                F.length(chunk).cast("bigint").alias("size"),
                F.array(chunk).alias("open"),
                F.array_append(acc["done"], F.array_join(acc["open"], "\n")).alias("done"),
            )
        ).cast(state)

    def finish(acc: Column) -> Column:
        return F.when(
            F.size(acc["open"]) > 0, F.array_append(acc["done"], F.array_join(acc["open"], "\n"))
        ).otherwise(acc["done"])

    return F.aggregate(F.filter(chunks, lambda c: c != ""), zero, step, finish)


def line_chunks(col: Column, limit: int = fixed.LINE_CHUNK_CHARS) -> Column:
    """WIN-06: whole lines packed into chunks; a chunk closes when the next line would pass ``limit``."""
    state = "struct<held:bigint,cuts:array<int>,at:int>"
    zero = F.struct(
        F.lit(0).alias("held"), F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("at")
    ).cast(state)

    def step(acc: Column, size: Column) -> Column:
        closes = (acc["held"] > 0) & (acc["held"] + size > limit)
        return F.struct(
            F.when(closes, size + 1).otherwise(acc["held"] + size + 1).cast("bigint").alias("held"),
            F.when(closes, F.array_append(acc["cuts"], acc["at"])).otherwise(acc["cuts"]).alias("cuts"),
            (acc["at"] + 1).alias("at"),
        ).cast(state)

    def run(text_lines: Column) -> Column:
        sizes = F.transform(text_lines, lambda line: F.length(line))
        return let(
            F.aggregate(sizes, zero, step, lambda acc: acc["cuts"]),
            lambda cuts: F.zip_with(
                F.concat(F.array(F.lit(0)), cuts),
                F.concat(cuts, F.array(F.size(text_lines))),
                lambda a, b: F.concat(F.array_join(F.slice(text_lines, a + 1, b - a), "\n"), F.lit("\n")),
            ),
        )

    return let(lines(col), run)
