"""Look-back, look-around and re-flow over the lines of one text (WIN-09 to WIN-11, JOI-11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirekit.functions.classify import clause_number, is_breadcrumb, is_heading_line, is_section_line, section_number
from quirekit.functions.lines import PAGE_MARKER
from quirekit.functions.rewrite import full, let


def marker_behind(found: Column) -> Column:
    """WIN-09: per line, whether a page marker stands at most three lines back with only structure labels between."""
    facts = F.transform(
        found,
        lambda line: F.struct(line.rlike(full(PAGE_MARKER)).alias("marker"), is_breadcrumb(line).alias("structural")),
    )

    def at(held: Column, index: Column, name: str) -> Column:
        return F.coalesce(F.when(index >= 1, F.try_element_at(held, index))[name], F.lit(False))

    def look_back(held: Column) -> Column:
        return F.transform(
            held,
            lambda _line, i: at(held, i, "marker")
            | (at(held, i, "structural") & at(held, i - 1, "marker"))
            | (at(held, i, "structural") & at(held, i - 1, "structural") & at(held, i - 2, "marker")),
        )

    return let(facts, look_back)


def nearby_clause(found: Column, reach: int = 6) -> Column:
    """WIN-10 / JOI-11: per line, whether a clause with the line's section number lies within ``reach`` lines."""
    facts = F.transform(
        found, lambda line: F.struct(section_number(line).alias("section"), clause_number(line).alias("clause"))
    )

    def look_around(held: Column) -> Column:
        return F.transform(
            held,
            lambda fact, i: (fact["section"] != "")
            & F.exists(
                F.slice(held, F.greatest(i + 1 - reach, F.lit(1)), F.least(i, F.lit(reach)) + reach + 1),
                lambda other: other["clause"] == fact["section"],
            ),
        )

    return let(facts, look_around)


def joins_paragraph(current: Column, following: Column) -> Column:
    """WIN-11: whether a line carries on the paragraph before it."""
    return (
        (current != "")
        & (following != "")
        & ~is_heading_line(following)
        & ~is_section_line(following)
        & ~following.rlike(r"\A\d+\z")
        & ~current.rlike(r"[.?!:;]\z")
        & (
            current.endswith(",")
            | (F.length(current) <= 4)
            | following.rlike(r"\A[\p{Ll}(\[\"']")
            | ((F.length(current) >= 45) & (F.length(following) >= 20))
        )
    )


def reflow(found: Column) -> Column:
    """WIN-11: lines joined to paragraphs. The test looks at the paragraph so far, so this is a fold."""
    state = "struct<open:string,done:array<string>>"
    zero = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done")).cast(state)

    def step(acc: Column, line: Column) -> Column:
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        return (
            F.when(
                joins_paragraph(acc["open"], line),
                F.struct(F.concat(acc["open"], F.lit(" "), line).alias("open"), acc["done"].alias("done")),
            )
            .otherwise(F.struct(line.alias("open"), closed.alias("done")))
            .cast(state)
        )

    return F.aggregate(
        found, zero, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
    )
