"""Output texts and line kinds for the writers (SNK-01 to SNK-06)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirekit.functions.rewrite import let, rewrite, strip
from quirekit.functions.text import escape_html

# Fixed patterns and wording ----------------------------------------------------------
PAGE_BREAK = "[[PAGE BREAK]]"
CHAPTER = r"(?i)<h2.*?>.*?</h2>"
LINE_KINDS = [("### ", "heading3"), ("## ", "heading2"), ("# ", "heading1")]


def document_text(title: Column, body: Column, fmt: Column, lang: Column, direction: Column) -> Column:
    """SNK-01: body with the header and footer of its format."""
    opening = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="'), lang, F.lit('" dir="'), direction,
        F.lit('">\n<head>\n<meta charset="utf-8">\n<title>'), escape_html(title),
        F.lit('</title>\n</head>\n<body>\n<main id="content" role="main">\n'),
    )
    page = F.concat(opening, body, F.lit("\n</main>\n</body>\n</html>\n"))
    return F.when(fmt == "html", page).when(fmt == "md", F.concat(F.lit("# "), title, F.lit("\n\n"), body)).otherwise(body)


def line_kind(line: Column) -> Column:
    """SNK-02: what a line becomes in a word-processor document."""

    def kind(text: Column) -> Column:
        chosen = F.when(text == PAGE_BREAK, "page_break").when(text.rlike(r"(?s)\A\|.*\|\z") & (F.length(text) >= 2), "table")
        for prefix, name in LINE_KINDS:
            chosen = chosen.when(text.startswith(prefix), name)
        return (
            chosen.when(text.rlike(r"\A\d+\.\s+"), "number")
            .when(text.startswith("- ") | text.startswith("* "), "bullet")
            .when(text != "", "paragraph")
            .otherwise("blank")
        )

    return let(strip(line), kind)


def line_text(line: Column) -> Column:
    """SNK-02: a line without the mark that gave it its kind."""
    return F.regexp_replace(strip(line), r"\A(?:#{1,3} |\d+\.\s+|[-*] )", "")


def chapters(title: Column, html: Column) -> Column:
    """SNK-04: ``array<struct(title, content)>``; each h2 opens a chapter, text before the first keeps the title."""
    pieces = F.split(html, CHAPTER, -1)
    heads = F.regexp_extract_all(html, F.lit(CHAPTER), F.lit(0))
    titles = F.concat(F.array(title), F.transform(heads, lambda h: F.regexp_replace(h, r"<[^>]+>", "")))
    contents = F.zip_with(F.concat(F.array(F.lit("")), heads), pieces, lambda h, p: F.concat(h, p))
    both = F.zip_with(titles, contents, lambda t, c: F.struct(t.alias("title"), c.alias("content")))
    return F.filter(both, lambda chapter: strip(chapter["content"]) != "")


def json_payload(content: Column) -> Column:
    """SNK-05: fenced or bare JSON passes; anything else is wrapped as extracted content."""

    def wrap(text: Column) -> Column:
        return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(
            F.to_json(F.struct(text.alias("extracted_content")))
        )

    bare = F.regexp_replace(strip(content), r"(?s)\A```json(.*?)(?:```)?\z", "$1")
    return let(strip(bare), wrap)


def csv_payload(content: Column) -> Column:
    """SNK-06."""
    return strip(rewrite(content, [(r"```csv", ""), (r"```", "")]))
