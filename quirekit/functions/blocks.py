"""A document as an array of blocks: cut once, changed by rules on neighbouring blocks, rendered once.

A block is a paragraph or heading with the facts rules ask for, an element whose inside is left alone (list, table,
quotation, header, footer, navigation), or other text between those. Rules are array functions inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirekit.functions.classify import CLAUSE, REFERENCE, STRUCTURE, canonical_heading
from quirekit.functions.lines import PAGE_MARKER
from quirekit.functions.rewrite import full, let, squash
from quirekit.functions.text import escape_html, strip_tags

#: Elements that are kept whole, and those whose labels rules look at.
HELD, FLOW = ["table", "nav", "header", "footer", "blockquote", "ol", "ul"], ["p", *(f"h{n}" for n in range(1, 7))]
_CUT = "(?is)" + "|".join(rf"<({'|'.join(names)})\b[^>]*>.*?</\{i}\s*>" for i, names in enumerate((HELD, FLOW), 1))
#: How a label must begin to hold any of the legal facts.
_LEGAL_START = rf"(?i)\A(?:[0-9]|section\b|{STRUCTURE}\b|commencement|simplified|notes)"

def _legal_facts(label: Column) -> Column:
    """``struct(head, clause, section, kind)``: canonical label, clause number, number of a bare section, structure word."""
    facts = let(canonical_heading(label), lambda head: F.struct(
        head.alias("head"),
        F.regexp_extract(head, rf"\A({CLAUSE})\s+[A-Z]", 1).alias("clause"),
        F.regexp_extract(head, rf"(?i)\ASection\s+({REFERENCE})\z", 1).alias("section"),
        F.lower(F.regexp_extract(head, rf"(?i)\A({STRUCTURE})\s+{REFERENCE}(?:\s+.+)?\z", 1)).alias("kind")))
    none = F.struct(label.alias("head"), *(F.lit("").alias(c) for c in ("clause", "section", "kind")))
    return F.when(label.rlike(_LEGAL_START), facts).otherwise(none)


def block(before: Column, raw: Column) -> Column:
    """A block and its facts from its source; ``before`` is the white space in front of it."""
    # Lower-casing costs more than a look-up, and most names are lower case.
    name = let(F.regexp_extract(raw, r"\A<([A-Za-z0-9]+)", 1), lambda n: F.when(n.isin(*HELD, *FLOW), n).otherwise(F.lower(n)))

    def shape(x: Column) -> Column:
        inner = F.when(x.isin(FLOW), F.regexp_extract(raw, r"(?is)\A<[^>]*>(.*)</[^>]*>\z", 1)).otherwise("")

        def facts(inside: Column) -> Column:
            return let(squash(strip_tags(inside), " -|:"), lambda label: let(_legal_facts(label), lambda legal: F.struct(
                before.alias("before"), raw.alias("raw"), x.alias("name"), inside.alias("inner"), label.alias("label"),
                *(legal[c].alias(c) for c in ("head", "clause", "section", "kind")),
                label.rlike(full(PAGE_MARKER, "(?i)")).alias("marker"))))

        return let(inner, facts)

    return let(name, shape)


def cut(html: Column) -> Column:
    """The blocks of a text; text that is not blank between elements is a block of its own."""

    def run(body: Column) -> Column:
        found = F.concat(F.regexp_extract_all(body, F.lit(_CUT), F.lit(0)), F.array(F.lit("")))
        pairs = F.zip_with(F.split(body, _CUT, -1), found, lambda text, raw: F.when(
            text.rlike(r"\S"), F.array(F.struct(F.lit("").alias("before"), text.alias("raw")), F.struct(F.lit("").alias("before"), raw.alias("raw")))
        ).otherwise(F.array(F.struct(text.alias("before"), raw.alias("raw")))))
        kept = F.filter(F.flatten(pairs), lambda p: (p["raw"] != "") | (p["before"] != ""))
        return F.transform(kept, lambda p: block(p["before"], p["raw"]))

    return let(html, run)


def render(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: F.concat(b["before"], b["raw"])), "")


def changed(b: Column, raw: Column) -> Column:
    """The block with another source; facts are left to ``refreshed``, an empty source drops it."""
    return b.withField("raw", raw).withField("name", F.lit(None).cast("string"))


def pruned(blocks: Column) -> Column:
    """Dropped blocks go; changed ones stay without facts, out of reach of later rules."""
    return F.filter(blocks, lambda b: b["name"].isNotNull() | (b["raw"] != ""))


def refreshed(blocks: Column) -> Column:
    """Dropped blocks go, and facts of changed blocks are worked out."""
    kept = F.filter(blocks, lambda b: (b["raw"] != "") | b["name"].isNotNull())
    return F.transform(kept, lambda b: F.when(b["name"].isNull(), block(b["before"], b["raw"])).otherwise(b))


def is_heading(b: Column) -> Column:
    return F.coalesce(b["name"].rlike(r"\Ah[1-6]\z"), F.lit(False))


def is_paragraph(b: Column) -> Column:
    return F.coalesce(b["name"] == "p", F.lit(False))


def by_neighbours(blocks: Column, rule) -> Column:
    """``rule(block, previous, next)`` for every block; a null neighbour stands for none."""
    return let(blocks, lambda held: F.transform(held, lambda b, i: rule(b, F.when(i > 0, F.get(held, i - 1)), F.get(held, i + 1))))


def dropped_if(blocks: Column, test) -> Column:
    """Blocks without those for which ``test(block, previous, next)`` holds."""
    return by_neighbours(blocks, lambda b, p, n: F.when(F.coalesce(test(b, p, n), F.lit(False)), changed(b, F.lit(""))).otherwise(b))


def element(name: Column | str, text: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.concat(F.lit("<"), name, F.lit(">"), escape_html(text), F.lit("</"), name, F.lit(">"))


def retagged(b: Column, name: Column, text: Column) -> Column:
    """The block's element under another name and text, with its attributes."""
    attributes = F.regexp_extract(b["raw"], r"(?is)\A<[A-Za-z0-9]+([^>]*)>", 1)
    return F.concat(F.lit("<"), name, attributes, F.lit(">"), escape_html(text), F.lit("</"), name, F.lit(">"))
