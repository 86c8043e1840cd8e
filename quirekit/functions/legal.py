"""Rules for legal documents (LEG family) as conditions on neighbouring blocks.

Each rule takes an array of blocks (``blocks``) and gives one. ``on_blocks`` applies rules to a text: cut, rules with
facts of changed blocks worked out behind each, render.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirekit.functions import fixed, labels, scan
from quirekit.functions.blocks import by_neighbours, changed, cut, dropped_if, element, is_heading, is_paragraph, pruned, refreshed, render, retagged
from quirekit.functions.classify import CLAUSE, HEADING_START, REFERENCE, STRUCTURE, _reordered, breadcrumb, canonical_heading, heading_level
from quirekit.functions.lines import with_previous
from quirekit.functions.rewrite import count_matches, let, rewrite, rewrite_first, squash, strip
from quirekit.functions.text import strip_tags

CONTENTS_BLOCK = (
    rf"(?is)(<h1\b[^>]*>\s*Contents\s*</h1>)(.*?)(?=<h[1-6]\b[^>]*>\s*{CLAUSE}\s+[A-Z])"
)
FOOTER_MARKER = (r"(?is)<footer>\s*(<p\b[^>]*>\s*\[Original Page Number:\s*[^\]]+\]\s*</p>)\s*</footer>", r"\1")
#: Words of a reference that wants a number behind it.
REFERRING = ["act", "chapter", "division", "paragraph", "paragraphs", "part", "regulations", "rules", "section", "sections", "subsection", "subsections"]
_DATE = rf"\d{{1,2}}\s+(?:{'|'.join(fixed.MONTHS)})\s+\d{{4}}"


def plain_inside(b: Column) -> Column:
    """No element inside."""
    return ~b["inner"].contains("<")


def next_to(b: Column, other: Column) -> Column:
    """A paragraph or heading right beside; null facts of a missing neighbour make tests null."""
    return other.isNotNull() & (is_heading(other) | is_paragraph(other))


# --- Single rules ---------------------------------------------------------------------------


def wants_number(label: Column) -> Column:
    """The label stops at a reference: its last word refers, perhaps with a number and a conjunction behind it."""

    def test(words: Column) -> Column:
        bare = F.when(F.element_at(words, -1).isin("and", "or") & (F.size(words) > 1), F.slice(words, 1, F.size(words) - 1)).otherwise(words)
        return let(bare, lambda w: F.element_at(w, -1).isin(REFERRING) | (
            F.element_at(w, -1).rlike(r"\A[0-9a-z.()/-]*[0-9][0-9a-z.()/-]*\z") & F.coalesce(F.try_element_at(w, F.lit(-2)).isin(REFERRING), F.lit(False))
            & (F.size(bare) < F.size(words))))

    # The last three words decide.
    return let(F.split(F.lower(F.substring_index(label, " ", -3)), " "), test)


def split_references(blocks: Column) -> Column:
    """LEG-06: a paragraph that stops at a reference takes the number that became a heading behind it."""
    number = lambda b: is_heading(b) & b["label"].rlike(r"\A\d{1,4}\.\z")
    open_ = lambda b: is_paragraph(b) & plain_inside(b) & wants_number(b["label"])

    def rule(b: Column, p: Column, n: Column) -> Column:
        return (
            F.when(F.coalesce(open_(b) & number(n), F.lit(False)), changed(b, F.concat(F.lit("<p>"), strip(b["inner"]), F.lit(" "), n["label"], F.lit("</p>"))))
            .when(F.coalesce(number(b) & open_(p), F.lit(False)), changed(b, F.lit("")))
            .otherwise(b)
        )

    return by_neighbours(blocks, rule)


def reordered_heads(blocks: Column) -> Column:
    """LEG-08: paragraphs and headings that are running heads in the wrong order."""
    return dropped_if(blocks, lambda b, p, n: (is_heading(b) | is_paragraph(b)) & plain_inside(b) & _reordered(b["label"]))


def continuations(blocks: Column) -> Column:
    """LEG-09: a structure heading takes the fragment after it when they make one heading of the same level."""

    def joined(head: Column, more: Column) -> Column:
        text = canonical_heading(F.concat(head["label"], F.lit(" "), more["label"]))
        agrees = lambda whole: let(
            F.transform(F.array(whole, head["head"]), heading_level), lambda levels: levels[0].isNotNull() & (levels[1].isNull() | (levels[1] == levels[0])))
        return F.when(
            (head["kind"] != "") & plain_inside(head) & plain_inside(more) & (more["label"] != "") & labels.carries_on(more["label"]),
            let(text, lambda whole: F.when((F.length(whole) > F.length(head["label"])) & agrees(whole), whole)))

    def run(held: Column) -> Column:
        # What each heading becomes with the block behind it; that block then goes.
        made = by_neighbours(held, lambda b, p, n: F.when(is_heading(b) & is_paragraph(n), joined(b, n)))
        return let(made, lambda texts: F.transform(held, lambda b, i: F.when(F.get(texts, i).isNotNull(), changed(b, element(b["name"], F.get(texts, i))))
            .when(F.when(i > 0, F.get(texts, i - 1)).isNotNull(), changed(b, F.lit(""))).otherwise(b)))

    return let(blocks, run)


def fragments(blocks: Column) -> Column:
    """LEG-10: headings that are dates, cross-references or loose ends become paragraphs."""

    def rule(b: Column, p: Column, n: Column) -> Column:
        plain = squash(b["label"], " -|")
        loose = lambda x: (x != "") & (x.rlike(rf"(?i)\A{_DATE}\z") | (~labels.is_cited_title(x) & (labels.is_unfinished(x) | labels.is_loose_end(x))))
        return F.when(is_heading(b) & plain_inside(b), let(plain, lambda x: F.when(loose(x), changed(b, element("p", x))).otherwise(b))).otherwise(b)

    return by_neighbours(blocks, rule)


def structure_key(b: Column) -> Column:
    return F.lower(F.regexp_extract(b["head"], rf"(?i)\A({STRUCTURE}\s+{REFERENCE})\b", 1))


def same_structure(blocks: Column) -> Column:
    """LEG-11: of neighbouring headings for the same unit the longer one stays, the first of equal ones."""

    def alike(a: Column, b: Column) -> Column:
        nested = a["head"].startswith(b["head"]) | b["head"].startswith(a["head"])
        return F.coalesce(is_heading(a) & is_heading(b) & (structure_key(a) != "") & (structure_key(a) == structure_key(b)) & nested, F.lit(False))

    def rule(b: Column, p: Column, n: Column) -> Column:
        size = lambda x: F.length(x["head"])
        return (
            F.when((alike(p, b) & (size(p) >= size(b))) | (alike(b, n) & (size(n) > size(b))), changed(b, F.lit("")))
            .when(alike(p, b) | alike(b, n), b.withField("raw", element(b["name"], b["head"])))
            .otherwise(b)
        )

    return by_neighbours(blocks, rule)


def spliced_subsections(blocks: Column) -> Column:
    """LEG-12: a clause heading run together with its first subsection is split in two."""

    def rule(b: Column) -> Column:
        def parts(cut_: Column) -> Column:
            split_ = lambda title: F.array(changed(b, element(b["name"], title)), changed(b, element("p", cut_[1])).withField("before", F.lit("")))
            return F.when(
                is_heading(b) & (b["clause"] != "") & (F.size(cut_) == 2) & plain_inside(b),
                let(canonical_heading(cut_[0]), lambda title: F.when(heading_level(title).isNotNull(), split_(title)).otherwise(F.array(b))),
            ).otherwise(F.array(b))

        return let(F.split(b["label"], r"\s+(?=\(\d+[A-Za-z]?\)\s)", 2), parts)

    return F.flatten(F.transform(blocks, rule))


def restart_runs(blocks: Column) -> Column:
    """LEG-13: a run of two or more structure headings that stood before, heading for heading, is dropped.

    Runs are cut out of one joined text and sorted by their labels, so equal ones meet.
    """
    item, gap, mark = "\x1d", "\x1e", "\x1f"

    def run(held: Column) -> Column:
        listed = F.array_join(
            F.transform(held, lambda b, i: F.when(is_heading(b) & (b["kind"] != ""), F.concat(F.lit(item), i.cast("string"), F.lit(mark), b["head"])).otherwise(gap)), "")
        runs = F.transform(F.split(listed, gap), lambda r: F.split(F.substring(r, 2, 1 << 30), item))
        keyed = F.transform(F.filter(runs, lambda r: F.size(r) > 1), lambda r: F.struct(
            F.array_join(F.transform(r, lambda x: F.split(x, mark)[1]), item).alias("key"),
            F.split(r[0], mark)[0].cast("int").alias("first"), F.size(r).alias("size")))
        again = F.array_compact(with_previous(F.sort_array(keyed), lambda cur, prev: F.when(prev["key"] == cur["key"], cur)))
        places = F.flatten(F.transform(again, lambda r: F.sequence(r["first"], r["first"] + r["size"] - 1)))
        return F.zip_with(held, scan.marked(places, F.size(held)), lambda b, gone: F.when(gone, changed(b, F.lit(""))).otherwise(b))

    return let(blocks, run)


def restart_sections(blocks: Column) -> Column:
    """LEG-14: ``Section n`` headings right before a list that starts at n or goes on with letters."""

    def attribute(b: Column, name: str) -> Column:
        return F.lower(F.regexp_extract(b["raw"], rf"(?i)\A<[^>]*\b{name}\s*=\s*['\"]?([^'\"\s>]*)", 1))

    return dropped_if(blocks, lambda b, p, n: is_heading(b) & (b["section"] != "") & (n["name"] == "ol") & (
        (attribute(n, "start") == F.lower(b["section"])) | attribute(n, "type").isin("a", "i")))


def repeated_structures(blocks: Column) -> Column:
    """LEG-14: a heading or label of a structure unit that stood before, with the same words, is dropped."""

    def run(held: Column) -> Column:
        keys = F.transform(held, lambda b: F.when((is_heading(b) | is_paragraph(b)) & (b["kind"] != ""), F.lower(b["head"])))
        return F.zip_with(held, scan.first_of_each(keys), lambda b, first: F.when((is_heading(b) | is_paragraph(b)) & (b["kind"] != "") & ~first, changed(b, F.lit(""))).otherwise(b))

    return let(blocks, run)


def known_sections(blocks: Column, reach: int = 6) -> Column:
    """LEG-14, JOI-11: a bare ``Section n`` label goes if clause n stood anywhere before it or is within ``reach`` blocks."""

    def run(held: Column) -> Column:
        # By number, clauses before labels and by place: the first of a number tells where its first clause stands.
        number = lambda b: F.when(b["clause"] != "", b["clause"]).when(b["section"] != "", b["section"])
        events = F.sort_array(F.filter(
            F.transform(held, lambda b, i: F.struct(number(b).alias("number"), (b["clause"] == "").alias("bare"), i.alias("at"))),
            lambda e: e["number"].isNotNull()))
        heads = scan.last_known(with_previous(events, lambda cur, prev: F.when(
            prev.isNull() | (prev["number"] != cur["number"]), F.when(cur["bare"], -1).otherwise(cur["at"]))), "int")
        behind = F.array_compact(F.zip_with(events, heads, lambda e, h: F.when(e["bare"] & (h >= 0) & (h < e["at"]), e["at"])))

        def near(b: Column, i: Column) -> Column:
            around = F.slice(held, F.greatest(i + 1 - reach, F.lit(1)), F.least(i, F.lit(reach)) + reach + 1)
            return (b["section"] != "") & F.exists(around, lambda o: o["clause"] == b["section"])

        return F.zip_with(
            F.transform(held, lambda b, i: F.struct(b.alias("b"), near(b, i).alias("near"))), scan.marked(behind, F.size(held)),
            lambda x, seen: F.when(seen | x["near"], changed(x["b"], F.lit(""))).otherwise(x["b"]))

    return let(blocks, run)


def is_crumb(b: Column) -> Column:
    return F.coalesce(is_paragraph(b) & breadcrumb(b["label"]), F.lit(False))


def breadcrumb_runs(blocks: Column) -> Column:
    """LEG-15: two or more structure labels between a page marker and the text go; the marker stays."""

    def run(held: Column) -> Column:
        crumbs = F.transform(held, lambda b: is_crumb(b))
        # What stands in front of a run of labels.
        opened = scan.shifted(scan.last_known(F.zip_with(held, crumbs, lambda b, crumb: F.when(~crumb, b["marker"])), "boolean"), -1)
        beside = F.zip_with(scan.shifted(crumbs, -1), scan.shifted(crumbs, 1), lambda p, n: F.coalesce(p, F.lit(False)) | F.coalesce(n, F.lit(False)))
        gone = F.zip_with(F.zip_with(crumbs, opened, lambda c, o: c & F.coalesce(o, F.lit(False))), beside, lambda a, b: a & b)
        return F.zip_with(held, gone, lambda b, drop: F.when(drop, changed(b, F.lit(""))).otherwise(b))

    return let(blocks, run)


def clause_trails(blocks: Column) -> Column:
    """LEG-15: two or more structure labels right before a clause heading go, also as lines of one paragraph."""

    def lines_of(b: Column) -> Column:
        return F.filter(F.transform(F.split(b["inner"], r"(?i)<br\s*/?>"), lambda x: squash(strip_tags(x), " -|:")), lambda x: x != "")

    def run(held: Column) -> Column:
        trail = F.transform(held, lambda b: is_crumb(b) & ~b["inner"].rlike(r"(?i)<br\b"))
        ahead = scan.shifted(scan.next_known(F.zip_with(held, trail, lambda b, t: F.when(~t, is_heading(b) & (b["clause"] != ""))), "boolean"), 1)
        beside = F.zip_with(scan.shifted(trail, -1), scan.shifted(trail, 1), lambda p, n: F.coalesce(p, F.lit(False)) | F.coalesce(n, F.lit(False)))
        listed = F.transform(held, lambda b: is_paragraph(b) & b["inner"].rlike(r"(?i)<br\b") & let(
            lines_of(b), lambda ls: (F.size(ls) > 1) & F.forall(ls, lambda x: breadcrumb(x))))
        gone = F.zip_with(F.zip_with(trail, beside, lambda a, b: a & b), listed, lambda a, b: a | b)
        return F.zip_with(held, F.zip_with(gone, ahead, lambda g, a: g & F.coalesce(a, F.lit(False))), lambda b, drop: F.when(drop, changed(b, F.lit(""))).otherwise(b))

    return let(blocks, run)


def redundant_sections(blocks: Column) -> Column:
    """LEG-16: a bare ``Section n`` label goes before the heading of clause n and behind a page marker."""

    def test(b: Column, p: Column, n: Column) -> Column:
        same = is_heading(n) & (n["clause"] != "") & n["clause"].rlike(r"\A[0-9]") & (
            F.regexp_extract(n["clause"], r"\A(\d+)", 1) == F.regexp_extract(b["section"], r"\A(\d+)", 1)) & n["clause"].startswith(b["section"])
        return (b["section"] != "") & (is_heading(b) | is_paragraph(b)) & (F.coalesce(same, F.lit(False)) | F.coalesce(p["marker"], F.lit(False)))

    return dropped_if(blocks, test)


def prefixed_sections(blocks: Column) -> Column:
    """LEG-16, JOI-11: ``Section n (a) ...`` loses its prefix if the nearest clause before it, else the nearest behind, is n.

    The nearest clause is found as of the place of the label, however far away.
    """
    pattern = rf"(?i)\ASection\s+({CLAUSE})\s+(\(.+)\z"

    def run(held: Column) -> Column:
        numbers = F.transform(held, lambda b: F.when(b["clause"] != "", b["clause"]))
        nearest = F.zip_with(scan.shifted(scan.last_known(numbers), -1), scan.shifted(scan.next_known(numbers), 1), lambda before, behind: F.coalesce(before, behind))
        return F.zip_with(held, nearest, lambda b, clause: F.when(
            F.coalesce(is_paragraph(b) & (b["section"] == "") & (F.regexp_extract(b["label"], pattern, 1) == clause), F.lit(False)),
            changed(b, element("p", F.regexp_extract(b["label"], pattern, 2)))).otherwise(b))

    return let(blocks, run)


def numeric_headings(blocks: Column) -> Column:
    """LEG-17: headings that are only a page number."""
    return dropped_if(blocks, lambda b, p, n: is_heading(b) & plain_inside(b) & strip(b["inner"]).rlike(r"\A\d{1,4}\z"))


def number_ladders(blocks: Column) -> Column:
    """LEG-01: paragraphs of line numbers only."""
    return dropped_if(blocks, lambda b, p, n: is_paragraph(b) & b["label"].rlike(r"\A\d{1,3}(?: \d{1,3})+\z"))


def typed_headings(blocks: Column) -> Column:
    """LEG-01: paragraphs, lines of a paragraph and bold beginnings that are legal headings become such; headings get their level."""
    bold = r"(?is)\A\s*<(strong|b)\b[^>]*>(.*?)</\1\s*>(.*)\z"

    def parts_of(b: Column) -> Column:
        """Labels that may be headings: the lines of a paragraph with breaks, its bold beginning and rest, or the whole."""
        pieces = (
            F.when(is_paragraph(b) & b["inner"].rlike(r"(?i)<br\b"), F.split(b["inner"], r"(?i)<br\s*/?>"))
            .when(is_paragraph(b) & b["inner"].rlike(bold), F.array(F.regexp_extract(b["inner"], bold, 2), F.regexp_extract(b["inner"], bold, 3)))
            .otherwise(F.array(b["inner"]))
        )
        return F.filter(F.transform(pieces, lambda x: squash(strip_tags(x), " -|:")), lambda x: x != "")

    def rule(b: Column) -> Column:
        leveled = F.transform(parts_of(b), lambda x: F.when(x.rlike(HEADING_START), let(canonical_heading(x), lambda head: F.struct(
            head.alias("text"), heading_level(head).alias("level")))).otherwise(F.struct(x.alias("text"), F.lit(None).cast("string").alias("level"))))

        def made(ls: Column) -> Column:
            listed = is_paragraph(b) & b["inner"].rlike(r"(?i)<br\b")
            kept = F.filter(ls, lambda x: x["level"].isNotNull() | ~(listed & x["text"].rlike(r"\A\d{1,3}\z")))
            blocks_ = F.transform(kept, lambda x, i: changed(b, F.when(is_heading(b), retagged(b, x["level"], x["text"])).when(
                x["level"].isNotNull(), element(x["level"], x["text"])).otherwise(element("p", x["text"]))).withField("before", F.when(i == 0, b["before"]).otherwise("")))
            wanted = F.when(listed, F.exists(ls, lambda x: x["level"].isNotNull())).otherwise(F.get(ls, F.lit(0))["level"].isNotNull())
            same = is_heading(b) & (F.get(ls, F.lit(0))["level"] == b["name"]) & (F.get(ls, F.lit(0))["text"] == b["label"])
            return F.when(F.coalesce(wanted & ~same, F.lit(False)), blocks_).otherwise(F.array(b))

        return F.when(is_heading(b) | is_paragraph(b), let(leveled, made)).otherwise(F.array(b))

    return F.flatten(F.transform(blocks, rule))


# --- Rules on texts --------------------------------------------------------------------------


def settled(rule):
    """The rule with dropped blocks gone and facts of changed ones worked out."""
    return lambda blocks: (refreshed if rule in REWRITING else pruned)(rule(blocks))


def on_blocks(*rules):
    """The rules as a function of a text."""

    def apply(html: Column) -> Column:
        blocks = cut(html)
        for rule in rules:
            # Behind the last rule only the source of a block counts.
            blocks = rule(blocks) if rule is rules[-1] else settled(rule)(blocks)
        return render(blocks)

    apply.__doc__ = " ".join(r.__doc__ or "" for r in rules)
    return apply


def strip_front_contents(html: Column) -> Column:
    """LEG-07: a printed contents list (dot leaders and structure headings) before the first clause."""
    def run(body: Column) -> Column:
        block = F.regexp_extract(body, CONTENTS_BLOCK, 2)
        printed = (count_matches(block, r"\.{5,}\s*\d{1,4}\b") >= 6) & (
            count_matches(block, rf"(?i)<h[1-6]\b[^>]*>\s*{STRUCTURE}\b") >= 3
        )
        return F.when(printed, rewrite_first(body, CONTENTS_BLOCK, r"\1" + "\n")).otherwise(body)

    return let(html, run)


def unwrap_footer_markers(html: Column) -> Column:
    """HTM-24: a page marker is content, not a footer."""
    return rewrite(html, [FOOTER_MARKER])


merge_split_references = on_blocks(split_references)
strip_reordered_heads = on_blocks(reordered_heads)
merge_continuations = on_blocks(continuations)
demote_fragments = on_blocks(fragments)
dedupe_same_structure = on_blocks(same_structure)
split_spliced_subsections = on_blocks(spliced_subsections)
dedupe_restart_blocks = on_blocks(restart_runs)
strip_restart_sections = on_blocks(restart_sections)
strip_breadcrumb_runs = on_blocks(breadcrumb_runs)
strip_fused_prefixes = on_blocks(prefixed_sections)
strip_numeric_headings = on_blocks(numeric_headings)

#: Rules whose changed blocks later rules look at again.
REWRITING = [continuations, spliced_subsections, prefixed_sections, typed_headings]
#: Steps on the text before it is cut, then the rules of the contract in their order.
BEFORE_CUT = [unwrap_footer_markers, strip_front_contents]
RULES = [
    reordered_heads,
    breadcrumb_runs,
    number_ladders,
    split_references,
    clause_trails,
    typed_headings,
    continuations,
    spliced_subsections,
    same_structure,
    fragments,
    prefixed_sections,
    restart_sections,
    redundant_sections,
    known_sections,
    restart_runs,
    repeated_structures,
    numeric_headings,
]
CONTRACT = [*BEFORE_CUT, cut, *map(settled, RULES), render]
