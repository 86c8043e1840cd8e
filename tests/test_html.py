from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quirekit.functions import html, legal, qa
from quirekit.functions.classify import is_page_furniture, looks_legal, may_be_legal
from quirekit.functions.text import strip_tags, visible_text
from quirekit.operators.documents import HEADING_PASSES, normalize_documents, staged, staged_pages


def main(body):
    return f"<main>{body}</main>"


CASES = [
    (html.promote_leading_paragraphs, "<p>Section 12</p><p>x</p>", "<h1>Section 12</h1><p>x</p>"),
    (html.promote_leading_paragraphs, "<p>THE LONG DAY</p><p>THE END</p>", "<h1>THE LONG DAY</h1><h2>THE END</h2>"),
    (html.promote_leading_paragraphs, "<p>Sept. 1914 WAR DIARY of the unit 12</p>", "<h1>WAR DIARY</h1>\n<p>of the unit</p>"),
    (html.promote_list_section, "<p>Topics</p><ul><li><strong>A</strong> x</li><li><strong>B</strong></li></ul>",
     "<h1>Topics</h1>\n<ul><li><h2>A</h2> x</li><li><strong>B</strong></li></ul>"),
    (html.promote_numbered_instructions, "<p>Steps</p><p>1. Open. the door</p><p>2. Close. it</p>",
     "<h1>Steps</h1><h2>1. Open</h2>\n<p>the door</p><p>2. Close. it</p>"),
    (html.promote_context_paragraph, "<p>Chapter 3 Overview</p><h2>Body</h2>", "<h1>Chapter 3 Overview</h1><h2>Body</h2>"),
    (html.promote_index, "<h2>INDEX</h2><p>a</p>", "<h1>INDEX</h1>\n<h2>Index Entries</h2><p>a</p>"),
    (html.promote_bold_after_h1, "<h1>T</h1><p><b>Sub</b></p>", "<h1>T</h1><h2>Sub</h2>"),
    (html.promote_short_h2, "<h2>One</h2><p>x</p><h2>Two</h2>", "<h1>One</h1><p>x</p><h2>Two</h2>"),
    (html.promote_strong_paragraphs, "<p><b>First</b><br>a</p><p><strong>Second</strong><br/>b</p>",
     "<h1>First</h1>\n<p>a</p><h2>Second</h2>\n<p>b</p>"),
    (html.promote_definition_list, "<p>Terms</p><dl><dt>Alpha</dt><dd>x</dd></dl>",
     "<h1>Terms</h1>\n<dl><h2>Alpha</h2><dd>x</dd></dl>"),
    (html.promote_figure_followup, "<figure>f</figure>\nA Loose Caption\n<p>x</p>", "<figure>f</figure>\n<h1>A Loose Caption</h1>\n\n<p>x</p>"),
    (html.promote_sparse_blocks, "<p>A Good Heading</p><p>Second Heading</p><p>and more</p>",
     "<h1>A Good Heading</h1>\n<h2>Second Heading</h2>\n<p>and more</p>"),
    (html.heading_hierarchy, "<h2>a</h2><h3>b</h3><h3>c</h3>", "<h1>a</h1><h2>b</h2><h2>c</h2>"),
    (html.promote_numbered_clauses, "<p><b>12A Objects</b></p><p><b>note.</b></p>", "<h3>12A Objects</h3><p><b>note.</b></p>"),
    (html.strip_page_furniture, "<p>12</p><p>real text</p><footer>Privacy Act 1988 4</footer>", "<p>real text</p>"),
    (html.form_semantics, '<input type="checkbox" checked> Yes<input type=radio>', "[Radio Button: Selected] Yes[Radio Button: Empty]"),
    (html.flatten_heading_breaks, "<h2>a<br/>\n b</h2>", "<h2>a b</h2>"),
    (legal.demote_fragments, "<h2>3 March 1999</h2><h3>Part 2 of Chapter 3</h3><h2>Chapter 1 Start</h2>",
     "<p>3 March 1999</p><p>Part 2 of Chapter 3</p><h2>Chapter 1 Start</h2>"),
    (legal.merge_split_references, "<p>see sections 4 and</p><h3>12.</h3>", "<p>see sections 4 and 12.</p>"),
]


@pytest.mark.parametrize("fn,given,expected", CASES)
def test_block_rewrites(apply, fn, given, expected):
    assert apply(fn, [main(given)]) == [main(expected)]


@pytest.mark.parametrize("fn", [c[0] for c in CASES[:15]])
def test_no_main_no_promotion(apply, fn):
    given = "<p>SECTION ONE</p><p>x</p>"
    if fn is not html.promote_numbered_clauses:
        assert apply(fn, [given]) == [given]


def sweep(tokens):
    """Repeated-run removal by repeated sweeps, widest runs first."""
    for width in range(6, 0, -1):
        changed = True
        while changed:
            changed, out, i = False, [], 0
            while i < len(tokens):
                run, following = tokens[i : i + width], tokens[i + width : i + 2 * width]
                if len(following) == width and run == following and all(t.startswith("<p") for t in run):
                    out += run
                    i += 2 * width
                    changed = True
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
    return "".join(tokens)


def test_paragraph_dedupe_matches_sweeps(apply):
    rng = random.Random(1)
    samples = []
    for _ in range(150):
        tokens = [f"<p>{rng.choice('ab')}</p>" for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.5:
            tokens.insert(rng.randint(0, len(tokens)), "<hr>")
        samples.append(tokens)
    assert apply(html.dedupe_paragraphs, ["".join(t) for t in samples]) == [sweep(t) for t in samples]


def test_toc_prefers_fullest_heading(spark):
    page = main("<h1>Top</h1><h2>Part one</h2><h2>2023</h2><h3>PART ONE!</h3><h2>Top</h2>")
    frame = spark.createDataFrame([(page,)], "html string").withColumn("toc", html.toc_rows(F.col("html")))
    row = frame.select("toc", html.inject_toc(F.col("html"), F.col("toc")).alias("page")).first()
    assert [(r.level, r.title) for r in row.toc] == [(1, "Top"), (3, "PART ONE!")]
    assert '<li><a href="#heading-3">PART ONE!</a></li>' in row.page
    assert row.page.index("<nav") < row.page.index('<h1 id="heading-1">Top</h1>')


def test_running_heads_go_only_with_repeats(apply):
    head = "<hr><header><h1>The Age</h1></header><h2>{}</h2>"
    three, two = main("".join(head.format(n) for n in "abc")), main("".join(head.format(n) for n in "ab"))
    got = apply(html.strip_running_head_h1s, [three, two])
    assert got == [main("<hr><h2>a</h2><hr><h2>b</h2><hr><h2>c</h2>"), two]


def test_profile_headings(spark):
    rows = [("medical", "<p>12</p>"), ("comic", "<p>Bam</p>"), ("archival", "<p>Letter</p><p>x</p>"), ("legal", "<p>x</p>")]
    frame = spark.createDataFrame([(i, p, main(b)) for i, (p, b) in enumerate(rows)], "i int, profile string, html string")
    got = [r.r for r in frame.select("i", html.enforce_profile_headings(F.col("html"), F.col("profile")).alias("r")).orderBy("i").collect()]
    assert got == [
        main("<h1>Clinical Note</h1><h2>Page 12</h2><p>12</p>"),
        main("<h1>Bam</h1><h2>Panel 1</h2><p>Bam</p>"),
        main("<h1>Letter</h1><h2>Body</h2><p>x</p>"),
        main("<p>x</p>"),
    ]


def test_title_cover(spark):
    frame = spark.createDataFrame([("<main> </main>", "zoom_call-page_2"), ("<main><p>x</p></main>", "t")], "html string, title string")
    got = [r.r for r in frame.select(html.title_cover(F.col("html"), F.col("title")).alias("r")).collect()]
    assert got == ["<main><h1>Zoom Call</h1>\n<h2>Cover Page</h2>\n</main>", "<main><p>x</p></main>"]


def test_normalize_takes_bodies_of_any_length(spark):
    bodies = ["some words", "y" * 300_000]
    given = [(main(f"<p>SECTION ONE</p><p>{body}</p>"),) for body in bodies]
    got = [r.html for r in normalize_documents(spark.createDataFrame(given, "html string")).collect()]
    assert got == [main(f"<h1>SECTION ONE</h1><p>{body}</p>") for body in bodies]


def test_normalize_cuts_a_page_few_times(spark):
    """Neighbouring rules for the inside of main share one cut, and leaked wrappers are looked for once."""
    plan = normalize_documents(spark.createDataFrame([("<main></main>",)], "html string"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count(html.MAIN_CLOSE) <= 4


def test_one_cut_gives_what_many_give(spark):
    """Pages without, with two or with an unclosed main, and such that one rule or several change."""
    bodies = ["", "x", "<p>SECTION ONE</p><p>x</p>", "<h2>Short</h2><p><b>Bold</b></p><h2>B</h2>", "<h3>Deep</h3><p>x</p>",
              "<p>Topics</p><ul><li><strong>A</strong></li><li><strong>B</strong></li></ul><p>INDEX</p>",
              "<p>Steps</p><p>1. Open. the door</p><p>2. Close. it</p>", "<p>Terms</p><dl><dt>Alpha</dt><dd>x</dd></dl>",
              "<p>List</p>\n<ol><li>First<br>x</li></ol>", "<p>a<ol></ol></p>", "<dl></dl></p><dl></dl>", "Bare title\n\n<p>1. Load. it</p><p>2. Aim. well</p>",
              "<h2>INDEX</h2>", "<header>INDEX</header>", "<h1>T</h1><p><b>Sub</b></p><p><strong>12A Objects</strong></p>"]
    pages = [w.replace("@", b) for b in bodies for w in ("<main>@</main>", "@", "a<MAIN id='x'>@</main >b<main>@</main>", "<main>@")] + [None]
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    shown = lambda made: [r.html for r in made.orderBy("i").collect()]
    assert shown(staged_pages(frame, "html", HEADING_PASSES)) == shown(staged(frame, "html", HEADING_PASSES))


def test_lists_are_not_looked_for_from_every_paragraph(apply):
    """Time for a page of paragraphs without a list grows with its length, not with its square."""
    page = main("".join(f"<p>the words of paragraph number {i}, which is as long as any other one in this text</p>" for i in range(6000)))
    start = time.perf_counter()
    assert apply(html.promote_ordered_list, [page]) == [page] and apply(html.promote_definition_list, [page]) == [page]
    assert time.perf_counter() - start < 8


def test_skipped_blocks_hold_nothing_to_find(spark):
    """What the cheap tests rule out, the whole tests do not hold for: with entities, tags, breaks inside tags and broken encodings."""
    bits = ["12", "xii", "page 4", "4a", "No. 4, 2023", "Privacy Act 1988", "Tax Rules 2004", "act1988", "fact", "words", "SECTION 4", "Part 2", "Chapter", "enacts",
            "This Act", "&nbsp;", "&amp;nbsp;", "&ndash;", "&#160;", "\u00c2", "\u00c2\u00a0", "<b>", "</b>", "<br>", "<a<br>b>", "<", "&", " ", "-", "|", "\u2013", "\u00e9", ".", ":"]
    rnd = random.Random(7)
    blocks = [f"<p>{''.join(rnd.choice(bits) for _ in range(rnd.randint(1, 5)))}</p>" for _ in range(6000)]
    frame = spark.createDataFrame(list(enumerate(blocks)), "i int, v string")
    v = F.col("v")
    found = frame.select(
        "v", html.may_be_furniture(v).alias("may"), is_page_furniture(strip_tags(v)).alias("is"),
        may_be_legal(v).alias("may_legal"), looks_legal(visible_text(v)).alias("legal"))
    rows = found.collect()
    assert not [r.v for r in rows if r["is"] and not r.may] and not [r.v for r in rows if r.legal and not r.may_legal]
    assert sum(r["is"] for r in rows) > 300 and sum(not r.may for r in rows) > 300 and any(r.legal for r in rows) and sum(not r.may_legal for r in rows) > 300


def test_normalize_cleans_what_leaked(spark):
    page = '<main><style>p{}</style><div style="x"><h2>One<br>two</h2><p>Some text here.</p></div></main>'
    got = normalize_documents(spark.createDataFrame([(page,)], "html string")).first().html
    assert "One two</h" in got and "<p>Some text here.</p>" in got
    assert not any(left in got for left in ("<style", "style=", "<div", "<br"))


def test_sanitize_html(apply):
    given = "```html\n<html><body><h2 class='a'>A<br>b</h2><p>x</p><p>x</p><script>1</script></body></html>\n```"
    assert apply(html.sanitize_html, [given]) == ["<h2>A b</h2><p>x</p>"]


def test_contract_runs_in_order(spark):
    page = "<h2>Chapter 4 Orders</h2><h3>Part 1 Who</h3><p>X.</p><h2>Chapter 4 Orders</h2><h3>Part 1 Who</h3><h2>14</h2><p>Y.</p>"
    got = staged(spark.createDataFrame([(page,)], "html string"), "html", legal.CONTRACT).first().html
    # the page number belongs to the second run of headings, so only its own rule removes it
    assert "<h2>14</h2>" not in got and got.count("Chapter 4 Orders") in (1, 2)


def test_quality_report(spark):
    rows = [("<h1>A</h1><h2>a</h2>", "html", "book"), ("<table>", "txt", "book"), ("fine", "txt", "book"),
            ("<h2>1 May 2001</h2><h2>part 1 of it</h2>", "html", "legal")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, f string, p string")
    got = [r.q for r in frame.select("i", qa.quality_report(F.col("c"), F.col("f"), F.col("p")).alias("q")).orderBy("i").collect()]
    assert [list(q.warnings) for q in got] == [
        ["adjacent duplicate heading"], ["HTML tag leaked into non-HTML output"], [], ["date-only legal heading"],
    ]
    assert [q.ok for q in got] == [False, False, True, False]
