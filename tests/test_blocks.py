"""Legal rules on blocks: literal cases for each rule, and scans against loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quirekit.functions import legal, scan
from quirekit.operators.documents import prepare_save, sanitize_output


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


CASES = [
    (legal.repeated_structures, "<h2>Chapter 1 A</h2><p>x</p><h2>Chapter 1 A</h2><h2>Chapter 1 B</h2><p>CHAPTER 1 a</p>", "<h2>Chapter 1 A</h2><p>x</p><h2>Chapter 1 B</h2>"),
    (legal.known_sections, "<h4>3 Fees</h4>" + p(*"abcdefghij", "Section 3", "Section 4"), "<h4>3 Fees</h4>" + p(*"abcdefghij", "Section 4")),
    (legal.known_sections, p("Section 5", *"abcde") + "<h4>5 Costs</h4>", p(*"abcde") + "<h4>5 Costs</h4>"),
    (legal.known_sections, p("Section 5", *"abcdef") + "<h4>5 Costs</h4>", p("Section 5", *"abcdef") + "<h4>5 Costs</h4>"),
    # as of its place: the nearest clause before, however far; without one the nearest behind
    (legal.prefixed_sections, "<h4>7 A thing</h4>" + p(*"abcdefghijk", "Section 7 (a) one", "Section 8 (a) two") + "<h4>8 B thing</h4>",
     "<h4>7 A thing</h4>" + p(*"abcdefghijk", "(a) one", "Section 8 (a) two") + "<h4>8 B thing</h4>"),
    (legal.prefixed_sections, p("Section 8 (a) two", "z") + "<h4>8 B thing</h4>", p("(a) two", "z") + "<h4>8 B thing</h4>"),
    (legal.breadcrumb_runs, p("[Original Page Number: 4]", *(f"Part {i} Orders" for i in range(1, 7)), "text."), p("[Original Page Number: 4]", "text.")),
    (legal.breadcrumb_runs, p("[Original Page Number: 4]", "Part 1 Orders", "text.", "Part 2 Orders", "Division 1 Fines"), p("[Original Page Number: 4]", "Part 1 Orders", "text.", "Part 2 Orders", "Division 1 Fines")),
    (legal.clause_trails, p("Part 1 Who<br>Division 2 What") + "<h4>4 Costs</h4>", "<h4>4 Costs</h4>"),
    (legal.clause_trails, p("Part 1 Who<br>and more text") + "<h4>4 Costs</h4>", p("Part 1 Who<br>and more text") + "<h4>4 Costs</h4>"),
    (legal.redundant_sections, "<h4>Section 9</h4><h4>9 Aims</h4>" + p("[Original Page Number: 2]", "Section 10", "Section 11"), "<h4>9 Aims</h4>" + p("[Original Page Number: 2]", "Section 11")),
    (legal.number_ladders, p("1 2 3", "12", "1 2 three"), p("12", "1 2 three")),
    (legal.typed_headings, p("intro<br>Part 2 Powers<br>14", "<b>3 Aims</b> of this", "Chapter 1 Start") + "<h2 class='x'>Part 4-Costs</h2>",
     p("intro") + "<h3>Part 2 Powers</h3><h4>3 Aims</h4>" + p("of this") + "<h2>Chapter 1 Start</h2><h3 class='x'>Part 4 Costs</h3>"),
    (legal.restart_runs, "<h2>Chapter 1 A</h2><h3>Part 1 B</h3><h4>Division 1 C</h4>" * 2 + "<h2>Chapter 1 A</h2>", "<h2>Chapter 1 A</h2><h3>Part 1 B</h3><h4>Division 1 C</h4>" * 2 + "<h2>Chapter 1 A</h2>"),
    (legal.split_references, p("under Part") + "<h3>4.</h3>" + p("the Rules") + "<h3>1999.</h3>" + p("see word 12") + "<h3>3.</h3>", p("under Part 4.", "the Rules 1999.", "see word 12") + "<h3>3.</h3>"),
]


def test_rules(spark):
    for rule in dict.fromkeys(r for r, *_ in CASES):
        given = [(i, html) for i, (r, html, _) in enumerate(CASES) if r is rule]
        got = spark.createDataFrame(given, "i int, html string").select("i", legal.on_blocks(rule)(F.col("html")).alias("r")).collect()
        assert {r.i: r.r for r in got} == {i: CASES[i][2] for i, _ in given}, rule.__name__


def test_blocks_keep_every_text(spark):
    texts = ["", "no tags", "<p>open", "<main>\n<p class='a'>x</p>\n\n text <ol><li><p>in</p></li></ol><h2>y</h2> tail</main>", "<table><tr><td><p>Part 1 A</p></td></tr></table>"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, html string")
    assert {r.i: r.r for r in frame.select("i", legal.on_blocks(legal.numeric_headings)(F.col("html")).alias("r")).collect()} == dict(enumerate(texts))


def test_scans(spark):
    draw = random.Random(1)
    rows = [[draw.choice([None, 1, 2, 3]) for _ in range(n)] for n in (0, 1, 2, 3, 7, 8, 9, 100)]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<int>")
    got = frame.select("i", scan.last_known(F.col("v"), "int").alias("last"), scan.next_known(F.col("v"), "int").alias("next"), scan.first_of_each(F.col("v")).alias("first")).collect()
    for r in got:
        row, held, last = rows[r.i], None, []
        for x in row:
            held = x if x is not None else held
            last.append(held)
        assert r.last == last
        assert r["next"] == [next((x for x in row[i:] if x is not None), None) for i in range(len(row))]
        assert r.first == [x is not None and x not in row[:i] for i, x in enumerate(row)]


def test_pages_are_saved_their_own_way(spark):
    page = "```html\n<html><body><main><h2 style='a'>Chapter 1<br>Orders</h2><table><tr><td>£3 at Main-road.- Then</td></tr></table><h4>1 Fees</h4><p>Section 1 (a) one</p></main></body></html>\n```"
    frame = spark.createDataFrame([(0, page, "html", "legal"), (1, page, "html", "standard"), (2, page, "txt", "legal")], "i int, body string, fmt string, profile string")
    on, off = F.lit(True), F.lit(False)
    flags = {"modernize_punctuation": on, "unit_conversion": on, "abbrev_expansion": off, "merge_files": off}
    got = {r.i: r.body for r in prepare_save(frame, "body", F.col("fmt"), F.col("profile"), flags).collect()}
    assert "<td>3 pounds at Main Road. Then</td>" in got[0] and "<h2>Chapter 1 Orders</h2>" in got[0] and "<p>(a) one</p>" in got[0]
    assert "<p>Section 1 (a) one</p>" in got[1] and "<table>" in got[1] and "<html" not in got[1] and "style=" not in got[1]
    assert "<td>" not in got[2] and "3 pounds at Main Road. Then" in got[2]


def test_books_get_the_plain_text_pass(spark):
    frame = spark.createDataFrame([(0, "He said 'yes' to it", "txt", "book"), (1, "He said 'yes' to it", "txt", "standard")], "i int, body string, fmt string, profile string")
    got = {r.i: r.body for r in sanitize_output(frame, "body", F.col("fmt"), F.col("profile"), pages=False).collect()}
    assert got == {0: 'He said "yes" to it', 1: "He said 'yes' to it"}
