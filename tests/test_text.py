from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quirekit.functions import fixed, flow, glossary, lines, sinks, state, text

CASES = [
    (text.clean_artifacts, "Itâ€™s “so” – Âx", "It's \"so\" - x"),
    (text.strip_tags, "<p>a<br/>b &amp; &lt;c&gt;</p>\n d", "a b & <c> d"),
    (text.fold_latin1, "é漢🙂x", "é??x"),
    (text.modernize_punctuation, "Main-road.- Next ,-x and y.-", "Main Road. Next , x and y."),
    (text.modernize_currency, "£3/10/- and 7/-, 3d. £9", "3 pounds, 10 shillings and 7 shillings, 3 pence 9 pounds"),
    (text.dialogue_quotes, "'Tis the 'end', don't", "'Tis the \"end\", don't"),
    (text.repair_scan_wraps, "walk-ing re-ed well-known", "walking re-ed well-known"),
    (text.numeric_quote_noise, '"12" - 3\nsay "12"', '12 - 3\nsay "12"'),
    (text.markdown_headings_to_html, "# A & b\ntext\n### C", "<h1>A &amp; b</h1>\ntext\n<h3>C</h3>"),
    (text.strip_placeholder_images, "<figure><img src='IMAGE_URL_3'></figure>x", "x"),
    (text.audit_key, "A-b 9!", "ab9"),
    (text.normalize_scope, " 1 2 ; 3 - 5,,", "1,2,3-5"),
    (text.clean_title, "war_diary-page_12", "War Diary"),
    (text.clean_title, "Document", ""),
    (text.redact_secrets, "api_key: abcdefghijklmnop sk-abcdefghijklmnopqrstuvwx", "api_key: [redacted] [redacted]"),
    (text.publication_date, "x SYDNEY, MONDAY, MARCH 4, 1912. y", "SYDNEY, MONDAY, MARCH 4, 1912"),
    (sinks.line_kind, " ## a", "heading2"),
    (sinks.line_kind, "|a|b|", "table"),
    (sinks.csv_payload, "```csv\na,b\n```", "a,b"),
    (sinks.json_payload, 'bad "json', '{"extracted_content":"bad \\"json"}'),
]


@pytest.mark.parametrize("fn,given,expected", CASES)
def test_literal_cases(apply, fn, given, expected):
    assert apply(fn, [given]) == [expected]


@pytest.mark.parametrize("fn", [text.clean_artifacts, text.visible_text, text.audit_key, text.normalize_scope, text.redact_secrets])
def test_idempotent(apply, fn):
    samples = ["<p>a</p> “x” – key=abcdefghijklmnop", "", "1 ; 2 - 3", "Â â€™ <b>c</b>"]
    once = apply(fn, samples)
    assert apply(fn, once) == once


def scan_quotes(s: str) -> str:
    """A character-by-character model of the dialogue-quote rule."""
    words = "|".join(fixed.LEADING_ELISIONS)
    out = []
    for i, c in enumerate(s):
        before, after = s[i - 1 : i] if i else "", s[i + 1 : i + 2]
        keep = c != "'" or (before.isalnum() and after.isalnum())
        keep = keep or (not before.strip() and re.match(rf"(?:{words})\b", s[i + 1 :], re.I))
        out.append(c if keep else '"')
    return "".join(out)


def test_dialogue_quotes_match_a_scan(apply):
    rng = random.Random(7)
    samples = ["".join(rng.choice("ab 'é'.\n") for _ in range(40)) + " 'tis 'emx 'round" for _ in range(200)]
    assert apply(text.dialogue_quotes, samples) == [scan_quotes(s) for s in samples]


def loop_batches(chunks, target):
    batches, held, size = [], [], 0
    for chunk in (c for c in chunks if c):
        if held and size + len(chunk) > target:
            batches.append("\n".join(held))
            held, size = [], 0
        held.append(chunk)
        size += len(chunk)
    return batches + (["\n".join(held)] if held else [])


def test_greedy_batches_match_a_loop(apply):
    rng = random.Random(3)
    samples = ["|".join("x" * rng.randint(0, 9) for _ in range(rng.randint(1, 12))) for _ in range(100)]
    got = apply(lambda c: lines.greedy_batches(F.split(c, r"\|"), 12), samples)
    assert got == [loop_batches(s.split("|"), 12) for s in samples]


def test_line_chunks_keep_every_line(apply):
    rng = random.Random(5)
    samples = ["\n".join("y" * rng.randint(0, 30) for _ in range(20)) for _ in range(30)]
    for given, got in zip(samples, apply(lambda c: lines.line_chunks(c, 50), samples)):
        assert "".join(got) == given + "\n"
        assert all(len(chunk) <= 50 + 1 or chunk.count("\n") == 1 or len(chunk) <= 81 for chunk in got)


def test_scope_round_trip(apply):
    scopes = ["1-3,5", "2", "1,3,5-9", ""]
    pages = lambda c: lines.scope_pages(c, F.lit(9))
    got = apply(lambda c: lines.compact_scope(pages(c)), scopes)
    assert got == ["1-3,5", "2", "1,3,5-9", "1-9"]
    assert apply(pages, ["1,3,5-7,6"]) == [[1, 3, 5, 6, 7]]


def test_scope_errors(apply):
    got = apply(lambda c: lines.scope_error(c, F.lit(4)), ["1-4", "5", "3-1", "2-x", "a", "0", "all"])
    assert got[0] is None and got[6] is None
    assert got[1] == "Page 5 exceeds this PDF's length of 4 pages."
    assert "greater than or equal" in got[2] and "Only numbers" in got[3]
    assert got[4].startswith("Invalid page value 'a'") and got[5] == "Page numbers must start at 1."
    assert apply(lines.scope_is_valid, ["1-4", "4-1", "x", "0", "1,2"]) == [True, False, False, False, True]


def test_page_markers_are_filled(apply):
    given = "a\n[Original Page Number: 2]\nb\n[Original Page Number: 5]\n[Original Page Number: 5]\nc"
    want = "a\n[Original Page Number: 2]\nb\n[Original Page Number: 3]\n[Original Page Number: 4]\n[Original Page Number: 5]\nc"
    assert apply(lines.fill_page_markers, [given, "plain"]) == [want, "plain"]


def test_book_text(apply):
    given = "x## Part One\n'hello there' walk-ing\n\n\n\nthe end"
    assert apply(text.book_text, [given]) == ["x\n## Part One\n\"hello there\" walking\n\nthe end"]


def test_reflow(apply):
    given = "Dear all,\nthis is a line\nEnd.\nCHAPTER ONE\nand so on"
    want = ["Dear all, this is a line", "End.", "CHAPTER ONE and so on"]
    assert apply(lambda c: flow.reflow(lines.content_lines(c)), [given]) == [want]


def test_glossary_order_and_tags(apply):
    def expand(profile):
        return lambda c: glossary.expand_abbreviations(c, F.lit(profile))

    given = 'R.N. Lt. Gray <b title="Lt">Capt</b> at the rd.'
    assert apply(expand("military"), [given]) == ['Royal Navy Lieutenant Gray <b title="Lt">Captain</b> at the rd.']
    assert apply(expand("legal"), ["MP Lt. Gray"])[0].startswith("Member of Parliament Lt. Gray")
    own = lambda c: glossary.expand_abbreviations(c, F.lit("military"), [("Lt", "Light"), ("Xy", "Xylophone")])
    assert apply(own, ["Lt. xy"]) == ["Light Xylophone"]


def test_one_pass_equals_entry_by_entry(apply):
    rng = random.Random(11)
    rules = [(glossary.pattern_of(a), w) for a, w in glossary.entries_for("archival")]
    words = ["Lt", "Gen.", "GEN", "R.A.A.F", "RAF", "inst", "xinst", "us", "U.S", "the", "U.S.", "Maj.Gen", "é", "col", "Hon.", "CO.", "NCO."]
    samples = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(60)]
    chain = lambda c: text.rewrite(c, rules)
    assert apply(lambda c: glossary.expand_abbreviations(c, F.lit("archival")), samples) == apply(chain, samples)


def test_progress_header_round_trip(apply):
    payload = '{"completed_units":3,"total_units":9}'
    header = apply(state.progress_header, [payload])
    assert len(header[0]) == fixed.PROGRESS_HEADER_BYTES
    assert apply(state.progress_payload, [header[0], "nothing"]) == [payload, None]


def test_overlay_last_wins(spark):
    base, over = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))
    row = spark.range(1).select(state.canonical_json(state.overlay(base, over)).alias("r")).first()
    assert row.r == '{"a":"1","b":"3"}'


def test_shared_text_steps_leave_plain_text_alone(apply):
    """A lone space is no match of the blank pattern; texts with and without entities, tags and odd characters come out as before."""
    import re

    from quirekit.functions import fixed
    from quirekit.functions.rewrite import BLANK_RUN, squash

    assert re.search(BLANK_RUN.replace(r"\x{A0}", r"\xa0"), "words with lone spaces") is None
    blanks = ["a b", " a  b ", "a b", "a   b", "a\n\tb \n c", " ", "", None, "a\r\n", "a \x0b\x0cb"]
    assert apply(squash, blanks) == [v if v is None else re.sub(r"[ \t\n\r\x0b\x0c\xa0]+", " ", v).strip(" \t\n\r\x0b\x0c") for v in blanks]
    values = ["plain", "R&amp;D &lt;b&gt;", "&amp;lt;", "<p>a<br/>b</p>", "it’s â€œso”", "café Â x", "a & b", "a < b > c", "", None]

    def by_hand(value):
        if value is None:
            return None
        value = re.sub(r"<[^>]+>", " ", re.sub(r"(?i)<br\s*/?>", " ", value))
        for old, new in fixed.HTML_ENTITIES:
            value = value.replace(old, new)
        value = re.sub(r"[ \t\n\r\x0b\x0c\xa0]+", " ", value).strip(" \t\n\r\x0b\x0c")
        for old, new in fixed.TEXT_ARTIFACTS:
            value = value.replace(old, new)
        return value

    assert apply(text.strip_tags, values) == [by_hand(v) for v in values]


def test_rules_skipped_without_their_needs_lose_no_match(apply):
    from quirekit.functions import html, text
    from quirekit.functions.rewrite import RuleIn, rewrite

    rules = [*text.PUNCTUATION_RULES, *text.CURRENCY_RULES, *text.LABEL_HTML_RULES, *text.REFUSAL_RULES, *html.FENCE_RULES, *html.ATTRIBUTE_RULES]
    held = [rule for rule in rules if isinstance(rule, RuleIn)]
    assert len(held) > 25
    given = [
        "Main-ROAD.- bay-Street ,- a,-b £3/4/- 7/- £9", "<H2 a>Source  Page 3, strip 4</H2> STRIPE 5 Text LAYER fallback [x]",
        "<p data-STRIP='a' style=\"b\" ID='c'>[ x ]</p><STYLE>y</STYLE><Script>z</sCript>", "```HTML\n<!doctype x><?XML y><b>c</b>\n``` ",
        "I AM unable to Provide a transcription because the image is completely blank. == end of OCR for page 3 ==\n[Original Page Number: 7]\n7\n", "plain words",
    ]
    for rule in held:
        assert apply(lambda c, r=rule: rewrite(c, [r]), given) == apply(lambda c, r=rule: rewrite(c, [tuple(r)]), given), rule


def test_blank_runs_are_found_by_one_class():
    from quirekit.functions.rewrite import BLANK_RUN

    # Choices at the head are tried at every character of a text.
    assert "|" not in BLANK_RUN
    java = BLANK_RUN.replace(r"\x{A0}", r"\xa0")
    given = " a  b\tc \n d\xa0e\xa0 f g \x0b"
    assert re.sub(java, " ", given) == re.sub(r"[ \t\n\x0b\f\r\xa0]+", " ", given)


def test_glossary_pattern_by_first_letter(apply):
    from quirekit.functions.glossary import expand_with

    entries = [("RAF", "Royal Air Force"), ("RA", "Royal Artillery"), ("Rd", "Road"), ("Rdx", "Road X"), ("yr", "year")]
    given = ["R.A.F. RAF. raf R.A. rd. RDX Yr <b yr>yr</b> xrd rd9 ard", "a < b yr"]
    assert apply(lambda c: expand_with(c, entries), given) == [
        "Royal Air Force Royal Air Force raf Royal Artillery Road Road X year <b yr>year</b> xrd rd9 ard", "a < b year"]
