from __future__ import annotations

import html
import itertools
import random
import re
import time

from quirekit.llm import main_content as main


def article(page):
    """The stored pages' article, read by its own plain rules."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = re.split(r"</?(?:p|h1|h2|ul|li|div)[^>]*>", inner)
    lines = (" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n".join(x for x in lines if x)


def test_stored_pages(table):
    pages, rows = table("pages")
    got = {r.page_id: r for r in main.extract_pages(pages).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_region_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-3.0, -1.0, 0.5, 2.0]) for _ in range(rng.randint(0, 25))]
        start, end = main.best_region(scores)
        best = max([0.0, *(sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2))])
        assert sum(scores[start:end]) == best


def test_boilerplate_inside_and_around_the_content():
    page = """<html><body><header><a href=/>Site</a> Daily news</header><nav><a>Home</a><a>About</a></nav>
    <div class="cookie-notice">We use cookies</div><main><article><h1>A title &amp; more</h1><p>First   paragraph
    with <b>bold</b> words.<p>Second, unclosed <aside>Read also this</aside><div class='ad'>Buy now</div><p>Third&nbsp;one<br>goes on</p>
    <form><label>Mail</label><button>Join</button></form><script>var x = "<p>no</p>";</script><section id="comments"><p>I disagree</p></section>
    <ul><li>point one<li>point two</ul></article></main><aside>Popular</aside><footer>&copy; 2024</footer></body></html>"""
    assert main.extract(page, {}) == "A title & more\nFirst paragraph with bold words.\nSecond, unclosed\nThird one goes on\npoint one\npoint two"


def test_broken_pages():
    for page in ("", "<", "<p", "plain words", "<!-- open", "<script>only", "<a href='x", "</p></p>", "<p>one<p>two</div>three", "<table><tr><td>a<td>b<tr><td>c"):
        main.extract(page, {})
    assert main.extract("<p>one<p>two", {}) == "one\ntwo"
    assert main.extract("<table><tr><td>a<td>b<tr><td>c</table>", {}) == "a\nb\nc"
    assert main.extract("<p>" + "<b>" * 3000 + "deep", {}) == "deep"


def test_layout_words_are_no_boilerplate():
    article = "<article{}><h1>Title</h1><p>Some words of the text.</p></article>"
    text = "Title\nSome words of the text."
    for page in (
        "<body class='single no-sidebar'>" + article.format(""),
        "<body class='search ads'>" + article.format(" class='post comments-open'"),
        "<html class=nav><body><div class='row no-ads'>" + article.format(""),
        "<div class='page with-sidebar'>" + article.format(" id=post-1") + "</div>",
        "<div class='sidebar-wrapper widget'><main>" + article.format("") + "</main></div>",
        "<div id=header-and-all class=header>" + article.format("") + "</div>",
        "<article><div class='entry-header'><h1>Title</h1></div><p>Some words of the text.</p></article>",
        "<article title='class=ad id=nav'><h1>Title</h1><p>Some words of the text.</p></article>",
        "<article title=it's><h1>Title</h1><p>Some words of the text.</p></article>",
    ):
        assert main.extract(page, {}) == text, page


def test_named_boilerplate_still_goes():
    page = "<article><p>Kept words of the article.</p><div class='{}'>Left out</div></article>"
    for name in ("ad", "post-comments", "sidebar", "sidebar-left", "ad-right", "single-comment", "nav-active", "cookie-notice", "site-header", "x related-posts"):
        assert main.extract(page.format(name), {}) == ("Kept words of the article."), name
    replies = "<article><p>Kept words of the article.</p></article><div class=comments><article class=comment><p>I disagree</p></article></div>"
    assert main.extract(replies, {}) == "Kept words of the article."


def test_whole_article_behind_empty_elements():
    page = "<body><nav>Home</nav><article><p>First words here.</p>" + "<div></div>" * 60 + "<br>" * 200 + "<p>Last words here.</p></article><footer>End</footer>"
    assert main.extract(page, {}) == "First words here.\nLast words here."
    page = "<body><nav>Home</nav><div><p>First words here.</p>" + "<div><b></b></div>" * 60 + "<p>Last words here.</p></div><footer>End</footer>"
    assert main.extract(page, {}) == "First words here.\nLast words here."


def test_time_is_linear_on_broken_pages():
    for part in ("<b>x", "<div class=ad>x", "<a b='x", "</i><p>x", "<li>x<td>", "<!-- x", "<x =\"", "<script>"):
        times = []
        for size in (100_000, 800_000):
            page = part * (size // len(part)) + ("'" if "'" in part else "")
            begun = time.process_time()
            main.extract(page, {})
            times.append(time.process_time() - begun)
        assert times[1] < 24 * times[0] + 0.5, (part, times)


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>text</p>"), (3, "u", "<p>text</p>"), (None, None, "<article><p>" + "word " * 50_000 + "</article>")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = main.extract_pages(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 4, 4, 249_999]
    assert main.extract_pages(pages.limit(0)).count() == 0
