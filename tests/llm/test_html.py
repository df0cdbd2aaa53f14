"""Whole pages with the text that is expected of them."""

import pytest

from skein.llm import html_extract as H

LONG = "A paragraph of the article, with commas, words and a full stop, long enough to count as prose."


def page(body, around=""):
    return f"<html><body><nav><a href=/>Home</a> <a href=/x>More</a></nav>{around}<article><p>{LONG}</p>{body}<p>{LONG}</p></article></body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<p>foo<script>var x = '<p>';</script>bar</p>", "foobar"),
        ("<p>foo<svg><path d=1></path></svg>bar</p>", "foobar"),
        ('<p>Alpha <svg width="1"/> beta gamma</p>', "Alpha beta gamma"),
        ("<p>one <button>Click</button> two</p>", "one two"),
        ("<p>The <label>small</label> print</p>", "The small print"),
        ('<p title="a hidden gem">kept</p>', "kept"),
        ('<p data-hidden="false" data-id="comments">kept</p>', "kept"),
        ("<p class=legal>Under the law of the sea.</p>", "Under the law of the sea."),
        ("<div class=discussion><p>" + LONG + "</p></div>", LONG),
        ("<div class=tags><a href=/a>one</a> <a href=/b>two</a></div>", ""),
        ("<p hidden>gone</p><div style='display: none'>gone</div>", ""),
        ("<div class='comments'><p>" + LONG + "</p></div>", ""),
        ("<aside><p>" + LONG + "</p></aside>", ""),
        ("<p>caf&eacute; &amp; &#8220;tea&#8221;\n  &nbsp;x</p>", "café & “tea” x"),
        ("<p>one<br>two</p><!-- <p>gone</p> -->", "one two"),
        ("<ul><li>first<li>second</ul>", "first second"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<p><b>bold</b><i>italic</i></p>", "bolditalic"),
    ],
)
def test_parts_of_an_article(body, text):
    assert H.main_text(page(body)) == " ".join(x for x in (LONG, text, LONG) if x)


def test_marks_hold_at_any_depth():
    for deep in (10, 600, 5000):
        inner = "<div>" * deep + f"<p>{LONG}</p><nav>Menu</nav><div class=cookie-notice>{LONG}</div>" + "</div>" * deep
        assert H.main_text(f"<body><article>{inner}</article></body>") == LONG


def test_long_pages():
    paragraphs = [f"Paragraph {i}, with commas, and more words than a menu has." for i in range(20_000)]
    assert H.main_text("<article>" + "".join(f"<p>{x}</p>" for x in paragraphs) + "</article>") == " ".join(paragraphs)


def test_container_and_siblings_without_marks():
    menu = "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(30))
    got = H.main_text(f"<body><ul>{menu}</ul><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div><div><a href=/>elsewhere, far away</a></div></body>")
    assert got == f"Title {LONG} {LONG}"


def test_extract_edges(spark):
    rows = [(1, None, None, "a"), (2, "u", "", "b"), (2, "u", page(""), "c"), (None, "v", "<p>x", "d"), (3, "w", "<script>only</script>", "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in H.extract(df).collect())
    assert got == [(0, "v", "x", 1), (1, "", "", 0), (2, "u", "", 0), (2, "u", f"{LONG} {LONG}", 2 * len(LONG) + 1), (3, "w", "", 0)]
    assert H.extract(df.limit(0)).count() == 0
