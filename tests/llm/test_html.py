import pandas as pd
import pytest

from pairloom.llm.html_extract import content_lines, extract_pages, main_text

LONG = "A sentence with enough words to be prose. " * 6
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
<header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div class="cookie-notice">We use cookies, agree.</div>
<main><article><header><h1>Head &amp; line</h1><span>By line</span></header><p>Short.</p><p>{LONG}
<ul><li>first<li>second</ul><p>Break<br>here, <b>bold <i>and</b> on</p>
<form><p>Subscribe</p><input></form><script>var x = "</p>";</script><div class="share-buttons">Share</div>
<table><tr><td>cell<td>other</table><div class="ad">Buy</div></article></main>
<div id="sideBar"><p>{LONG}</p></div><section id="comments"><article class="comment"><p>{LONG}</p></article></section>
<footer>&copy; foot</footer></body></html>"""


def test_page_keeps_the_article_alone():
    assert main_text(PAGE).split("\n\n") == [
        "Head & line", "Short.", LONG.strip(), "first", "second", "Break here, bold and on", "cell", "other",
    ]


@pytest.mark.parametrize("name", ["layout sidebar-right", "post tags-news search-x", "has-ads widget"])
def test_a_name_alone_drops_no_article(name):
    page = f"<body><nav><a href=1>One</a></nav><div class='{name}'><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></article></div><div class=sidebar><p>Other</p></div></body>"
    assert main_text(page) == f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}"


def test_long_comments_stay_out():
    page = f"<body><article><h1>Title</h1><p>{LONG}</p></article><div class=comments><article><p>{LONG * 4}</p></article></div></body>"
    assert main_text(page) == f"Title\n\n{LONG.strip()}"


def test_a_short_second_section_is_kept():
    first, second = f"<section><h2>One</h2><p>{LONG * 3}</p><p>{LONG * 3}</p></section>", f"<section><p>{LONG}</p></section>"
    page = f"<body><div class=top><a href=1>x</a></div><div id=content>{first}{second}</div><div class=low><a href=1>y</a></div></body>"
    assert main_text(page).endswith(LONG.strip()) and main_text(page).count("A sentence") == 42


def test_less_than_at_the_end_is_text():
    page = f"<article><h1>Title</h1><p>{LONG}</p><p>if a < b then the rest of the text follows"
    assert main_text(page).endswith("if a < b then the rest of the text follows")


def test_page_without_article_element():
    page = f"<body><div class=top><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div><h2>Title</h2><p>{LONG}</p><p>End.</p><p>{LONG}</p></div></body>"
    assert main_text(page) == f"Title\n\n{LONG.strip()}\n\nEnd.\n\n{LONG.strip()}"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<p>cut <b", "cut"), ("<p>&lt;x&gt; &#233;&nbsp;y", "<x> é y"),
        ("</div></p>x", "x"), ("<nav>menu</nav>", ""), ("<!-- c --><p>a</p><!-- open", "a"), ("<p>a < b</p>", "a < b"), ("<![if]><p>q</p>", "q"),
    ],
)
def test_small_pages(html, text):
    assert main_text(html) == text


def test_deep_and_long_pages_end():
    assert main_text("<div>" * 3000 + "x").strip() == "x"
    assert len(main_text("<article>" + "<p>word</p>" * 20000 + "</article>")) == 6 * 20000 - 2


def test_smoothing_separates_two_levels():
    import numpy as np

    chosen = content_lines(np.array([1, 2, 1, 90, 2, 80, 85, 1, 1, 2], float))
    assert chosen[3:7].all() and not chosen[:2].any() and not chosen[8:].any()


def test_operator_returns_every_row(spark, small):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (3, "v", "", "y")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).toPandas()
    assert len(got) == 4 and list(got.columns) == ["page_id", "url", "text", "n_chars"]
    assert (got.n_chars == got.text.str.len()).all() and pd.isna(got.page_id).sum() == 1
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages_hold_the_article_element(spark, small):
    import html as names
    import re

    for row in spark.read.parquet(f"{small}/pages.parquet").limit(60).collect():
        article = row.html.partition("<article>")[2].partition("</article>")[0].partition("<footer")[0]
        blocks = [" ".join(names.unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert main_text(row.html) == "\n\n".join(b for b in blocks if b)
