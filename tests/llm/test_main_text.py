"""Main texts of pages against the articles that the pages were made from."""

from __future__ import annotations

import html
import re
import time

import pytest
from document_rows import CLASHING, prose
from pyspark.sql import functions as F

from ledgerloom.llm import main_text
from ledgerloom.llm.main_text import extract

ARTICLE = [
    "A headline & more",
    "Short.",
    prose(1, 60),
    prose(2, 90) + " with <angles> & “quotes”",
    "Be.",
    prose(3, 40),
]
TEXT = "\n\n".join(ARTICLE)

_paragraphs = "".join(f"<p>{html.escape(x)}</p>\n" for x in ARTICLE[1:])
BODY = f"<h1>{html.escape(ARTICLE[0])}</h1>\n{_paragraphs}"
MENU = "".join(f'<li><a href="/{i}">Menu entry {i}</a></li>' for i in range(8))
LONG = prose(9, 80)

LAYOUTS = {
    "article": f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head>
        <body class="has-sidebar no-comments"><header><p>{LONG}</p></header><nav><ul>{MENU}</ul></nav><!-- ad <p> -->
        <div class="ad">Buy it now.</div><article>{BODY}</article><aside><p>{LONG}</p></aside>
        <section id="comments"><h2>Comments</h2><article class="comment"><p>{LONG}</p></article></section>
        <footer>&copy; us</footer></body></html>""",
    "named containers": f"""<html><body><div id="page"><div class="site-header"><p>{LONG}</p></div>
        <div class="menu-main"><ul>{MENU}</ul></div><div class="cookie-notice"><p>We use cookies. {LONG}</p></div>
        <div class="entry-content">{BODY}</div><div id="sidebar"><p>{LONG}</p></div>
        <div class="commentList"><p>{LONG}</p></div><form><p>Name <input> {LONG}</p></form>
        <div class="site-footer">{LONG}</div></div></body></html>""",
    "only lines": f"""<body><div><div><div><a href="/">Home</a> <a href="/a">About us</a></div></div></div>
        <div><div><ul>{MENU}</ul></div></div><div><div><div>{BODY}</div></div></div>
        <div><div><div><p>Follow us</p></div></div></div><div><div><ul>{MENU}</ul></div></div></body>""",
    "article in main": f"<main><div class=breadcrumbs>Here &gt; there</div><article>{BODY}</article><p>{LONG}</p></main>",
    "main": f"<p>{LONG}<main role=main>{BODY}</main><div>{LONG}</div>",
    "remarks within": f"<article>{BODY}<div class='post-comments'><p>{LONG}</p></div><footer>{LONG}</footer></article>",
    "never closed menu": f"<body><nav><ul>{MENU}<article>{BODY}</article>",
    "form around the page": f"<form id=f><div class=menu>{MENU}</div><article>{BODY}</article></form>",
    "cut off": f"<html><body><nav><ul>{MENU}</ul></nav><article>{BODY}</article><footer>&copy; us &middot; {LONG}",
    "broken": f"<article><p><b>{BODY}<br></i></div></article><aside>{LONG}</aside>",
    "quotes": f"<div title='a > b' class=\"share\">{LONG}</div><article data-x='</article>'>{BODY}</article>",
    "upper case": f"<ARTICLE>{BODY}<SCRIPT>if (a < b) x('<p>{LONG}</p>')</SCRIPT></ARTICLE><ASIDE>{LONG}</ASIDE>",
    "hidden": f"<article><p hidden>{LONG}</p>{BODY}<span style='display: none'>{LONG}</span></article>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert extract(LAYOUTS[name]) == TEXT


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("no markup at all", "no markup at all"),
        ("<p>a&nbsp;\t b<br>c</p>&lt;p&gt;&#x41;&bogus;", "a b c\n\n<p>A&bogus;"),
        ("<script>never closed <p>x", ""),
        ("<!-- never closed <p>x", ""),
        ("<article></article><p>outside</p>", "outside"),
        ("<article><p>X</p></article><div class=ad>An advert of some length</div>", "X"),
        ("<article>5 < 6 <b>is</b> true<p>1<hr>2</article>", "5 < 6 is true\n\n1\n\n2"),
        ("<article><ul><li>a<li><a href=x>b</a></ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
        ("<nav>a</nav><footer>b</footer><form>c</form>", ""),
    ],
)
def test_small_pages(source, text):
    assert extract(source) == text


@pytest.mark.parametrize(
    "source",
    [
        "<b" * 200_000,
        '<a "' * 200_000 + ">",
        "<a x=" + "= " * 200_000,
        "<!--" * 200_000,
        "<div>" * 100_000 + "x",
        "<b><div>" * 50_000 + "</b>" * 50_000,
        "<i class=ad>" * 50_000 + "</div>" * 50_000,
        "<div class=menu><article>a" * 50_000,
        "<p>a" * 200_000,
    ],
)
def test_time_is_linear(source):
    start = time.process_time()
    extract(source)
    assert time.process_time() - start < 5


def test_the_given_pages(spark):
    """The template's articles, cut out by their tag."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r for r in main_text.digest(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for page_id, url, source in rows:
        inside = re.sub("</?b>", "", re.search("<article>(.*?)</article>", source, re.DOTALL)[1])
        blocks = [" ".join(html.unescape(x).split()) for x in re.split("</?(?:p|h1|br)>", inside)]
        text = "\n\n".join(b for b in blocks if b)
        assert tuple(found[page_id]) == (page_id, url, text, len(text))


def test_tables(spark):
    rows = [(1, "u", LAYOUTS["article"]), (1, "u", LAYOUTS["article"]), (2, None, None), (None, "v", "")]
    schema = "page_id long, url string, html string"
    frame = spark.createDataFrame(rows, schema)
    expected = sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert sorted(map(tuple, main_text.digest(frame).collect()), key=str) == expected
    extra = frame.select("*", *[F.lit(7).alias(c) for c in [*CLASHING, "text", "n_chars"]])
    assert sorted(map(tuple, main_text.digest(extra).collect()), key=str) == expected
    assert main_text.digest(spark.createDataFrame([], schema)).count() == 0
