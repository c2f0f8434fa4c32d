import html
import re
import time

import pyarrow.parquet as pq
import pytest

from tonearm.llm import html_text as H

P1 = "The first paragraph is long enough, has commas, and says what the article is about."
P2 = "A second paragraph, with <a href='/x'>a link</a> and <b>bold</b> words,\n and&nbsp;space &amp; marks &#233;."
T2 = "A second paragraph, with a link and bold words, and space & marks é."
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Menu item {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>'</script></head><body><nav>{MENU}</nav><article><p>{P1}</p><p>{P2}</p></article><footer>&copy; me, all rights, reserved</footer></body></html>",
        f"<body><div id=menu>{MENU}</div><div class='col'><p>{P1}<p>{P2}</div><div class='sidebar'><p>Other things, to read, here and there, every day of the week.</p></div></body>",
        f"<body>{MENU}<main><header><nav>{MENU}</nav></header><p>{P1}</p><div class='ad'>Buy this, now, or never, at a price that is right.</div><p>{P2}</p><form><label>Mail</label><input><button>Go</button></form></main></body>",
        f"<body><div><section><p>{P1}</p></section><section><p>{P2}</p></section></div><section class='comments'><p>First!, I say, and a long reader comment it is, with commas, many of them.</p></section></body>",
        f"<body><!-- <p>not, this, one, at, all</p> --><table><tr><td>{MENU}</td><td><p>{P1}</p><p>{P2}</p></td></tr></table></body>",
        f"<div class='cookie-notice'><p>We use cookies, as everyone does, to make, well, cookies.</p></div><div class=post-content><p>{P1}</p><p>{P2}</p>{MENU}</div>",
        f"<article><p>{P1}<br><p>{P2}</article>",
    ],
)
def test_article_without_the_rest(page):
    assert H.main_text(page) == f"{P1} {T2}"


def test_headings_and_short_paragraphs_stay():
    assert H.main_text("<body><article><h1>Title</h1><p><b>Lead<br><p>A.</p><p>B</p><ul><li>one</li><li>two</li></ul></article></body>") == "Title Lead A. B one two"


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<script>x</script>", "<nav><a href=x>y</a></nav>"])
def test_no_article(page):
    assert H.main_text(page) == ""


def test_plain_text_and_broken_markup():
    assert H.main_text("just text, no markup") in ("", "just text, no markup")
    assert H.main_text("<body>just text, no markup") == "just text, no markup"
    assert H.main_text("<div><p>open <b>never closed &lt;tag&gt; a < b") == "open never closed <tag> a < b"
    assert H.main_text("<p>" * 3000 + "<div>" * 3000 + "deep, text") == "deep, text"


def test_deep_pages_take_linear_time():
    took = []
    for n in (4000, 16000):
        page = "<body>" + "<div>" * n + f"<p>{P1}</p>" + "</section>" * n + "</div>" * n + "<li>x" * 50
        start = time.perf_counter()
        assert H.main_text(page).startswith(P1)
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 0.2  # sixteen times if it grew with the square


def test_pages_of_the_table():
    """Every page's article paragraphs are found, and no words of its menus, notices and comments are."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    kept = lost = extra = 0
    for page in filter(None, pages):
        text = H.main_text(page)
        for part in re.findall(r"<article[^>]*>(.*?)</article>", page, re.S):
            plain = re.sub(r"<(script|style|aside|nav|form|footer)\b.*?</\1>", " ", part, flags=re.S)
            for body in re.findall(r"<p>([^<]{30,}?)</p>", plain):
                found = " ".join(html.unescape(body).split()) in text
                kept, lost = kept + found, lost + (not found)
        for part in re.findall(r"<(?:nav|footer)\b[^>]*>(.*?)</(?:nav|footer)>", page, re.S):
            for body in re.findall(r">([^<>]{12,})<", part):
                extra += " ".join(html.unescape(body).split()) in text
    assert kept + lost > 20 and kept / (kept + lost) > 0.95 and extra <= 0.02 * (kept + lost), (kept, lost, extra)


def test_query_rows(spark):
    rows = [(1, "u1", f"<article><p>{P1}</p></article>", "x"), (2, None, None, "y"), (2, None, None, "y"), (None, "u", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted([tuple(x) for x in H.extract(pages).collect()], key=str)
    assert got == sorted([(1, "u1", P1, len(P1)), (2, None, "", 0), (2, None, "", 0), (None, "u", "", 0)], key=str)
    assert H.extract(pages.limit(0)).collect() == []
