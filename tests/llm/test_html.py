import html
import re

import numpy as np
import pytest

from spectraweave.llm import html_extract
from spectraweave.llm.html_extract import main_text


def test_whole_table_has_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


BODY = "<h1>Title here</h1><p>First   paragraph &amp; more, with a <a href=x>link</a>.</p><p>Yes.</p><p>Another long paragraph of words that go on for a while.</p>"
TEXT = "Title here\nFirst paragraph & more, with a link.\nYes.\nAnother long paragraph of words that go on for a while."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title></head><body><nav><a>One</a><a>Two</a></nav><main>{BODY}</main><footer>(c)</footer></body></html>",
        f"<body><header>Site name</header><div id=menu><ul><li>Home<li>News</ul></div><div class='content'>{BODY}</div><div class='comments'><p>A long reader comment that is certainly not part of it.</p></div>",
        f"<article>{BODY}<div class='ad banner'>Buy now, all the very best things for nearly nothing at all!</div></article><aside>More</aside>",
        f"<article><form><input><p>Your mail</p></form>{BODY}<!-- <p>x</p> --><script>document.write('<p>no</p>')</script><style>p {{}}</style></article>",
        f"<div class=cookie-notice>We use cookies on this page, as on all of the others.</div><div>{BODY.replace('</p>', '')}</div>",
    ],
)
def test_layouts(page):
    assert main_text(page) == TEXT


def test_edges(spark):
    assert [main_text(x) for x in (None, "", "<html>", "<nav>a</nav>", "plain words", "<p>a<br>b\n c&nbsp;d")] == ["", "", "", "", "plain words", "a b c d"]
    long = "<article>" + "<p>word &lt;x&gt; and more</p>" * 20_000 + "</article>"
    assert main_text(long).count("\n") == 19_999
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x</p>"), (2, "v", "<p>\ud83d</p>".encode("utf-8", "replace").decode())]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(df).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", ""), ("1", ""), ("2", "?"), ("None", "x")]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_smoothing_and_threshold():
    x = np.array([1.0, 2, 1, 50, 60, 55, 2, 1])
    s = html_extract.smoothed(x)
    kernel = np.exp(-0.5 * np.arange(-3, 4) ** 2.0)
    assert s[4] == pytest.approx((x[1:8] * kernel).sum() / kernel.sum()) and s[0] == pytest.approx((x[:4] * kernel[3:]).sum() / kernel[3:].sum())
    assert 3 < html_extract.threshold(x) < 50


SENTENCES = "<h1>Head</h1>" + "".join(f"<p>This is sentence number {i} of the article that goes on for a while.</p>" for i in range(18))


@pytest.mark.parametrize("wrap", ['<div class="layout has-sidebar">%s</div>', '<div class="elementor-widget-wrap">%s</div>', '<div class="notice-board">%s</div>', '<div class="related-topics-article">%s</div>', "<form>%s</form>"])
def test_an_element_that_holds_the_article_is_no_side_matter(wrap):
    for inner in (SENTENCES, f"<article>{SENTENCES}</article>", f"{SENTENCES}<div class=sidebar><a href=x>one</a> <a>two</a></div>"):
        got = main_text(f"<html><body><nav><a>a</a></nav>{wrap % inner}<footer>c</footer></body></html>")
        assert got.split("\n")[0] == "Head" and got.count("\n") == 18


def test_the_clusters_decide(monkeypatch):
    page = f"<article>{SENTENCES}<div class=promo><p>Buy now, all the very best things!</p></div></article>"
    comments = f"<body><div class=content>{SENTENCES}</div><div class=comments>" + "<p>Yes, I think so too, as I said a while ago.</p>" * 3 + "</div></body>"
    want = [main_text(x) for x in (page, comments)]
    assert all("Buy" not in x and "I said" not in x and x.count("\n") == 18 for x in want)
    monkeypatch.setattr(html_extract, "threshold", lambda x: -1.0)
    assert "Buy" in main_text(page)
    monkeypatch.setattr(html_extract, "threshold", lambda x: 1e9)
    assert main_text(comments) != want[1]


def test_deep_pages():
    n = 50_000
    assert main_text("<div>" * n + "<p>hello there</p>") == "hello there"
    assert main_text("<b>" * n + "<p>x<div>y").endswith("y")
