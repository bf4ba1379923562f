"""Main text of pages: the given pages against what their article elements hold, planted layouts, broken markup, odd rows."""

import html
import re

import duckdb
import pytest

from lattica.llm import main_text

SCHEMA = "page_id long, url string, html string, text string, n_chars long"
NAMES, WEIGHTS = main_text.learn()


def some(n, word="x"):
    return " ".join(f"{word}{i}" for i in range(n))


def brute(page):
    """The generator of the given pages marks main text by one article of paragraphs and a heading."""
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


LAYOUTS = {
    "divisions": (f'<div id="header"><a href="/">Site</a></div><ul class="menu"><li><a href=x>home</a></li></ul><div id="content"><h1>T</h1><p>{some(30)}</p><p>Short.</p></div><div id="sidebar"><h3>More</h3><p>{some(20, "s")}</p></div>'
                  f'<div id="comments"><p>{some(40, "c")}</p></div><div id="footer">(c)</div>', f"T\n{some(30)}\nShort."),
    "references": ("<p>A &lt;b&gt; &amp; caf&eacute; &#8212; x&nbsp;y &#x41;</p>", "A <b> & café — x y A"),
    "no markup": ("just text  here\n and more", "just text here and more"),
    "menu only": ('<nav><a href="/">x</a></nav>', ""),
    "parts inside": (f'<article><h1>T</h1><p>{some(20)}</p><div class="advert">buy now</div><p>{some(5, "y")}</p><form><input><label>email</label></form><p>Last.</p><section class="comments"><article><p>{some(50, "c")}</p></article></section></article>',
                     f"T\n{some(20)}\n{some(5, 'y')}\nLast."),
    "comments are articles": (f'<article><p>{some(20)}</p></article><section class="comments"><h2>Comments</h2><article><p>{some(50, "c")}</p></article></section>', some(20)),
    "publishing system": (f'<body class="single has-sidebar"><div id="page" class="site"><header id="masthead" class="site-header"><h1>Blog</h1></header><div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main">'
                          f'<article id="post-1" class="post type-post"><header class="entry-header"><h1>Title here</h1></header><div class="entry-content"><p>{some(40)}</p><blockquote>{some(5, "q")}</blockquote></div><footer class="entry-footer">tags</footer></article>'
                          f'<div id="comments" class="comments-area">{some(9, "c")}</div></main></div><aside id="secondary" class="widget-area">{some(9, "w")}</aside></div><footer>foot</footer></div>', f"Title here\n{some(40)}\n{some(5, 'q')}"),
    "advert never closed": (f'<div class="ad">buy<article><p>{some(20)}</p></article>', some(20)),
    "notice and lists": (f'<div class="cookie-banner"><p>We use cookies {some(20, "k")}</p></div><main><h1>T</h1><p>{some(20)}</p><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table></main><div class="newsletter-signup">{some(10, "n")}</div>',
                         f"T\n{some(20)}\none\ntwo\na\nb"),
    "no names": (f"<div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div><h1>Head</h1><p>{some(30)}</p><p>ok</p><p>{some(30)}</p><div><a href=1>a</a> <a href=2>b</a></div>", f"Head\n{some(30)}\nok\n{some(30)}"),
    "inline": ("<article><p>one<br>two<b>bold</b>end</p></article>", "one twoboldend"),
    "signs in attributes": (f'<article><p title="a > b">{some(6)}</p><img alt="x>y"><p>z</p></article>', f"{some(6)}\nz"),
    "never closed": ("<body><article><p>a b c<p>d e f<li>g<li>h</article><p>out", "a b c\nd e f\ng\nh"),
    "cut off": ('<body><article><p>a b c d<p>e f <a href="x', "a b c d\ne f"),
    "hidden and scripts": ('<article><p>seen</p><p hidden>no</p><div style="display: none">no</div><script>if (a < b) "</p>"</script><style>p {}</style><!-- <p>no</p> --><p>too</p></article>', "seen\ntoo"),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layout(name):
    page, want = LAYOUTS[name]
    assert main_text.extract(page, NAMES, WEIGHTS) == want


def test_given_pages(spark, sf):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in main_text.op12(spark, sf).collect()}
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        want = brute(page)
        assert tuple(got[page_id]) == (page_id, url, want, len(want))


def test_odd_rows(spark):
    long = f"<article><p>{some(200_000)}</p></article>"
    rows = [(1, "u", None, "t", 1), (2, None, "", "t", 1), (None, "u", "<p>a b</p>", "t", 1), (4, "u", long, "t", 1), (5, "u", "<p>a b</p>", "t", 1), (5, "u", "<p>a b</p>", "t", 1), (6, "u", "<" * 20_000, "t", 1), (7, "u", '<a b="' * 3000, "t", 1)]
    got = sorted((tuple(r) for r in main_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [(1, "u", "", 0), (2, None, "", 0), (None, "u", "a b", 3), (4, "u", some(200_000), len(some(200_000))), (5, "u", "a b", 3), (5, "u", "a b", 3), (6, "u", "<" * 20_000, 20_000), (7, "u", "", 0)]
    assert got == sorted(want, key=str)
    assert main_text.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_weights():
    """Tags cost, words of paragraphs gain, and what learning sees is the label, not its name."""
    assert all(v < 0 for k, v in WEIGHTS.items() if "<" in k)
    assert WEIGHTS["any p "] > 0 > WEIGHTS["any li a"]
    assert not any("data" in k for k in NAMES)
    turned = [p.replace("data-main=no", "x").replace("data-main", "y") for p in main_text.PAGES]
    assert all(v < 0 for v in main_text.learn(turned)[0].values())
