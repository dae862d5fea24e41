import html
import itertools
import random
import re
import time

import pyarrow.parquet as pq

from cohortlake.llm import html_main as H
from cohortlake.llm.common import ship


def expected(page):
    """The one layout of the test pages: everything within the article."""
    inside = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)
    text = re.sub(r"</?(p|h1|br)>", " ", inside[1]) if inside else ""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", text)).split())


def test_query_equals_layout(spark, sf_dir):
    for d in (sf_dir, "/root/testdata/sf0.01"):
        pages = pq.read_table(f"{d}/pages.parquet").to_pydict()
        want = sorted((i, u, expected(h), len(expected(h))) for i, u, h in zip(pages["page_id"], pages["url"], pages["html"]))
        assert sorted(map(tuple, H.op8_html_main(spark, d).collect())) == want


def test_parts_of_a_page():
    words = "The quick brown fox jumps over the lazy dog while the others look on in silence."
    page = f"""<html><body class="menu-open"><header><a href=/>Site</a> <h2>Slogan of the site</h2></header>
    <div id="cookie-notice"><p>{words}</p></div><main><article><header><h1>Title &amp; more</h1></header>
    <p>{words}<p>Second&nbsp;paragraph, with a <a href="#">link</a> in a sen<b>ten</b>ce.<br>New line.
    <div class="ad"><p>{words} Buy now.</p></div><ul><li>A point that is made in the article at some length</li></ul>
    <form><p>{words}</p><select><option>one</select></form><script>if (a < b) "</article>";</script>
    </article><section class="comments"><article class="comment"><p>{words} Said a reader.</p></article></section></main>
    <aside><p>{words} Aside.</p></aside><!-- <p>{words}</p> --><footer><p>{words} Footer.</p></footer>"""
    assert H.main_text(page) == f"Title & more {words} Second paragraph, with a link in a sentence. New line. A point that is made in the article at some length"
    plain = f"<div><a href=a>Home</a> <a href=b>News</a></div><div><div>{words}</div><div>{words}</div></div><div><a href=c>Terms</a></div>"
    assert H.main_text(plain) == f"{words} {words}"
    assert [H.main_text(x) for x in (None, "", "<br>", "<", "<p", "a < b")][:5] == ["", "", "", "", ""]


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        smooth = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda keep: sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(scores, keep)) + sum(w for (i, j), w in smooth.items() if keep[i] != keep[j])  # noqa: E731, B023
        assert abs(cost(H.min_cut(scores, smooth)) - min(map(cost, itertools.product([True, False], repeat=n)))) < 1e-6


def test_names_that_are_topics_keep_their_text():
    words = "The quick brown fox jumps over the lazy dog while the others look on in silence."
    for part in (f'<div class="legal">{words}</div>', f'<p id="share">{words}</p>', f"<noscript><p>{words}</p></noscript>", f'<p class="social-history">{words}</p>', f"<object><p>{words}</p></object>"):
        assert H.main_text(f"<article><p>{words}</p>{part}<p>{words}</p></article>") == f"{words} {words} {words}"
    plain = f'<div><p>{words}</p><p class="social-history">{words}</p><p>Yes.</p><table><tr><td>1990<td>12 goals</table><p>{words}</p></div>'
    assert H.main_text(plain) == f"{words} {words} Yes. 1990 12 goals {words}"
    for name in ("sidebar-left", "cookie-notice", "comments", "ad-slot", "share-buttons sidebar"):
        assert H.main_text(f'<article><p>{words}</p></article><div class="{name}"><p>{words}</p></div>') == words


def test_many_blocks_take_near_linear_time():
    rng = random.Random(7)
    for build in (lambda i: f"<p>{'word ' * rng.randint(1, 40)}</p>", lambda i: f"<div><a href=x>{'link ' * rng.randint(1, 9)}</a>{'word ' * rng.randint(0, 30)}</div>"):
        began = time.process_time()
        H.main_text("<body>" + "".join(map(build, range(50_000))))
        assert time.process_time() - began < 20


def test_odd_rows(spark, empty):
    ship(spark)
    pages = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", "<p>" + "word " * 200_000, 2), (2, "u", "", None)], "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, H.extract(pages).collect()), key=str)
    assert [(r[0], r[1], len(r[2]), r[3]) for r in got] == [(1, None, 0, 0), (1, None, 0, 0), (2, "u", 0, 0), (None, "u", 999_999, 999_999)]
    assert H.extract(pages.limit(0)).count() == 0


def test_raw_elements_are_whole_names():
    words = "The quick brown fox jumps over the lazy dog while the others look on in silence."
    for tag in ("<svg-icon name=a></svg-icon>", "<title-bar></title-bar>", "<svg/>", "<svg width=1 />", "<svg><path d=x /></svg>"):
        assert H.main_text(f"<article><p>{words}</p>{tag}<p>{words}</p></article>") == f"{words} {words}"


def test_wrappers_keep_their_article():
    """Pages whose article lies within an element that looks like a side part."""
    words = "The quick brown fox jumps over the lazy dog while the others look on in silence, every day of the week."
    text = f"<h1>Title of the day</h1><p>{words}</p><p>{words} Again.</p><p>{words} And again.</p>"
    want = f"Title of the day {words} {words} Again. {words} And again."
    site = '<nav><a href="/">Home</a> <a href="/news">News of the day</a></nav>{0}<footer><p>Copyright of the owners.</p></footer>'
    for page in (
        f'<form runat="server">{text}</form>', f"<form><article>{text}</article></form>", f'<div class="elementor-widget-container">{text}</div>', f'<div class="wrap sidebar-right"><article>{text}</article></div>',
        f'<div class="modal-open"><main>{text}</main></div>', f'<div class="comments-open content"><article>{text}</article></div>', f'<div class="widget"><div class="modal">{text}</div></div>',
    ):
        assert H.main_text(site.format(page)) == want, page
        assert H.main_text(f"<html><body>{page}</body></html>") == want, page
    # what is aside stays aside within a wrapper, and large side parts are no wrappers
    assert H.main_text(f'<form><article>{text}<div class="ad"><p>{words}</p></div></article><div class="sidebar"><p>{words}</p></div></form>') == want
    many = f"<p>{words} Said a reader.</p>" * 30
    for part in (f'<section class="comments">{many}</section>', f'<div id="cookie-notice">{many}</div>', f"<aside>{many}</aside>", f'<div class="comments"><article class="comment">{many}</article></div>'):
        assert H.main_text(f"<article>{text}</article>{part}") == want, part[:40]
    assert H.main_text(f'<section class="comments">{many}</section>') == ""
    standfirst = f"<article><header><h1>Title of the day</h1><p>{words}</p><p>By A. Writer</p></header><p>{words} Again.</p></article>"
    assert H.main_text(standfirst) == f"Title of the day {words} {words} Again."
