"""Main text of pages against a plain version on the given pages, and on pages of other builds."""

import re
import time
from html import unescape

import pytest

from millrace.llm import main_text as m

PARAGRAPHS = ["The first paragraph of the article is long enough to count, and it goes on.", "A second one, with <a href='/x'>a link in it</a> and more words to follow after it.", "Short.", "The last paragraph says what there is left to say about the matter at hand."]
PLAIN = [re.sub("<[^>]*>", "", p) for p in PARAGRAPHS]
BODY = "".join(f"<p>{p}</p>\n" for p in PARAGRAPHS)


def test_given_pages_by_a_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in m.op12_line_blocks(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for r in pages:
        inner = re.sub("</?b>", "", re.search("<article>(.*?)</article>", r.html, re.S)[1])
        want = " ".join(unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


NOISE = """<header class="site-header"><h1>Site</h1><p>The site's own slogan, which is long enough to look like text, really.</p></header>
<nav><ul><li><a href="/">Home</a><li><a href="/a">About</a></ul></nav><div id="cookie-notice"><p>We use cookies to make this site work, and you should agree to all of them.</p></div>
<div class="sidebar left"><p>Text of the sidebar that is as long as a paragraph of an article would be, nearly.</p></div>
<form action="/s"><label>Search this site for anything that you want to find in it</label><input><select><option>One<option>Two</select></form>
<script>if (a < b) { document.write("<p>written text</p>") }</script><style>p > b { color: red }</style>"""
AFTER = """<div class="ad-slot">Buy this thing now, it is the best thing that you can buy for money today.</div>
<section id="comments"><h2>2 comments</h2><div class="comment"><p>I read this article and I liked all that it says about the matter.</p></div></section>
<footer><p>Copyright of the site, and all its rights are reserved to those who own them.</p></footer>"""


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main><article class='post'>{}</article></main>", "<div class='article-body'>{}</div>", "<div id=content>{}</div>", "<div>{}</div>", "{}"])
def test_noise_around_an_article(shell):
    page = f"<!doctype html><html><head><title>T</title></head><body class='has-sidebar'>{NOISE}{shell.format('<h1>Head</h1>' + BODY)}{AFTER}</body></html>"
    assert m.main_text(page) == " ".join(["Head", *PLAIN])


def test_unmarked_page_by_its_lines():
    links = "".join(f"<div><a href='/{i}'>Link {i}</a></div>" for i in range(6))
    page = f"<body><div>{links}</div><div>Home</div><div><h1>Head</h1>{BODY}</div><div>{links}</div><div>© A site 2020</div></body>"
    assert m.main_text(page) == " ".join(["Head", *PLAIN])


def test_advert_inside_and_header_of_an_article():
    page = f"<article><header><h1>Head</h1></header>{BODY}<aside>See also</aside><div class='ad'>Buy</div><p hidden>unseen</p><p>More of it.</p><footer>By me</footer></article>"
    assert m.main_text(page) == " ".join(["Head", *PLAIN, "More of it."])


def test_references_and_white_space():
    assert m.main_text("<article><p>a&amp;b &lt;p&gt; &eacute;&#233;&#xe9;\n\t c&nbsp;d</p><p>e<b>f</b>g<br>h</p></article>") == "a&b <p> ééé c d efg h"
    assert m.main_text("<article><td>1</td><td>2</td> 3 < 4 <5></article>") == "1 2 3 < 4 <5>"


@pytest.mark.parametrize("html,want", [(None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("just text", "just text"), ("<script>x", ""), ("<!-- open", ""), ("<article>kept <b", "kept"), ("<article><p>a<p>b<li>c", "a b c"), ("<div class=widget><p>All there is.</p></div>", "All there is.")])
def test_odd_pages(html, want):
    assert m.main_text(html) == want


def test_short_and_long_articles_are_whole():
    assert m.main_text(f"<body>{NOISE}<article><p>No.</p></article>{AFTER}</body>") == "No."
    words = " ".join(f"w{i}" for i in range(200_000))
    assert m.main_text(f"<article><p>{words}</p></article>") == words


@pytest.mark.parametrize("piece", ["<a href='x", "<div>", "<", "<!", "<p class=\"", "</b>", "&am", "<div class='ad'>", "<script>", "<x =", "<article>", "a<br>", "<a><p>x"])
def test_linear_time(piece):
    start = time.perf_counter()
    m.main_text(piece * (400_000 // len(piece)))
    assert time.perf_counter() - start < 5


def test_rows(spark, tmp_path):
    rows = [(1, "u", "<article>x</article>"), (1, "u", "<article>x</article>"), (None, None, None), (2, "v", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "'a' AS n_chars").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in m.op12_line_blocks(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, "u", "x", 1)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)


@pytest.mark.parametrize("noise", ["<div class='usercomments'><p>{}</p></div>", "<div id=pagefooter><p>{}</p></div>", "<section aria-label='Reader comments'><p>{}</p></section>", "<div class='topnav'><p>{}</p></div>", "<div id='leftSidebar'><p>{}</p></div>", "<div class='content-footer'><p>{}</p></div>"])
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<div class='articlebody'>{}</div>", "<div>{}</div>"])
def test_names_in_one_word(noise, shell):
    said = "Somebody says something of the length of a paragraph here, and it is no article."
    for page in (noise.format(said) + shell.format(BODY), shell.format(BODY) + noise.format(said), shell.format(BODY + noise.format(said))):
        assert m.main_text(page) == " ".join(PLAIN)


def test_names_that_only_look_like_it():
    for name in ("content-sidebar-wrap", "has-sidebar", "download", "thread", "platform", "readable", "page with-comments"):
        assert m.main_text(f"<div class='{name}'>{BODY}</div>") == " ".join(PLAIN)


@pytest.mark.parametrize("heading", ["Comments", "3 comments", "Comments (12)", "Leave a reply", "Kommentare", "Reader comments:"])
def test_a_heading_of_comments_ends_the_text(heading):
    more = "<div><p>I read this article and I liked all that it says about the matter.</p></div>"
    assert m.main_text(f"<main><h1>Head</h1>{BODY}<div><h2>{heading}</h2>{more}</div></main>") == " ".join(["Head", *PLAIN])
    assert m.main_text(f"<main><h1>Head</h1>{BODY}<h2>Comments on the results</h2>{more}</main>").endswith("about the matter.")
