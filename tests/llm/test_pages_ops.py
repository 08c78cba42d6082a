"""Operators 9 and 10: fixtures with known articles, and round trips."""

import base64
import gzip
import hashlib
import io
import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from foliograph.llm import html, queries, warc

SF = "/root/testdata/sf0.001"
P1 = "The first paragraph of the article is long enough, has commas, and says something of its own about the matter."
P2 = "A second one follows, with more of the same, so that the container gathers points &amp; stands out clearly."
P2T = P2.replace("&amp;", "&")
P3 = "Short end."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='</p><p>no';</script>{head}</head><body>{body}</body></html>"


ARTICLE = f"<h1>Title</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
WANT = "\n\n".join(["Title", P1, P2T, P3])
AROUND = {
    "plain": f"<nav><a href=/>Home</a></nav><article>{ARTICLE}</article><footer>Foot, of, the, page</footer>",
    "div by class": f'<div class="site-header"><a href="/">Site, name</a></div><div class="content">{ARTICLE}</div><div id="sidebar"><p>Read this, too, and that, and more of it, please, now, and again and again.</p></div>',
    "comments": f'<article>{ARTICLE}</article><section id="comments"><h3>3 comments</h3><article class="comment"><p>I, for one, liked it, a lot, and more, and more, and more, and I write at length.</p></article></section>',
    "comments inside": f'<main><article>{ARTICLE}<div class="comment-list"><p>First, second, third, and so on, said a reader, at length.</p></div></article></main>',
    "notices": f'<div class="cookie-banner"><p>We use cookies, and more cookies, and yet more, on this page, for you.</p></div><article>{ARTICLE}</article>',
    "advert inside": f'<article><h1>Title</h1><p>{P1}</p><div class="ad">Buy, buy, buy, now, here, today.</div><p>{P2}</p><aside>By the way, this, and that, and others.</aside><p>{P3}</p></article>',
    "form inside": f"<article>{ARTICLE}<form><label>Mail</label><input name=a><button>Send</button></form></article>",
    "links inside": f'<article>{ARTICLE}<ul class="related-links"><li><a href=a>One more</a></li><li><a href=b>Another one</a></li><li><a href=c>And a third</a></li></ul></article>',
    "unclosed": f"<article><h1>Title<h1></h1><p>{P1}<p><b>{P2}<br><p>{P3}</article>",
    "header in article": f"<article><header><h1>Title</h1><div>By someone, on a day</div></header><p>{P1}</p><p>{P2}</p><p>{P3}</p></article>",
    "page header": f"<header><div>Name, of, the, site</div></header><div><div>{ARTICLE}</div></div>",
    "hidden": f'<div style="display: none"><p>Hidden, words, that, nobody, sees, at all, ever, here.</p></div><article>{ARTICLE}</article>',
    "spaces": f"<article>\n <h1>\n  Ti<i>tl</i>e </h1>\n<p>  {P1.replace(' ', '  ')}</p>\n\t<p>{P2.replace(' ', chr(10))}</p><!-- x, y, z --><p>{P3}</p>",
    "form as page": f"<form><article>{ARTICLE}</article></form>",
    "upper case": f"<ARTICLE>{ARTICLE.replace('<p>', '<P CLASS=x>').replace('</p>', '</P>')}</ARTICLE>",
}


@pytest.mark.parametrize("name", AROUND)
def test_op9_article(name):
    assert html.main_text(page(AROUND[name])) == WANT


@pytest.mark.parametrize("text,want", [("", ""), ("   ", ""), ("<nav><a href=x>Menu</a></nav>", ""), ("just text, no tags", "just text, no tags"), ("<p>a &lt; b&nbsp;c &eacute;&#233;", "a < b c éé"), ("<p title='a>b'>x</p><", "x\n\n<"), ("<script>only", ""), ("a <b>bold</b>er <br>line", "a bolder line")])
def test_op9_odd(text, want):
    assert html.main_text(text) == want


def test_op9_lists_and_quotes_stay():
    body = f"<article>{ARTICLE}<blockquote>Quoted words</blockquote><ul><li>One item</li><li>Two <a href=x>items</a></li><li>Three</li></ul><pre>a\n  b</pre></article>"
    assert html.main_text(page(body)) == WANT + "\n\nQuoted words\n\nOne item\n\nTwo items\n\nThree\n\na b"


def test_op9_siblings_stay():
    body = f"<div id=x><div class=part><p>{P1}</p><p>{P2}</p></div><div class=part><p>{P2}</p><p>{P1}</p></div></div>"
    assert html.main_text(page(body)) == "\n\n".join([P1, P2T, P2T, P1])


LEAD = "The lead says in a hundred and twenty characters, more or less, what the matter is about and does not go into details."
BODY = f"<div class=body>{f'<p>{P1}</p>' * 20}</div>"
LINKS = "<div><a href=a>One page</a> <a href=b>Another page</a></div>"


def test_op9_short_siblings_stay():
    body = f"<div id=content><div class=title><h1>Title</h1></div><div class=lead><p>{LEAD}</p></div>{BODY}<ul><li>An item</li></ul><blockquote>Quoted</blockquote><pre>a b</pre><table><tr><td>cell</td></tr></table><section>Short</section>{LINKS}</div>"
    assert html.main_text(page(body)) == "\n\n".join(["Title", LEAD, *[P1] * 20, "An item", "Quoted", "a b", "cell", "Short"])
    assert html.main_text(page(f"<div id=content><div class=title><h1>Title</h1></div><div class=wrap>{BODY}</div>{LINKS}</div>")) == "\n\n".join(["Title", *[P1] * 20])


@pytest.mark.parametrize("rows", [2, 3])
def test_op9_rows_of_wrappers_stay(rows):
    body = f"<div id=content>{f'<div class=row><div class=col><p>{P1}</p><p>{P2}</p></div></div>' * rows}{LINKS}</div>{LINKS}"
    assert html.main_text(page(body)) == "\n\n".join([P1, P2T] * rows)


@pytest.mark.parametrize(
    "inside,text",
    [
        (f'<section id="discussion"><h2>Discussion</h2><p>{P1}</p></section>', f"Discussion\n\n{P1}"),
        (f'<div class="policy"><p>{P1}</p></div>', P1),
        (f'<div class="promotion"><h2>Ranks</h2><p>{P1}</p></div>', f"Ranks\n\n{P1}"),
        ("<p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "Where x=1 holds"),
        ("<div><label>Figure 1</label> shows it</div>", "Figure 1 shows it"),
        ("<h2>Sources</h2><ul><li><a href=a>One book</a></li><li><a href=b>Another book</a></li><li><a href=c>A third</a></li></ul>", "Sources\n\nOne book\n\nAnother book\n\nA third"),
        ("<!--><p>After an abrupt comment</p><!---><p>and another</p>", "After an abrupt comment\n\nand another"),
        (f'<div class="section-header"><h2>Part</h2><div>by someone</div><p>{P1}</p></div>', f"Part\n\n{P1}"),
    ],
)
def test_op9_article_text_stays(inside, text):
    assert html.main_text(page(f"<nav><a href=/>Home</a></nav><article>{ARTICLE}{inside}<p>{P2}</p></article><footer>Foot</footer>")) == f"{WANT}\n\n{text}\n\n{P2T}"


@pytest.mark.parametrize(
    "inside",
    [
        '<div class="share-buttons">Share: <a href=a>One</a> <a href=b>Two</a></div>',
        '<div class="newsletter"><p>Subscribe to the newsletter, for weekly news, at no cost, and more, every Monday morning, for all of you.</p><form><input name=m></form></div>',
        '<div class="ad"><p>Buy this, and that, and more of it, at a price that is lower than ever, here, today, for all of you.</p></div>',
        f'<div id="discussion"><div class="comment">{P1}</div><div class="comment">{P1}</div></div>',
        f'<section class="comments"><p>{P1}</p><textarea>Write</textarea></section>',
        '<div class="breadcrumbs">Home / News</div>',
    ],
)
def test_op9_other_parts_of_an_article_go(inside):
    assert html.main_text(page(f"<article>{ARTICLE}{inside}<p>{P2}</p></article>")) == f"{WANT}\n\n{P2T}"


def test_op9_names_are_forgiven_where_no_prose_is_left():
    assert html.main_text(page(f'<div class="social-policy">{ARTICLE}</div>')) == WANT
    assert html.main_text(page(f'<div class="related">{ARTICLE}</div><div class="content"><h1>Title</h1><p>{P1}</p></div>')) == f"Title\n\n{P1}"
    menu = "".join(f"<li><a href=/{k}>Page {k}</a></li>" for k in range(5))
    assert html.main_text(page(f"<ul>{menu}</ul><div>{ARTICLE}</div><ul>{menu}</ul>")) == WANT


def test_op9_ends_of_elements_keep_to_their_cells():
    assert html.main_text(f"<div><table><tr><td>a</div>b<td>c</table><p>{P1}</p></div>") == f"ab\n\nc\n\n{P1}"


@pytest.mark.parametrize("text", ["<div>", "<a ", "<div class=nav>", "<div>x", "<p><b>", "<ul><li>", "<table><tr><td>", "<!", "<a href='", "</p>", "<form><h1>"])
def test_op9_takes_time_in_proportion_to_the_page(text):
    import time

    start = time.time()
    html.main_text(text * 100_000)
    assert time.time() - start < 8


def test_op9_deep_nesting_ends():
    assert html.main_text("<div>" * 5000 + P1 + "</div>" * 5000) == P1
    assert html.main_text("<b>" * 5000 + P1) == P1


def test_op9_query(spark):
    got = queries.op9_tree_scoring(spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) > 0 and "<" not in r.text
        inside = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)[^>]*>", re.sub(r"<!--.*?-->", "", inside.replace("<br>", " "), flags=re.S))
        assert r.text == "\n\n".join(t for t in (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts) if t)
    odd = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>x", 2), (1, None, None, 1)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html.extract(odd).collect()) == ["", "", "x"]
    assert html.extract(odd.limit(0)).count() == 0


PAGES = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, "http://a/3", "same"), (2, "http://b/\r\nx", "other é"), (7, None, None), (8, "http://e", ""), (4, "http://g", "x" * 300000), (None, "n", "same"), (9, "z", "twice"), (9, "z", "twice")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, key string").repartition(3)


@pytest.mark.parametrize("split", [1 << 20, 97])
def test_op10_round_trip(spark, pages, split):
    rows = warc.read(spark, warc.write(pages), split).collect()
    assert len(rows) == len(PAGES)
    by = {(r.page_id, r.record_type): r for r in rows}
    want = {1: 5, 3: 5, None: 5, 7: 8, 9: 9}
    assert {r.page_id: r.refers_to for r in rows if r.record_type == "revisit"} == want
    for i, _, h in PAGES:
        payload = (h or "").encode()
        for kind in ("response", "revisit"):
            if r := by.get((i, kind)):
                assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
                assert r.payload is None if kind == "revisit" else bytes(r.payload) == payload
    assert sum(r.page_id == 9 and r.record_type == "response" for r in rows) == 1


def test_op10_least_and_empty(spark, pages):
    rows = warc.read(spark, warc.write(pages, least=1)).collect()
    assert {r.page_id for r in rows if r.record_type == "response"} == {5, 2, 7, 8, 4, 9}
    assert warc.write(pages.limit(0)) == [] and warc.read(spark, []).count() == 0


def test_op10_every_split_finds_each_record_once():
    rng = random.Random(4)
    data, starts = b"", []
    for i in range(60):
        starts.append(len(data))
        payload = rng.randbytes(rng.randint(0, 3000)) + b"\x1f\x8b\x08" * rng.randint(0, 3) + gzip.compress(b"inner")
        data += warc.record(i, i, f"u{i}", payload)
    for split in (1, 50, 1000, 7777, len(data)):
        if split == 1:
            cuts = [(s + d, s + d + 1) for s in starts[:20] for d in (-1, 0, 1) if s + d >= 0]
        else:
            cuts = [(a, min(len(data), a + split)) for a in range(0, len(data), split)]
        found = [int(f["x-page-id"]) for a, b in cuts for f, _ in warc.records(io.BytesIO(data), len(data), a, b)]
        assert found == list(range(20 if split == 1 else 60))


@pytest.mark.parametrize("split", [400, 3000, 1 << 20])
def test_op10_damage_is_an_error_wherever_it_is(split):
    rng = random.Random(5)
    members = [warc.record(i, i, f"u{i}", rng.randbytes(rng.choice([5, 900]))) for i in range(12)]
    data = b"".join(members)
    read = lambda d: [f["x-page-id"] for a in range(0, len(d), split) for f, _ in warc.records(io.BytesIO(d), len(d), a, min(len(d), a + split))]
    assert read(data) == [str(i) for i in range(12)]
    at = 0
    for m in members:
        for place in (0, 1, 12, len(m) // 2, len(m) - 6):
            bad = bytearray(data)
            bad[at + place] ^= 0x55
            with pytest.raises(ValueError):
                read(bytes(bad))
        at += len(m)
    with pytest.raises(ValueError):
        read(data[:-3])


def test_op10_window_goes_back():
    window = warc._Window(io.BytesIO(bytes(range(200))), 200, 0)
    assert window.byte(50, 3) == bytes([50, 51, 52]) and window.byte(10, 2) == bytes([10, 11]) and window.byte(199, 5) == bytes([199])


def test_op10_hot_payload_is_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, F.lit("same " * 50)).otherwise(F.col("id").cast("string")).alias("html")).repartition(4)
    rows = warc.read(spark, warc.write(df)).collect()
    assert len(rows) == 3000 and {r.refers_to for r in rows if r.record_type == "revisit"} == {2999} and sum(r.record_type == "revisit" for r in rows) == 1999


def test_op10_members_are_plain_gzip():
    data = warc.record(1, 0, "http://x", b"abc") + warc.record(2, 1, "http://y", b"abc", (1, 0, "http://x"))
    text = gzip.decompress(data).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Refers-To-Target-URI: http://x" in text
