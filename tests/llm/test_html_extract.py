"""HTML extraction: cuts against all labellings, pages of several layouts, edge cases."""

import itertools
import random
import re
import time
from html import unescape

from pyspark.sql import types as T

from cladeloom.llm import html_extract, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site"><h1>Daily Site</h1></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<!-- <p>gone</p> --><div class="ad">Buy this very good thing now, it is cheap and it is here.</div>
<div id="cookie-notice"><p>This site uses cookies and many other things. You may accept all of them.</p></div>
<article><h1>The &amp; title</h1><p>First para&shy;graph of the <b>article<i> goes</b> on&nbsp;here.<br>And on.
<p>Second, with a <a href="x">link</a> &lt;in&gt; it.<p>Short.</p><div class="ad">An advert that interrupts the article, sadly.</div>
<ul><li>item one<li>item two</ul><form><label>Mail</label><input></form></article>
<section class="comments"><p>I really like this article, it is great and it is long enough to read.</p></section>
<aside><p>Other news that is unrelated. It has many words and it is a sentence.</p></aside>
<footer>&copy; Site</footer></body></html>"""
TEXT = "The & title First para­graph of the article goes on here. And on. Second, with a link <in> it. Short. item one item two"


def test_a_page_with_an_article():
    assert html_extract.main_text(PAGE) == TEXT


def test_a_page_of_plain_divisions():
    text = "This is a sentence of some length that says one thing or another about it. " * 2
    html = (
        '<body><div><a href="/">Home</a> <a href="/x">Other</a></div><div><div><h1>A heading of the story</h1>'
        f"<div>{text}</div><div>{text}</div><div>Yes.</div><div>{text}</div></div></div>"
        '<div><a href="/1">more stories</a></div><div>© 2020 The Site. All rights reserved.</div>'
    )
    want = " ".join(["A heading of the story", text.strip(), text.strip(), "Yes.", text.strip()])
    assert html_extract.main_text(html) == want


def test_broken_markup():
    assert html_extract.main_text("<article><p>a b c d e f g. <p title='x > y'>more words are here now.") == "a b c d e f g. more words are here now."
    assert html_extract.main_text("<article><p>tail of a page that ends <!-- never") == "tail of a page that ends"
    assert html_extract.main_text("<article><p>a < b and c > d are words.</p></article><script>open") == "a < b and c > d are words."
    for html in (None, "", "<", "<p", "</p></div>", "<<<>>>", "&", "<script>", "<article></article>"):
        html_extract.main_text(html)
    deep = "<div>" * 3000 + "<article><p>" + "some words in here. " * 20000
    assert html_extract.main_text(deep) == ("some words in here. " * 20000).strip()


def test_the_cut_is_the_least():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 9)
        terminal = [rng.choice([rng.randint(-9, 9), rng.randint(-2, 2)]) for _ in range(n)]
        edges = [(*rng.sample(range(n), 2), rng.randint(1, 6)) for _ in range(rng.randint(0, 14) if n > 1 else 0)]

        def cost(label):
            return sum(max(0, t) if not x else max(0, -t) for t, x in zip(terminal, label)) + sum(
                w for i, j, w in edges if label[i] != label[j]
            )

        assert cost(html_extract.min_cut(terminal, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_long_ambiguous_pages():
    rng = random.Random(5)
    terminal = [rng.randint(-300, 300) for _ in range(4000)]
    label = html_extract.min_cut(terminal, [(i, i + 1, 500) for i in range(3999)])
    best = (0, 0)  # least cost of a chain, ending in False and True
    for i, t in enumerate(terminal):
        no, yes = max(0, t), max(0, -t)
        best = (no, yes) if i == 0 else (no + min(best[0], best[1] + 500), yes + min(best[1], best[0] + 500))
    got = sum(max(0, t) if not x else max(0, -t) for t, x in zip(terminal, label))
    assert got + 500 * sum(a != b for a, b in zip(label, label[1:])) == min(best)


def test_query_on_the_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op9_html_extract(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, r in pages.items():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"</?(p|h1|br|li|ul)>", " ", inner).replace("<b>", "")).split())
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == r.url


def test_edge_rows(spark):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("page_id", "html", "text")])
    rows = [(None, None, "x"), ("1", "", None), ("2", PAGE, "x"), ("2", PAGE, "x")]
    got = html_extract.extract(spark.createDataFrame(rows, schema)).collect()
    assert [(r.page_id, r.text, r.main.text, r.main.n_chars) for r in got] == [
        (None, "x", "", 0), ("1", None, "", 0), ("2", "x", TEXT, len(TEXT)), ("2", "x", TEXT, len(TEXT))
    ]
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0


def test_hidden_elements_without_an_end_tag():
    want = html_extract.main_text("<html><head><title>T</title></head><body><article><p>The words of this page. And more of them.</article>")
    assert want == "The words of this page. And more of them."
    for start in ("<body>", "", "<body class=x>"):
        assert html_extract.main_text(f"<html><head><meta charset=x><title>T</title><script>1</script>{start}<article><p>{want}</article>") == want
    for open_ in ("<button>Go", "<select><option>a<option>b", "<object data=x>no", "<button>A</button><button>B", "<svg><path d=x>"):
        assert html_extract.main_text(f"<body><div>{open_}</div><article>{open_}<p>{want}</article>") == want, open_
    for closed in ("<button><div>Go there now.</div></button>", "<object><object><p>No.</p></object><p>No plugin here.</p></object>"):
        assert html_extract.main_text(f"<body><article><p>{want}</p>{closed}</article>") == want, closed


def test_broken_markup_takes_linear_time():
    size = 1_000_000
    pieces = ["<a ", '<a b="', "<div>", '<a "> "', "<a", "<ul><li>", "<p><span>a", "<button><p>", "<table><td><span>"]
    inputs = [x * (size // len(x)) for x in pieces] + ["<span>" * (size // 10) + "</b>" * (size // 10), "<i>" * (size // 7) + "<li>" * (size // 7)]
    for html in inputs:
        begun = time.process_time()
        html_extract.main_text(html)
        assert time.process_time() - begun < 10, html[:20]


def test_tags_end_outside_quotes_or_at_the_next_end():
    rng = random.Random(6)
    for _ in range(3000):
        html = "".join(rng.choice("ab>\"'< ") for _ in range(rng.randint(1, 25))) + ">"
        ends = html_extract.TagEnds(html)
        for at in range(len(html)):
            whole = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""").match(html, at)
            assert ends.after(at) == (whole.end() - 1 if whole else html.index(">", at))
