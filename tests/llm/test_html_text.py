import random
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from genopair.llm import html_text
from genopair.llm.html_text import lines, longest_common, unshared

SCHEMA = "page_id bigint, url string, html string, uid string, near string, host string, keys string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


class Article(HTMLParser):
    """The blocks of an article element, by the standard library's parser: an independent reading of plain pages."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "ul", "div", "article", "table", "tr", "td"}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside = [""], False
        self.feed(html)
        self.close()
        self.text = "\n\n".join(" ".join(b.split()) for b in self.blocks if b.split())

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in self.BLOCKS:
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.blocks.append("")
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_every_page_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()
    got = {(r.page_id, r.url): r for r in html_text.extract(df).collect()}
    assert len(got) == len(rows)
    for p in rows:
        r = got[p["page_id"], p["url"]]
        assert r.text == Article(p["html"]).text and r.n_chars == len(r.text)


ROUGH = """<!DOCTYPE html><html><head><title>t &amp; u</title><style>p > a {x:"</p>"}</style><script>if (a < b) document.write("<p>no</p></" + "script>");</script></head>
<body class="no-sidebar"><div class="has-sidebar"><header id="siteHeader"><h1>Site</h1></header><div role="navigation">go</div>
<article class="post"><header><h1>Ti&shy;tle &lt;b&gt; &copy &#8212;&#x41;</h1></header><p>one<br>two &nbsp; <b>bo</b>ld<a href="/x"> link</a> <span class="share">tweet</span> end
<p title="a > b">three &am</p><div class="AdBox">buy</div><ul><li>four<li>five</ul><!-- <p>hidden</p> --><p hidden>gone</p>
<p class="notice">read this</p><pre>six
  seven</pre><form><p>mail</p><input></form><table><tr><td>8</td><td>9</td></tr></table>
<section id="comments"><article><p>first!</p></article></section><article><p>nested comment</p></article></article>
<aside><article><p>card</p></article></aside><p>loose</p><footer>&copy; site</footer></div></body></html>"""


def test_a_rough_page():
    texts, places = lines(ROUGH)
    kept = [t for t, k in zip(texts, unshared(texts, places, [])) if k]
    assert kept == ["Ti\xadtle <b> © —A", "one two bold link end", "three &am", "four", "five", "six seven", "8", "9"]


@pytest.mark.parametrize(
    "html", ["", " ", "text", "<", "<p", "<p>a<", "</p></p>x", "<!-- a", "<script>x", "<article>", "<p a='", "<nav>x", "<div class=ad>x", "<a><b></a></b>", "&#0;&#99999999;", "\x00", "<br>" * 3000, "<div>" * 3000 + "x", "<p title=\"" * 2000]
)
def test_no_page_is_too_rough(html):
    texts, places = lines(html)
    assert len(texts) == len(places) and all(t == " ".join(t.split()) and t for t in texts)


def subsequence_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_longest_common_subsequences():
    r = random.Random(0)
    for _ in range(400):
        a, b = ([r.randrange(r.choice((2, 5, 40))) for _ in range(r.randrange(30))] for _ in "ab")
        at = longest_common(a, b)
        assert at == sorted(set(at)) and len(at) == subsequence_length(a, b)
        rest = iter(b)
        assert all(a[k] in rest for k in at)
    a = [r.randrange(50) for _ in range(20000)]
    b = [x for x in a if r.random() < 0.9]
    assert len(longest_common(a, b)) == len(b)


def site(n, host="a.example.org"):
    """Pages without an article element: a frame that all share, and a text of their own."""
    frame = "<p>Welcome to our site</p><div><p>Products</p><p>Services</p></div>{}<p>All rights reserved</p>"
    return [(k, f"http://{host}/en/{k:04d}.html?x={k}", frame.format(f"<h2>Title {k}</h2><p>Body of page {k}, long enough to count for most of it</p>")) for k in range(n)]


def texts_of(rows):
    return {(r.page_id, r.url): r.text for r in rows}


def test_shared_lines_go_where_no_article_is_marked(spark):
    rows = site(40) + site(1, "alone.example.org")
    got = texts_of(html_text.extract(pages(spark, rows)).collect())
    for i, url, _ in rows[:40]:
        assert got[i, url] == f"Title {i}\n\nBody of page {i}, long enough to count for most of it"
    assert got[0, "http://alone.example.org/en/0000.html?x=0"].startswith("Welcome to our site\n\nProducts")


def test_awkward_pages(spark):
    rows = site(6)
    rows += [(50, "http://a.example.org/en/0003", rows[3][2]), (51, "http://a.example.org/en/00035", rows[3][2])]  # one path with a copy, and a copy beside it
    rows += [rows[2], rows[2], (60, None, "<p>no url</p>"), (61, "http://a.example.org/x", None), (None, "http://b.example.org", "<p>no id</p>"), (62, "not a url", ""), (63, "http://[bad", "<p>x</p>")]
    rows += [(64, "http://c.example.org/a", "<p>" + "w " * 200000 + "</p>"), (65, "http://c.example.org/b", "<p>same</p>" * 3000 + "<p>own</p>")]
    got = html_text.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    text = texts_of(got)
    assert text[60, None] == "no url" and text[61, "http://a.example.org/x"] == "" and text[None, "http://b.example.org"] == "no id"
    assert text[2, rows[2][1]] == "Title 2\n\nBody of page 2, long enough to count for most of it"
    assert "Body of page 3" in text[3, rows[3][1]] and "Body of page 3" in text[50, "http://a.example.org/en/0003"]
    assert len(text[64, "http://c.example.org/a"]) == 399999 and text[63, "http://[bad"] == "x"
    assert html_text.extract(pages(spark, [])).collect() == []


def test_ranges_do_not_matter(spark):
    """Neighbours across the border of two ranges are found: the same rows from one range and from many."""
    from genopair.llm.common import Scratch

    named = html_text._named(pages(spark, site(300)), "page_id", "url", "html").cache()
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found.append(sorted((r.uid, r.near) for r in html_text.neighbours(named, Scratch(spark, "t")).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found[0] == found[1] and len(found[0]) == 300 and sum(len(near) == 2 for _, near in found[0]) == 298
