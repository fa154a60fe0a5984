"""Main text of web pages, by differencing each page with its nearest ones.

A page is a list of lines, one for each block of text, with the place of each: what element of the
page's frame holds it, if any. Pages of a host are ordered by URL path, and each is paired with the
nearest different page before and after it. A page's lines are aligned with a neighbour's by their
longest common subsequence, and shared lines go: a site repeats its frame, not its articles.

Differencing alone cannot give right results: menus and adverts may differ on every page, and
articles may quote or copy each other. So lines in an element that names itself as part of the
frame (a menu, a footer, a form, comments) always go; where a page marks its article, the lines
inside are the text and all others go; on other pages the unshared lines are the text. Neighbours
at the same path, and those with nearly all of the page's text, are copies and delete nothing.

Defined results: a null or empty html has an empty text; rows that are equal in all three columns have
equal results; pages without a host, or alone on it, are not differenced; an empty table gives an
empty table; other columns are ignored.
"""

import re
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genopair.llm.common import Scratch, small
from genopair.session import ship_package

COPY = 0.9  # of the letters in either page's unmarked lines

# Element names of HTML.
RAW = "script style textarea title xmp iframe noembed noframes".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
FRAME = set(
    "aside audio button canvas datalist dialog fieldset footer form head header iframe input math menu nav noembed noframes noscript object script search select style svg template textarea title video xmp".split()
)

# Roles, and words of class names and ids, that name parts of the frame.
FRAME_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
FRAME_WORDS = set(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promotion promoted related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)

TITLES = set("header hgroup h1 h2 h3 h4 h5 h6".split())
TITLE_WORDS = set("banner header masthead".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![-\w])(class|id|role|hidden|itemprop)(?![-\w])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text else {}


def _tokens(html: str):
    """(name, closes, attributes, text) in page order: a tag, or, without a name, text. What raw elements hold is left out."""
    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            yield None, False, "", html[at:]
            return
        if m.start() > at:
            yield None, False, "", html[at : m.start()]
        at = m.end()
        if name := m["name"]:
            name, closes = name.lower(), bool(m["close"])
            yield name, closes, m["attributes"], ""
            if not closes and name in RAW_END:
                end = RAW_END[name].search(html, at)
                at = end.start() if end else n


def _words(attributes: dict[str, str]) -> set[str]:
    return {w.lower() for k in ("class", "id") for w in WORDS.findall(attributes.get(k, ""))}


def _is_frame(name: str, attributes: dict[str, str], in_article: bool, holds_articles: bool) -> bool:
    """Whether an element names itself as part of the frame. An article's own header is its title, and what holds all articles is no part."""
    if name in FRAME and not (name == "header" and in_article):
        return True
    if holds_articles or name in ("html", "body", "main"):
        return False
    if attributes.get("role", "").lower() in FRAME_ROLES or "hidden" in attributes:
        return True
    named = FRAME_WORDS & _words(attributes)
    return bool(named - TITLE_WORDS if in_article and name in TITLES else named)


def _is_article(name: str, attributes: dict[str, str]) -> bool:
    return name == "article" or "articlebody" in attributes.get("itemprop", "").lower().split() or attributes.get("role", "").lower() == "article"


def lines(html: str) -> tuple[list[str], list[int]]:
    """The blocks of text, in page order, and the place of each: 0 free, 1 in an article, 2 in the frame."""
    found = list(_tokens(html))
    # Where each element ends: at its own end tag, if there is one.
    ends, open_, articles = {}, {}, []
    for k, (name, closes, _, _) in enumerate(found):
        if name and name not in VOID:
            if not closes:
                open_.setdefault(name, []).append(k)
                if name in ("article", "main"):
                    articles.append(k)
            elif open_.get(name):
                ends[open_[name].pop()] = k
    texts, places, part = [], [], []
    # The last token of the part of the frame, of the inline element of the frame and of the article that are open.
    frame_end = inline_end = article_end = -1

    def flush(k: int) -> None:
        text = " ".join("".join(part).split())
        part.clear()
        if text:
            texts.append(text)
            places.append(2 if k <= frame_end else 1 if k <= article_end else 0)

    for k, (name, closes, given, text) in enumerate(found):
        if name is None:
            if k > inline_end:
                part.append(unescape(text))
            continue
        inline = name in INLINE
        if not inline:
            flush(k)
        elif name == "br":
            part.append(" ")
        if closes or k <= max(frame_end, inline_end) or (inline and not given):
            continue
        attributes = _attributes(given)
        # An element without an end holds nothing but the text that follows its tag.
        end = ends.get(k, k if name in VOID or name in RAW else k + 1)
        in_article = k <= article_end
        holds_articles = bool(articles) and k < articles[0] and articles[-1] < end
        if _is_frame(name, attributes, in_article, holds_articles) or (in_article and name == "article"):
            # An article within an article is a reader's comment, as HTML names it.
            if inline:
                inline_end = end
            else:
                frame_end = end
        elif not in_article and _is_article(name, attributes):
            article_end = ends.get(k, len(found))
    flush(len(found))
    return texts, places


def longest_common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Equal ends are cut off and what the other side lacks is left out; the rest is halved, as often as
    needed, where the lengths of both halves, from one bit vector each, are greatest together.
    """
    lo, end_a, end_b = 0, len(a), len(b)
    while lo < min(end_a, end_b) and a[lo] == b[lo]:
        lo += 1
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    out = [*range(lo), *range(end_a, len(a))]
    in_b, in_a = set(b[lo:end_b]), set(a[lo:end_a])
    at = [k for k in range(lo, end_a) if a[k] in in_b]
    rest = [x for x in b[lo:end_b] if x in in_a]
    stack = [(at, rest)]
    while stack:
        at, rest = stack.pop()
        if not at or not rest:
            continue
        if len(at) == 1:
            out.extend(k for k in at if a[k] in rest)
            continue
        mid = len(at) // 2
        head = _lengths([a[k] for k in at[:mid]], rest)
        tail = _lengths([a[k] for k in at[mid:]][::-1], rest[::-1])[::-1]
        cut = int(np.argmax(head + tail))
        stack += [(at[:mid], rest[:cut]), (at[mid:], rest[cut:])]
    return sorted(out)


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with every beginning of ``b``; a bit of the vector is one of b's lines."""
    masks: dict[int, int] = {}
    for k, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer((full ^ v).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits[: len(b)], dtype=np.int64)])


def _hashes(texts: list[str]) -> list[int]:
    from xxhash import xxh3_64_intdigest

    return [xxh3_64_intdigest(t.encode("utf-8")) - (1 << 63) for t in texts]


def host_and_path(url: str) -> tuple[str | None, str]:
    """Host and path; without query, fragment, and what may or may not end a path."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname
    except ValueError:
        return None, ""
    return host, re.sub(r"(?:/|/index\.\w+|\.\w{3,5})$", "", parts.path)


def unshared(texts: list[str], places: list[int], neighbours: list[list[int]]) -> list[bool]:
    """Whether each line is kept after the page's lines are aligned with those of each neighbour."""
    keys = _hashes(texts)
    free = [k for k, p in enumerate(places) if p == 0]
    shared: set[int] = set()
    letters = sum(len(texts[k]) for k in free)
    for other in neighbours:
        found = set(longest_common(keys, other))
        if sum(len(texts[k]) for k in free if k in found) < COPY * letters:
            shared |= found
    marked = 1 in places
    return [p == 1 or (p == 0 and not marked and k not in shared) for k, p in enumerate(places)]


def _named(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    columns = (F.col(f"`{c}`").alias(n) for c, n in ((id_col, "page_id"), (url_col, "url"), (html_col, "html")))
    return pages.select(*columns).withColumn("uid", F.xxhash64("page_id", "url", "html"))


def neighbours(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """uid and near, the line hashes of the nearest pages of its host before and after it in the order of paths.

    Pages at one path are one place in the order, and its first page stands for it. Places are dealt
    out in ranges, so that a host's places lie in as many tasks as they need; ranges meet at a table
    of their first and last places.
    """

    def run(batches):
        for batch in small(batches):
            rows = []
            for url, html in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
                host, path = host_and_path(url)
                rows.append((host, path, _hashes(lines(html)[0]) if host and html else []))
            host, path, keys = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["uid"], pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                names=["uid", "host", "path", "keys"],
            )

    read = pages.select("uid", "url", "html").mapInArrow(run, "uid bigint, host string, path string, keys array<bigint>")
    read = scratch.write(read.where("host IS NOT NULL"), "lines")
    places = read.groupBy("host", "path").agg(F.min("uid").alias("uid"))
    places = places.repartitionByRange("host", "path").sortWithinPartitions("host", "path").withColumn("part", F.spark_partition_id())
    places = scratch.write(places, "places")
    inside = Window.partitionBy("part", "host").orderBy("path")
    near = places.select("*", F.lag("uid").over(inside).alias("before"), F.lead("uid").over(inside).alias("after"))
    # A range's first and last places of a host: two rows for each range and host at a border.
    borders = near.where("before IS NULL OR after IS NULL").select("part", "host", "path", "uid")
    counts = borders.groupBy("host").agg(F.count_distinct("part").alias("parts")).where("parts > 1").select("host")
    across = Window.partitionBy("host").orderBy("path")
    borders = borders.join(F.broadcast(counts), "host", "left_semi")
    borders = borders.select("host", "path", F.lag("uid").over(across).alias("far_before"), F.lead("uid").over(across).alias("far_after"))
    near = near.join(borders, ["host", "path"], "left")
    found = F.array_compact(F.array(F.coalesce("before", "far_before"), F.coalesce("after", "far_after")))
    # A table of its own, so that Spark can split the join on a path that many rows share.
    near = scratch.write(near.select("host", "path", found.alias("others")), "near")
    asks = read.select("uid", "host", "path").distinct().join(near, ["host", "path"]).select("uid", F.explode("others").alias("other"))
    keys = read.groupBy(F.col("uid").alias("other")).agg(F.any_value("keys").alias("keys"))
    return asks.join(keys, "other").groupBy("uid").agg(F.sort_array(F.collect_list("keys")).alias("near"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, and how many lines each page has and keeps."""
    ship_package(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "pages")
    named = _named(pages, id_col, url_col, html_col)
    near = neighbours(named, scratch)
    kind = named.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in small(batches, 128):
            rows = []
            for html, others in zip(batch["html"].to_pylist(), batch["near"].to_pylist()):
                texts, places = lines(html or "")
                keep = unshared(texts, places, others or [])
                rows.append(("\n\n".join(t for t, k in zip(texts, keep) if k), len(texts), sum(keep)))
            text, n, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_lines", "n_kept"],
            )

    joined = named.join(near, "uid", "left").select("page_id", "url", "html", "near")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint, n_lines bigint, n_kept bigint")
