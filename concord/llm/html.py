"""Main-text extraction by consensus paths of a host.

Pass one parses each page, scores its containers by text outside links and votes for the generalised path of the best
one (tags and classes of the block elements down to it, those above the last ``STEPS`` as one digest; digits and
positions dropped).  Spark counts the votes per host and keeps the leading paths.  Pass two parses again and takes the first leading path that the page has
with text; a page that has none of them, or a host without votes, falls back to the page's own best container, or to one
around it where that holds a quarter more text.

Left out everywhere: scripts, styles, navigation, headers outside the article, footers, sidebars, forms, and elements
that a whole class, id or role token names as menu, advert, cookie notice or comments (``userComments`` does,
``share-price`` names none).
Names that an article's own blocks bear too (notice, related, alert, share ...) count outside the article; inside it such
a block goes only on evidence: half of its text or more stands in links, or the host has the very block on a tenth of
its pages, three at least.  A token that holds such a name beside other words (``has-sidebar``, ``ads-free``) takes that
last evidence everywhere, and only for a block with less than half of the page's text.  Character references are decoded, white space in a block becomes one space, blocks are joined
in page order by one space.

Edge cases: a null or empty page has the empty text; a null url is the host '' of its own; broken markup is read as
far as it goes (open elements end with the page), in time that grows with the page alone; repeated rows are extracted
each; an empty table gives an empty table; an input column ``text`` is replaced, all other columns pass through.
"""

from __future__ import annotations

import re
from functools import cache
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import discard, small, text_or_empty, written

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select".split())
LEFT_OUT = frozenset("nav footer aside form button menu dialog".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr img".split())
CONTAINERS = {"article": 1.5, "main": 1.3, "section": 1.0, "div": 1.0, "td": 1.0, "body": 0.6}
BAD_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr comment comments disqus social sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead newsletter subscribe pagination pager contentinfo complementary adsbygoogle adsense adbox adslot adunit commentlist commentbox commentform cookiebar cookiebanner".split())
#: Inside an article these take evidence.
UNSURE_NAMES = frozenset("header notice alert popup modal overlay banner widget share sharing related recommended search login signup reply replies respond".split())
#: Words beside these in a token that leave its meaning as it is.
NEUTRAL = frozenset("site page main global top bottom left right inner outer box block list item items section area container wrapper wrap bar slot unit text content primary secondary buttons button links link icons posts form the and by user users reader readers visitor visitors guest guests thread threads google policy privacy law eu".split())
STEPS = 12
GOOD_NAMES = frozenset("article content post entry story main body text".split())
LISTS = frozenset("ul ol table dl select".split())
_CLOSES = {"li": "li", "td": "td", "th": "td", "tr": "tr", "dt": "dd", "dd": "dd", "option": "option"}


def _named(token: str) -> int:
    """What a class, id or role token names: 3 something beside the article, 2 perhaps so, 1 it or something else, 0 neither."""
    words = {w.lower() for w in _WORDS.findall(token)} - NEUTRAL
    if not words <= BAD_NAMES | UNSURE_NAMES:
        return 1 if words & BAD_NAMES else 0
    return 3 if words & BAD_NAMES else 2 if words else 0


class Page:
    """The containers of a page: path, score and the span of chunks that each holds."""

    def __init__(self, html: str):
        self.chunks: list[str] = []
        self.nodes: list[list] = []  # path, weight, first chunk, last chunk, characters, characters in links, parent
        self.unsure: list[tuple[int, int, int]] = []  # hash of the text, first chunk, last chunk
        self._read(html)

    def _read(self, html: str) -> None:
        chunks, nodes = self.chunks, self.nodes
        # tag, digest of the steps above the path, path, left out, inside the article, node, nearest node, unsure: first chunk,
        # nodes, characters, characters in links, level
        stack: list[tuple] = [("", 0, (), False, False, None, None, None)]
        half: list[tuple[int, tuple]] = []  # characters and place of unsure blocks of level 1
        open_at: dict[str, list[int]] = {}
        blocks, lists = [0], [0]  # places in the stack of what a p, or an item of a list, does not reach across
        at, links, chars, in_links = 0, 0, 0, 0

        def close(to: int) -> None:
            nonlocal links, chars, in_links
            while len(stack) > to:
                tag, _, _, _, _, node, _, unsure = stack.pop()
                open_at[tag].pop()
                for places in (blocks, lists):
                    if places[-1] == len(stack):
                        places.pop()
                links -= tag == "a"
                if tag not in INLINE:
                    chunks.append(" ")
                if unsure:
                    first, inner, before, linked, level = unsure
                    said, in_link = chars - before, in_links - linked
                    if level == 2 and 2 * in_link >= said > 0:
                        chunks[first:] = [" "]
                        chars, in_links = before, linked
                        del nodes[inner:]
                        node = None
                    elif said:
                        found = crc32(_joined(chunks[first:]).encode("utf-8", "surrogatepass")), first, len(chunks)
                        if level == 2:
                            self.unsure.append(found)
                        else:
                            half.append((said, found))
                if node:
                    node[3], node[4], node[5] = len(chunks), chars - node[4], in_links - node[5]

        def say(raw: str) -> None:
            nonlocal chars, in_links
            if raw and not stack[-1][3]:
                text = unescape(raw)
                chunks.append(text)
                n = len(text.strip())
                chars += n
                in_links += n if links else 0

        last_end = html.rfind(">")  # no tag ends after it
        while (m := _TAG.search(html, at)) if at <= last_end else None:
            say(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            mine = open_at.setdefault(tag, [])
            if m[1] or m[4]:
                if mine:
                    close(mine[-1])
                elif tag == "p":
                    chunks.append(" ")
                continue
            if tag in VOID:
                if tag not in INLINE:
                    chunks.append(" ")
                continue
            if tag in RAW:
                end = _raw_end(tag).search(html, at)
                at = end.end() if end else len(html)
                chunks.append(" ")
                continue
            if tag not in INLINE:
                chunks.append(" ")
                if (p := open_at.get("p")) and p[-1] > blocks[-1]:
                    close(p[-1])
                if tag in _CLOSES and mine and mine[-1] > lists[-1]:
                    close(mine[-1])
            _, above, path, out, inside, _, near, _ = stack[-1]
            classes, good, bad = "", False, 0
            if said := m[3] or m[6]:
                named = [(k.lower(), a or b or c) for k, a, b, c in _ATTR.findall(said)]
                good = any(w.lower() in GOOD_NAMES for _, v in named for w in _WORDS.findall(v))
                classes = ".".join(sorted({re.sub(r"\d+", "", c) for k, v in named if k == "class" for c in v.split()}))
                if tag not in ("html", "body", "article", "main"):
                    bad = max((_named(t) for _, v in named for t in v.split()), default=0)
            out = out or tag in LEFT_OUT or (tag == "header" and not inside) or bad == 3 or (bad == 2 and not inside)
            unsure = (len(chunks), len(nodes), chars, in_links, bad) if bad and not out else None
            inside = inside or tag in ("article", "main")
            node = None
            if tag not in INLINE:
                path = (*path, f"{tag}{'.' + classes if classes else ''}")
                if len(path) > STEPS:
                    above, path = crc32(path[0].encode("utf-8", "surrogatepass"), above), path[1:]
            if tag in CONTAINERS or tag in LEFT_OUT:
                blocks.append(len(stack))
            if tag in LISTS:
                lists.append(len(stack))
            if tag in CONTAINERS and not out:
                node = [f"{above:08x}>" * (above > 0) + ">".join(path), CONTAINERS[tag] * (1.3 if good else 1.0), len(chunks), 0, chars, in_links, near]
                nodes.append(node)
            links += tag == "a"
            mine.append(len(stack))
            stack.append((tag, above, path, out, inside, node, node or near, unsure))
        say(re.sub(r"<[a-zA-Z/!][^<>]*\Z", "", html[at:]))
        close(1)
        self.unsure += [found for said, found in half if 2 * said < chars]

    def best(self) -> list | None:
        """The container with the highest weight times text outside links; of equals the innermost, which comes last."""
        return max(reversed(self.nodes), key=lambda n: n[1] * (n[4] - 2 * n[5]), default=None)

    def drop(self, common: set[int]) -> None:
        """Leave out the unsure blocks whose text the host has on many pages."""
        for h, first, last in self.unsure:
            if h in common:
                self.chunks[first:last] = [" "] * (last - first)

    def taken(self, paths: list[str]) -> str:
        """Text of the first of ``paths`` that has any; else of the best container, or of one around it that holds a
        quarter more; else of all that isn't left out."""
        text = lambda n: _joined(self.chunks[n[2] : n[3]])
        for path in paths:
            inner: list[list] = []
            for n in self.nodes:
                if n[0] == path and not (inner and n[2] < inner[-1][3]):
                    inner.append(n)
            if found := " ".join(filter(None, map(text, inner))):
                return found
        if node := self.best():
            own = lambda n: n[4] - 2 * n[5]
            wider = node
            while wider := wider[6]:
                if own(wider) >= 1.25 * own(node) > 0:
                    node = wider
            if found := text(node):
                return found
        return _joined(self.chunks)


def _joined(chunks: list[str]) -> str:
    return " ".join("".join(chunks).split())


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>?", re.I)


def host(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _vote(pages: pa.Array) -> pa.Array:
    read = [Page(x.as_py()) for x in pages]
    best = [p.best() for p in read]
    paths = pa.array([n[0] if n and n[4] > 0 else None for n in best], pa.string())
    unsure = pa.array([list({u[0] for u in p.unsure}) for p in read], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([paths, unsure], names=["path", "unsure"])


def _extract(pages: pa.Array, paths: pa.Array, common: pa.Array) -> pa.Array:
    out = []
    for x, p, c in zip(pages, paths, common, strict=True):
        page = Page(x.as_py())
        if page.unsure and (often := c.as_py()):
            page.drop(set(often))
        out.append(page.taken(p.as_py() or []))
    return pa.array(out, pa.string())


def consensus(pages: DataFrame, html: str = "html", url: str = "url", leaders: int = 3) -> DataFrame:
    """__host, paths, common: per host the ``leaders`` paths with the most votes, most first, and the unsure blocks that a
    tenth of its pages have, three at least (so at most ten for each that a page has on average)."""
    votes = pages.select(host(url).alias("__host"), F.arrow_udf(_vote, "struct<path:string,unsure:array<bigint>>")(text_or_empty(html)).alias("v"))
    votes = written(votes.select("__host", "v.path", "v.unsure"), "votes")
    counted = votes.where("path is not null").groupBy("__host", "path").agg(F.count("*").alias("votes"))
    rank = F.row_number().over(Window.partitionBy("__host").orderBy(F.desc("votes"), "path"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= leaders)
    top = top.groupBy("__host").agg(F.array_sort(F.collect_list(F.struct("rank", "path")))["path"].alias("paths"))
    often = votes.select("__host", F.explode("unsure").alias("block")).groupBy("__host", "block").agg(F.count("*").alias("n"))
    often = often.where("n >= 3").join(votes.groupBy("__host").agg(F.count("*").alias("of")), "__host").where("10 * n >= of")
    often = often.groupBy("__host").agg(F.collect_list("block").alias("common")).withColumnRenamed("__host", "__of")
    out = written(top.join(often, F.col("__host") == F.col("__of"), "left").drop("__of"), "paths")
    discard(votes)
    return out


def extract(pages: DataFrame, html: str = "html", url: str = "url", leaders: int = 3) -> DataFrame:
    """``pages`` with ``text``."""
    winners = consensus(pages, html, url, leaders).withColumnsRenamed({"paths": "__paths", "common": "__common"})
    keyed = pages.withColumn("__key", host(url))
    joined = keyed.join(small(winners), F.col("__key") == F.col("__host"), "left")
    return joined.withColumn("text", F.arrow_udf(_extract, "string")(text_or_empty(html), "__paths", "__common")).drop("__key", "__host", "__paths", "__common")
