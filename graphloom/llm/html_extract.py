"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of elements (tag and class). For each node the site's
pages tell how varied it is: by presentation, the entropy of the sequences of children that it shows, and by content,
how much its blocks differ from page to page. A block that k of m pages of the host repeat says 1 - log_m k; a node's
content importance is the mean over its blocks. Navigation, banners and notices recur and score low, articles are new
on each page and score high. Branches of low importance go from each page.

All elements with text enter the tree, however they are marked. What a page says about a branch is a prior that its
importance is multiplied by: MARKED for elements that by their very tag, class, id or role are menus, headers, footers,
sidebars, notices, adverts, forms or comments. That is strong enough to decide by itself, as menus and readers' comments
may differ on each page, and it holds on hosts with too few pages to judge. The article's root and all that encloses it
are not judged, nor are the single paragraphs, headings and cells in it, so a paragraph that many articles share stays.
Other branches in an article are judged like those outside of it; they stay if nothing else would be left of it.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import private, quoted, ship
from graphloom.storage import materialise

#: A branch goes if its importance, between 0 and 1, is below this ...
LEAST_IMPORTANCE = 0.3
#: ... and at least so many pages of the host show it. With fewer, a repeated block says little.
LEAST_PAGES = 10
#: What the importance of a branch that is marked as something other than the article is multiplied by.
MARKED = 0.25
#: Share of the content in a node's importance; the rest is presentation.
CONTENT_SHARE = 0.9
#: Tables of at most so many (host, node) pairs are broadcast (about 10 bytes each).
MOST_NODES = 200_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROP = frozenset(
    "script style noscript template iframe svg canvas audio video map select option button input textarea "
    "form nav footer aside menu head title".split()
)
#: Markup, scripts and the like, whose text isn't the page's.
_HIDDEN = frozenset("script style noscript template iframe svg canvas audio video map head title".split())
#: These mark a branch unless they are in an article.
_DROP_OUTSIDE = frozenset("header dialog".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr script style template noscript iframe svg math canvas object audio video "
    "map select button input textarea math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mover munder "
    "munderover mspace semantics annotation".split()
)
#: Elements that no class, id or role drops.
_CONTENT = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: A class, id or role made of these words alone marks a branch as something other than the article.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs header masthead footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice alert "
    "popup modal overlay comment comments disqus respond reply replies share sharing social related newsletter subscribe "
    "signup login search pagination pager widget toolbar".split()
)
_TAG = re.compile(r"<(?:!--(?P<c>.*?)(?:-->|\Z)|(?P<b>[!?])[^>]*>?|(?P<e>/)?(?P<t>[a-zA-Z][^\s/>]*)(?P<a>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?)", re.S)
_ATTR = re.compile(r"""([^\s"'=<>/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
#: Names without a value, or values' quoted text, which has no first group.
_BARE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)|([^\s"'=<>/]+)(?!\s*=)(?=[\s/]|\Z)""")
_SPACE = re.compile(r"\s+")
#: In an article these are single pieces of text, which importance doesn't judge.
_SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre figcaption summary".split())
#: Closed by the opening of any of these.
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
_CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",)}


@dataclass
class Element:
    tag: str
    name: str  # tag and classes
    path: int  # hash of the names from the root
    dropped: bool  # marked as something other than the article, itself or by what encloses it
    article: bool
    hidden: bool = False  # its text isn't the page's


@dataclass
class Block:
    text: str
    paths: list[int]  # of its elements that importance judges, outermost first
    dropped: bool
    article: bool


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _names(value: str) -> bool:
    """Whether any name of the attribute consists of words to drop alone: "ad", "cookie-notice", not "has-sidebar"."""
    found = (set(re.split(r"[^a-z0-9]+", n)) - {""} for n in value.split())
    return any(words and words <= _WORDS for words in found)


def _attributes(raw: str, judged: bool = True) -> tuple[str, bool]:
    """(classes, whether class, id or role names something to drop, which is asked of ``judged`` elements only)."""
    classes, bad = "", False
    if raw:
        bad = any(k.lower() == "hidden" for k in _BARE.findall(raw))
    if "=" in raw:
        for key, value in _ATTR.findall(raw):
            key = key.lower()
            if key in ("class", "id", "role"):
                value = entities.unescape(value.strip("\"'")).lower()
                bad |= judged and _names(value)
                if key == "class":
                    classes = ".".join(sorted(value.split()))
            elif key in ("hidden", "aria-hidden") and value.strip("\"'").lower() in ("true", "hidden", ""):
                bad = True
    return classes, bad


def parse(page: str) -> tuple[list[Block], dict[int, tuple[str, ...]]]:
    """The page's blocks of text in order, marked ones too, and the children's names of each node."""
    stack = [Element("", "", 0, False, False)]
    blocks: list[Block] = []
    children: dict[int, list[str]] = {}
    held: list[str] = []
    paths: dict[tuple[int, str], int] = {}
    marked: set[int] = set()  # articles and all that encloses them
    attributes: dict[tuple[str, bool], tuple[str, bool]] = {}

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                at = stack[-1]
                outer = [e.path for e in stack[1:] if e.tag not in _INLINE and not (e.article and not e.dropped and e.tag in _SINGLE)]
                blocks.append(Block(text, outer, at.dropped, at.article))

    def pop(to: int) -> None:
        """Close all elements above the first ``to`` of the stack."""
        if any(e.tag not in _INLINE for e in stack[to:]):
            flush()
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            if not stack[-1].hidden:
                held.append(page[at:tag])
            at = tag
            if at == n:
                break
        m = _TAG.match(page, at)
        if m is None:  # a "<" that opens nothing is text
            if not stack[-1].hidden:
                held.append("<")
            at += 1
            continue
        at = m.end()
        name = m["t"]
        if name is None:
            continue
        name = name.lower()
        if m["e"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    pop(k)
                    break
                if name in _INLINE and stack[k].tag not in _INLINE:
                    break  # a stray end of an inline element doesn't close blocks
            continue
        raw = m["a"] or ""
        if name not in _INLINE:
            flush()
            closes = ("p",) if name in _CLOSES_P else _CLOSES_SAME.get(name, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    pop(k)
                    break
                if stack[k].tag not in _INLINE and not (closes and stack[k].tag in ("td", "th") and name == "tr"):
                    break
        if name == "br":
            held.append(" ")
        judged = name not in _CONTENT
        found = attributes.get((raw, judged))
        if found is None:
            found = attributes[raw, judged] = _attributes(raw, judged)
        classes, bad = found
        parent = stack[-1]
        if name not in _VOID and not raw.endswith("/"):
            full = f"{name}.{classes}" if classes else name
            path = paths.get((parent.path, full))
            if path is None:
                path = paths[parent.path, full] = _hash(parent.path, full)
            children.setdefault(parent.path, []).append(full)
            article = parent.article or name in ("article", "main")
            dropped = parent.dropped or bad or name in _DROP or (name in _DROP_OUTSIDE and not parent.article)
            hidden = parent.hidden or name in _HIDDEN or (dropped and not parent.dropped and name in _INLINE)
            stack.append(Element(name, full, path, dropped, article, hidden))
            if name in ("article", "main") and not dropped:
                marked.update(e.path for e in stack)
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = end.start() if end else n
    flush()
    for b in blocks:
        b.paths = [p for p in b.paths if p not in marked]
    return blocks, {k: tuple(v) for k, v in children.items()}


def main_text(blocks: list[Block], low: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks that stay, joined by line ends. ``low`` are the site's nodes of low importance."""
    blocks = [b for b in blocks if not b.dropped]  # importance is 1 at most: times MARKED it is below the least
    kept = [b for b in blocks if low.isdisjoint(b.paths)]
    if not any(b.article for b in kept):
        kept = [b for b in blocks if b.article or low.isdisjoint(b.paths)]
    return "\n".join(b.text for b in kept)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[^/?#]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, marked, presentation, content, importance) of each node that is judged.

    Counts are summed by (host, node, feature) before they are joined up, so a host of any size costs no task more than
    its distinct features.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for host, page in zip(pdf["host"], pdf["html"], strict=True):
                blocks, children = parse(page or "")
                marked: dict[int, bool] = {}
                for b in blocks:
                    feature = _hash(b.text)
                    out += [(host, p, 0, feature, b.dropped) for p in b.paths]
                    marked.update((p, marked.get(p, True) and b.dropped) for p in b.paths)
                out += [(host, p, 1, _hash(children.get(p, ())), m) for p, m in marked.items()]
            yield pd.DataFrame(out, columns=["host", "node", "kind", "feature", "marked"])

    rows = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    counted = rows.mapInPandas(run, "host string, node long, kind int, feature long, marked boolean")
    counted = counted.groupBy("host", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("k"), F.bool_and("marked").alias("marked"))
    counted = materialise(counted, "style_features")
    shown = counted.where("kind = 1").groupBy("host", "node").agg(F.sum("k").alias("pages"))
    joined = counted.join(shown, ["host", "node"])
    m = F.greatest(F.log(F.col("pages").cast("double")), F.lit(1e-9))
    share = F.col("k") / F.col("pages")
    by = joined.groupBy("host", "node", "pages").agg(
        F.bool_and("marked").alias("marked"),
        F.sum(F.when(F.col("kind") == 1, -share * F.log(share))).alias("entropy"),
        (F.sum(F.when(F.col("kind") == 0, F.col("k") * (1 - F.least(F.lit(1.0), F.log(F.col("k").cast("double")) / m))))
         / F.sum(F.when(F.col("kind") == 0, F.col("k")))).alias("content"),
    )
    one = F.col("pages") < 2
    by = by.withColumn("presentation", F.when(one, 1.0).otherwise(F.col("entropy") / m))
    by = by.withColumn("content", F.when(one, 1.0).otherwise(F.col("content")))
    both = F.lit(1 - CONTENT_SHARE) * F.col("presentation") + F.lit(CONTENT_SHARE) * F.col("content")
    prior = F.when(F.col("marked"), MARKED).otherwise(1.0)
    return by.select("host", "node", "pages", "marked", "presentation", "content", (both * prior).alias("importance"))


def extract(pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` without html, with ``text``: the blocks that stay in page order, joined by line ends.

    Null and empty html give an empty text; a page without a url belongs to the nameless host. Rows that repeat are
    counted and returned as often as they occur. If no block is left the text is empty. A column of ``pages`` that is
    called ``text`` is replaced, others may have any names; an empty table gives an empty result.
    """
    ship(pages.sparkSession)
    low = style_tree(pages).where((F.col("importance") < least) & (F.col("pages") >= least_pages))
    low = materialise(low.where("not marked").select("host", "node"), "low_nodes")  # marked ones go by their mark
    few = low.count() <= MOST_NODES
    host, nodes, at = private([*pages.columns, "text"], "_host", "_low", "_at")
    low = low.groupBy(F.col("host").alias(host)).agg(F.collect_set("node").alias(nodes))
    rows = pages.withColumn(at, host_of(F.col("url").cast("string")))
    rows = rows.join(F.broadcast(low) if few else low, F.col(at) == F.col(host), "left")

    @F.pandas_udf("string")
    def text(html: pd.Series, nodes: pd.Series) -> pd.Series:
        return pd.Series([main_text(parse(h or "")[0], set() if x is None else set(x)) for h, x in zip(html, nodes, strict=True)], dtype=object)

    columns = quoted(c for c in pages.columns if c.lower() not in ("html", "text"))
    return rows.select(*columns, text(F.col("html").cast("string"), nodes).alias("text"))
