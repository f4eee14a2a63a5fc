"""Main text of web pages by removal of site templates.

Each page is parsed into a tree of elements. Every element outside the article, and every box
(division, section, list, table) inside it, has a hash of its whole subtree (names, classes, text).
Spark counts, per host, on how many different pages a subtree occurs; subtrees that recur on many
pages of their host are its template and are deleted. What the markup itself names as menu, header,
footer, sidebar, notice, advert, form, comment or script is deleted as well, by tag or by a class, id or
role that is such a name as a whole (or a compound of it); never what holds the article, and inside the
article, by class, only boxes. The text of the article
(of the body where no article is marked) is left, block by block. A paragraph, heading or quotation
that many articles share is content, and so is a box with most of an article's text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import stored, text_key

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z", re.S)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
#: What a start tag ends if it is open, and where the search for it stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)), "option": (("option",), ("select", "optgroup")),
}
DROPPED = frozenset("aside button datalist dialog footer form head header iframe input menu nav noembed noframes noscript script select style svg template textarea title".split())
#: Words in a class, id or role that name a part outside the main text.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that make a compound of a name with them a part ("ad-slot", "share-buttons"), and words that make it a statement about
#: something else ("has-sidebar", "article-header").
HOLDERS = frozenset("area bar block box button buttons container form inner item items left link links list outer panel posts right section slot thread top unit widget wrap wrapper".split())
ABOUT = frozenset("article body content entry fixed has is main no off on page post sticky story text title with without".split())
#: Parts that stay parts in compounds with a word for the page ("main-nav", "page-footer").
CLEAR = frozenset("ad ads advert breadcrumb breadcrumbs comments cookie footer menu nav navbar navigation newsletter sidebar".split())
OF_PAGE = frozenset("main page post".split())
#: Tags that are dropped although they hold an article (a teaser), as long as another article is left.
ASIDES = frozenset("aside dialog footer menu nav noscript template".split())
ROOTS = ("article", "main")
#: Elements inside an article that are compared; paragraphs, headings, items and cells by themselves are content.
BOXES = frozenset("address center details dir div dl fieldset figure ol section table ul".split())
#: A box of so many characters that holds half of its article or more is the article's body.
BODY_CHARS = 500
#: Templates are broadcast up to so many elements (8 bytes each) in all and in one host, beyond that joined page by page.
BROADCAST_ELEMENTS = 1_000_000
HOST_ELEMENTS = 2_000
#: A subtree on so many different pages of a host is template.
ENOUGH_PAGES = 20


class Node:
    __slots__ = ("tag", "words", "children", "parent")

    def __init__(self, tag: str, words: str, parent: Node | None):
        self.tag, self.words, self.children, self.parent = tag, words, [], parent


def parse(page: str) -> Node:
    """The tree of a page; text children are strings with their character references."""
    root = node = Node("", "", None)
    at = 0
    find = TAG.search
    opened: Counter[str] = Counter()  # open elements by tag: what is not open is not searched for
    while True:
        m = find(page, at)
        if m is None:
            if at < len(page):
                node.children.append(page[at:])
            return root
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            while opened[tag]:
                opened[node.tag] -= 1
                node, ended = node.parent, node.tag
                if ended == tag:
                    break
            continue
        if tag in CLOSES_P:
            node = _close(node, ("p",), ("button", "table", "td", "th", "caption", "article", "section", "div", "body", "li", "blockquote"), opened)
        elif tag in ENDS:
            node = _close(node, *ENDS[tag], opened)
        attributes = m[3]
        words = " ".join(a or b or c for a, b, c in NAMED.findall(attributes)).lower() if "=" in attributes else ""
        child = Node(tag, words, node)
        node.children.append(child)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            child.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCKS):
            node = child
            opened[tag] += 1


def _close(node: Node, tags: tuple[str, ...], stops: tuple[str, ...], opened: Counter[str]) -> Node:
    """The node to go on from once the outermost open element of ``tags`` up to a stop is ended."""
    left = sum(opened[t] for t in tags)
    up, out = node, node
    while left and up.parent is not None and up.tag not in stops:
        if up.tag in tags:
            out = up.parent
            left -= 1
        up = up.parent
    while node is not out:
        opened[node.tag] -= 1
        node = node.parent
    return out


def is_root(node: Node) -> bool:
    return node.tag in ROOTS or "main" in node.words.split()


def names_part(token: str) -> bool:
    """True for a class, id or role that names a part outside the main text."""
    if token in PARTS:
        return True
    words = [w for w in WORD.findall(token)]
    if len(words) < 2 or PARTS.isdisjoint(words):
        return False
    about = ABOUT.intersection(words)
    if about:
        return about <= OF_PAGE and words[-1] in CLEAR
    return words[-1] in PARTS or (words[0] in PARTS and words[-1] in HOLDERS)


def named_part(node: Node, inside: bool = False) -> bool:
    """True if the markup says that an element is not main text; ``inside`` an article, classes count for boxes only."""
    if node.tag in DROPPED:
        return True
    if not node.words or node.tag in ("html", "body", "main") or (inside and node.tag not in BOXES):
        return False
    return any(map(names_part, node.words.split()))


def subtree_hashes(root: Node) -> dict[Node, int]:
    """The hashes of the subtrees that may be template, from the leaves up; odd for boxes inside an article, else even.

    No element that is or holds an article is among them, nor a box with the body of its article.
    """
    order, walk = [], [(root, None)]
    while walk:
        node, article = walk.pop()
        if article is None and is_root(node):
            article = node
        order.append((node, article))
        walk += [(c, article) for c in node.children if not isinstance(c, str)]
    digests: dict[Node, bytes] = {}
    sizes: dict[Node, int] = {}
    holding = set()
    for node, _ in reversed(order):
        digest = hashlib.blake2b(f"{node.tag} {node.words}".encode(errors="replace"), digest_size=8)
        size, holds = 0, is_root(node)
        for child in node.children:
            if isinstance(child, str):
                words = " ".join(child.split())
                digest.update(b"\0" + words.encode(errors="replace"))
                size += len(words)
            else:
                digest.update(b"\1" + digests[child])
                size += sizes[child]
                holds = holds or child in holding
        digests[node], sizes[node] = digest.digest(), size
        if holds:
            holding.add(node)
    seen = {}
    for node, article in order:
        if node is root or node in holding or node.tag in ("html", "head", "body") or node.tag in RAW or not node.children:
            continue
        value = int.from_bytes(digests[node], "big", signed=True)
        if article is None:
            seen[node] = value & ~1
        elif node.tag in BOXES and (sizes[node] < BODY_CHARS or 2 * sizes[node] < sizes[article]):
            seen[node] = value | 1
    return seen


def blocks(root: Node, template: frozenset[int] | set[int], hashes: dict[Node, int]) -> list[str]:
    """The blocks of main text in page order."""

    holding, open_nodes = set(), [root]
    while open_nodes:
        node = open_nodes.pop()
        if is_root(node):
            up = node.parent
            while up is not None and up not in holding:
                holding.add(up)
                up = up.parent
        open_nodes += [c for c in node.children if not isinstance(c, str)]

    def dropped(node: Node, inside: bool = False) -> bool:
        return named_part(node, inside) or hashes.get(node) in template

    articles: list[Node] = []
    for through in ((), ASIDES):  # through menus and sidebars only where no article is left otherwise
        open_nodes = [] if articles else [root]
        while open_nodes:
            node = open_nodes.pop()
            if node in holding:
                if node.tag in ASIDES and node.tag not in through:
                    continue
            elif node is not root and dropped(node):
                continue
            if is_root(node):
                articles.append(node)
            else:
                open_nodes += [c for c in reversed(node.children) if not isinstance(c, str)]
    out, line = [], []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    for start in articles or [root]:
        steps: list = [(start, False)]
        while steps:
            node, leave = steps.pop()
            if isinstance(node, str):
                line.append(html.unescape(node) if "&" in node else node)
            elif leave:
                flush()
            elif node is not start and dropped(node, bool(articles)):
                if node.tag in BLOCKS:
                    flush()
            elif node.tag == "br":
                line.append(" ")
            else:
                if node.tag in BLOCKS:
                    flush()
                    steps.append((node, True))
                steps += [(c, False) for c in reversed(node.children)]
        flush()
    return out


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _hashes(page: str) -> tuple[Node, dict[Node, int]]:
    root = parse(page)
    return root, subtree_hashes(root)


def _subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, subtree) of the different subtrees of each row of host, page, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, found = [], [], []
            for host, key, page in zip(*(c.to_pylist() for c in batch.columns)):
                own = set(_hashes(page)[1].values())
                hosts += [host] * len(own)
                keys += [key] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(found, pa.int64())], names=["host", "page", "subtree"])

    return pages.select("host", "page", F.coalesce(F.col("html"), F.lit("")).alias("html")).mapInArrow(run, "host string, page long, subtree long")


def count_templates(source: DataFrame, least_pages: int = 3, share: float = 0.05, inside_share: float = 0.5, enough_pages: int = ENOUGH_PAGES) -> DataFrame:
    """(host, subtree): the hashes of subtrees on ``enough_pages`` different pages of a host, whatever its size.

    On a small host fewer will do: ``least_pages`` that are ``share`` of its different pages. Boxes
    inside an article must be on ``inside_share`` of them, so that what a few articles quote stays.
    """
    counted = _subtrees(source).groupBy("host", "subtree").agg(F.count_distinct("page").alias("n"))
    sizes = source.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    enough = F.col("pages") * F.when(F.col("subtree") % 2 == 0, share).otherwise(inside_share)
    recurring = counted.filter(F.col("n") >= least_pages).join(sizes, "host").filter((F.col("n") >= enough) | (F.col("n") >= enough_pages))
    return recurring.select("host", "subtree")


def _with_template(source: DataFrame, templates: DataFrame) -> DataFrame:
    """``source`` with its template: that of its host broadcast up to checked sizes, else the page's own part of it."""
    templates = stored(templates)
    hosts = templates.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    elements, largest = hosts.agg(F.coalesce(F.sum("n") + F.count(F.lit(1)), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if elements <= BROADCAST_ELEMENTS and largest <= HOST_ELEMENTS:
        return source.join(F.broadcast(templates.groupBy("host").agg(F.collect_list("subtree").alias("template"))), "host", "left")
    hits = _subtrees(source).distinct().join(templates, ["host", "subtree"]).groupBy("host", "page").agg(F.collect_list("subtree").alias("template"))
    return source.join(hits, ["host", "page"], "left")


def extract_main_text(pages: DataFrame, least_pages: int = 3, share: float = 0.05) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    NULL and empty html give an empty text; a NULL url belongs to the host without name. Repeated
    rows give repeated results (copies of a page count as one page of the host); a NULL page_id
    stays NULL; further columns are ignored; an empty table gives an empty result.
    """
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("host"), F.xxhash64(text_key(F.col("html"))).alias("page"))
    templates = count_templates(source, least_pages, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, pages_, templates_ = (c.to_pylist() for c in batch.columns)
            texts = []
            for page, template in zip(pages_, templates_):
                root, hashes = _hashes(page or "") if template else (parse(page or ""), {})
                texts.append("\n".join(blocks(root, frozenset(template or ()), hashes)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    joined = _with_template(source, templates).select("page_id", "url", "html", "template")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
