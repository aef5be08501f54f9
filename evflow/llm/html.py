"""Main text of web pages by paths that the pages of a host agree on.

Each page scores its containers by the prose in them: a block's characters outside links count for the container it
stands in, half for the next element out, a quarter for the one beyond.  Prose counts a fiftieth for each element around
it that names itself a menu, sidebar, advert, comments or the like by class, id or role, or is a form or hidden.  A best
container inside an article or main element gives way to that element, unless such an element stands between.  Its path
(tags and classes from the root, digits made alike), known by a hash, is the page's vote.  Spark counts the votes of
each host, and each page is extracted again from the containers with its host's winning path; a page without that path,
or with no text there, uses its own best container.  Within a container, elements that name themselves boilerplate are
left out; navigation, header, footer, aside and the like are left out everywhere by tag, and form controls, scripts and
styles with them.

Names alone drop little within the container: those of menus, adverts, sidebars, comments and the like count on blocks
that hold others, never on paragraphs, headings or inline elements.  A block whose name may as well be the article's (a
header, form, notice, search, legal text...) is kept if it has a heading and few links, or long prose and hardly any
links.  If nothing but named blocks has prose, all are kept.  Where one article element alone on the page has prose, a
twentieth of the page's at least, it is the page's vote, however long reader comments beside it are.

A page is read in one pass whose time grows with its length alone: an open element knows its path's hash and its
nearest enclosing block and list, which count what is open in them, so no tag walks over elements that it doesn't close.

Cases: a null or empty page, or one without prose, gives an empty text and no vote; a null url is a host of its own;
repeated pages vote as often as they occur; ties go to the deepest path, then to the greatest hash; a very long page, or
one of very deep nesting, is one row, which a task holds; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evflow.llm.store import stage
from evflow.llm.text import slices

#: Bytes of hosts with their winning paths that go to every executor at most; beyond that they are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: A host's pages are dealt to so many joined groups when its paths are joined by shuffle.
SALTS = 64
#: What prose inside an element that names itself boilerplate counts.
BOILER_WEIGHT = 0.02

# HTML's elements by kind.
_RAW = "script|style|noscript|template|textarea|iframe|title"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article body div form main section td blockquote center html".split())
_LIST = _CONTAINER | {"ul", "ol", "dl", "table"}
_LEFT_OUT = frozenset("nav header footer aside menu button dialog head fieldset label input select option optgroup datalist".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMED = frozenset("div section form ul ol dl table tbody tr td th center details dir figure blockquote li".split())
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_CLOSES_P = _BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOILER_WORD = "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead header topbar toolbar comment comments respond reply replies disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget search pagination pager copyright legal disclaimer skip form"

#: Those of them that parts of an article have in their names as well.
_EITHER_WORD = "banner side footer foot masthead header notice notices alert legal copyright disclaimer search form widget skip head"

_BOILER_CLASS = frozenset(_BOILER_WORD.split())
_EITHER_CLASS = frozenset(_EITHER_WORD.split())
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][^\s/>]*)[^>]*>?", re.I | re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_READ = frozenset(("class", "id", "role", "hidden"))
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


class Node:
    """An open element.

    ``path`` is its path's hash, ``boiler`` how many elements on it name themselves boilerplate, ``inside`` the same of
    the element of the wanted path around it; ``scope`` and ``lists`` are the nearest block and list, itself among them,
    and ``opened`` and ``listed`` what is open in them by tag.
    """

    __slots__ = ("article", "at", "boiler", "container", "inside", "left_out", "link", "listed", "lists", "named", "opened", "parent", "path", "scope", "sure", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None, wanted: int | None):
        found = {}
        if attrs:
            for k, a, b, c in _ATTR.findall(attrs):
                if (k := k.lower()) in _READ:
                    found.setdefault(k, a or b or c)
        classes = found["class"].split() if "class" in found else []
        self.tag, self.parent = tag, parent
        self.opened: dict[str, int] | None = None
        self.listed: dict[str, int] | None = None
        if parent is None:
            self.named = self.article = None
            self.sure = False
            self.at, self.boiler, self.left_out, self.link, self.path, self.inside = 0, 0, False, False, 0, 0 if wanted == 0 else None
            self.container = self.scope = self.lists = self
            return
        self.at = parent.at + 1
        name = tag + "".join(f".{_DIGITS.sub('N', c)}" for c in sorted(classes)) if classes else tag
        self.path = xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), seed=parent.path & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
        says = names_boilerplate(tag, classes, found)
        self.boiler, self.sure = parent.boiler + (says > 0), says > 1
        self.article = parent.article or (self if tag == "article" else None)
        self.left_out = parent.left_out or tag in _LEFT_OUT
        self.link = tag == "a" or parent.link
        self.container = self if tag in _CONTAINER else parent.container
        self.scope = self if tag in _BLOCK and tag != "p" else parent.scope
        self.lists = self if tag in _LIST else parent.lists
        self.inside = parent.inside
        self.named = parent.named
        if self.inside is not None and self.named is None and says:
            self.named = self
        if self.inside is None and wanted is not None and self.path == wanted:
            self.inside = self.boiler


def names_boilerplate(tag: str, classes: list[str], attrs: dict[str, str]) -> int:
    """Whether an element says by role, class, id or otherwise that it is not the article: 0 no, 1 maybe, 2 yes."""
    if "hidden" in attrs or attrs.get("role", "").lower() in _BOILER_ROLE:
        return 2
    if tag not in _NAMED:
        return 0
    words = {w.lower() for n in (*classes, attrs.get("id", "")) for w in _PART.findall(n)}
    if not words.isdisjoint(_BOILER_CLASS - _EITHER_CLASS):
        return 2
    return int(tag == "form" or not words.isdisjoint(_EITHER_CLASS))


class Stack:
    """The open elements."""

    def __init__(self, wanted: int | None):
        self.wanted = wanted
        self.nodes = [Node("", "", None, wanted)]
        self.blocks: dict[str, int] = {}

    def push(self, tag: str, attrs: str) -> None:
        top = self.nodes[-1]
        for scope, name in ((top.scope, "opened"), (top.lists, "listed")):
            counts = getattr(scope, name)
            if counts is None:
                counts = {}
                setattr(scope, name, counts)
            counts[tag] = counts.get(tag, 0) + 1
        if tag in _BLOCK:
            self.blocks[tag] = self.blocks.get(tag, 0) + 1
        self.nodes.append(Node(tag, attrs, top, self.wanted))

    def cut(self, at: int) -> None:
        """Close the elements from place ``at`` on."""
        for node in self.nodes[at:]:
            node.parent.scope.opened[node.tag] -= 1
            node.parent.lists.listed[node.tag] -= 1
            if node.tag in _BLOCK:
                self.blocks[node.tag] -= 1
        del self.nodes[at:]

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the last open element of these tags, of which there is one."""
        at = len(self.nodes) - 1
        while self.nodes[at].tag not in tags:
            at -= 1
        return at

    def end(self, tag: str) -> None:
        """An end tag: one of a block closes all up to its element, another one stays within its block."""
        if self.blocks.get(tag) if tag in _BLOCK else (self.nodes[-1].scope.opened or {}).get(tag):
            self.cut(self.last((tag,)))

    def start(self, tag: str, attrs: str, closed: bool) -> None:
        """A start tag, after what it closes by itself: an open paragraph, or its sibling in a list or table."""
        top = self.nodes[-1]
        if tag in _CLOSES_P and top.scope.opened and top.scope.opened.get("p"):
            self.cut(self.last(("p",)))
        if tag in _BLOCK and (counts := self.nodes[-1].scope.opened) and counts.get("select"):
            self.cut(self.last(("select",)))
        if siblings := _SIBLING.get(tag):
            lists = self.nodes[-1].lists
            if lists.listed and any(lists.listed.get(t) and lists is not self.nodes[-1] for t in siblings):
                self.cut(self.last(siblings))
            elif lists.tag in siblings:
                self.cut(lists.at)
        if not closed:
            self.push(tag, attrs)


class Block(NamedTuple):
    """A block of prose: the element and the container it stands in, its text and the characters of it in links."""

    node: Node
    container: Node
    text: str
    linked: int


def blocks(html: str, wanted: int | None = None) -> Iterator[Block]:
    """Blocks of prose in page order; with a ``wanted`` path, only what stands in an element of that path."""
    stack = Stack(wanted)
    text: list[str] = []
    linked = 0
    end = 0

    def read(piece: str, top: Node) -> None:
        nonlocal linked
        if not top.left_out and (top.boiler == top.container.boiler if wanted is None else top.inside is not None):
            text.append(piece)
            linked += top.link * len(piece)

    def close() -> Block | None:
        nonlocal linked
        if not text:
            return None
        whole = _SPACE.sub(" ", unescape("".join(text))).strip()
        text.clear()
        inside, linked = linked, 0
        return Block(stack.nodes[-1], stack.nodes[-1].container, whole, inside) if whole else None

    for m in _TOKEN.finditer(html):
        if m.start() > end:
            read(html[end : m.start()], stack.nodes[-1])
        end = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        if tag in _BLOCK and (done := close()):
            yield done
        if m[2] or m[5]:
            stack.end(tag)
        elif tag not in _VOID:
            attrs = m[4] or ""
            stack.start(tag, attrs, attrs.endswith("/") and tag not in _BLOCK)
    if end < len(html):
        read(html[end:], stack.nodes[-1])
    if done := close():
        yield done


def best_path(found: list[Block]) -> tuple[int, float] | None:
    """The page's best container by prose outside links, as its path's hash, with its score."""
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    articles: dict[int, tuple[Node, float]] = {}
    prose = 0.0
    for block in found:
        node = block.container
        gain = float(max(0, len(block.text) - 2 * block.linked)) * BOILER_WEIGHT**node.boiler
        prose += gain
        if (own := node.article) is not None and not own.boiler and gain:
            articles[id(own)] = own, articles.get(id(own), (own, 0.0))[1] + gain
        for up in range(3):
            scores[node.path] = scores.get(node.path, 0.0) + gain / (1 << up)
            nodes.setdefault(node.path, node)
            if (node := node.parent) is None:
                break
    if len(articles) == 1:
        own, gain = next(iter(articles.values()))
        if gain >= prose / 20:
            return own.path, gain
    best = max((p for p, s in scores.items() if s > 0), key=lambda p: (scores[p], nodes[p].at, p), default=None)
    if best is None:
        return None
    kept, whole = {}, nodes[best]
    while whole is not None and whole.boiler == nodes[best].boiler:
        kept[whole.tag] = whole.path
        whole = whole.parent
    return kept.get("article", kept.get("main", best)), scores[best]


def kept_texts(found: list[Block]) -> list[str]:
    """Texts of the blocks without those that stand in boilerplate within the container."""
    sums: dict[int, list[int]] = {}
    free = False
    for b in found:
        heading = b.node.tag in _HEADING
        if b.node.named is None:
            free = free or not heading
        else:
            own = sums.setdefault(id(b.node.named), [0, 0, 0])
            own[0] += len(b.text)
            own[1] += b.linked
            own[2] += heading

    def stays(node: Node | None) -> bool:
        if node is None:
            return True
        size, linked, headings = sums[id(node)]
        return not node.sure and (headings > 0 and 3 * linked < size or size >= 400 and 10 * linked < size)

    if not free and not any(stays(b.node.named) for b in found if b.node.tag not in _HEADING):
        return [b.text for b in found]
    return [b.text for b in found if stays(b.node.named)]


def main_text(html: str | None, winner: int | None) -> str:
    """Text of the containers with the winning path, else of the page's best one; blocks are parted by an empty line."""
    if not html:
        return ""
    kept = kept_texts(list(blocks(html, winner))) if winner is not None else []
    if not kept and (best := best_path(list(blocks(html)))):
        kept = kept_texts(list(blocks(html, best[0])))
    return "\n\n".join(kept)


def host_votes(pages: DataFrame) -> DataFrame:
    """One vote a page with prose: its host, best path and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                rows = []
                for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    if html and (best := best_path(list(blocks(html)))):
                        rows.append((host, *best))
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64()), strict=True)], names=["host", "path", "score"])

    return pages.select("host", "html").mapInArrow(run, "host string, path long, score double")


def winning_paths(votes: DataFrame) -> DataFrame:
    """Each host's path with most votes, then the highest score; votes are summed before they are dealt by host."""
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    best = F.max_by("path", F.struct("votes", F.round("score", 6).alias("score"), "path"))
    return counted.groupBy("host").agg(best.alias("path"), F.max("votes").alias("votes"))


def extract(pages: DataFrame, min_votes: int = 2, salts: int = SALTS) -> DataFrame:
    """Main text of every page; ``min_votes`` is how many pages must agree on a path for it to bind the host.

    Returns page_id, url, text, n_chars, path (hash of the host's winner, null if none binds).
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host.alias("host"))
    winners = stage(winning_paths(host_votes(pages)).where(F.col("votes") >= min_votes).select("host", "path"), "host-paths")
    if (winners.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        joined = pages.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        dealt = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        joined = dealt.join(salted.hint("shuffle_merge"), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h, p) for h, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist(), strict=True)]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), part.column("path")]
                yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars", "path"])

    return joined.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long, path long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
