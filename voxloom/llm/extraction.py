"""Main text of web pages by the consensus of their hosts.

First pass: each page's containers are scored by the prose that they hold outside of boilerplate, and those near the best
vote for their path, written as tags and classes with digits generalised (``html/body/div.post-#/article``). Spark adds up
the votes per host. Second pass: of the paths that a page has, the one its host values most is extracted; so a page with
little text, or with a long sidebar, is read where the other pages of its host have their article.

A path's value is the mean of its points (100 on a page where it is the best) over the host's pages that vote for it,
drawn towards ``PRIOR`` by ``PRIOR_PAGES`` pages. Paths voted for by one page alone have the value of that one vote, which
the page knows itself; the others are kept where ``SHARE`` of the host's votes or more is theirs, which bounds their number
per host. Hosts go to the pages by broadcast only if their list was counted and is small, else by a join that splits
hot hosts.

Nulls: a null html is empty text, a null url a host of its own. Every row gives a row, equal ones equal rows; pages without
prose give an empty text. Work is linear in a page's length; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import map_arrow, small_batches, written

PRIOR, PRIOR_PAGES, SHARE, NEAR = 50, 3, 0.02, 50
BROADCAST_PATHS = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z!?/][^>]*\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_HEADING = re.compile("h[1-6]")

# Fixed values of HTML: elements without content, with raw text, blocks, and what an open p, li, ... ends at.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title iframe xmp noembed noframes".split())
_BLOCK = set(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table caption colgroup tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - set("html head body dd dt li optgroup option caption colgroup tbody td tfoot th thead tr legend".split()) | {"li", "dd", "dt"}
_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
_SCOPE = {"table", "td", "th", "caption", "html"}
_CONTAINER = set("html body address article blockquote center details div figure fieldset main section table tbody td tr".split())

_DROPPED = set(
    "head script style noscript template svg math canvas object embed iframe audio video map nav aside footer button select textarea input menu dialog "
    "title noembed noframes xmp datalist".split()
)
_ROLES = set("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog status".split())
#: Names of parts that are no article, and of parts that are even if they hold the heading.
_PART = set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs pager pagination sitemap skip topbar toolbar masthead header footer foot colophon copyright legal "
    "disclaimer sidebar side aside rail widget widgets related recommended recommendations suggested trending popular ad ads adv advert adverts advertisement "
    "advertising adsense banner sponsor sponsored promo promoted promotion teaser cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "lightbox paywall newsletter subscribe subscription signup login signin register search form share sharing social follow comment comments commentlist disqus "
    "respond reply replies responses discussion hidden".split()
)
_ALWAYS = set("comment comments commentlist disqus respond replies responses ad ads advert adverts advertisement advertising adsense nav navbar cookie cookies consent".split())
_NOT_PART = set("no without has with".split())
_GOOD = set("article content story post entry main body text prose".split())


class Node:
    """An element; ``name`` is its step of a path, empty for tags that are none, ``key`` the path's hash.

    ``good`` and ``bad`` are the characters of prose and links below it, ``down`` the most prose of a container inside.
    """

    __slots__ = ("parent", "tag", "name", "key", "dropped", "mute", "link", "inner", "named", "good", "bad", "down")

    def __init__(self, parent: Node | None, tag: str, name: str, dropped: bool):
        self.parent, self.tag, self.name, self.dropped = parent, tag, name, dropped
        above = parent.key if parent else 0
        self.key = xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), above) if name else above
        self.mute = self.link = self.inner = False
        self.named = self.good = self.bad = self.down = 0

    def path(self) -> str:
        names, node = [], self
        while node:
            names += [node.name] if node.name else []
            node = node.parent
        return "/".join(reversed(names))


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _named(attributes: dict[str, str]) -> tuple[list[str], set[str]]:
    """The generalised classes, and the words of class and id."""
    classes = sorted({_DIGITS.sub("#", c) for c in attributes.get("class", "").split()})
    words: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [w.lower() for w in _WORD.findall(name)]
        if not _NOT_PART & set(parts):
            words |= set(parts)
    return classes, words


def _hidden(tag: str, attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return (
        tag in _DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style
        or "visibility:hidden" in style or (attributes.get("role", "").lower() in _ROLES and tag not in ("html", "body"))
    )


class Page:
    """The elements of a page, and its text as runs: (element, block number, text)."""

    def __init__(self, html: str):
        self.nodes = [Node(None, "html", "html", False)]
        self.runs: list[tuple[Node, int, str]] = []
        self.suspects: list[tuple[Node, bool]] = []
        self._open = [self.nodes[0]]
        self._count = {"html": 1}
        self._block = 0
        self._read(html)
        self._judge()

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        lower = None
        while at < n:
            found = _TOKEN.search(html, at)
            if not found:
                self._text(html[at:])
                break
            if found.start() > at:
                self._text(html[at : found.start()])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                self._end(tag)
                continue
            self._start(tag, found[3] or found[6] or "")
            if tag in _RAW:
                lower = html.lower() if lower is None else lower
                if len(lower) != n:  # some letters change their length
                    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), html)
                end = lower.find(f"</{tag}", at)
                at = n if end < 0 else end

    def _text(self, text: str) -> None:
        self.runs.append((self._open[-1], self._block, unescape(text) if "&" in text else text))

    def _pop(self, node: Node) -> None:
        while True:
            gone = self._open.pop()
            self._count[gone.tag] -= 1
            self._block += gone.tag in _BLOCK
            if gone is node:
                return

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Ends the outermost open element of ``tags`` inside the nearest of ``stop``."""
        if not any(self._count.get(t) for t in tags):
            return
        last = None
        for node in reversed(self._open):
            if node.tag in stop or node.parent is None:
                break
            if node.tag in tags:
                last = node
        if last:
            self._pop(last)

    def _start(self, tag: str, rest: str) -> None:
        if tag in ("html", "body"):
            if self._count.get(tag):
                return
            if tag == "body":
                self._close({"head"}, set())
        if tag == "br":
            self.runs.append((self._open[-1], self._block, " "))
            return
        if tag in _ENDS_P and self._count.get("p"):
            self._close({"p"}, _SCOPE)
        if tag in _SAME:
            self._close(*_SAME[tag])
        self._block += tag in _BLOCK
        if tag in _VOID:
            return
        attributes = _attributes(rest) if "=" in rest or "hidden" in rest else {}
        classes, words = _named(attributes) if attributes else ([], set())
        parent = self._open[-1]
        node = Node(parent, tag, ".".join([tag, *classes]) if tag in _CONTAINER else "", parent.dropped or _hidden(tag, attributes))
        node.inner = parent.inner or parent.tag in ("article", "main")  # inside of an article
        node.link = parent.link or tag == "a"
        node.named = sum(w in _GOOD for w in words)
        if not node.dropped and tag not in ("html", "body", "main") and (tag == "form" or words & _PART):
            self.suspects.append((node, bool(words & _ALWAYS)))
        if tag == "header":
            node.dropped |= not node.inner
            node.mute = True
        self.nodes.append(node)
        if rest.endswith("/") and tag not in _BLOCK and tag not in ("a", "span", "b", "i", "em", "strong"):
            return
        self._open.append(node)
        self._count[tag] = self._count.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.runs.append((self._open[-1], self._block, " "))
        if not self._count.get(tag) or tag in ("html", "body"):
            return
        for node in reversed(self._open):
            if node.tag == tag:
                self._pop(node)
                return
            if node.parent is None or (tag not in _BLOCK and node.tag in _BLOCK) or (node.tag in _SCOPE and tag not in _BLOCK):
                return

    def _judge(self) -> None:
        """Drops parts by their names, then adds up prose and links per element."""
        marked = {id(node) for node, _ in self.suspects}
        around: tuple[set[int], set[int]] = (set(), set())  # what holds an article or heading, and what a heading or main
        for node in self.nodes if marked else ():
            if not node.dropped:
                for held, tags in zip(around, (("h1", "main", "article"), ("h1", "main")), strict=True):
                    up = node.parent if node.tag in tags and (node.tag != "article" or id(node) not in marked) else None
                    while up is not None and id(up) not in held:
                        held.add(id(up))
                        up = up.parent
        for node, always in self.suspects:
            # A part's name on what holds the article tells of the layout, not of what it is.
            node.dropped |= id(node) not in around[always]
        blocks: dict[int, list] = {}
        for node in self.nodes[1:]:
            node.dropped |= node.parent.dropped
            # Of an article's header only the headings are text.
            node.mute |= node.parent.mute and not _HEADING.fullmatch(node.tag)
        for node, block, text in self.runs:
            if not (node.dropped or node.mute):
                held = blocks.setdefault(block, [node, 0, 0])
                size = len(text.strip())
                held[1] += size
                held[2] += size if node.link else 0
        for node, size, links in blocks.values():
            if 2 * links > size:
                node.bad += size
            else:
                node.good += size - links
        for node in reversed(self.nodes[1:]):
            if not node.dropped:
                node.parent.good += node.good
                node.parent.bad += node.bad
                node.parent.down = max(node.parent.down, node.good if node.tag in _CONTAINER else node.down)

    def score(self, node: Node) -> int:
        factor = 125 if node.tag in ("article", "main") else 70 if node.tag in ("html", "body") else 100
        return max(0, node.good * (factor + 10 * min(node.named, 2)) - 50 * node.bad)

    def candidates(self) -> dict[int, tuple[int, Node]]:
        """Path to points and element, for containers of at least ``NEAR`` hundredths of the best score.

        Of elements one inside the other with the same prose the inner ones count, or the outer if its score is higher.
        """
        best = {key: (self.score(node), node) for key, node in self.tops().items()}
        top = max((s for s, _ in best.values()), default=0)
        near = {key: (100 * s // top, node) for key, (s, node) in best.items() if top and 100 * s >= NEAR * top}
        return {k: (s, n) for k, (s, n) in near.items() if s == 100 or n.good > n.down}

    def tops(self) -> dict[int, Node]:
        """The element with the highest score of each path."""
        out: dict[int, Node] = {}
        for node in self.nodes:
            if node.name and not node.dropped and node.good and (node.key not in out or self.score(node) > self.score(out[node.key])):
                out[node.key] = node
        return out

    def text(self, top: Node) -> str:
        inside = {id(top)}
        for node in self.nodes:
            if node.parent is not None and id(node.parent) in inside and not node.dropped:
                inside.add(id(node))
        parts: list[tuple[int, list[str]]] = []
        for node, block, text in self.runs:
            if id(node) in inside and not node.mute:
                if not parts or parts[-1][0] != block:
                    parts.append((block, []))
                parts[-1][1].append(text)
        return "\n\n".join(t for t in (" ".join("".join(p).split()) for _, p in parts) if t)


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def worth(points: int, pages: int) -> int:
    """Thousandths of the mean points, drawn towards the prior."""
    return 1000 * (points + PRIOR * PRIOR_PAGES) // (pages + PRIOR_PAGES)


def host_paths(pages: DataFrame) -> DataFrame:
    """Per host the paths that several of its pages vote for, with their worth: host, paths (array of struct path, worth)."""

    def votes(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            counts: dict[tuple[str, int], list[int]] = {}
            for at, html in zip(batch.column(0), batch.column(1), strict=True):
                found = Page(html.as_py() or "").candidates()
                for path, (points, _) in found.items():
                    held = counts.setdefault((at.as_py(), signed(path)), [0, 0])
                    held[0] += points
                    held[1] += 1
            keys = list(counts)
            yield {"host": [h for h, _ in keys], "path": [p for _, p in keys], "points": [counts[k][0] for k in keys], "pages": [counts[k][1] for k in keys]}

    found = map_arrow(pages.select(host(F.col("url")).alias("host"), "html"), votes, "host string, path long, points long, pages long")
    found = written(found.groupBy("host", "path").agg(F.sum("points").alias("points"), F.sum("pages").alias("pages")), "votes")
    total = found.groupBy("host").agg(F.sum("pages").alias("_all"))
    kept = found.where("pages > 1").join(total, "host").where(F.col("pages") >= SHARE * F.col("_all"))
    value = F.floor(F.lit(1000) * (F.col("points") + PRIOR * PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)).cast("long")
    return kept.groupBy("host").agg(F.collect_list(F.struct("path", value.alias("worth"))).alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the winning path of every page."""
    winners = written(host_paths(pages), "hosts")
    few = (winners.agg(F.sum(F.size("paths"))).first()[0] or 0) <= BROADCAST_PATHS
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(winners) if few else winners, "host", "left").select("page_id", "url", "html", "paths")
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("path", pa.string())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = [], []
            for html, known in zip(batch.column(2), batch.column(3), strict=True):
                text, path = extracted(html.as_py() or "", {k["path"]: k["worth"] for k in known.as_py() or ()})
                texts.append(text)
                paths.append(path)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())],
                schema=out,
            )

    small_batches(pages.sparkSession)
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long, path string")


def extracted(html: str, known: dict[int, int]) -> tuple[str, str | None]:
    """Text and path of a page whose host values paths as ``known``; paths it doesn't list have the page's own vote.

    Of several elements of the path the one with the highest score is taken; of paths of one value, that with most prose.
    """
    page = Page(html)
    own = page.candidates()
    best: tuple[int, int] = (-1, -1)
    top: Node | None = None
    for key, node in page.tops().items():
        value = known.get(signed(key), worth(own[key][0], 1) if key in own else -1)
        if value >= 0 and (value, node.good) > best:
            best, top = (value, node.good), node
    return (page.text(top), top.path()) if top else ("", None)
