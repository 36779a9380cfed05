"""Operator 8: main text of web pages by site template removal.

Every element's subtree is hashed twice: with its text, and by its shape (tags, classes, ids and
roles, with text and repeated siblings masked). Per host, Spark counts on how many different
pages each hash occurs; copies of a page count once. What recurs on many pages of its host is
template and is deleted, outer elements first:

* a subtree with its text, wherever it stands; paragraphs, headings and list items of an
  article stay, since quoted or reposted articles recur too;
* a shape that has a name (a class, id or role, or a tag such as nav or footer), as its text
  may change from page to page. Shapes are learned where an article or main element shows that
  they stand outside it, and deleted on every page of the host.

What counting cannot settle - hosts of few pages, reader comments - falls to a named fallback:
text outside a page's article or main element, and elements that their tag, role or class marks
as no part of an article. A class or id marks an element only if all its words are such marks or
names of plain boxes (``share-buttons``, but not ``menu-history``). ``template_chars`` and
``fallback_chars`` say how much text each way deleted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.llm.common import arrow_limits, materialize

#: A subtree is template if it is on so many different pages of its host, ...
LEAST_PAGES = 5
#: ... and on this share of them; inside an article, on the second share; ...
SHARE = 0.1
SHARE_INSIDE = 0.5
#: ... but on so many different pages it is template whatever its share of a large host.
MANY_PAGES = 50

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_DIGITS = re.compile(r"[0-9]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names by their role in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rt",
}
LANDMARK = {"article", "main"}
DROPPED = {
    "nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "head",
    "title", "dialog", "menu", "textarea", "object", "embed", "canvas", "noframes", "math", "audio", "video",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
MARKS = {
    "ad", "ads", "advert", "advertisement", "adsense", "sponsored", "sponsor", "promo", "promotion", "banner", "cookie", "cookies", "consent",
    "gdpr", "notice", "sidebar", "comment", "comments", "disqus", "respond", "reply", "share", "sharing", "social", "related", "newsletter",
    "subscribe", "signup", "login", "breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "footer", "popup", "modal", "overlay",
    "masthead", "toolbar", "pagination", "pager", "widget", "skip",
}
#: Words that name a box whatever it holds; beside a mark they leave it one.
BOXES = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "content", "form", "group", "icons", "inner", "item",
    "items", "left", "link", "links", "list", "main", "outer", "panel", "right", "section", "site", "slot", "small", "thread", "top", "unit", "wrap",
    "wrapper",
}
#: Elements whose start ends an open paragraph.
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
    "table", "ul",
}
#: Elements that end an open one of the second set when they start, up to one of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Text that an article consists of: never template inside one.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "tr", "tbody", *LANDMARK, *INLINE}


class Node:
    __slots__ = ("tag", "name", "landmark", "dropped", "inside", "first", "last", "digest", "hasher", "solid", "shape", "children")

    def __init__(self, tag, name, landmark, dropped, inside, first, hasher):
        self.tag, self.name, self.landmark, self.dropped, self.inside = tag, name, landmark, dropped, inside
        self.first, self.last, self.digest, self.hasher, self.solid = first, first, 0, hasher, False
        self.shape, self.children = 0, []


def _read(tag: str, attributes: str) -> tuple[bool, str]:
    """The fallback - whether role, class or id, or being hidden, mark an element as no part of
    the article - and the element's name: its role, id and classes, digits masked."""
    if not attributes.strip():
        return False, ""
    marked, names = False, []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in ("body", "html"):
            for own in value.split():
                words = {w.lower() for w in _NAME.findall(own) if not w.isdigit()}
                marked |= bool(words & MARKS) and words <= MARKS | BOXES
            names += sorted(f"{name}={own}" for own in set(_DIGITS.sub("#", value).split()))
        elif name == "role":
            marked |= value.lower() in ROLES
            names.append(f"role={value.lower()}")
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            marked = True
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            marked = True
    return marked, " ".join(names)


def parse(html: str) -> tuple[list[str], list[Node]]:
    """(pieces of text, elements in the order of their ends); a blank piece stands between blocks.

    Unclosed elements end where HTML implies it or with their parent; stray end tags do nothing.
    """
    pieces: list[str] = []
    done: list[Node] = []
    stack: list[Node] = []

    def text(raw: str) -> None:
        if raw:
            pieces.append(unescape(raw) if "&" in raw else raw)
            if stack and not raw.isspace():
                stack[-1].solid = True
                stack[-1].hasher.update(" ".join(raw.split()).encode("utf-8", "surrogatepass"))

    def close() -> None:
        node = stack.pop()
        if node.tag not in INLINE:
            pieces.append(" ")
        node.last = len(pieces)
        node.digest = node.hasher.intdigest()
        node.shape = xxhash.xxh64_intdigest(f"{node.tag} {node.name} {node.solid} {node.children}", 1)
        node.children.clear()
        if stack:
            stack[-1].solid |= node.solid
            stack[-1].hasher.update(node.digest.to_bytes(8, "little"))
            if node.tag not in INLINE and stack[-1].children[-1:] != [node.shape]:
                stack[-1].children.append(node.shape)
        done.append(node)

    def close_to(tags: set[str], until: set[str]) -> None:
        """Ends the innermost open element of ``tags``, unless one of ``until`` is nearer."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in until:
                return

    at = 0
    while m := _MARKUP.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            close_to({tag}, set())
            continue
        if tag in ENDS_PARAGRAPH:
            close_to({"p"}, {"table", "td", "th", "li", "button", "object", *LANDMARK} - {tag})
        if tag in ENDS:
            close_to(*ENDS[tag])
        if tag not in INLINE:
            pieces.append(" ")
        if tag in VOID:
            continue
        above = stack[-1] if stack else None
        marked, name = _read(tag, m[3])
        landmark = tag in LANDMARK and not marked
        inside = bool(above and (above.inside or above.landmark))
        own = marked or tag in DROPPED and not (tag == "header" and inside)
        if landmark and above and above.dropped != "marked":
            dropped = ""  # an article in a navigation that was never closed
        else:
            dropped = (above.dropped if above else "") or ("marked" if marked else "tag" if own else "")
        hasher = xxhash.xxh64(tag)
        hasher.update(m[3].encode("utf-8", "surrogatepass"))
        stack.append(Node(tag, name, landmark, dropped, inside, len(pieces), hasher))
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
            stop = end.start() if end else len(html)
            text(html[at:stop])
            at = stop
            if not end:
                break
    text(html[at:])
    while stack:
        close()
    return pieces, done


#: Elements that hold nothing to be read.
UNREAD = {"html", "body", "head", "title", *RAW}


#: Elements that hold text of any kind; without a name their shape says nothing.
PLAIN = PROSE | {"div", "section", "ul", "ol", "dl", "table", "thead", "tfoot", "figure", "figcaption", "details", "summary", "center", "address"}


def _countable(n: Node) -> bool:
    """Whether an element can be template: it has text and is no article, nor prose of one."""
    return n.solid and n.tag not in UNREAD and not n.landmark and not (n.inside and n.tag in PROSE)


def _shaped(n: Node) -> bool:
    """Whether an element can be template by its shape."""
    return _countable(n) and n.tag not in INLINE and (bool(n.name) or n.tag not in PLAIN)


def _landmarks(nodes: list[Node]) -> list[Node]:
    return [n for n in nodes if n.landmark and not n.dropped and n.solid]


def subtrees(html: str | None) -> tuple[list[int], list[int], list[int], int]:
    """Signed hashes of a page's distinct subtrees with text (outside articles, with the shapes there
    if the page has an article; inside them), of its other shapes, and of the whole page."""
    outside, inside, others = set(), set(), set()
    pieces, nodes = parse(html or "")
    whole = xxhash.xxh64_intdigest(" ".join(" ".join(pieces).split()).encode("utf-8", "surrogatepass"))
    known = bool(_landmarks(nodes))
    for n in nodes:
        if _countable(n):
            (inside if n.inside else outside).add(_signed(n.digest))
        if _shaped(n):
            (outside if known and not n.inside else others).add(_signed(n.shape))
    return sorted(outside), sorted(inside), sorted(others), _signed(whole)


def _is_template(n: Node, template: set[int]) -> bool:
    return _countable(n) and _signed(n.digest) in template or _shaped(n) and _signed(n.shape) in template


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def main_text(html: str | None, template: set[int]) -> str:
    """The page's text without markup, template and what is no part of the article."""
    return measured(html, template)[0]


def measured(html: str | None, template: set[int]) -> tuple[str, int, int]:
    """(main text, characters that the template took, characters that the fallback took after it)."""
    pieces, nodes = parse(html or "")
    outer = sorted((n for n in nodes if n.last > n.first), key=lambda n: (n.first, -n.last))  # outer elements first
    landmarks = _landmarks(outer)
    unread = bytearray(len(pieces))
    for n in outer:
        if n.tag in RAW or n.tag in ("head", "title"):
            unread[n.first : n.last] = b"\1" * (n.last - n.first)
    kept = bytearray(b"\1" * len(pieces))
    for n in outer:
        if n.landmark and not n.dropped and n.solid:
            kept[n.first : n.last] = b"\1" * (n.last - n.first)
        elif template and _is_template(n, template):
            kept[n.first : n.last] = bytes(n.last - n.first)
    by_template = sum(len(p.strip()) for p, k, u in zip(pieces, kept, unread, strict=True) if not k and not u)
    if landmarks:
        within = bytearray(len(pieces))
        for n in landmarks:
            within[n.first : n.last] = kept[n.first : n.last]
        rest = within
    else:
        rest = bytearray(kept)
    held = bytes(rest)
    for n in outer:
        if n.landmark and not n.dropped and n.solid:
            rest[n.first : n.last] = held[n.first : n.last]
        elif n.dropped:
            rest[n.first : n.last] = bytes(n.last - n.first)
    by_fallback = sum(len(p.strip()) for p, k, r, u in zip(pieces, kept, rest, unread, strict=True) if k and not r and not u)
    # A piece that is left out parts what stands around it.
    return " ".join("".join(p if k else " " for p, k in zip(pieces, rest, strict=True)).split()), by_template, by_fallback


def templates(pages: DataFrame) -> DataFrame:
    """``pages(host, page, html)`` -> (page, template): the hashes of template subtrees on each page that has any.

    ``page`` stands for host and html. Counting combines before the shuffle, so a host with most
    pages is no one task; pages meet the templates by (host, subtree), so that no host's list is
    held as a whole, and a page's list is no longer than its own subtrees. Null html has no
    subtree, rows that repeat a page count once, and an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subtrees(h.as_py()) for h in batch.column(2)]
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            kinds = (*[pa.list_(pa.int64())] * 3, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["host", "page", "outside", "inside", "others", "whole"],
            )

    lists = ", ".join(f"{c} array<long>" for c in ("outside", "inside", "others"))
    found = materialize(pages.mapInArrow(run, f"host string, page binary, {lists}, whole long"), "subtrees")
    wholes = found.groupBy("host", "whole").agg(F.min(F.struct("outside", "inside")).alias("x")).select("host", "whole", "x.*")
    sizes = wholes.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    counted = (
        wholes.select("host", F.explode(F.array(F.struct(F.col("outside").alias("h"), F.lit(False).alias("inside")), F.struct(F.col("inside").alias("h"), F.lit(True).alias("inside")))).alias("x"))
        .select("host", "x.inside", F.explode("x.h").alias("subtree"))
        .groupBy("host", "inside", "subtree")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_PAGES)
    )
    share = F.when(F.col("inside"), SHARE_INSIDE).otherwise(SHARE)
    known = (
        counted.join(sizes, "host")
        .where(F.col("n") >= F.least(share * F.col("pages"), F.lit(MANY_PAGES)))
        .select("host", "subtree")
        .distinct()
    )
    own = found.groupBy("host", "page").agg(F.first(F.array_union(F.array_union("outside", "inside"), "others")).alias("own"))
    return (
        own.select("host", "page", F.explode("own").alias("subtree"))
        .join(materialize(known, "templates"), ["host", "subtree"])
        .groupBy("page")
        .agg(F.collect_set("subtree").alias("template"))
    )


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> page_id, url, text, n_chars, template_chars, fallback_chars,
    one row per row.

    Null html is empty and has the text "". Pages whose url names no host share one without a
    template of its own. Repeated rows and null ids each return; an empty table gives an empty
    one; further columns are ignored.
    """
    arrow_limits(pages.sparkSession)
    host = F.lower(F.nullif(F.regexp_extract(F.col("url").cast("string"), _HOST, 1), F.lit("")))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    rows = rows.withColumn("page", F.unhex(F.md5(F.concat_ws("\n", F.length("host"), "host", F.isnull("html"), "html"))))
    known = materialize(templates(rows.where("host is not null").select("host", "page", "html")), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                measured(html.as_py(), set(template.as_py() or ()))
                for html, template in zip(batch.column(2), batch.column(3), strict=True)
            ]
            texts, by_template, by_fallback = list(zip(*found, strict=True)) or [(), (), ()]
            counts = (map(len, texts), by_template, by_fallback)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts)],
                ["page_id", "url", "text", "n_chars", "template_chars", "fallback_chars"],
            )

    kinds = dict(rows.dtypes)
    # One short row a page: hashed, so that no html is sorted.
    joined = rows.join(known.hint("shuffle_hash"), "page", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, template_chars long, fallback_chars long")
