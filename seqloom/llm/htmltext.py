"""HTML extraction by consensus host paths.

Each page's containers are scored by the text below them, links left out, and the page names
the path, of generalised tag and class names, of its best one. Spark counts by host how many
votes a path gets and how many pages have it: what is the best container of most pages that
have it is the article of a layout, what is there on all pages but seldom best is a sidebar
that is long now and then. Every page is then read again with its host's winning paths, the
surest first: the text of all containers on the first that gives any; else of the page's own
best container.

What is never an article's by its element (menus, footers, forms, scripts) is left out at once, and
so is a container with a class or role that says so by a word of its own (``ad``, ``comments``). A
longer class that only holds such a word (``share-price``, ``share-buttons``), or an id, makes a container suspect: inside the winning container it
goes if Spark sees its text repeated over the host's pages, if it is mostly links, or if it
names adverts or comments; it stays if it holds most of the page. Headings and what stands in a line never
go by a name, tables and their cells not within an article, and its paragraphs and list items
only as notices or adverts. What is left out ends where HTML lets an end tag be left off.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import sized, stored, tidy
from seqloom.llm.urls import host_of

# Fixed names of HTML.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold blocks.
CONTAINER = frozenset("html body div section article main center table tbody thead tfoot tr td th ul ol dl figure fieldset details".split())
#: Elements that begin and end a block of text, besides containers.
BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote address caption figcaption hr summary legend option hgroup".split())
#: Elements whose text is never the article's.
OUT = frozenset("head nav footer aside form button select dialog svg canvas object menu audio video math".split())
#: Classes, ids and roles that mark such text.
OUT_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer"
    " header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies reply respond search"
    " share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets contentinfo complementary".split()
)
#: Classes of an article that is a reader's comment.
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies".split())
#: Words that say it even as the first or last part of a longer class.
STRONG = COMMENT_WORDS | frozenset("ad ads advert advertisement advertising sponsor sponsored cookie cookies consent".split())
#: What a paragraph or list item of an article must be named to go.
ITEM_WORDS = frozenset("ad ads advert advertisement advertising sponsor sponsored promo promoted promotion notice notices cookie cookies consent".split())
#: Containers that a class or role of OUT_WORDS leaves out, and that a longer class or an id makes suspect.
WRAPPER = frozenset("div section center ul ol dl figure fieldset details".split())
#: Elements that an article ends if they were left open before it.
UNCLOSED = ("nav", "header", "form", "aside", "menu", "head")
#: Start tags that end an element without an end tag of its own, unless one of the third kind was opened in it.
_P_ENDS = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_ROW, _CELL = frozenset(("tr", "tbody", "tfoot", "thead")), frozenset(("td", "th"))
IMPLIED: dict[str, tuple[frozenset, frozenset]] = {
    "p": (_P_ENDS, frozenset()), "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    "tr": (_ROW, frozenset(("table",))), **dict.fromkeys(_CELL, (_CELL | _ROW, frozenset(("table",)))), **dict.fromkeys(_ROW - {"tr"}, (_ROW - {"tr"}, frozenset(("table",)))),
}
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')|["'=])*+)>""", re.S
)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
_ATTR = re.compile(r"""\b(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)|display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A child container takes its parent's place if it holds this part of the parent's text.
HOLDS = 0.75
#: Pages of a host that a suspect path needs to be judged by.
LEAST_PAGES = 3
SUSPECT, SURE = 1, 2


class Node:
    """A container. ``size`` counts its characters outside of links, ``linked`` those inside, ``mix`` stands for its text."""

    __slots__ = ("key", "kids", "label", "linked", "mix", "parent", "size", "suspect", "tag")

    def __init__(self, tag: str, label: str, parent: Node | None, suspect: int) -> None:
        self.tag, self.label, self.parent, self.suspect = tag, label, parent, suspect
        self.size = self.linked = self.mix = 0
        self.kids: list[Node] = []
        self.key = _step(parent.key, label) if parent else 0
        if parent:
            parent.kids.append(self)

    @property
    def path(self) -> str:
        labels, at = [], self
        while at.parent:
            labels.append(at.label)
            at = at.parent
        return "".join("/" + x for x in reversed(labels))


def _step(key: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(label, seed=key)


def path_key(path: str) -> int:
    """The key of the nodes on a path: a chain of hashes, so that deep pages take no longer a node."""
    key = 0
    for label in path.split("/")[1:]:
        key = _step(key, label)
    return key


def _names(attrs: str) -> tuple[str, set[str], int]:
    """The generalised class (digits as #, sorted), the words by which class or role name what the element is, and how suspect longer classes, or an id, make it.

    An id may only be the aim of a link, so it alone names nothing.
    """
    cls, named, suspect = "", set(), 0
    for m in _ATTR.finditer(attrs):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "style":
            continue
        if kind == "class":
            cls = ".".join(sorted({re.sub(r"\d+", "#", c).replace("/", "|") for c in value.lower().split()}))
        for token in value.split():
            if token.lower() in OUT_WORDS and kind != "id":
                named.add(token.lower())
                continue
            parts = [p.lower() for p in _PART.findall(token)]
            if OUT_WORDS.intersection(parts):
                suspect = max(suspect, SURE if STRONG.intersection((parts[0], parts[-1])) else SUSPECT)
    return cls, named, suspect


def _named_out(tag: str, cls: str, named: set[str], inner: bool) -> bool:
    """Whether an element's names leave it out; ``inner`` says that it is within an article.

    Headings and what stands in a line never go; nor does a table or its cells within an
    article, whose paragraphs and list items go as notices or adverts alone (items as
    comments too) and whose header is its title's.
    """
    if tag == "article":
        return bool(COMMENT_WORDS & set(cls.split(".")))
    if tag in WRAPPER or (not inner and (tag in CONTAINER or tag in ("p", "li", "dt", "dd")) and tag not in ("html", "body", "main")):
        return bool(named - {"header"} if inner else named)
    return bool(named & (ITEM_WORDS | COMMENT_WORDS if tag == "li" else ITEM_WORDS)) if tag in ("p", "li") else False


def blocks(html: str) -> tuple[Node, list[tuple[str, Node]]]:
    """The tree of containers and the blocks of text, each with the innermost container around it, in page order.

    Menus, page headers, footers, sidebars, notices, adverts, forms, comments and what is
    not text are left out already where an element or a class of its own says so.
    """
    root = Node("", "", None, 0)
    nodes, stack = [root], [root]
    open_ = Counter({"": 1})
    out: list[tuple[str, Node]] = []
    parts: list[str] = []
    linked = 0
    in_link = False
    skip: list[str] = []  # open elements from the first left-out one on
    skipped: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                node = stack[-1]
                links = min(linked, len(text))
                node.linked += links
                node.size += len(text) - links
                node.mix = (node.mix + xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))) % (1 << 64)
                out.append((text, node))
        linked = 0

    def leave_out(tag: str) -> None:
        skip.append(tag)
        skipped[tag] += 1

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at and not skip:
            parts.append(html[at:stop])
            if in_link:
                linked += len(" ".join(html[at:stop].split()))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            if skip:
                if skipped[tag]:
                    while (last := skip.pop()) != tag:
                        skipped[last] -= 1
                    skipped[tag] -= 1
                    continue
                # What is around ends here, and with it an element that was left open.
                loose = skip[0] in IMPLIED or not (skip[0] in CONTAINER or skip[0] in BLOCK or skip[0] in OUT)
                if not (open_[tag] and tag in CONTAINER and (loose or tag in ("article", "main", "body", "html")) or loose and tag in BLOCK):
                    continue
                skip.clear()
                skipped.clear()
            if tag == "a":
                in_link = False
            if tag in CONTAINER or tag in BLOCK or tag in OUT or tag == "header":
                flush()
            if tag in CONTAINER and open_[tag]:
                while (last := stack.pop().tag) != tag:
                    open_[last] -= 1
                open_[tag] -= 1
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(html, at)
            at = close.end() if close else end
            continue
        if tag in VOID or attrs.endswith("/"):
            if tag == "br" and not skip:
                parts.append(" ")
            elif tag == "hr" and not skip:
                flush()
            continue
        inner = bool(open_["article"] or open_["main"])
        if skip and skip[0] in IMPLIED and tag in IMPLIED[skip[0]][0] and not any(skipped[x] for x in IMPLIED[skip[0]][1]):
            skip.clear()
            skipped.clear()
        if skip:
            if tag in ("article", "main") and skip[0] in UNCLOSED and not inner:
                skip.clear()  # an article inside a menu means that the menu was never closed
                skipped.clear()
                in_link = False
            else:
                if tag in CONTAINER or tag in OUT or skipped[tag]:
                    leave_out(tag)
                continue
        cls, suspect, gone = "", 0, False
        if attrs:
            cls, named, suspect = _names(attrs)
            gone = _named_out(tag, cls, named, inner) or (tag not in ("html", "body", "main", "article") and bool(_HIDDEN.search(attrs)))
        if tag in OUT or (tag == "header" and not inner) or gone:
            if tag in CONTAINER or tag in BLOCK or tag in OUT or tag == "header":
                flush()
            leave_out(tag)
            continue
        if tag in CONTAINER:
            flush()
            node = Node(tag, f"{tag}{'.' + cls if cls else ''}", stack[-1], suspect if tag in WRAPPER else 0)
            nodes.append(node)
            stack.append(node)
            open_[tag] += 1
        elif tag in BLOCK or tag == "header":
            flush()
        elif tag == "a":
            in_link = True
    flush()
    for node in reversed(nodes[1:]):
        node.parent.size += node.size
        node.parent.linked += node.linked
        node.parent.mix = (node.parent.mix + node.mix) % (1 << 64)
    return root, out


def _all(root: Node) -> Iterator[Node]:
    """Every node, parents first."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += node.kids


def best(root: Node) -> Node:
    """The deepest container that holds most of the text: from the root down while one child holds HOLDS of it.

    An article or main element counts half as much again.
    """
    now = root
    while now.kids:
        score = lambda k: k.size * (1.5 if k.tag in ("article", "main") else 1.0)
        child = max(now.kids, key=score)
        if not child.size or score(child) < HOLDS * now.size:
            break
        now = child
    return now


def _below(root: Node, found: list[tuple[str, Node]], chosen: set[Node], repeated: set[int]) -> str:
    """The text of the chosen containers without the suspect ones in them that go."""
    inside: set[Node] = set()
    for node in _all(root):
        if node in chosen:
            inside.add(node)
        elif node.parent in inside:
            # The page itself is no article: what only the words of its classes tell is all there is to go by.
            bare = node.suspect and any(n.tag in ("", "html", "body") for n in chosen)
            links = 2 * node.linked >= node.linked + node.size
            gone = node.suspect and (bare or links or node.suspect == SURE or node.key in repeated) and 2 * node.size <= root.size
            if not gone:
                inside.add(node)
    return "\n\n".join(t for t, node in found if node in inside)


def extract(html: str | None, paths: list[str] | None, repeated: Iterable[int] = ()) -> str:
    """The main text of a page, by its host's winning ``paths`` in order and the keys of ``repeated`` suspects."""
    root, found = blocks(html or "")
    gone = set(repeated)
    for path in paths or ():
        key = path_key(path)
        text = _below(root, found, {n for n in _all(root) if n.key == key and n.parent}, gone)
        if text:
            return text
    return _below(root, found, {best(root)}, gone)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page ``(host, path, key, mix)``: its best path; every path with text, by key; the key and text of each suspect."""
    for batch in batches:
        rows = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            root, _ = blocks(html.as_py() or "")
            node = best(root)
            if node.size:
                rows.append((host, node.path, node.key - 2**63, None))
                rows += [(host, None, k - 2**63, None) for k in {n.key for n in _all(root) if n.size}]
            rows += [(host, None, n.key - 2**63, n.mix - 2**63) for n in _all(root) if n.suspect == SUSPECT and n.size + n.linked]
        host, path, key, mix = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(key, pa.int64()), pa.array(mix, pa.int64())], names=["host", "path", "key", "mix"])


def consensus(pages: DataFrame, least: float = 0.05) -> DataFrame:
    """``(host, paths, repeated)``: what a host's pages agree on.

    ``paths`` got ``least`` of the host's votes or more; first those that are best on the
    largest part of the pages that have them, then by votes, then by path. ``repeated`` are
    keys of suspect paths on LEAST_PAGES and a hundredth of the host's voters or more, with
    one text for every two pages at most.
    """
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path string, key long, mix long")
    # Summed before they are shuffled, so that a large host is a few rows of each task.
    counts = stored(votes.groupBy("host", "path", "key", "mix").agg(F.count("*").alias("n")), "votes")
    by_path = counts.filter("path is not null").select("host", "path", "key", "n")
    have = counts.filter("path is null and mix is null").select("host", "key", F.col("n").alias("pages"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("host"))
    top = by_path.withColumn("share", share).filter(F.col("share") >= least).join(have, ["host", "key"])
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n") / F.col("pages")).alias("sure"), (-F.col("n")).alias("n"), "path")))
    won = top.groupBy("host").agg(ranked.alias("r")).select("host", F.col("r.path").alias("paths"))
    voters = by_path.groupBy("host").agg(F.sum("n").alias("voters"))
    seen = counts.filter("mix is not null").groupBy("host", "key").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    often = seen.join(voters, "host").filter((F.col("n") >= LEAST_PAGES) & (100 * F.col("n") >= F.col("voters")) & (2 * F.col("texts") <= F.col("n")))
    return won.join(often.groupBy("host").agg(F.collect_list("key").alias("repeated")), "host", "left")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        won = [[x or [] for x in batch.column(i).to_pylist()] for i in (3, 4)]
        texts = [extract(h.as_py(), p, [k + 2**63 for k in r]) for h, p, r in zip(batch.column(2), *won, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


@tidy
def main_texts(pages: DataFrame, least: float = 0.05) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    White space inside a block becomes one space and blocks are joined by two line feeds; a
    null or textless page has the empty text. A null url's host is empty. Repeated rows are
    read alike (and vote each); an empty table gives an empty result.
    """
    won = stored(consensus(pages, least), "paths").select(F.col("host").alias("h"), "paths", "repeated")
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    rows = rows.join(sized(won), F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "paths", "repeated")
    return rows.mapInArrow(_read, "page_id long, url string, text string, n_chars long")
