"""Operator 10, HTML extraction by site template removal.

Each page's element tree is hashed bottom up: an element's hash covers its tag, its text and its
children's hashes. Spark counts, per host, the pages of different content that hold a hash; subtrees that
recur on at least `RECUR` of these and on the share `SHARE` of them are template and are deleted, wherever
they stand; blocks whose text is links alone, as items of menus, from `LINKS_RECUR` and `LINKS_SHARE` on.
What a page marks as no content - menus, headers, footers, sidebars, forms, scripts, notices, adverts, reader comments, by tag, role or class name - is deleted as well, since a host with few pages
shows no recurrence. Inside <article> or <main> only a name that says this as a whole counts (related-links,
not related-work), and ids of sections and headings, which tell their subject, do not. If the page has an <article> or <main>, only these are read.

Both passes parse the pages in Arrow batches. The first emits (host, hash, content) rows, which are made
distinct under all three and then counted with map-side sums, so that a host with a third of all pages is
no hot key; only the recurring hashes of a host come back to its pages, by a join.

Defined cases: null html is an empty text; text without markup is one block; unclosed, misnested and
unknown tags are repaired as browsers do for the common cases (a block ends an open <p>, an end tag closes
what is open inside it, a stray end tag is passed over); a null url is a host of its own, without
recurrence; repeated rows give equal rows; pages of equal content, in whatever frame, count as one, so
that copies of an article do not make it a template; an empty table gives an empty result; columns beside those named are passed over.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, work_table

#: Pages of a host, and the share of them, on which a template recurs; for blocks of links alone, as menus are.
RECUR, SHARE = 8, 0.5
LINKS_RECUR, LINKS_SHARE = 3, 0.1

# Names that HTML gives to kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mpadded mspace annotation tspan".split())
NO_CONTENT = frozenset("nav header footer aside form script style noscript template iframe button select option input textarea dialog menu head title".split())
CONTENT = frozenset("article main".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NO_CONTENT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside "
    "header masthead footer comment comments disqus reply replies cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup login search social share sharing "
    "related recommended widget toolbar pagination pager copyright".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

# A tag with more than 256 quoted and other runs, or with quotes that do not close, ends at the first ">".
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]{0,4096}+\"|'[^']{0,4096}+'){0,256}+)>|([^>]*)>)", re.S)
_OPEN_COMMENT = re.compile(r"<!--.*\Z", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: A name that begins so is marked, whatever follows.
_BEGINNINGS = ("advert", "breadcrumb", "comment", "cookie", "navbar", "newsletter", "sidebar", "sponsor")
#: Class names such as no-sidebar say what a page lacks or has, not what an element is.
_STATES = frozenset("no has with without is".split())
#: Inside an article a whole name counts: these may only stand beside such words, as in share-buttons.
_SHAPES = frozenset("area bar box block button buttons container count form icons inner label link links list panel slot thread unit widget wrap wrapper".split())
_ID_IS_SUBJECT = frozenset("section h1 h2 h3 h4 h5 h6".split())
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "drop", "hash", "inside", "links", "tag")

    def __init__(self, tag: str, drop: bool = False, inside: bool = False):
        self.tag, self.drop, self.inside, self.children, self.hash, self.links = tag, drop, inside, [], b"", False


def _names_frame(word: str, inside: bool) -> bool:
    parts = _NAME.findall(word)
    if not parts or parts[0] in _STATES:
        return False
    if inside:
        named = [p in NO_CONTENT_NAMES for p in parts]
        return any(named) and all(n or p in _SHAPES for n, p in zip(named, parts, strict=True))
    return parts[0] in NO_CONTENT_NAMES or parts[-1] in NO_CONTENT_NAMES or parts[0].startswith(_BEGINNINGS)


def _marked(attributes: str, tag: str = "", inside: bool = False) -> bool:
    """Whether class, id or role name something other than content. Whole words of a name count, and
    inside an article the whole name."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in NO_CONTENT_ROLES):
            return True
        if name == "class" or (name == "id" and not (inside and tag in _ID_IS_SUBJECT)):
            if any(_names_frame(word, inside) for word in value.split()):
                return True
    return False


class _Open:
    """The open elements, with the places of each tag and of the blocks, so that no step searches the stack."""

    def __init__(self, root: Node):
        self.stack, self.of, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.of.setdefault(node.tag, []).append(at)
        if node.tag not in INLINE:
            self.blocks.append(at)

    def last(self, *tags: str) -> int:
        """The place of the innermost of these, 0 if none is open."""
        return max((found[-1] for tag in tags if (found := self.of.get(tag))), default=0)

    def close(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.of[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        at = self.last(tag)
        if at and not (tag in INLINE and at < self.blocks[-1]):  # an inline end tag does not close a block
            self.close(at)

    def begin(self, tag: str) -> None:
        """Closes what cannot hold the tag."""
        if tag in CLOSES_P and self.stack[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag in CLOSES_SAME and (at := self.last(*CLOSES_SAME[tag])) > self.last(*SCOPES[tag]):
            # of tr, td and th the outermost in the table
            while (more := self._before(at, CLOSES_SAME[tag])) > self.last(*SCOPES[tag]):
                at = more
            self.close(at)

    def _before(self, at: int, tags: tuple[str, ...]) -> int:
        below = at - 1
        return below if below > 0 and self.stack[below].tag in tags else 0


def parse(source: str) -> Node:
    """The element tree; text is a child of type str, with references decoded."""
    root = Node("#root")
    open_, at, n = _Open(root), 0, len(source)
    stack, last = open_.stack, source.rfind(">")  # no tag ends behind it

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(html.unescape(value) if "&" in value else value)

    while at < n:
        m = _TAG.search(source, at) if at <= last else _OPEN_COMMENT.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = m.group(2) if m.re is _TAG else None
        if tag is None:  # a comment, doctype or instruction
            continue
        tag = tag.lower()
        if m.group(1):
            open_.end(tag)
            continue
        open_.begin(tag)
        attributes = m.group(3) or m.group(4) or ""
        inside = stack[-1].inside
        node = Node(tag, tag in NO_CONTENT or (bool(attributes) and tag not in ("html", "body", "article", "main") and _marked(attributes, tag, inside)), inside or tag in CONTENT)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else n
            continue
        open_.push(node)
    return root


def _bottom_up(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node))
    return order[::-1]


def hash_tree(root: Node) -> list[Node]:
    """Sets the hash of every element that holds text, and whether all of it is links; returns these elements."""
    out = []
    for node in _bottom_up(root):
        h, filled, links = blake2b(node.tag.encode("utf-8", "surrogatepass"), digest_size=8), False, True
        for c in node.children:
            if isinstance(c, Node):
                if c.hash:
                    h.update(b"\1" + c.hash)
                    filled, links = True, links and c.links
            elif words := c.split():
                h.update(b"\2" + " ".join(words).encode("utf-8", "surrogatepass"))
                filled, links = True, False
        if filled:
            node.hash, node.links = h.digest(), links or node.tag == "a"
            out.append(node)
    return out


def main_text(root: Node, template: frozenset[bytes] = frozenset()) -> str:
    """The blocks of the page, without elements marked as no content and those in `template`."""
    scope = [root]
    found, todo = [], [root]
    while todo:  # outermost <article> and <main>, in page order
        node = todo.pop()
        if node.tag in CONTENT and not node.drop:
            found.append(node)
        elif not node.drop:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    scope = found or scope
    blocks: list[list[str]] = [[]]
    todo = []
    for top in reversed(scope):
        todo.append((top, False))
    while todo:
        item, closing = todo.pop()
        if isinstance(item, str):
            blocks[-1].append(item)
            continue
        inline = item.tag in INLINE
        if closing:
            blocks.append([])
            continue
        if item.drop or (item.hash and item.hash in template):
            if not inline:
                blocks.append([])
            continue
        if inline:
            if item.tag in ("br", "wbr"):
                blocks[-1].append(" " if item.tag == "br" else "")
        else:
            blocks.append([])
            todo.append((item, True))
        todo.extend((c, False) for c in reversed(item.children))
    lines = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n".join(line for line in lines if line)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def subtrees(root: Node) -> dict[int, bool]:
    """The hashes of a page's elements that may be template, and whether they are blocks of links alone."""
    return {int.from_bytes(node.hash, "little", signed=True): node.links and node.tag not in INLINE for node in hash_tree(root) if node.tag not in ("#root", "html", "body")}


def template_hashes(pages: DataFrame, url: str, source: str, recur: int = RECUR, share: float = SHARE, links: tuple[int, float] = (LINKS_RECUR, LINKS_SHARE)) -> DataFrame:
    """host, hash: subtrees on many pages of a host. Pages of equal content count as one."""
    names, kinds = ["host", "hash", "links", "content"], [pa.string(), pa.int64(), pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page)
                mine = subtrees(root) | {0: False}  # 0 stands for the page
                content = int.from_bytes(blake2b(main_text(root).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                out += [(host, h, is_links, content) for h, is_links in mine.items()]
                if len(out) >= 65536:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = pages.where(F.col(url).isNotNull() & F.col(source).isNotNull()).select(host_of(F.col(url)).alias("host"), F.col(source).cast("string").alias("h"))
    seen = rows.mapInArrow(run, "host string, hash long, links boolean, content long").distinct()
    enough = F.when(F.col("links"), F.lit(links[0])).otherwise(F.lit(recur))
    counts = work_table(seen.groupBy("host", "hash", "links").agg(F.count("*").alias("n")).where((F.col("n") >= enough) | (F.col("hash") == 0)), "subtrees")
    totals = counts.where("hash = 0").select("host", F.col("n").alias("total"))
    of_all = F.ceil(F.col("total") * F.when(F.col("links"), F.lit(links[1])).otherwise(F.lit(share)))
    return counts.where("hash != 0").join(totals, "host").where(F.col("n") >= F.greatest(enough, of_all)).select("host", "hash")


def extract(pages: DataFrame, keep: list[str], url: str = "url", source: str = "html", **params) -> DataFrame:
    """keep (of pages) and text: the main text of each page."""
    template = template_hashes(pages, url, source, **params)
    # a host has few recurring subtrees: each is on a share of its pages, which hold so many elements
    per_host = work_table(template.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("template")), "templates")
    names = [f"__{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], host_of(F.col(url)).alias("host"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("h"))
    rows = rows.join(per_host, "host", "left").select(*names, "h", "template")
    ddl = ", ".join(f"{n} {t.dataType.simpleString()}" for n, t in zip(names, pages.select(*[f"`{c}`" for c in keep]).schema, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, frozenset()
        for batch in batches:
            out = []
            lists = batch.column(len(names) + 1)
            for i, page in enumerate(batch.column(len(names)).to_pylist()):
                mine = lists[i]
                if mine != last:
                    last, known = mine, frozenset(x.to_bytes(8, "little", signed=True) for x in mine.as_py() or ())
                root = parse(page)
                hash_tree(root)
                out.append(main_text(root, known))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.string())], names=[*names, "text"])

    return rows.mapInArrow(run, f"{ddl}, text string").toDF(*keep, "text")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))
