"""Main text of web pages: subtrees that recur across a host's pages are its template.

Each page is parsed into elements; an element's subtree has a hash over its tag, class, id,
text and children. Spark counts in how many different surroundings on a host each subtree
occurs: the innermost article or main element around it, else the page. Subtrees in at
least ``MIN_PAGES`` of them are deleted, also inside articles and however large the host.
An article posted often is one surrounding and stays; one posted with small edits is told
by recurring text that makes up over half of it, and loses only link lists. What markup
itself calls menu, header, footer, aside, form, script, style, notice, advert or comment
goes as well, so hosts with few pages are cleaned too.

Defined cases: a null or empty page, or one without text, gives an empty text; a page
without article or main element keeps all that is left of its body; a url without a host
counts for the empty host; unclosed and stray tags are repaired, a tag in which the page
ends is left out; repeated rows and null ids are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, durable, trimmed

MIN_PAGES = 5
#: Template hashes up to which they are broadcast (a few MB), else joined by host.
BROADCAST_HASHES = 200_000
def _tag(quotes: str) -> re.Pattern:
    """A whole tag, read once without going back; ``quotes`` are those whose other end is still to come."""
    values = "".join(rf"|{q}[^{q}]*+{q}" for q in quotes)
    return re.compile(rf"<(/?)([A-Za-z][^\s/>]*+)((?:[^>{quotes}]++{values})*+)>")


_TAGS = {q: _tag(q) for q in ("\"'", "\"", "'", "")}
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)", re.I)
# Element kinds of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_DROPPED = set("head script style noscript template iframe object embed canvas svg math nav footer aside form button input select textarea dialog menu noframes noembed audio video map".split())
_CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"thead", "tbody"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_MAIN = {"article", "main"}
_PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt td th".split())
# Names by which markup marks what is not the article.
_NOISE = set(
    "ad ads advert adverts advertisement adsbygoogle banner sponsor sponsored promo menu nav navbar navigation topbar breadcrumb breadcrumbs sidebar aside footer "
    "masthead header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "comment comments commentlist disqus replies reply respond pagination pager widget toolbar skip skiplink copyright".split()
)
_NEUTRAL = set("area articles bar block bottom box button buttons col column container content element form global group holder inner item items left line link links list main media message outer page panel popular posts primary region right row secondary section site slot strip text thread top unit wrap wrapper zone".split())
_COMMENT = set("comment comments reply replies commentlist".split())
_PARTS = re.compile(r"[-_]|(?<=[a-z])(?=[A-Z])")
#: Attributes whose reading a worker remembers, and characters of the longest such.
_REMEMBERED, _SHORT = 20_000, 300
_NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}


class Node:
    __slots__ = ("tag", "mark", "noise", "children", "digest", "text_len", "link_len")

    def __init__(self, tag: str, mark: str = "", noise: bool = False):
        self.tag, self.mark, self.noise = tag, mark, noise
        self.children: list[Node | str] = []
        self.digest, self.text_len, self.link_len = 0, 0, 0


def _says(value: str, names: set[str], neutral: set[str]) -> bool:
    """Whether a class or id is made of the given names, at least one, and else of neutral words only."""
    parts = [p.rstrip("0123456789") for p in _PARTS.split(value) if p]
    low = [p.lower() for p in parts]
    return any(p in names for p in low) and all(p in names or p in neutral or not p for p in low)


def _named(attributes: str, tag: str) -> tuple[str, bool]:
    """Class and id for the hash, and whether the names say that this isn't the article.

    An article or main element goes by name only where the name says reader comment;
    paragraphs, headings and cells only where it says nothing else.
    """
    mark, noise = [], False
    names, neutral = _COMMENT if tag in _MAIN else _NOISE, set() if tag in _MAIN | _PROSE else _NEUTRAL
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            mark.append(f"{name}={value}")
            noise = noise or any(_says(x, names, neutral) for x in value.split())
        elif name == "role":
            noise = noise or value.lower() in _NOISE_ROLES
        elif name == "style":
            noise = noise or "display:none" in value.replace(" ", "").lower()
        elif name == "hidden" or value.lower() == "true":
            noise = True
    return " ".join(mark), noise


_named_again = functools.lru_cache(_REMEMBERED)(_named)


class Open:
    """The open elements, and where each tag and the innermost block stand, so that no tag searches them."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag not in _INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, i: int) -> None:
        while len(self.stack) > i:
            self.at[self.stack.pop().tag].pop()
        while self.blocks[-1] >= i:
            self.blocks.pop()

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def parse(page: str) -> Node:
    """The element tree of a page, in time linear in its length."""
    root = Node("#root")
    opened = Open(root)
    at, size, quotes = 0, len(page), "\"'"
    while at < size:
        lt = page.find("<", at)
        if lt != at:
            opened.stack[-1].children.append(page[at : lt if lt >= 0 else size])
            if lt < 0:
                break
        at = lt
        m = _TAGS[quotes].match(page, at)
        if m is None:
            head = page[at + 1 : at + 2]
            if head in ("!", "?"):
                if page.startswith("<!--", at):
                    stop, skip = page.find("-->", at + 4), 3
                elif page.startswith("<![CDATA[", at):
                    stop, skip = page.find("]]>", at + 9), 3
                    opened.stack[-1].children.append(entities.escape(page[at + 9 : stop if stop >= 0 else size], quote=False))
                else:
                    stop, skip = page.find(">", at), 1
                at = stop + skip if stop >= 0 else size
            elif re.match("</?[A-Za-z]", page[at : at + 3]):
                left = _unpaired(page, at, quotes)
                if left is None or page.find(">", at) < 0:
                    break  # the page ends inside this tag
                quotes = quotes.replace(left, "")  # that quote never ends, here or further on: it is an ordinary character
            elif head == "/":
                stop = page.find(">", at)
                at = stop + 1 if stop >= 0 else size
            else:
                opened.stack[-1].children.append("<")
                at += 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if own := opened.at.get(tag):
                if tag not in _INLINE or opened.blocks[-1] < own[-1]:
                    opened.cut(own[-1])
            continue
        if tag in _CLOSES_P and opened.at.get("p") and opened.blocks[-1] == opened.at["p"][-1]:
            opened.cut(opened.blocks[-1])
        if closed := _CLOSED_BY.get(tag):
            if (i := opened.last(closed)) > opened.last(_SCOPE[tag]):
                opened.cut(i)
        elif opened.at.get("head") and (tag == "body" or (tag in _CLOSES_P and opened.stack[-1].tag == "head")):
            opened.cut(opened.at["head"][0])
        attributes = m[3]
        mark, noise = ("", False) if len(attributes) < 2 else _named_again(attributes, tag) if len(attributes) <= _SHORT else _named(attributes, tag)
        node = Node(tag, mark, noise and tag not in ("html", "body"))
        opened.stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in _VOID:
            opened.push(node)
    return root


def _unpaired(page: str, at: int, quotes: str) -> str | None:
    """The first quote of a tag that has no other end."""
    while quotes and (m := re.compile(f"[>{quotes}]").search(page, at)):
        if m[0] == ">":
            return None
        stop = page.find(m[0], m.end())
        if stop < 0:
            return m[0]
        at = stop + 1
    return None


def finish(root: Node) -> list[Node]:
    """Hashes and text lengths of all subtrees, bottom up; the block-level elements that hold text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    out = []
    for node in reversed(order):
        digest = xxhash.xxh3_64(f"{node.tag} {node.mark}")
        for c in node.children:
            if isinstance(c, Node):
                digest.update(c.digest.to_bytes(8, "little"))
                node.text_len += c.text_len
                node.link_len += c.text_len if c.tag == "a" else c.link_len
            else:
                text = " ".join(c.split())
                digest.update("\x01" + text)
                node.text_len += len(text)
        node.digest = digest.intdigest()
        if node.text_len and node.tag not in _INLINE and node.tag not in ("#root", "html", "body", "head"):
            out.append(node)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def surroundings(root: Node) -> set[tuple[int, int]]:
    """Block-level subtrees that hold text, each with the hash of what surrounds it: the innermost article or main, else the page."""
    out, todo = set(), [(c, root.digest) for c in root.children if isinstance(c, Node)]
    while todo:
        node, around = todo.pop()
        if node.text_len and node.tag not in _INLINE and node.tag not in ("html", "body", "head"):
            out.add((_signed(node.digest), _signed(around)))
        around = node.digest if node.tag in _MAIN else around
        todo += [(c, around) for c in node.children if isinstance(c, Node)]
    return out


def _is_template(node: Node, links_only: bool, template: set[int]) -> bool:
    """In an article that recurs itself only link lists can be template."""
    return _signed(node.digest) in template and not (links_only and node.link_len * 2 < node.text_len) and node.tag not in _MAIN


def _recurs(top: Node, template: set[int]) -> bool:
    """Whether recurring prose is over half of the text of an article, besides what goes anyway."""
    found, left, todo = 0, 0, [top]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            left += len(" ".join(node.split()))
        elif node.tag in _DROPPED or node.noise:
            continue
        elif _is_template(node, False, template):
            found += node.text_len - node.link_len
        else:
            todo += node.children
    return found > left


def _mains(root: Node) -> list[Node]:
    """The outermost article or main elements that are not reader comments."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in _DROPPED or node.noise:
            continue
        if node.tag in _MAIN and node.text_len:
            out.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the article in page order, joined by an empty line."""
    mains = _mains(root)
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append(text)

    for top in mains or [root]:
        links_only = bool(mains) and _recurs(top, template)
        todo: list[tuple[Node | str | None, bool]] = [(top, bool(mains))]
        while todo:
            node, inside = todo.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                held.append(node)
            elif node.tag == "br":
                held.append(" ")
            elif node.tag in _DROPPED or node.noise or _is_template(node, links_only, template):
                if node.tag not in _INLINE:
                    flush()
            elif node.tag == "header" and not inside:
                flush()
            else:
                block = node.tag not in _INLINE
                if block:
                    flush()
                    todo.append((None, inside))
                todo += [(c, inside) for c in reversed(node.children)]
        flush()
    return "\n\n".join(blocks)


_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points) and n_template (subtree hashes of its host's template)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), _HOST, 1))
    pages = arrow_rows(df).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))

    def subtrees(batches):
        for batch in batches:
            found: dict[tuple[str, int], set[int]] = {}
            for where, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                root = parse(page or "")
                finish(root)
                for d, around in surroundings(root):
                    own = found.setdefault((where, d), set())
                    if len(own) < min_pages:  # that many are enough to tell
                        own.add(around)
            rows = [(*k, a) for k, own in found.items() for a in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["host", "digest", "around"])

    met = pages.select("host", "html").mapInArrow(subtrees, "host string, digest long, around long").distinct()
    counted = met.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    template = durable(counted.groupBy("host").agg(F.collect_list("digest").alias("template")), "template")
    n = template.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0]
    joined = pages.join(F.broadcast(template) if n <= BROADCAST_HASHES else template, "host", "left")

    def text(batches):
        for batch in batches:
            out, size, known, templates = [], [], {}, batch.column("template")
            for i, (where, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())):
                if where not in known:  # a host's list is the same in all its rows
                    known[where] = set(templates[i].as_py() or ())
                root = parse(page or "")
                finish(root)
                out.append(main_text(root, known[where]))
                size.append(len(known[where]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64()), pa.array(size, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_template"])

    kind = dict(pages.dtypes)
    return joined.select("page_id", "url", "host", "html", "template").mapInArrow(text, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long, n_template long")
