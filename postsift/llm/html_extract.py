"""Main-text extraction by wrapper induction over the pages of a host.

Pages of a host are dealt into groups of about GROUP_PAGES. In a group each page's DOM tree is aligned with a
reference page by simple tree matching. A node whose text is the same on nearly all different pages of the group
is template; a node whose text varies is a slot. The element that holds most of the varying text of the group is
the content region, on every page the node that is aligned with it; all that stands inside it stays, but for elements
that HTML itself marks as furniture (menus, forms, asides), roles, and names of class or id. A page without evidence
(too few different pages, or no region) is bounded by its article or main elements, or by such names alone.

Groups follow from the pages' contents, so no partitioning or order of rows changes a text: equal pages share a group,
and a page that a host has very often is extracted once.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import Tables, bound_batches, broadcast_if_small, plain

#: Pages that are aligned together; a host with more has several groups.
GROUP_PAGES = 96
#: Hosts of up to this number are sent as a broadcast table of (host, groups); more are joined by a shuffle.
BROADCAST_HOSTS = 50_000
#: Often repeated pages up to this number are joined to their rows by broadcast.
BROADCAST_TEXTS = 100
#: A slot's text counts as template from this share of different pages on, of at least TEMPLATE_PAGES.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 3
#: Share of the varying text that the content region holds, and of all text that varies on a host of different articles.
REGION_SHARE, VARYING_SHARE = 0.75, 0.2

#: Cells of an alignment table that is kept to be traced back, two bits each; larger ones are halved.
TRACE_CELLS = 1 << 26

# Fixed values of the HTML standard: void elements, elements of raw text, and elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table caption tbody tfoot thead tr ul".split()
)
# Start tags that end an open element of the listed kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("table article section aside nav ul ol dl div body main td th footer header form blockquote".split())

# Furniture by element, by role and by the words of a name of class or id. A name tells furniture if each
# of its words is in NAMES or NEUTRAL and one in NAMES: "ad-banner" and "site-footer" do, "social-history" does not.
FURNITURE = frozenset("nav footer aside form button select input dialog menu search head object audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe signup login sidebar sidebars widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar "
    "share sharing social related recommended recommendations copyright skip".split()
)
NEUTRAL = frozenset(
    "area articles bar block bottom box button buttons col column container content global group header icons inner items js left link links list main module outer page pages panel posts "
    "primary right row secondary section site slot stories sub text to top unit wrap wrapper".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies discussion".split())
CONTENT = frozenset("content article post entry story main body text".split())

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Elements that hold the page itself, whatever they are named.
PAGE = frozenset(("html", "body"))
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _names(found: dict[str, str]) -> list[set[str]]:
    """The words of each name of class and id."""
    return [{w.lower() for w in _NAME_PARTS.findall(name)} for name in f"{found.get('class', '')} {found.get('id', '')}".split()]


def _all_of(names: list[set[str]], words: frozenset[str]) -> bool:
    return any(own & words and all(w in words or w in NEUTRAL or w.isdigit() for w in own) for own in names)


class Node:
    __slots__ = ("tag", "parts", "kids", "furniture", "comment", "named", "shape", "size", "parent")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.parts: list = []  # text and nodes, in order
        self.kids: list[Node] = []
        self.furniture, self.comment, self.named = tag in FURNITURE or tag in RAW, False, False
        self.shape = self.size = 0
        if attributes:
            found: dict[str, str] = {}
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            names, role = _names(found), found.get("role", "").lower()
            self.named = any(own & CONTENT for own in names) or found.get("itemprop", "") == "articleBody" or role == "main"
            if tag not in PAGE:
                hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN_STYLE.search(found.get("style", "")))
                self.comment = _all_of(names, COMMENTS)
                self.furniture = self.furniture or _all_of(names, NAMES) or role in ROLES or hidden


def parse(source: str) -> Node:
    """Element tree of a page; tags left open, misnested or cut off are closed as HTML implies."""
    root = node = Node("#root", "", None)
    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            node.parts.append(source[at:])
            break
        if m.start() > at:
            node.parts.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            up = node
            while up is not root and up.tag != tag:
                if tag in ("p", "li", "b", "i", "a", "span", "em", "strong") and up.tag in SCOPES:
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        ends = ENDS.get(tag) or ({"p"} if tag in BLOCK else None)
        if ends:
            up, scopes = node, SCOPES - ends
            while up is not root and up.tag not in scopes:
                if up.tag in ends:
                    node = up.parent
                    if ends == {"p"}:
                        break
                up = up.parent
        new = Node(tag, m[3] or m[6] or "", node)
        node.parts.append(new)
        node.kids.append(new)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            at = source.find(">", close.start()) + 1 or end if close else end
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            node = new
    _release(root)
    return root


def _nodes(root: Node) -> list[Node]:
    found, open_ = [], [root]
    while open_:
        node = open_.pop()
        found.append(node)
        open_.extend(reversed(node.kids))
    return found


def _release(root: Node) -> None:
    """Forms, and elements whose names tell furniture, are none where they hold an article or main element, or most of the page's text."""
    nodes, size, holds = _nodes(root), {}, {}
    for node in reversed(nodes):
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        size[id(node)] = 0 if node.tag in RAW else own + sum(size[id(k)] for k in node.kids)
        holds[id(node)] = any(k.tag in ("article", "main") and not k.comment or holds[id(k)] for k in node.kids) and not node.comment
    for node in nodes:
        if node.furniture and (node.tag == "form" or node.tag not in FURNITURE and node.tag not in RAW) and (holds[id(node)] or node.tag == "form" and 2 * size[id(node)] > size[id(root)]):
            node.furniture = False


def _own_text(node: Node) -> str:
    return " ".join(" ".join(p for p in node.parts if isinstance(p, str)).split())


def _measure(root: Node, shapes: dict[tuple, int]) -> int:
    """Sets shape (equal for equal trees of tags) and size of each node; the number of nodes."""
    nodes = _nodes(root)
    for node in reversed(nodes):
        node.size = 1 + sum(k.size for k in node.kids)
        node.shape = shapes.setdefault((node.tag, *[k.shape for k in node.kids]), len(shapes))
    return len(nodes)


def _middle(a: Node, b: Node) -> tuple[int, int, int]:
    """Children pair from both ends while their shapes are equal: (pairs in front, ends of the rest of a and of b)."""
    low, i, j = 0, len(a.kids), len(b.kids)
    while low < min(i, j) and a.kids[low].shape == b.kids[low].shape:
        low += 1
    while i > low and j > low and a.kids[i - 1].shape == b.kids[j - 1].shape:
        i, j = i - 1, j - 1
    return low, i, j


def _weight(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> int | None:
    """The matching of two trees where it is plain or known. It depends on their shapes alone."""
    if a.tag != b.tag:
        return 0
    if a.shape == b.shape:
        return a.size
    if not a.kids or not b.kids:
        return 1
    return memo.get((a.shape, b.shape))


def _weights(a: Node, b: Node, memo: dict) -> tuple[list[np.ndarray], list[tuple[Node, Node]]]:
    """Matchings of the children of two nodes between the equal ends, a row for each child of `a`, and the pairs whose matching is not known yet.

    Children of one shape share a row.
    """
    low, i, j = _middle(a, b)
    left, right = a.kids[low:i], b.kids[low:j]
    if not left or not right:
        return [], []
    rows, cols = {x.shape: x for x in left}, {y.shape: y for y in right}
    table, open_ = {}, []
    for x in rows.values():
        line = []
        for y in cols.values():
            w = _weight(x, y, memo)
            if w is None:
                open_.append((x, y))
            line.append(w or 0)
        table[x.shape] = line
    if open_:
        return [], open_
    place = {shape: k for k, shape in enumerate(cols)}
    at = [place[y.shape] for y in right]
    whole = {shape: np.array(line, np.int64)[at] for shape, line in table.items()}
    return [whole[x.shape] for x in left], []


def _fold(weights: list[np.ndarray], steps: bool = False) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """The heaviest order-keeping pairing, row by row; with `steps` one bit a cell each for: as above, as to the left."""
    if not weights:
        return 0, []
    line, kept = np.zeros(len(weights[0]) + 1, np.int64), []
    for row in weights:
        above, line = line, np.empty_like(line)
        line[0] = 0
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + row), out=line[1:])
        if steps:
            kept.append((np.packbits(line[1:] == above[1:]), np.packbits(line[1:] == line[:-1])))
    return int(line[-1]), kept


def _pairing(weights: list[np.ndarray]) -> list[tuple[int, int]]:
    """(row, column) pairs of the heaviest order-keeping pairing. Many rows are halved at the column where the two halves' sums are largest, so memory stays bounded."""
    found, open_ = [], [(0, len(weights), 0, len(weights[0]) if weights else 0)]
    while open_:
        top, end, left, right = open_.pop()
        if (end - top) * (right - left) > TRACE_CELLS and end - top > 1:
            middle = (top + end) // 2
            above = _line([w[left:right] for w in weights[top:middle]], right - left)
            below = _line([w[left:right][::-1] for w in reversed(weights[middle:end])], right - left)[::-1]
            cut = left + int((above + below).argmax())
            open_ += [(top, middle, left, cut), (middle, end, cut, right)]
            continue
        rows = [w[left:right] for w in weights[top:end]]
        steps = _fold(rows, True)[1] if right > left else []
        r, c = len(steps), right - left
        while r and c:
            up, beside = steps[r - 1]
            byte, bit = c - 1 >> 3, 7 - (c - 1 & 7)
            if up[byte] >> bit & 1:
                r -= 1
            elif beside[byte] >> bit & 1:
                c -= 1
            else:
                r, c = r - 1, c - 1
                found.append((top + r, left + c))
    return found


def _line(weights: list[np.ndarray], width: int) -> np.ndarray:
    """The heaviest pairing of all rows with the first 0, 1, ... columns."""
    line = np.zeros(width + 1, np.int64)
    for row in weights:
        above, line = line, np.zeros_like(line)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + row), out=line[1:])
    return line


def match(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> int:
    """Simple tree matching: the most node pairs of an order-keeping, level-keeping alignment of two trees.

    Pairs of subtrees wait on a list of their own, so no depth of nesting overflows the stack.
    """
    open_ = [(a, b)]
    while open_:
        x, y = open_[-1]
        if _weight(x, y, memo) is not None:
            open_.pop()
            continue
        weights, unknown = _weights(x, y, memo)
        if unknown:
            open_ += unknown
            continue
        low, i, _ = _middle(x, y)
        memo[x.shape, y.shape] = 1 + sum(k.size for k in x.kids[:low]) + sum(k.size for k in x.kids[i:]) + _fold(weights)[0]
        open_.pop()
    return _weight(a, b, memo)


def _align(a: Node, b: Node, memo: dict) -> list[tuple[Node, Node]]:
    """Best order-keeping pairs of the children of two nodes. Equal shapes at both ends always pair."""
    low, i, j = _middle(a, b)
    pairs = [*zip(a.kids[:low], b.kids[:low], strict=True), *zip(a.kids[i:], b.kids[j:], strict=True)]
    if i > low and j > low:
        weights, unknown = _weights(a, b, memo)
        if unknown:
            for x, y in unknown:
                match(x, y, memo)
            weights = _weights(a, b, memo)[0]
        pairs += [(a.kids[low + r], b.kids[low + c]) for r, c in _pairing(weights)]
    return pairs


def alignment(reference: Node, page: Node) -> list[tuple[Node, Node]]:
    """(node of the reference, node of the page) pairs of the best simple tree matching."""
    memo: dict[tuple[int, int], int] = {}
    found, open_ = [(reference, page)], [(reference, page)]
    while open_:
        pairs = _align(*open_.pop(), memo)
        found += pairs
        open_ += pairs
    return found


def _plain_sizes(page: Node) -> list[tuple[Node, int]]:
    """(node, characters of its own text outside links), parents first."""
    linked, out = set(), []
    for node in _nodes(page):
        if node.tag == "a" or id(node.parent) in linked:
            linked.add(id(node))
        out.append((node, 0 if id(node) in linked else len(_own_text(node))))
    return out


def _region(reference: Node, pages: list[tuple[Node, dict[int, int], dict[int, str]]], fixed: dict[int, str]) -> Node | None:
    """The node of the reference that holds most of the text that varies; pages: (root, aligned id, own text by reference id)."""
    varying, constant = Counter(), 0
    for page, aligned, texts in pages:
        home: dict[int, int] = {}
        for node, size in _plain_sizes(page):
            r = aligned.get(id(node))
            home[id(node)] = home[id(node.parent)] if r is None else r
            if r is not None and r in fixed and fixed[r] == texts[r]:
                constant += size
            else:
                varying[home[id(node)]] += size
    total = sum(varying.values())
    if not total or total < VARYING_SHARE * (total + constant):
        return None
    order = _nodes(reference)
    sums = {id(n): varying[id(n)] for n in order}
    for node in reversed(order):
        if node.parent is not None:
            sums[id(node.parent)] += sums[id(node)]
    region = reference
    while large := [k for k in region.kids if sums[id(k)] >= REGION_SHARE * total]:
        region = large[0]
    while region.parent is not None and sum(k.tag == region.tag == "article" and sums[id(k)] > 0 for k in region.parent.kids) > 1:
        region = region.parent  # one of several articles
    while region.parent is not None and region.tag not in ("body", "html") and any(k.tag in HEADINGS and sums[id(k)] for k in region.parent.kids):
        region = region.parent  # a varying heading beside it is the article's
    return None if region.tag in ("#root", "html", "body") else region


def induce(pages: list[Node]) -> list[Node | None]:
    """The content region of each page; None where the group gives no evidence of it."""
    shapes: dict[tuple, int] = {}
    sizes = [_measure(p, shapes) for p in pages]
    none: list = [None] * len(pages)
    if len(pages) < TEMPLATE_PAGES:
        return none
    reference = pages[sorted(range(len(pages)), key=lambda i: (sizes[i], i))[len(pages) // 2]]
    pairs = [alignment(reference, p) for p in pages]
    texts = [{id(r): _own_text(n) for r, n in own} for own in pairs]
    different = list({(sizes[i], *t.values()): i for i, t in enumerate(texts)}.values())  # copies of a page are one witness
    if len(different) < TEMPLATE_PAGES:
        return none
    told: dict[int, Counter] = {}
    for i in different:
        for r, text in texts[i].items():
            told.setdefault(r, Counter())[text] += 1
    fixed = {}
    for r, texts_of in told.items():
        text, n = texts_of.most_common(1)[0]
        if text and n >= TEMPLATE_PAGES and n >= TEMPLATE_SHARE * len(different):
            fixed[r] = text
    aligned = [{id(n): id(r) for r, n in own} for own in pairs]
    region = _region(reference, [(pages[i], aligned[i], texts[i]) for i in different], fixed)
    if region is None:
        return none
    return [next((n for r, n in own if r is region), None) for own in pairs]


def _blocks(root: Node, inside: bool) -> list[tuple[str, int, bool]]:
    """(text, length of it in links, whether a heading) of the blocks under `root`, furniture left out."""
    blocks, parts, linked = [], [], [0]

    def flush(heading: bool) -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append((text, min(linked[0], len(text)), heading))
        parts.clear()
        linked[0] = 0

    open_: list = [(root, 0, False)]
    while open_:
        node, at, link = open_.pop()
        if at == 0 and node.tag in BLOCK:
            flush(False)
        while at < len(node.parts):
            part = node.parts[at]
            at += 1
            if isinstance(part, str):
                parts.append(part)
                linked[0] += len(part) if link else 0
            elif part.tag == "br" or part.tag in ("td", "th"):
                parts.append(" ")
                if part.tag != "br" and not part.furniture:
                    open_.append((node, at, link))
                    open_.append((part, 0, link))
                    break
            elif not (part.furniture or part.comment or part.tag == "header" and not inside):
                open_.append((node, at, link))
                open_.append((part, 0, link or part.tag == "a"))
                break
        else:
            if node.tag in BLOCK:
                flush(node.tag in HEADINGS)
    flush(False)
    return blocks


def _main(root: Node) -> tuple[list[Node], bool]:
    """The elements that bound the article by their element or name, and whether the page names them. Articles side by side all stay."""
    kept, open_ = [], [root]
    while open_:
        node = open_.pop()
        kept.append(node)
        open_.extend(k for k in reversed(node.kids) if not k.comment and not k.furniture)

    def text_size(node: Node) -> int:
        return sum(len(b[0]) for b in _blocks(node, True))

    for named in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.named and n.tag not in PAGE):
        found = [n for n in kept if named(n)]
        if found:
            best = found[0] if len(found) == 1 else max(found, key=text_size)
            return [n for n in found if n is best or n.tag == best.tag == "article" and n.parent is best.parent], True
    return [root], False


def extract_group(sources: list[str | None]) -> list[str]:
    """Main texts of pages that are aligned with each other."""
    pages = [parse(s or "") for s in sources]
    regions = induce(pages)
    out = []
    for page, region in zip(pages, regions, strict=True):
        mains, named = ([region], True) if region is not None else _main(page)
        blocks = [b for main in mains for b in _blocks(main, named)]
        if not named:  # what is mostly links is a menu
            blocks = [b for b in blocks if b[1] <= 0.6 * len(b[0])]
        out.append(blocks)
    return ["\n".join(b[0] for b in blocks) for blocks in out]


def _extract(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["html", "page_id"], kind="stable", na_position="first")  # the order of arrival tells nothing
    texts = extract_group(rows["html"].tolist())
    return plain(pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "host": rows["host"], "digest": rows["digest"], "often": rows["often"], "text": texts, "n_chars": [len(t) for t in texts]}))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_pages: int = GROUP_PAGES) -> DataFrame:
    """One row per input row: id, url, text (blocks joined by a line feed), n_chars.

    Null html is empty; a page without main text gives an empty text. Pages with a null url share one host. Rows of
    a host are dealt into groups by a hash of their html, so equal pages of a host give equal texts; one that a host
    has more than `group_pages` times is extracted once, and its text joined to its rows. An empty table gives an
    empty result. Other columns of `pages` are not read.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    tables = Tables(spark, "html")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host")).withColumn("digest", digest)
    copies = tables.write(rows.groupBy("host", "digest").agg(F.count("*").alias("n")), "copies")
    often = tables.write(copies.where(F.col("n") > group_pages).select(F.col("host").alias("o_host"), F.col("digest").alias("o_digest")), "often")
    once = copies.groupBy("host").agg(F.ceil(F.sum(F.when(F.col("n") > group_pages, 1).otherwise(F.col("n"))) / group_pages).alias("groups")).where("groups > 1")
    large = tables.write(once.select(F.col("host").alias("l_host"), "groups"), "hosts")
    tables.drop("copies")
    if large.count() <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    is_often = (F.col("host") == F.col("o_host")) & (F.col("digest") == F.col("o_digest"))
    repeated = not often.isEmpty()
    single = rows.withColumn("often", F.lit(False))
    if repeated:
        known = broadcast_if_small(often)
        one = rows.join(known, is_often, "left_semi").groupBy("host", "digest").agg(F.first("html").alias("html"))  # equal rows meet before the shuffle
        nameless = one.select(F.lit(None).cast(pages.schema[id_col].dataType).alias("page_id"), F.lit(None).cast("string").alias("url"), "html", "host", "digest", F.lit(True).alias("often"))
        single = rows.join(known, is_often, "left_anti").withColumn("often", F.lit(False)).unionByName(nameless)
    dealt = single.join(large, F.col("host") == F.col("l_host"), "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("digest"), F.coalesce("groups", F.lit(1)))).drop("l_host", "groups")
    id_type = pages.schema[id_col].dataType.simpleString()
    out = dealt.groupBy("host", "part").applyInPandas(_extract, f"page_id {id_type}, url string, host string, digest string, often boolean, text string, n_chars long")
    names = ["page_id", "url", "text", "n_chars"]
    if repeated:
        out = tables.write(out, "texts")
        told = out.where("often").select(F.col("host").alias("o_host"), F.col("digest").alias("o_digest"), "text", "n_chars")
        out = out.where("not often").select(*names).unionByName(rows.drop("html").join(broadcast_if_small(told, BROADCAST_TEXTS), is_often).select(*names))
    return out.select(*names).withColumnsRenamed({"page_id": id_col, "url": url_col})
