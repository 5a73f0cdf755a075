"""Main text of web pages by wrapper induction.

Pages of a host share a template. Each page's DOM tree is aligned with one reference page of its host by simple tree matching
(the largest set of node pairs with equal labels that keeps parents and sibling order). A reference node that holds the same
text in most of the host's different pages is template; a node whose text varies is a slot, and slots are content.

1. The reference is the shortest page among those with the host's commonest set of tags: one page per host.
2. One pass parses and aligns every page and writes its blocks: place in the reference, text hash, text.
3. Votes are counted per (host, reference node, text) over pages with different texts, so copies of a page count once.
4. Blocks that are template, or lie in parts that hold no article by their markup (menus, forms, adverts, comments, ...), go.
   If a page has article or main elements with text, only text inside them stays.

Trees may be of any depth and nodes of any number of kids; nothing recurses. Kids between those alike at both ends are matched by
a table of their number squared.

Defined cases: null, empty and blank html gives an empty text; broken and cut-off markup is closed at the end; a host with fewer
than VOTES different pages has no template and relies on the markup; repeated pages get a row each; a null url is the host "".
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import checked, written
from tallylog.llm.urls import host_and_path

#: A node is template if this share of at least VOTES different pages agree on its text.
SHARE, VOTES = 0.8, 5
#: Hosts whose reference pages are broadcast together.
HOSTS = 5_000
#: Reference pages that a task keeps parsed.
REFERENCES = 32

# Elements and names by their meaning in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg select object title".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow msup msub mfrac msqrt".split())
OUTSIDE = set("head nav footer aside form button dialog menu noscript template".split())
NAMES = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo related replies reply respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: What such names are made of besides: inside an article, a name counts only if nothing else is in it.
PARTS = set("area bar block box button buttons container content form group icon icons inner item items link links list outer panel row section slot unit widget widgets wrap wrapper".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu".split())
#: A start tag of the key closes an open element of these, up to the nearest of the bounds.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "blockquote"}

_OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOPS = re.compile("[>\"']")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_WORD = re.compile("[a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "inside", "kids", "label", "outside", "place", "shape", "tag")

    def __init__(self, tag: str, label: str, outside: bool, inside: bool):
        self.tag, self.label, self.outside, self.inside = tag, label, outside, inside
        self.children: list[Node | str] = []
        self.kids: list[Node] = []
        self.place = self.shape = -1


def _names_a_part(value: str, inside: bool) -> bool:
    """Whether a class or id names a part that is no article: by any word in it, inside an article by all words of one name."""
    if not inside:
        return not NAMES.isdisjoint(_WORD.findall(value))
    return any(not NAMES.isdisjoint(own) and own <= NAMES | PARTS for own in (set(_WORD.findall(name)) for name in value.split()))


def _made(tag: str, attributes: str, parent: Node) -> Node:
    label, outside = tag, parent.outside or tag in OUTSIDE or (tag == "header" and not parent.inside)
    if "=" in attributes:
        for kind, *values in _NAMED.findall(attributes):
            value = next((v for v in values if v), "").lower()
            if kind.lower() == "role":
                outside = outside or value in ROLES
            elif tag not in ("html", "body", "article", "main"):
                outside = outside or _names_a_part(value, parent.inside)
                if kind.lower() == "class":
                    label = f"{tag}.{value}"
    return Node(tag, label, outside, parent.inside or tag in ("article", "main"))


class _Tags:
    """The tags of a page from the front on, as (start, end, closing, name, attributes); name is empty for comments and such.

    A place is looked at once: what is not there any more (a quote, an end of a tag) is remembered. Where quotes would swallow
    the rest of the page, they count as plain characters from there on.
    """

    def __init__(self, html: str):
        self.html, self.quotes = html, {'"': True, "'": True}

    def _end(self, at: int) -> int:
        """The place of the ``>`` that closes a tag, -1 without one."""
        html, place = self.html, at
        while any(self.quotes.values()):
            stop = _STOPS.search(html, place)
            if not stop:
                self.quotes = dict.fromkeys(self.quotes, False)
                break
            if stop[0] == ">":
                return stop.start()
            place = stop.end()
            if self.quotes[stop[0]]:
                shut = html.find(stop[0], place)
                if shut < 0:
                    self.quotes[stop[0]] = False
                else:
                    place = shut + 1
        return html.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        opens = _OPENS.search(self.html, at)
        if not opens:
            return None
        if opens[2]:
            end = self._end(opens.end())
            return None if end < 0 else (opens.start(), end + 1, opens[1], opens[2], self.html[opens.end() : end])
        if opens[0] == "<!--":
            end = self.html.find("-->", opens.end())
            return opens.start(), len(self.html) if end < 0 else end + 3, "", "", ""
        end = self.html.find(">", opens.end())
        return None if end < 0 else (opens.start(), end + 1, "", "", "")


def parse(html: str) -> Node:
    """The tree of a page; forgiving about what is never closed or never opened."""
    root = Node("", "", False, False)
    stack, at, end, tags = [root], 0, len(html), _Tags(html)
    while at < end:
        found = tags.next(at)
        if not found:
            break
        start, after, closing, tag, attributes = found
        if start > at:
            stack[-1].children.append(entities.unescape(html[at:start]))
        at = after
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW and not attributes.endswith("/"):
            shut = _RAW_END[tag].search(html, at)
            at = shut.end() if shut else end
            continue
        if tag in VOID:
            stack[-1].children.append(" ")
            continue
        if tag not in INLINE:
            shuts = CLOSES.get(tag, {"p"})
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shuts:
                    del stack[k:]
                    break
                if stack[k].tag in BOUNDS:
                    break
        node = _made(tag, attributes, stack[-1])
        stack[-1].children.append(node)
        stack[-1].kids.append(node)
        if not attributes.endswith("/"):
            stack.append(node)
    if at < end:
        stack[-1].children.append(entities.unescape(html[at:]))
    return root


def numbered(root: Node) -> Node:
    """The reference: every node's place, in page order."""
    stack, place = [root], 0
    while stack:
        node = stack.pop()
        node.place, place = place, place + 1
        stack.extend(reversed(node.kids))
    return root


class Reference:
    """A numbered reference tree with what aligning pages with it has taught: shapes of subtrees and matchings of shapes.

    A shape is a label and the shapes of the kids, as a number. How two subtrees match depends on their shapes alone, and of
    those a site has few.
    """

    #: Numbers of shapes and tables that are kept; beyond it they are worked out anew.
    MOST_SHAPES, MOST_TABLES = 200_000, 20_000

    def __init__(self, html: str):
        self.root = numbered(parse(html))
        self.shapes: dict[tuple, int] = {}
        self.kids: list[tuple[str, tuple[int, ...], int]] = []
        self.tables: dict[tuple[int, int], tuple] = {}
        self.shape(self.root)

    def shape(self, root: Node) -> None:
        """Numbers the shapes of a tree, kids before their parents."""
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.kids)
        for node in reversed(order):
            key = node.label, tuple(kid.shape for kid in node.kids)
            if key not in self.shapes:
                self.shapes[key] = len(self.kids)
                self.kids.append((*key, 1 + sum(self.kids[k][2] for k in key[1])))
            node.shape = self.shapes[key]

    def _known(self, one: int, two: int) -> int | None:
        """Size of the largest matching of two shapes with equal labels, the roots included, if that is known or plain."""
        if one == two:
            return self.kids[one][2]
        if not self.kids[one][1] or not self.kids[two][1]:
            return 1
        table = self.tables.get((one, two))
        return None if table is None else table[2]

    def matching(self, one: int, two: int) -> tuple[int, int, int, list]:
        """Kids alike at the front and at the back, size of the largest matching, and the table of the kids between.

        Kids of one shape at the same end match whole, which no other matching of them beats.
        """
        stack = [(one, two)]
        while stack:
            x, y = stack[-1]
            if (x, y) in self.tables:
                stack.pop()
                continue
            a, b = self.kids[x][1], self.kids[y][1]
            front, most = 0, min(len(a), len(b))
            while front < most and a[front] == b[front]:
                front += 1
            back = 0
            while back < most - front and a[-1 - back] == b[-1 - back]:
                back += 1
            left, right = a[front : len(a) - back], b[front : len(b) - back]
            weights: dict[tuple[int, int], int] = {}
            waiting = []
            for p in set(left):
                for q in set(right):
                    if self.kids[p][0] == self.kids[q][0]:
                        known = self._known(p, q)
                        if known is None:
                            waiting.append((p, q))
                        else:
                            weights[p, q] = known
            if waiting:
                stack.extend(waiting)
                continue
            row = np.zeros(len(right) + 1, np.int32)
            table = [row]
            rows: dict[int, np.ndarray] = {}
            for p in left:
                if p not in rows:
                    rows[p] = np.array([weights.get((p, q), 0) for q in right], np.int32)
                after = np.zeros_like(row)
                np.maximum.accumulate(np.maximum(row[1:], row[:-1] + rows[p]), out=after[1:])
                row = after
                table.append(row)
            size = 1 + sum(self.kids[k][2] for k in a[:front]) + sum(self.kids[k][2] for k in a[len(a) - back :]) + int(row[-1])
            self.tables[x, y] = front, back, size, table
            stack.pop()
        front, back, size, table = self.tables[one, two]
        return front, back, size, table


def align(page: Node, reference: Reference) -> None:
    """Gives the nodes of ``page`` the places of the nodes of the reference they match."""
    if len(reference.kids) > reference.MOST_SHAPES:
        reference.shapes.clear()
        reference.kids.clear()
        reference.tables.clear()
        reference.shape(reference.root)
    if len(reference.tables) > reference.MOST_TABLES:
        reference.tables.clear()
    reference.shape(page)
    pairs = [(page, reference.root)]
    while pairs:
        one, two = pairs.pop()
        one.place = two.place
        if one.shape == two.shape:
            pairs.extend(zip(one.kids, two.kids, strict=True))
            continue
        if not one.kids or not two.kids:
            continue
        front, back, _, table = reference.matching(one.shape, two.shape)
        pairs.extend(zip(one.kids[:front], two.kids[:front], strict=True))
        if back:
            pairs.extend(zip(one.kids[-back:], two.kids[-back:], strict=True))
        i, j = len(table) - 1, len(table[0]) - 1
        while i and j:
            here = table[i][j]
            if here == table[i - 1][j]:
                i -= 1
            elif here == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((one.kids[front + i], two.kids[front + j]))


def blocks(root: Node) -> list[tuple[int, bool, bool, str]]:
    """(place, outside, inside an article, text) of every block with text, in page order."""
    out: list[tuple[int, bool, bool, str]] = []
    held: list[str] = []

    def close(owner: Node) -> None:
        text = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append((owner.place, owner.outside, owner.inside, text))

    # (node, the block it belongs to, None or its children still to come)
    stack: list[tuple[Node, Node, Iterator]] = [(root, root, iter(root.children))]
    while stack:
        node, owner, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                held.append(child)
                continue
            block = child.tag not in INLINE
            if block or child.outside != owner.outside:
                close(owner)
                stack.append((child, child, iter(child.children)))
            else:
                stack.append((child, owner, iter(child.children)))
            break
        else:
            stack.pop()
            if node is owner:
                close(owner)
    return out


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Reference] = {}
    kind = pa.list_(pa.struct([("place", pa.int32()), ("skip", pa.bool_()), ("text", pa.string())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = []
            for page, model in zip(part.column("html").to_pylist(), part.column("reference").to_pylist(), strict=True):
                tree = parse(page or "")
                if model:
                    if model not in known:
                        if len(known) >= REFERENCES:
                            known.pop(next(iter(known)))
                        known[model] = Reference(model)
                    align(tree, known[model])
                own = blocks(tree)
                only = any(inside and not outside for _, outside, inside, _ in own)
                found.append([{"place": place, "skip": outside or (only and not inside), "text": text} for place, outside, inside, text in own])
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), pa.array(found, kind)], names=["page_id", "url", "host", "blocks"])


def references(pages: DataFrame) -> DataFrame:
    """host and reference: the shortest page with the host's commonest set of tags."""
    tags = F.array_join(F.array_sort(F.array_distinct(F.expr("regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)"))), " ")
    seen = pages.where("html IS NOT NULL").select("host", tags.alias("tags"), F.length("html").alias("size"), F.xxhash64("html").alias("of"))
    common = seen.groupBy("host", "tags").agg(F.count("*").alias("n"), F.min(F.struct("size", "of")).alias("page"))
    chosen = common.groupBy("host").agg(F.max_by("page", F.struct("n", "tags")).alias("page")).select("host", "page.*")
    chosen = written(chosen, "reference-ids")
    rows = pages.select("host", "html", F.length("html").alias("size"), F.xxhash64("html").alias("of")).join(checked(chosen), ["host", "size", "of"])
    return rows.groupBy("host").agg(F.min("html").alias("reference"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    hosted = pages.select("page_id", "url", host_and_path(F.col("url"))[0].alias("host"), "html")
    chosen = written(references(hosted), "references")
    parsed = hosted.join(checked(chosen, HOSTS), "host", "left").select("page_id", "url", "host", "html", "reference")
    parsed = written(parsed.mapInArrow(_blocks_of, "page_id long, url string, host string, blocks array<struct<place: int, skip: boolean, text: string>>"), "blocks")

    voting = parsed.select("host", F.expr("xxhash64(transform(blocks, b -> b.text))").alias("page"), F.explode(F.expr("filter(blocks, b -> b.place >= 0 AND NOT b.skip)")).alias("b"))
    votes = voting.select("host", "page", F.col("b.place").alias("place"), F.xxhash64("b.text").alias("of")).distinct()
    same = votes.groupBy("host", "place", "of").agg(F.countDistinct("page").alias("n"))
    nodes = same.groupBy("host", "place").agg(F.sum("n").alias("all"), F.max(F.struct("n", "of")).alias("most"))
    template = nodes.where((F.col("all") >= VOTES) & (F.col("most.n") >= SHARE * F.col("all")))
    template = written(template.groupBy("host").agg(F.collect_list(F.struct("place", F.col("most.of").alias("of"))).alias("template")), "template")

    joined = parsed.join(checked(template, HOSTS), "host", "left")
    kept = F.expr("filter(blocks, b -> NOT b.skip AND NOT coalesce(array_contains(template, named_struct('place', b.place, 'of', xxhash64(b.text))), false))")
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return joined.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
