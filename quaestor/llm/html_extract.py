"""Main text of web pages by wrapper induction.

All pages of a host are aligned, in batches of at most BATCH, with the batch's
page of median length by simple tree matching. How many pages have a text unit
in the same place, saying the same, is added up over all batches; units with a
share of SUPPORT of the host's pages are its template. Other text is in slots.
The wrapper is the template and the path of the deepest element that holds most
of the slots' text and of their headings, over all batches; article and main
elements are never gone below.

On a page, the elements at the wrapper's path are the container, or the articles in it if
they hold most of its text, and what is in the template goes; in article and main elements only what FIRM pages have, and nothing if
nothing would be left. Pages that lack the path, and hosts with one page, take
their outermost article elements, else the main element, else the body. In either
case menus, headers, footers, side bars, notices, adverts, forms, comments, scripts
and styles inside go by tag, role and class: by any part of a name in STRONG, or
if all parts of all names are in WEAK or SHAPES. An outermost article is never judged
by its class. The column chosen_by says what has chosen the container.

Matching depends on the shape of subtrees alone, labels without text, so shapes
are numbered and each pair of them is matched once; equal shapes match as they
are, equal children at both ends go first, and the rest is one array operation for
each child, halved recursively when its table would be large.

Defined cases: null or empty html gives an empty text; a null url, or one
without a host, is of the host ''; pages that were cut off are read as far as
they go; neither depth nor number of children is limited; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.common import map_arrow, materialise, read, sized

#: Pages that one alignment holds at a time.
BATCH = 16
#: Of a host's pages, what must say the same for a template.
SUPPORT = 0.5
#: Pages of a host that must say the same, besides, for a template inside articles.
FIRM = 4
#: Of the slots' text, and of their headings, what the container must hold.
MOST = 0.8
#: Cells of a matching table that are held at once.
CELLS = 1 << 22

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option optgroup legend".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
DROPPED = frozenset("script style noscript template head nav footer aside form button select input textarea iframe svg canvas object audio video dialog menu fieldset search".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar".split())
STRONG = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal overlay newsletter sidebar aside menu menus nav navbar navigation breadcrumb breadcrumbs comment comments disqus footer masthead pagination pager".split())
WEAK = STRONG | frozenset("promo promoted promotion banner notice notices subscribe subscription toolbar share sharing social related recommended recommendations reply replies respond copyright widget widgets login signup skip header".split())
SHAPES = frozenset("area bar block body bottom box btn button buttons col column container content cta footer form group head holder icon icons inner item items left link links list main nav new page panel post posts right row section site strip stories top unit wrap wrapper".split())
WHOLE = frozenset(("html", "body", "article", "main"))
HEADINGS = frozenset(("h1", "h2"))
NONE: dict = {}
_WORD = re.compile(r"[a-z]+")


class Node:
    """path: a hash of the labels from the root down; shape: a number for the labels below, once ``Shapes`` has seen it."""

    __slots__ = ("tag", "attrs", "children", "parent", "path", "label", "shape", "_said")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.children, self.parent, self.shape, self._said = tag, attrs, [], parent, -1, None
        names = attrs.get("class") if attrs else None
        self.label = f"{tag}.{'.'.join(sorted(names.split()))}" if names else tag
        self.path = xxhash.xxh64_intdigest(self.label, parent.path) >> 1 if parent is not None else 0

    def elements(self) -> list:
        return [c for c in self.children if c.__class__ is Node]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            one = stack.pop()
            if one.__class__ is str:
                out.append(one)
            else:
                stack.append(" ")
                stack.extend(reversed(one.children))
                stack.append(" ")
        return " ".join("".join(out).split())

    def said(self) -> int:
        """A hash of the text, 0 for none."""
        if self._said is None:
            text = self.text()
            self._said = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 if text else 0
        return self._said


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.open = [self.root]
        self.n_open: Counter = Counter()

    def _pop(self, k: int) -> None:
        for node in self.open[k:]:
            self.n_open[node.tag] -= 1
        del self.open[k:]

    def _close(self, tags, limits=frozenset()) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                self._pop(k)
                return
            if self.open[k].tag in limits:
                return

    def handle_starttag(self, tag, attrs):
        if self.n_open["p"] and tag in CLOSES_P:
            self._close({"p"}, {"td", "th", "button", "object", "caption"})
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], LIMITS.get(tag, frozenset()))
        node = Node(tag, dict(attrs) if attrs else NONE, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.n_open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag):
        if self.n_open[tag]:
            self._close({tag}, {"table"} if tag not in ("table", "article", "main", "body", "html", "div", "section") else frozenset())

    def updatepos(self, i, j):  # lines aren't counted
        return j

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def walk(node: Node):
    stack = [node]
    while stack:
        one = stack.pop()
        yield one
        stack.extend(reversed(one.elements()))


def dropped(node: Node, inside: bool) -> bool:
    """Whether tag, role, class or id say that it isn't content. inside: an article or main element is above it."""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED and tag != "header":
        return True
    names: list = []
    if attrs:
        if attrs.get("role", "") in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return True
        if "class" in attrs or "id" in attrs:
            names = _WORD.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower())
    if tag in WHOLE and (tag != "article" or not inside):
        return False
    if tag == "header" or "header" in names:  # the header of an article holds its title
        return not inside or not any(n.tag == "h1" for n in walk(node))
    return bool(names) and (any(n in STRONG for n in names) or (all(n in WEAK or n in SHAPES for n in names) and any(n in WEAK for n in names)))


def visible(node: Node):
    """(element, whether an article or main element is above it) of those that aren't dropped, in page order."""
    stack = [(node, False)]
    while stack:
        one, inside = stack.pop()
        if not dropped(one, inside):
            yield one, inside
            below = inside or one.tag in ("article", "main")
            stack.extend((c, below) for c in reversed(one.elements()))


class Shapes:
    """Numbers the shapes of subtrees, and matches each pair of shapes once."""

    def __init__(self):
        self.number: dict = {}
        self.label: list[str] = []
        self.below: list[tuple] = []
        self.size: list[int] = []
        self.known: dict = {}

    def add(self, root: Node) -> None:
        for node in reversed(list(walk(root))):  # children come before their parent
            key = (node.label, tuple(c.shape for c in node.elements()))
            k = self.number.get(key)
            if k is None:
                k = self.number[key] = len(self.label)
                self.label.append(node.label)
                self.below.append(key[1])
                self.size.append(1 + sum(self.size[c] for c in key[1]))
            node.shape = k

    def match(self, x: int, y: int) -> tuple[int, list]:
        """Simple tree matching of two shapes of one label: its size, and the pairs of their children."""
        if x == y:
            return self.size[x], [(k, k) for k in range(len(self.below[x]))]
        found = self.known.get((x, y))
        if found is None:
            xs, ys = self.below[x], self.below[y]
            # A child whose equal stands at the same end has no better match.
            most, at = min(len(xs), len(ys)), 0
            while at < most and xs[at] == ys[at]:
                at += 1
            end = 0
            while end < most - at and xs[-1 - end] == ys[-1 - end]:
                end += 1
            pairs = [(k, k) for k in range(at)]
            if at + end < most:
                pairs += [(i + at, j + at) for i, j in self._pairs(xs[at : len(xs) - end], ys[at : len(ys) - end])]
            pairs += [(len(xs) - k, len(ys) - k) for k in range(end, 0, -1)]
            total = 1
            for i, j in pairs:
                total += self.match(xs[i], ys[j])[0]
            found = self.known[x, y] = total, pairs
        return found

    def _weights(self, xs: tuple, ys: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, other = list(dict.fromkeys(xs)), list(dict.fromkeys(ys))
        table = np.zeros((len(own), len(other)), np.int64)
        for i, x in enumerate(own):
            for j, y in enumerate(other):
                if self.label[x] == self.label[y]:
                    table[i, j] = self.match(x, y)[0]
        at, to = {x: i for i, x in enumerate(own)}, {y: j for j, y in enumerate(other)}
        return table, np.array([at[x] for x in xs]), np.array([to[y] for y in ys])

    def _pairs(self, xs: tuple, ys: tuple) -> list:
        table, rows, columns = self._weights(xs, ys)

        def best(rows, columns, keep=False):
            last = np.zeros(len(columns) + 1, np.int64)
            every = [last]
            for r in rows:
                now = np.zeros_like(last)
                np.maximum.accumulate(np.maximum(last[1:], last[:-1] + table[r, columns]), out=now[1:])
                last = now
                if keep:
                    every.append(last)
            return every if keep else last

        out, stack = [], [(0, len(rows), 0, len(columns))]
        while stack:
            a, b, c, d = stack.pop()
            if a == b or c == d:
                continue
            if (b - a) * (d - c) > CELLS and b - a > 1:
                half = (a + b) // 2
                cut = c + int(np.argmax(best(rows[a:half], columns[c:d]) + best(rows[half:b][::-1], columns[c:d][::-1])[::-1]))
                stack += [(half, b, cut, d), (a, half, c, cut)]
                continue
            score, i, j, found = best(rows[a:b], columns[c:d], keep=True), b - a, d - c, []
            while i and j:
                w = table[rows[a + i - 1], columns[c + j - 1]]
                if w and score[i][j] == score[i - 1][j - 1] + w:
                    found.append((a + i - 1, c + j - 1))
                    i, j = i - 1, j - 1
                elif score[i][j] == score[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
            out += reversed(found)
        return out


def align(a: Node, b: Node, shapes: Shapes | None = None) -> list[tuple[Node, Node]]:
    """Pairs of nodes in the largest matching of two trees with like roots."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # Python calls alone, which take no other stack
    if shapes is None:
        shapes = Shapes()
        shapes.add(a)
        shapes.add(b)
    out, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        out.append((x, y))
        xs, ys = x.elements(), y.elements()
        if x.shape == y.shape:
            stack.extend(zip(xs, ys, strict=True))
        elif xs and ys:
            stack.extend((xs[i], ys[j]) for i, j in shapes.match(x.shape, y.shape)[1])
    return out


def is_unit(node: Node) -> bool:
    """An element with no blocks inside."""
    return node.parent is not None and not any(c.__class__ is Node and c.tag in BLOCK for c in node.children)


def counts(pages: list[str]) -> tuple[dict, dict]:
    """What one batch of a host's pages says.

    (path, text) -> pages that have it there, both as hashes; (path, path above, tag) -> size of the slots' text below it and of their headings.
    """
    shapes, roots = Shapes(), [parse(p) for p in pages]
    for r in roots:
        shapes.add(r)
    order = sorted(range(len(roots)), key=lambda k: (len(pages[k]), pages[k]))
    first = roots[order[len(order) // 2]]
    nodes = list(walk(first))
    agree = {n: 1 for n in nodes if is_unit(n) and n.said()}
    for other in roots:
        if other is not first:
            for n, m in align(first, other, shapes):
                if n in agree and is_unit(m) and m.said() == n.said():
                    agree[n] += 1
    same: dict = {}
    for n, k in agree.items():
        key = (n.path, n.said())
        same[key] = max(same.get(key, 0), k)
    if len(roots) < 2:
        return same, {}
    seen = {n for n, _ in visible(first)}
    size = dict.fromkeys(nodes, 0)
    heads = dict.fromkeys(nodes, 0)
    for n in reversed(nodes):
        if n in seen and agree.get(n, 0) < max(2, SUPPORT * len(roots)):
            size[n] += sum(len(c.strip()) for c in n.children if c.__class__ is str)
        if n.tag in HEADINGS:
            heads[n] = size[n]
        if n.parent is not None:
            size[n.parent] += size[n]
            heads[n.parent] += heads[n]
    sizes: dict = {}
    for n in nodes:
        if size[n] and n.elements():
            key = (n.path, n.parent.path if n.parent is not None else -1, n.tag)
            old = sizes.get(key, (0, 0))
            sizes[key] = max(old[0], size[n]), max(old[1], heads[n])
    return same, sizes


def conclude(same: dict, sizes: dict, n_pages: int) -> dict:
    """The wrapper of a host from the sums of its batches' counts; with no slots, it has no container."""
    template = sorted(k for k, n in same.items() if n >= max(2, SUPPORT * n_pages))
    below: dict = {}
    for (path, above, tag), n in sizes.items():
        below.setdefault(above, []).append((n, path, tag))
    at, tag, whole = None, "", sizes.get((0, -1, ""), (0, 0))
    if whole[0]:
        at = 0
        while tag not in ("article", "main"):
            inner = [x for x in below.get(at, ()) if x[0][0] >= MOST * whole[0] and x[0][1] >= MOST * whole[1] and x[2] not in ("p", "h1", "h2", "h3", "ul", "ol", "table")]
            if not inner:
                break
            _, at, tag = max(inner)
    return {"template": template, "firm": [k for k in template if same[k] >= FIRM], "container": at, "tag": tag}


def induce(pages: list[str]) -> dict:
    """The wrapper of same-host pages: template texts by path, and the path of the content."""
    if len(pages) < 2:
        return {"template": [], "firm": [], "container": None, "tag": ""}
    same, sizes = Counter(), {}
    for at in range(0, len(pages), BATCH):
        own, size = counts(pages[at : at + BATCH])
        same.update(own)
        for k, (n, h) in size.items():
            old = sizes.get(k, (0, 0))
            sizes[k] = old[0] + n, old[1] + h
    return conclude(same, sizes, len(pages))


def containers(root: Node, wrapper: dict) -> tuple[list[Node], str]:
    """The elements that hold the content, in page order, and what has chosen them."""
    seen = list(visible(root))

    def outermost(wanted) -> list[Node]:
        out, taken = [], set()
        for n, _ in seen:
            if n.parent in taken or wanted(n):
                if n.parent not in taken:
                    out.append(n)
                taken.add(n)
        return out

    path = wrapper.get("container")
    if path is not None and (found := outermost(lambda n: n.path == path)):
        if wrapper["tag"] not in ("article", "main"):
            held = set(found)
            inner = [a for a in outermost(lambda n: n.tag == "article") if any(x in held for x in above(a))]
            if inner and len(_blocks(inner, set(), False)) >= MOST * len(_blocks(found, set(), False)):
                return inner, "article"
        return found, "wrapper"
    for name, wanted in (("article", lambda n: n.tag == "article"), ("main", lambda n: n.tag == "main" or n.attrs.get("role") == "main"), ("main", lambda n: "articlebody" in (n.attrs.get("itemprop") or "").lower())):
        if found := outermost(wanted):
            return found, name
    return outermost(lambda n: n.tag == "body") or [root], "body"


def extracted(html: str | None, wrapper: dict | None = None) -> tuple[str, str]:
    """The main text, and what has chosen its container."""
    root, wrapper = parse(html), wrapper or {}
    found, by = containers(root, wrapper)
    whole = wrapper.get("tag") in ("article", "main") if by == "wrapper" else by != "body"
    template = {tuple(x) for x in wrapper.get("firm" if whole else "template", ())}
    text = _blocks(found, template, not whole)
    return (text or _blocks(found, set(), False) if whole else text), by


def main_text(html: str | None, wrapper: dict | None = None) -> str:
    return extracted(html, wrapper)[0]


def _blocks(found: list[Node], template: set, inline: bool) -> str:
    """The text below the elements without the template, of which inline elements only go if ``inline``."""
    blocks, line, places = [], [], {path for path, _ in template}

    def flush():
        if block := " ".join("".join(line).split()):
            blocks.append(block)
        line.clear()

    for main in found:
        flush()
        inside = main.tag in ("article", "main") or any(a.tag in ("article", "main") for a in above(main))
        stack: list = [(main, inside)]
        while stack:
            one, inside = stack.pop()
            if one is None:
                flush()
            elif one.__class__ is str:
                line.append(one)
            elif one.tag == "br":
                line.append(" ")
            elif one is main or not dropped(one, inside) and not (one.path in places and (inline or one.tag in BLOCK) and is_unit(one) and (one.path, one.said()) in template):
                if one.tag in BLOCK:
                    flush()
                    stack.append((None, False))
                below = inside or one.tag in ("article", "main")
                stack.extend((c, below) for c in reversed(one.children))
    flush()
    return "\n\n".join(blocks)


def above(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from rows (host, html). All pages are aligned, at most BATCH of a host at a time; a repeated page counts once."""
    pages = pages.filter("html IS NOT NULL AND html <> ''").select("host", "html", F.xxhash64("html").alias("hash"))
    per_host = materialise(pages.select("host", "hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter("pages > 1"))
    parts = F.ceil(F.col("pages") / F.lit(4 * BATCH)).cast("int")
    dealt = pages.join(sized(per_host), "host").select("host", F.pmod(F.xxhash64("hash"), parts).alias("part"), "hash", "html")
    dealt = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "hash", "html").select("host", "part", "html")

    def count(batches):
        def told(host, group):
            same, sizes = counts(group)
            rows = [(host, p, t, None, n, 0) for (p, t), n in same.items()] + [(host, p, a, tag, n, h) for (p, a, tag), (n, h) in sizes.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "other", "tag", "n", "heads"])

        at, last, group = None, None, []
        for batch in batches:
            for host, part, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == (host, part) and html == last:
                    continue
                if group and (at != (host, part) or len(group) == BATCH):
                    yield told(at[0], group)
                    group = []
                at, last = (host, part), html
                group.append(html)
        if group:
            yield told(at[0], group)

    # A row without a tag counts a text, with one it adds up what is below an element.
    sums = map_arrow(dealt, count, "host string, path long, other long, tag string, n long, heads long").groupBy("host", "path", "other", "tag").agg(F.sum("n").alias("n"), F.sum("heads").alias("heads"))
    sums = materialise(sums)
    whole = materialise(sums.filter("other = -1 AND tag IS NOT NULL").select("host", F.col("n").alias("total")))
    few = sums.join(sized(per_host), "host").join(sized(whole), "host", "left")
    few = few.filter(F.when(F.col("tag").isNull(), (F.col("n") >= 2) & (F.col("n") >= SUPPORT * F.col("pages"))).otherwise(F.col("n") >= MOST * F.col("total")))
    few = few.groupBy("host").agg(F.first("pages").alias("pages"), F.collect_list(F.struct("path", "other", "tag", "n", "heads")).alias("told"))

    def run(batches):
        for batch in batches:
            made = []
            for n_pages, told in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                same = {(x["path"], x["other"]): x["n"] for x in told if x["tag"] is None}
                sizes = {(x["path"], x["other"], x["tag"]): (x["n"], x["heads"]) for x in told if x["tag"] is not None}
                made.append(json.dumps(conclude(same, sizes, n_pages)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["host", "wrapper"])

    return map_arrow(few, run, "host string, wrapper string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, chosen_by."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host.alias("host"))
    found = materialise(wrappers(rows.select("host", "html")))
    both = rows.join(sized(found, limit=20_000), "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches):
        last, wrapper = None, {}
        for batch in batches:
            texts, by = [], []
            for html, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own != last:
                    last, wrapper = own, json.loads(own) if own else {}
                text, chosen = extracted(html, wrapper)
                texts.append(text)
                by.append(chosen)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(by, pa.string())], ["page_id", "url", "text", "n_chars", "chosen_by"])

    return map_arrow(both, run, "page_id long, url string, text string, n_chars long, chosen_by string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
