"""Page content by rules: which element of a host's pages is the text, what to remove, where to cut."""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Select:
    tag: str
    attr: str = ""
    value: str = ""
    text: str = ""  # the element's own text, exactly

    def fits(self, node) -> bool:
        if node.tag != self.tag:
            return False
        if self.text:
            return node.text_exact() == self.text
        own = node.attrs.get(self.attr) or ""
        return not self.attr or (self.value in own.split() if self.attr == "class" else own == self.value)


@dataclass(frozen=True)
class Drop:
    what: Select
    parent: bool = False
    sibling: str = ""


@dataclass(frozen=True)
class Rule:
    name: str
    host: str
    path: str
    main: tuple[Select, ...]
    drops: tuple[Drop, ...] = ()
    cut: str = ""


def _class(tag: str, name: str) -> Select:
    return Select(tag, "class", name)


# Fixed values; of the rules that fit, the first counts.
RULES = (
    Rule("H1", "www.cancer.gov", "", (Select("main", "id", "main-content"),), (Drop(_class("nav", "on-this-page")), Drop(_class("div", "pdq-hp-patient-toggle"))), "To Learn More About"),
    Rule("H2", "ghr.nlm.nih.gov", "", (_class("div", "main"),), (), "Additional Information & Resources"),
    Rule("H3", "www.niddk.nih.gov", "", (_class("article", "dk-content"),), (Drop(Select("b", text="On this page:"), True, "ul"), Drop(Select("strong", text="On this page:"), True, "ul"), Drop(Select("strong", text="In this section:"), True, "ul")), "References"),
    Rule("H4", "www.nhlbi.nih.gov", "", (_class("div", "field__items"),)),
    Rule("H5", "www.nlm.nih.gov", "/medlineplus/ency", (_class("div", "main-single"), _class("div", "main"))),
    Rule("H6", "www.nlm.nih.gov", "/medlineplus/druginfo/meds", (Select("article"),), (Drop(_class("div", "page-info"), sibling="div"),), "Last Revised -"),
    Rule("H7", "www.nlm.nih.gov", "/medlineplus/druginfo/natural", (Select("article"),), (Drop(_class("div", "page-info"), sibling="div"),), "References"),
    Rule("H8", "www.nlm.nih.gov", "", (_class("div", "main"),), (Drop(Select("section", "id", "toc-section")), Drop(_class("div", "mp-refs")), Drop(_class("p", "attribution"))), "Start Here"),
)
#: For hosts that no rule names, if wanted.
ARTICLE = Rule("article", "", "", (Select("article"),))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text_exact(self) -> str | None:
        return self.children[0] if len(self.children) == 1 and isinstance(self.children[0], str) else None

    def walk(self):
        stack = [self]
        while stack:
            one = stack.pop()
            yield one
            stack.extend(c for c in reversed(one.children) if isinstance(c, _Node))

    def find(self, what: Select):
        return next((n for n in self.walk() if n is not self and what.fits(n)), None)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]

    def fragments(self, scripts: bool):
        stack = [self]
        while stack:
            one = stack.pop()
            if isinstance(one, str):
                if one.strip():
                    yield one.strip()
            elif scripts or one.tag not in ("script", "style"):
                stack.extend(reversed(one.children))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def page_content(html: str | None, rule: Rule, scripts: bool = False) -> str | None:
    """A page's text fragments, one a line, up to the rule's mark; null without the main element. ``scripts`` keeps script text."""
    if html is None:
        return None
    tree = _Tree()
    tree.feed(html)
    tree.close()
    for drop in rule.drops:
        node = tree.root.find(drop.what)
        if node is not None:
            node = node.parent if drop.parent and node.parent is not None else node
            if drop.sibling and node.parent is not None:
                after = node.parent.children[node.parent.children.index(node) + 1 :]
                sibling = next((c for c in after if isinstance(c, _Node) and c.tag == drop.sibling), None)
                if sibling is not None:
                    sibling.remove()
            node.remove()
    main = next((n for n in (tree.root.find(s) for s in rule.main) if n is not None), None)
    if main is None:
        return None
    text = "\n".join(main.fragments(scripts))
    return text.split(rule.cut)[0] if rule.cut else text


def route(url: Column, rules: tuple[Rule, ...] = RULES, default: str | None = None) -> Column:
    """The name of the first rule that fits a URL's authority and path."""
    host, path = F.try_parse_url(url, F.lit("AUTHORITY")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    out = F.lit(default).cast("string")
    for rule in reversed(rules):
        out = F.when((host == rule.host) & path.startswith(rule.path), rule.name).otherwise(out)
    return out


def contents(pages: DataFrame, url: str = "url", html: str = "html", rules: tuple[Rule, ...] = RULES, default: Rule | None = None, scripts: bool = False) -> DataFrame:
    """(url, content) of each distinct URL (of several pages of one URL the first by their html); content is null when no rule fits or the main element is missing."""
    named = {r.name: r for r in (*rules, *([default] if default else []))}
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).groupBy("url").agg(F.min("html").alias("html"))
    rows = rows.select("url", "html", route(F.col("url"), rules, default.name if default else None).alias("rule"))

    def run(batches):
        for batch in batches:
            texts = [page_content(h, named[r], scripts) if r else None for h, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["url", "content"])

    return rows.mapInArrow(run, "url string, content string")


def with_contents(rows: DataFrame, pages: DataFrame, url: str, drop_empty: bool = False, **options) -> DataFrame:
    """Adds the content of each row's page; pages are parsed once each."""
    found = contents(pages, **options).withColumnRenamed("url", "__url")
    out = rows.join(found, F.col(url) == F.col("__url"), "left").drop("__url")
    return out.filter(F.col("content").isNotNull() & (F.col("content") != "")) if drop_empty else out
