"""UD2: HTML pages as arrays of nodes, and card fields as Column expressions over them.

A small Arrow helper flattens a page into its nodes in document order. A node's subtree is then a
contiguous slice of the array, so every selector cascade is a higher-order function that Spark
evaluates; no per-card Python runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from vitrine.functions.text import strip

NODES = T.ArrayType(T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("last", T.IntegerType()),
    T.StructField("parent", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("classes", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
]))
# fixed values: elements without content; elements whose text is not page text
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))


class _Flattener(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.text_ended = [], [], True

    def _add(self, tag, text=None, attrs=None):
        at = len(self.nodes)
        parent = self.open[-1] if self.open else -1
        # class names between blanks, so that a name is found with its two blanks
        classes = f" {' '.join(attrs.get('class', '').split())} " if attrs else None
        self.nodes.append({"pos": at, "last": at, "parent": parent, "tag": tag, "text": text,
                           "classes": classes, "attrs": attrs})
        self.text_ended = tag != ""
        return at

    def _close(self, down_to):
        self.text_ended = True
        while len(self.open) > down_to:
            self.nodes[self.open.pop()]["last"] = len(self.nodes) - 1

    def handle_starttag(self, tag, attrs):
        at = self._add(tag, attrs={name: value or "" for name, value in attrs})
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs={name: value or "" for name, value in attrs})

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]]["tag"] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        if self.open and self.nodes[self.open[-1]]["tag"] in HIDDEN:
            return
        if self.text_ended:
            self._add("", text=data)
        else:
            self.nodes[-1]["text"] += data

    def handle_comment(self, data):
        self.text_ended = True

    def finish(self):
        self.close()
        self._close(0)
        return self.nodes


# plain mark-up, about which the parser of the standard library leaves no doubt; the last group is any other "<"
_BLANK, _NAME = r"[ \t\n\r\f]", "[A-Za-z][A-Za-z0-9]*"
_TOKEN = re.compile(
    rf'<({_NAME})((?:{_BLANK}+[A-Za-z_][A-Za-z0-9_-]*(?:="[^"]*")?)*){_BLANK}*(/?)>'
    rf"|</({_NAME}){_BLANK}*>|([^<]+)|(<!--[^->]*-->)|(<)")
_ATTRIBUTE = re.compile(r'([A-Za-z_][A-Za-z0-9_-]*)(?:="([^"]*)")?')
_RAW_TEXT = frozenset(("script", "style"))


def _plain(page: str) -> list[dict] | None:
    """The nodes of a page of plain mark-up, as ``_Flattener`` gives them; none when the page holds anything else."""
    nodes, opened, text_ended = [], [], True
    for name, source, closed, ended, data, comment, odd in _TOKEN.findall(page):
        if data:
            if opened and nodes[opened[-1]]["tag"] in HIDDEN:
                continue
            if "&" in data:
                data = unescape(data)
            if text_ended:
                at = len(nodes)
                nodes.append({"pos": at, "last": at, "parent": opened[-1] if opened else -1, "tag": "", "text": data,
                              "classes": None, "attrs": None})
                text_ended = False
            else:
                nodes[-1]["text"] += data
        elif ended:
            ended = ended.lower()
            for depth in range(len(opened) - 1, -1, -1):
                if nodes[opened[depth]]["tag"] == ended:
                    last = len(nodes) - 1
                    for at in opened[depth:]:
                        nodes[at]["last"] = last
                    del opened[depth:]
                    text_ended = True
                    break
        elif name:
            name = name.lower()
            if name in _RAW_TEXT:
                return None
            attrs, classes, at = {}, None, len(nodes)
            if source:
                for key, value in _ATTRIBUTE.findall(source):
                    attrs[key.lower()] = unescape(value) if "&" in value else value
                if attrs:
                    classes = f" {' '.join(attrs['class'].split())} " if "class" in attrs else "  "
            nodes.append({"pos": at, "last": at, "parent": opened[-1] if opened else -1, "tag": name, "text": None,
                          "classes": classes, "attrs": attrs})
            if not closed and name not in VOID:
                opened.append(at)
            text_ended = True
        elif odd:
            return None
        else:
            text_ended = True
    for at in opened:
        nodes[at]["last"] = len(nodes) - 1
    return nodes


# a page cut at its tags; what is no plain tag, with attributes in quotes of either kind, is told by ``tag_of``
PIECES = re.compile(r"""<!--[^->]*-->|<[^<>"']*(?:(?:"[^"]*"|'[^']*')[^<>"']*)*>|[^<]+|<""")
_TAG = re.compile(
    rf"""<({_NAME})((?:{_BLANK}+[A-Za-z_][A-Za-z0-9_-]*(?:="[^"]*"|='[^']*')?)*){_BLANK}*(/?)>|</({_NAME}){_BLANK}*>|(<!--[^->]*-->)""")
_PAIR = re.compile(r"""([A-Za-z_][A-Za-z0-9_-]*)(?:="([^"]*)"|='([^']*)')?""")
OPENS, ALONE, CLOSES, SAYS_NOTHING = range(4)


def tag_of(piece: str) -> tuple[int, str, dict[str, str]] | None:
    """What a piece of plain mark-up does, the name and the attributes of its tag; none for anything that needs the parser."""
    m = _TAG.fullmatch(piece)
    if m is None:
        return None
    name, source, closed, ended, _ = m.groups()
    if ended:
        return CLOSES, ended.lower(), {}
    if not name:
        return SAYS_NOTHING, "", {}
    name = name.lower()
    if name in _RAW_TEXT:
        return None
    attrs = {}
    for key, double, single in _PAIR.findall(source):
        value = double or single
        attrs[key.lower()] = unescape(value) if "&" in value else value
    return ALONE if closed or name in VOID else OPENS, name, attrs


def _flatten(page):
    if page is None:
        return []
    nodes = _plain(page)
    if nodes is None:
        parser = _Flattener()
        parser.feed(page)
        nodes = parser.finish()
    return nodes


@F.pandas_udf(NODES)
def page_nodes(page: pd.Series) -> pd.Series:
    return page.map(_flatten)


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(unescape, na_action="ignore")


def decode_entities(text: Column) -> Column:
    """P33. Only texts that hold an ampersand travel to Python."""
    needs = F.contains(text, F.lit("&"))
    return F.when(needs, _unescape(F.when(needs, text))).otherwise(text)


# --- selectors: plain predicates over a node -------------------------------
Selector = Callable[[Column], Column]


def tag(*names: str) -> Selector:
    return lambda n: n["tag"].isin(*names)


def has(attr: str) -> Selector:
    return lambda n: n["attrs"][attr].isNotNull()


def cls(*names: str) -> Selector:
    return lambda n: reduce(
        lambda a, b: a & b, [F.contains(n["classes"], F.lit(f" {c} ")) for c in names])


def attr_is(attr: str, value: str) -> Selector:
    return lambda n: n["attrs"][attr] == value


def attr_like(attr: str, part: str) -> Selector:
    return lambda n: F.contains(n["attrs"][attr], F.lit(part))


def every(*tests: Selector) -> Selector:
    return lambda n: reduce(lambda a, b: a & b, [t(n) for t in tests])


def either(*tests: Selector) -> Selector:
    return lambda n: reduce(
        lambda a, b: a | b, [F.coalesce(t(n), F.lit(False)) for t in tests])


def inside(outer: Selector, inner: Selector, nodes: Column) -> Selector:
    """Descendant selector: an ``inner`` node with an ``outer`` ancestor anywhere above it."""
    return lambda n: inner(n) & F.exists(
        nodes, lambda m: (m["pos"] < n["pos"]) & (m["last"] >= n["pos"]) & outer(m))


def _elements(nodes: Column, test: Selector) -> Column:
    return F.filter(nodes, lambda n: (n["tag"] != "") & F.coalesce(test(n), F.lit(False)))


def select_all(nodes: Column, test: Selector) -> Column:
    return _elements(nodes, test)


def below(nodes: Column, node: Column) -> Column:
    """The descendants of a node."""
    return F.slice(nodes, node["pos"] + 2, node["last"] - node["pos"])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_fields(use: Callable[[Column], Column], **fields: Column) -> Column:
    """Compute the named fields once, then build the result from them."""
    return let(F.struct(*[value.alias(name) for name, value in fields.items()]), use)


def find(nodes: Column, node: Column, test: Selector) -> Column:
    """First descendant that passes, else null."""
    return F.try_element_at(_elements(below(nodes, node), test), F.lit(1))


def text_of(nodes: Column, node: Column, joiner: str = "") -> Column:
    """Text of a node: its text pieces stripped, empty ones dropped. Null for a null node."""
    def joined(n: Column) -> Column:
        pieces = F.transform(
            F.filter(below(nodes, n), lambda t: t["tag"] == ""), lambda t: strip(t["text"]))
        return F.when(n.isNotNull(), F.array_join(F.filter(pieces, lambda t: t != ""), joiner))
    return let(node, joined)


def raw_text_of(nodes: Column, node: Column) -> Column:
    """Text of a node as it stands."""
    return let(node, lambda n: F.when(n.isNotNull(), F.array_join(F.transform(
        F.filter(below(nodes, n), lambda t: t["tag"] == ""), lambda t: t["text"]), "")))


def texts(nodes: Column, node: Column, tests: Iterable[Selector]) -> Column:
    """Text of the first hit of every selector, null where a selector has none."""
    return F.array(*[text_of(nodes, find(nodes, node, test)) for test in tests])


def first_long_text(nodes: Column, node: Column, tests: Iterable[Selector], least: int = 10) -> Column:
    """The first hit whose text is long enough; without one the text of the last hit."""
    return let(texts(nodes, node, tests), lambda found: F.coalesce(
        F.try_element_at(F.filter(found, lambda t: F.length(t) >= least), F.lit(1)),
        F.try_element_at(F.filter(found, lambda t: t.isNotNull()), F.lit(-1)),
    ))


def first_value(found: Column, read: Callable[[Column], Column]) -> Column:
    """The first text that ``read`` can make something of."""
    return F.try_element_at(
        F.filter(F.transform(found, lambda t: read(t)), lambda v: v.isNotNull()), F.lit(1))


def first_cards(nodes: Column, tests: Iterable[Selector], enough: int, fallback_last: bool = True) -> Column:
    """Card cascade: the first selector with ``enough`` hits; else the last one's hits (or none)."""
    found = [select_all(nodes, test) for test in tests]
    chosen = reduce(lambda rest, hits: F.when(F.size(hits) >= enough, hits).otherwise(rest),
                    reversed(found[:-1]), found[-1])
    return chosen if fallback_last else F.when(F.size(chosen) >= enough, chosen)
