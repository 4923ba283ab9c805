"""UD2, SC13-SC18 as data: a site's cards are described by rows of store, field, rank, selector, attr and post.

The field ``card`` names the cards; of its selectors the first by rank that finds any on a page counts. Other fields are looked
for inside a card, selector by selector in the order of rank; the first value that fits wins. ``attr`` is the attribute to
read, null for the text. ``post``: ``strip_query`` cuts a link at its question mark, ``absolute:<base>`` completes a path.

Selectors: ``tag.class#id[attr]``, with ``=``, ``*=``, ``^=`` and ``$=`` for attributes, a blank for descendants, ``>`` for children,
commas for alternatives. All selectors of a store are tested in one walk over the page: a node inherits from its parent which
steps of which selectors may come next, so the time is linear in the nodes, whatever their depth.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from functools import partial
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions import text
from vitrine.functions.html import ALONE, CLOSES, HIDDEN, OPENS, PIECES, _flatten, tag_of
from vitrine.sources.common import item_rows, offer, offer_rows, text_map

TEMPLATES = "store string, field string, rank int, selector string, attr string, post string"
#: Rows of all templates together; they are sent to every worker.
MOST_ROWS = 10_000
NUMBERS = ("price", "original_price", "discount_pct")
_DIGIT = re.compile(r"[0-9]").search
_PART = re.compile(r"([\w-]+|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$]?=)[\"']?([^\"'\]]*)[\"']?)?\]")
Test = Callable[[dict], bool]


def _attribute(name: str, sign: str | None, value: str) -> Test:
    tests = {None: lambda x: True, "=": lambda x: x == value, "*=": lambda x: value in x,
             "^=": lambda x: x.startswith(value), "$=": lambda x: x.endswith(value)}
    return lambda node: name in node["attrs"] and tests[sign](node["attrs"][name])


def _compound(source: str) -> Test:
    """``needs`` on the test names something a node must have to pass it: its tag, a class or an attribute. ``valued``: it
    depends on the value of an attribute other than the class."""
    tests, at, needs, valued = [], 0, None, False
    while at < len(source):
        m = _PART.match(source, at)
        if not m or (m[1] and at):
            raise ValueError(f"can't read the selector {source!r}")
        tag, cls, name, attr, sign, value = m.groups()
        if needs is None and tag != "*":
            needs = tag.lower() if tag else f".{cls}" if cls else "[id" if name else f"[{attr.lower()}"
        if tag and tag != "*":
            tests.append(lambda node, tag=tag.lower(): node["tag"] == tag)
        elif cls:
            tests.append(lambda node, cls=f" {cls} ": cls in (node["classes"] or ""))
        elif name:
            tests.append(_attribute("id", "=", name))
            valued = True
        elif attr:
            valued |= sign is not None and attr.lower() != "class"
            tests.append(_attribute(attr.lower(), sign, value or ""))
        at = m.end()
    test = tests[0] if len(tests) == 1 else lambda node: all(t(node) for t in tests)
    test = partial(test)  # the test of a tag is shared by no one else
    test.needs, test.valued = needs, valued
    return test


def parse(selector: str) -> list[list[tuple[str, Test]]]:
    """The alternatives of a selector, each a list of (how it follows the step before, test)."""
    chains = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        # blanks and commas inside brackets belong to a value
        words = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", alternative)
        if "".join("".join(words).split()) != "".join(alternative.split()):
            raise ValueError(f"can't read the selector {selector!r}")
        chain, follows = [], " "
        for word in words:
            if word == ">":
                follows = ">"
            else:
                chain.append((follows, _compound(word)))
                follows = " "
        if not chain or follows == ">":
            raise ValueError(f"can't read the selector {selector!r}")
        chains.append(chain)
    return chains


class Nodes(NamedTuple):
    """A page's nodes in document order, column by column: name of the tag (empty: a text), text, attributes, place of the
    parent (or -1) and of the last node below."""

    tags: list[str]
    texts: list[str | None]
    attrs: list[dict[str, str] | None]
    parents: list[int]
    lasts: list[int]


def _node(tag: str, attrs: dict[str, str]) -> dict:
    """What tests look at."""
    return {"tag": tag, "attrs": attrs, "classes": f" {' '.join(attrs.get('class', '').split())} " if attrs else None}


class Matcher:
    """Many selectors, tested in one walk. A node meets only the tests that ask for its tag, its classes or its attributes."""

    def __init__(self, selectors: list[str]):
        self.steps: list[tuple[Test, int, int]] = []  # test, bit of the next step and how it follows, selector it ends
        self.first = 0
        self.child = 0
        for number, selector in enumerate(selectors):
            for chain in parse(selector):
                for k, (follows, test) in enumerate(chain):
                    bit = 1 << len(self.steps)
                    if k == 0:
                        self.first |= bit
                    elif follows == ">":
                        self.child |= bit
                    self.steps.append((test, 0 if k + 1 == len(chain) else bit << 1, number))
        self.count = len(selectors)
        self.asking: dict[str | None, list[tuple[int, Test]]] = {}
        for k, (test, *_) in enumerate(self.steps):
            self.asking.setdefault(test.needs, []).append((1 << k, test))
        self.known: dict[tuple, tuple[int, list[tuple[int, Test]]]] = {}
        self.pieces: dict[str, tuple | None] = {}
        self.moves: dict[tuple[int, int, int], tuple[int, int, tuple[int, ...]]] = {}

    def _passed(self, tag: str, attrs: dict[str, str]) -> int:
        """The bits of the steps whose test a node passes. What its tag, its class and the names of its attributes say is remembered."""
        key = (tag, attrs.get("class"), *attrs)
        if key not in self.known:
            if len(self.known) >= MOST_ROWS:
                self.known.clear()
            node, passed, open_ = _node(tag, attrs), 0, []
            for name in (None, tag, *[f"[{a}" for a in attrs], *[f".{c}" for c in set((node["classes"] or "").split())]):
                for bit, test in self.asking.get(name, ()):
                    if test.valued:
                        open_.append((bit, test))
                    elif test(node):
                        passed |= bit
            self.known[key] = passed, open_
        passed, open_ = self.known[key]
        if open_:
            node = _node(tag, attrs)
            for bit, test in open_:
                if test(node):
                    passed |= bit
        return passed

    def _move(self, inherited: int, direct: int, passed: int) -> tuple[int, int, tuple[int, ...]]:
        """From the steps that may come at a node and those it passes: the steps that may come anywhere below it and at its
        children, and the selectors that end at it."""
        key = (inherited, direct, passed)
        move = self.moves.get(key)
        if move is None:
            deeper, children, ended = inherited, 0, []
            hits = (self.first | inherited | direct) & passed
            while hits:
                bit = hits & -hits
                hits ^= bit
                _, following, number = self.steps[bit.bit_length() - 1]
                if not following:
                    if number not in ended:
                        ended.append(number)
                elif following & self.child:
                    children |= following
                else:
                    deeper |= following
            move = deeper, children, tuple(ended)
            if len(self.moves) >= MOST_ROWS:
                self.moves.clear()
            self.moves[key] = move
        return move

    def walk(self, nodes: list[dict]) -> list[list[int]]:
        """Per selector the places of the nodes it matches, ascending."""
        found: list[list[int]] = [[] for _ in range(self.count)]
        below, children = [0] * len(nodes), [0] * len(nodes)
        for node in nodes:
            at, up = node["pos"], node["parent"]
            if not node["tag"]:  # text
                continue
            inherited, direct = (below[up], children[up]) if up >= 0 else (0, 0)
            below[at], children[at], ended = self._move(inherited, direct, self._passed(node["tag"], node["attrs"]))
            for number in ended:
                found[number].append(at)
        return found

    def _piece(self, piece: str) -> tuple | None:
        """``tag_of`` a piece and the bits of the steps its tag passes."""
        read = tag_of(piece)
        if read is not None:
            kind, name, attrs = read
            read = kind, name, attrs, self._passed(name, attrs) if kind <= ALONE else 0
        if len(piece) <= 200:
            if len(self.pieces) >= MOST_ROWS:
                self.pieces.clear()
            self.pieces[piece] = read
        return read

    def read(self, page: str | None) -> tuple[Nodes, list[list[int]]]:
        """The nodes of a page, and per selector the places of those it matches: one pass over a page of plain mark-up.
        Pages of other kinds go through the parser."""
        if page is None:
            return Nodes([], [], [], [], []), [[] for _ in range(self.count)]
        return self._read_plain(page) or self._read_any(page)

    def _read_any(self, page: str) -> tuple[Nodes, list[list[int]]]:
        nodes = _flatten(page)
        return Nodes(*([n[k] for n in nodes] for k in ("tag", "text", "attrs", "parent", "last"))), self.walk(nodes)

    def _read_plain(self, page: str) -> tuple[Nodes, list[list[int]]] | None:
        tags, texts, all_attrs, parents, lasts = nodes = Nodes([], [], [], [], [])
        found: list[list[int]] = [[] for _ in range(self.count)]
        # the open elements: place, name, and the steps that may come below and at their children
        opened, names, inner = [-1], [""], [(0, 0)]
        seen, moves, text_ended = self.pieces, self.moves, True
        for piece in PIECES.findall(page):
            if piece[0] != "<":
                if names[-1] in HIDDEN:
                    continue
                if "&" in piece:
                    piece = unescape(piece)
                if text_ended:
                    lasts.append(len(tags))
                    tags.append("")
                    texts.append(piece)
                    all_attrs.append(None)
                    parents.append(opened[-1])
                    text_ended = False
                else:
                    texts[-1] += piece
                continue
            known = seen[piece] if piece in seen else self._piece(piece)
            if known is None:
                return None
            kind, name, attrs, passed = known
            if kind <= ALONE:
                at = len(tags)
                lasts.append(at)
                tags.append(name)
                texts.append(None)
                all_attrs.append(attrs)
                parents.append(opened[-1])
                inherited, direct = inner[-1]
                deeper, children, ended = moves.get((inherited, direct, passed)) or self._move(inherited, direct, passed)
                for number in ended:
                    found[number].append(at)
                if kind == OPENS:
                    opened.append(at)
                    names.append(name)
                    inner.append((deeper, children))
                text_ended = True
            elif kind == CLOSES:
                depth = len(names) - 1
                while depth and names[depth] != name:
                    depth -= 1
                if depth:
                    for at in opened[depth:]:
                        lasts[at] = len(tags) - 1
                    del opened[depth:], names[depth:], inner[depth:]
                    text_ended = True
            else:
                text_ended = True
        for at in opened[1:]:
            lasts[at] = len(tags) - 1
        return nodes, found


class Template:
    """The rows of one store, ready for pages."""

    def __init__(self, rows: list[tuple[str, int, str, str | None, str | None]]):
        rows = sorted(rows, key=lambda r: r[:2])
        self.cards = [i for i, r in enumerate(rows) if r[0] == "card"]
        self.fields: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            if r[0] != "card":
                self.fields.setdefault(r[0], []).append(i)
        self.rows, self.matcher = rows, Matcher([r[2] for r in rows])

    def __call__(self, page: str | None) -> list[dict[str, str]]:
        nodes, found = self.matcher.read(page)
        cards = next((found[i] for i in self.cards if found[i]), [])
        # what no selector of a field finds on the page needs no look inside the cards
        fields = [(field, own) for field, numbers in self.fields.items()
                  if (own := [(found[i], *self.rows[i][3:]) for i in numbers if found[i]])]
        return [self._card(nodes, fields, at) for at in cards]

    def _card(self, nodes: Nodes, fields: list, card: int) -> dict[str, str]:
        out, last = {}, nodes.lasts[card]
        for field, selectors in fields:
            for places, attr, post in selectors:
                k = bisect_left(places, card)
                while k < len(places) and places[k] <= last:
                    value = self._value(nodes, places[k], field, attr, post)
                    if value:
                        out[field] = value
                        break
                    k += 1
                if field in out:
                    break
        return out

    def _value(self, nodes: Nodes, at: int, field: str, attr: str | None, post: str | None) -> str | None:
        if attr:
            value = nodes.attrs[at].get(attr.lower(), "").strip()
        else:
            value = " ".join("".join(filter(None, nodes.texts[at + 1:nodes.lasts[at] + 1])).split())
        if field in NUMBERS and not _DIGIT(value) and not any(c.isdigit() for c in value):
            return None
        if post == "strip_query":
            value = value.split("?")[0]
        elif post and post.startswith("absolute:") and value.startswith("/"):
            value = post.removeprefix("absolute:").rstrip("/") + value
        return value or None


def _reader(templates: DataFrame):
    rows = templates.select("store", "field", "rank", "selector", "attr", "post").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} template rows")
    by_store: dict[str, list[tuple]] = {}
    for store, *row in rows:
        by_store.setdefault(store, []).append(tuple(row))
    for store, own in by_store.items():
        Template(own)  # a selector that can't be read is told here, not by a task

    kinds = pa.list_(pa.map_(pa.string(), pa.string()))

    @F.arrow_udf("array<map<string,string>>")
    def read(store: pa.Array, body: pa.Array) -> pa.Array:
        ready = {name: Template(by_store[name]) for name in store.unique().to_pylist() if name in by_store}
        pages = ((ready.get(name), page.as_py()) for name, page in zip(store.to_pylist(), body))
        return pa.array([[[*card.items()] for card in reader(page)] if reader else [] for reader, page in pages], kinds)

    return read


def _offer(card: Column, store: Column) -> Column:
    value = lambda name: F.try_element_at(card, F.lit(name))
    link = value("link")
    return offer(
        key=F.coalesce(value("key"), link), title=text.clean_title(value("title")), link=link,
        price=text.parse_price(value("price")), original_price=text.parse_price(value("original_price")),
        discount_pct=text.percent_in_text(value("discount_pct"), False), category=value("category"), image_url=value("image_url"),
        coupon_code=value("coupon_code"), free_shipping=value("free_shipping").isNotNull(), extra=text_map(source=F.lit("template"), template=store))


def template_cards(pages: DataFrame, templates: DataFrame, tier: int = 0) -> DataFrame:
    """Offers of all pages whose store has a template."""
    cards = _reader(templates)(F.col("store"), F.col("body"))
    return offer_rows(item_rows(pages, cards), _offer(F.col("item"), F.col("store")), tier)
