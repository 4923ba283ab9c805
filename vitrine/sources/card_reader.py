"""UD2: what a site's cards say, read in one walk over a page.

A site is described by the selectors of its cards and, per field, the selectors to try and what to read of a hit. A page
becomes one small struct of texts per card, in time linear in its nodes; what the texts mean is left to Column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, functions as F

from vitrine.sources.templates import Matcher, Nodes

AROUND = re.compile("card|item|product", re.I | re.A)


@dataclass(frozen=True)
class Read:
    """One field: ``of`` the hits of the selectors below the root their text, their raw text, their text with blanks between the
    pieces, the place alone, or attributes, of which the first filled counts. Without a selector the root itself is read.

    ``pick``: the first hit of the one selector; the first hits of all selectors; or of those the first with a long text, else the last.
    ``root``: the card; the link, which is the card itself or the first hit of ``Site.link``; its parent; the card-like node around it.
    """

    selectors: tuple[str, ...] = ()
    of: str | tuple[str, ...] = "text"
    pick: str = "first"
    root: str = "card"


@dataclass(frozen=True)
class Site:
    """The first of the ``cards`` selectors with ``enough`` hits names the cards, else the last one."""

    cards: tuple[str, ...]
    fields: Mapping[str, Read]
    enough: int = 3
    link: str | None = None
    long: int = 10


class CardReader:
    def __init__(self, site: Site, most: int | None):
        self.site, self.most = site, most
        chosen = dict.fromkeys([*site.cards, *([site.link] if site.link else []), *[s for f in site.fields.values() for s in f.selectors]])
        self.number = {selector: k for k, selector in enumerate(chosen)}
        self.matcher = Matcher(list(chosen))
        self.fields = [(name, f, [self.number[s] for s in f.selectors]) for name, f in site.fields.items()]

    def __call__(self, page: str | None) -> list[dict]:
        nodes, found = self.matcher.read(page)
        hits = [found[self.number[s]] for s in self.site.cards]
        cards = next((h for h in hits if len(h) >= self.site.enough), hits[-1])
        # what no selector of a field finds on the page needs no look inside the cards
        fields = [(name, f, [found[k] for k in numbers if found[k]]) for name, f, numbers in self.fields]
        longest: dict[int, str] = {}
        return [self._card(nodes, found, fields, at, longest) for at in cards[:self.most]]

    def _root(self, nodes, found, card: int, name: str) -> int | None:
        if name == "card":
            return card
        if name == "link":
            return card if nodes.tags[card] == "a" else next(_firsts(nodes, [found[self.number[self.site.link]]], card), None)
        above = nodes.parents[card]
        while name == "around" and above >= 0 and not AROUND.search(nodes.attrs[above].get("class", "")):
            above = nodes.parents[above]
        return above if above >= 0 else None

    def _card(self, nodes, found, fields, card: int, longest: dict[int, str]) -> dict:
        out, roots = {}, {"card": card}
        for name, wanted, hits in fields:
            of, pick, root = wanted.of, wanted.pick, wanted.root
            if root not in roots:
                roots[root] = self._root(nodes, found, card, root)
            at = roots[root]
            if of == "beside":
                out[name] = self._beside(nodes, card, longest)
                continue
            if at is None:
                values = iter(())
            elif wanted.selectors:
                values = (_value(nodes, place, of) for place in _firsts(nodes, hits, at))
            else:
                values = iter((_value(nodes, at, of),))
            if pick == "all":
                out[name] = list(values)
            elif pick == "long":
                text = None
                for text in values:
                    if len(text) >= self.site.long:
                        break
                out[name] = text
            else:
                out[name] = next(values, None)
        return out

    @staticmethod
    def _beside(nodes, at: int, longest: dict[int, str]) -> str:
        """The longest text among a node and those beside it, its own before others of the same length."""
        own, above = _value(nodes, at, "text"), nodes.parents[at]
        if above < 0:
            return own
        if above not in longest:
            best, child = "", above + 1
            while child <= nodes.lasts[above]:
                text = _value(nodes, child, "text") if nodes.tags[child] else nodes.texts[child].strip()
                best, child = text if len(text) > len(best) else best, nodes.lasts[child] + 1
            longest[above] = best
        return longest[above] if len(longest[above]) > len(own) else own


def _firsts(nodes: Nodes, hits: list[list[int]], at: int) -> Iterator[int]:
    """The first place below a node out of each list of places that has one."""
    last = nodes.lasts[at]
    for places in hits:
        k = bisect_right(places, at)
        if k < len(places) and places[k] <= last:
            yield places[k]


def _value(nodes: Nodes, at: int, of: str | Sequence[str]) -> str | None:
    if of == "place":
        return ""
    if isinstance(of, tuple):
        attrs = nodes.attrs[at]
        return attrs.get(of[0]) if len(of) == 1 else next((v for v in map(attrs.get, of) if v), None)
    texts = filter(None, nodes.texts[at + 1:nodes.lasts[at] + 1])
    if of == "raw":
        return "".join(texts)
    return (" " if of == "spaced" else "").join(filter(None, map(str.strip, texts)))


def read_cards(site: Site, body: Column, most: int | None) -> Column:
    """The cards of a page, at most ``most`` (None: all), as structs of the site's fields."""
    many = {name for name, f in site.fields.items() if f.pick == "all"}
    kinds = pa.list_(pa.struct([(name, pa.list_(pa.string()) if name in many else pa.string()) for name in site.fields]))
    sql = ", ".join(f"`{name}`: " + ("array<string>" if name in many else "string") for name in site.fields)

    @F.arrow_udf(f"array<struct<{sql}>>")
    def read(pages: pa.Array) -> pa.Array:
        reader = CardReader(site, most)
        return pa.array([reader(page) for page in pages.to_pylist()], kinds)

    return read(body)
