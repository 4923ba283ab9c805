import random

import pytest

from vitrine.functions.html import _flatten
from vitrine.sources import templates
from vitrine.sources.templates import Matcher, Template, parse

PAGE = """<html><body><div class="list a"><div class="card x" id="one"><h2> Mouse <b>gamer</b></h2><a href="/p/1?ref=2">x</a><span class="old price">R$ 20,00</span>
<span class="price">R$ 10,50</span><i data-off="-47%">sale</i></div><div class="card"><h2></h2><h3>Teclado</h3><a href="https://other/p/2">y</a><span class="price">consulte</span>
<p class="money"><b>R$ 7</b></p></div></div><div class="card">fora</div></body></html>"""


def brute(nodes, selector):
    """Every chain against every node, by walking up."""
    def up(at, chain):
        if not chain:
            return True
        (_, test), before = chain[-1], chain[:-1]
        if not nodes[at]["tag"] or not test(nodes[at]):
            return False
        if not before:
            return True
        parent = nodes[at]["parent"]
        if chain[-1][0] == ">":
            return parent >= 0 and up(parent, before)
        while parent >= 0:
            if up(parent, before):
                return True
            parent = nodes[parent]["parent"]
        return False
    return [n["pos"] for n in nodes if any(up(n["pos"], c) for c in parse(selector))]


def test_one_walk_equals_every_chain_by_itself():
    chance = random.Random(4)
    names = ["div", "span", "a", "p"]
    def tree(depth):
        attrs = "".join(f' {k}="{chance.choice(v)}"' for k, v in (("class", ["a", "b", "a b", "c"]), ("id", ["x", "y"]), ("href", ["/p/1", "q"])) if chance.random() < 0.5)
        inner = "".join(tree(depth - 1) for _ in range(chance.randint(0, 3))) if depth else "t"
        tag = chance.choice(names)
        return f"<{tag}{attrs}>{inner}</{tag}>"
    selectors = ["div", ".a", "div.a", ".a .b", "div > span", ".a > .b a", "#x p", "[href]", "a[href^='/p'], p.c", "div div div", "* > #y", ".b [href*=q]", "span[class$='b'] > a"]
    for _ in range(30):
        nodes = _flatten("".join(tree(5) for _ in range(3)))
        assert Matcher(selectors).walk(nodes) == [brute(nodes, s) for s in selectors]


@pytest.mark.parametrize("bad", ["", "div >", "a..b", "a:hover", "div[", ">"])
def test_unreadable_selectors(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_fields_by_rank():
    rows = [("card", 1, ".nothing", None, None), ("card", 2, ".list > .card", None, None), ("title", 1, "h2", None, None), ("title", 2, "h3", None, None),
            ("link", 1, "a[href]", "href", "absolute:https://shop/"), ("price", 1, "span.price:", None, None)]
    with pytest.raises(ValueError):
        Template(rows)
    rows[-1] = ("price", 1, "span.price", None, None)
    got = Template([*rows, ("price", 2, ".money b", None, None), ("discount_pct", 1, "[data-off]", "data-off", None)])(PAGE)
    assert got == [{"title": "Mouse gamer", "link": "https://shop/p/1?ref=2", "price": "R$ 20,00", "discount_pct": "-47%"},
                   {"title": "Teclado", "link": "https://other/p/2", "price": "R$ 7"}]
    assert Template(rows)(None) == [] and Template(rows)("") == []


def test_deep_pages_take_linear_time():
    import time
    template = Template([("card", 1, "div .c", None, None), ("title", 1, "div div b", None, None)])
    def took(n):
        page = "<div>" * 50 + "<div class='c'><b>t</b></div>" * n + "</div>" * 50
        start = time.process_time()
        assert len(template(page)) == n
        return time.process_time() - start
    took(200)
    assert took(16_000) < 16 * max(took(2_000), 0.02)


def test_offers_of_a_new_site(spark, page):
    rows = [("nova", "card", 1, ".list .card", None, None), ("nova", "title", 1, "h2", None, None), ("nova", "title", 2, "h3", None, None),
            ("nova", "link", 1, "a", "href", "strip_query"), ("nova", "price", 1, "span.price", None, None), ("nova", "price", 2, ".money", None, None)]
    table = spark.createDataFrame(rows, templates.TEMPLATES)
    pages = page(PAGE, store="nova").unionByName(page(PAGE, store="unknown")).unionByName(page(None, store="nova"))
    got = templates.template_cards(pages, table).collect()
    assert [(r["store"], r["title"], r["link"], float(r["price"])) for r in sorted(got, key=lambda r: r["pos"])] == [
        ("nova", "Mouse gamer", "/p/1", 20.0), ("nova", "Teclado", "https://other/p/2", 7.0)]


def test_a_plain_page_is_read_in_one_pass_without_the_parser(monkeypatch):
    from vitrine.functions import html
    page = "<section>" + "".join(f"<div class='c'><b>Item {i}</b><a HREF='/p/{i}?a=1&amp;b=2'>x</a></div>\n" for i in range(50)) + "</section>"
    template = Template([("card", 1, "section > .c", None, None), ("title", 1, "b", None, None), ("link", 1, "a[href^='/p/']", "href", None)])
    monkeypatch.setattr(html._Flattener, "feed", lambda *_: pytest.fail("the parser was asked"))
    assert template(page) == [{"title": f"Item {i}", "link": f"/p/{i}?a=1&b=2"} for i in range(50)]


def test_one_pass_gives_the_nodes_and_hits_of_the_parser():
    from vitrine.functions.html import _Flattener
    chance, matcher = random.Random(9), Matcher(["div", ".a", "div > b", "a[href*='/p']", "#x span", "[hidden]", "div .a > a"])
    names = ["div", "a", "b", "span", "br", "template"]
    attrs = ['class="a"', "class='b a'", 'href="/p/1?x=1&amp;y=2"', "href='q'", "id='x'", 'hidden', "title='a>b'", 'alt="<"', "z=''"]
    texts = ["t", " ", "\n", "a &amp; b", "&eacute", "<!-- c -->", "</a>", "é", "\"'"]
    odd = ["a < b", "<!doctype html>", "<p x=1>", "<script>1<2</script>", "<!-- it's -- -->"]

    def tree(depth, texts):
        if not depth or chance.random() < 0.2:
            return chance.choice(texts)
        tag, own = chance.choice(names), " ".join(chance.sample(attrs, chance.randint(0, 3)))
        inner = "".join(tree(depth - 1, texts) for _ in range(chance.randint(0, 4)))
        return f"<{tag} {own}{'/' * (chance.random() < 0.1)}>{inner}" + f"</{tag}>" * (chance.random() < 0.9)

    for i in range(600):
        page = "".join(tree(4, texts + odd * (i % 2)) for _ in range(3))
        parser = _Flattener()
        parser.feed(page)
        nodes = parser.finish()
        got, found = matcher.read(page)
        assert [list(row) for row in zip(*got)] == [[n[k] for k in ("tag", "text", "attrs", "parent", "last")] for n in nodes], page
        assert found == [brute(nodes, s) for s in ("div", ".a", "div > b", "a[href*='/p']", "#x span", "[hidden]", "div .a > a")]
        assert i % 2 or matcher._read_plain(page) is not None
