"""Selectors against plain matching by the chains of parents."""

import random

import pytest
from pageloom.operators import selector as sel


def model(rows, chain):
    """Starts of the rows that a parsed chain picks, by walking up from each."""
    by = {r.start: r for r in rows}

    def passes(r, tests):
        for kind, *rest in tests:
            value = rest[0] if rest else None
            attrs = r.attrs or {}
            if r.tag.startswith("#"):
                return False
            if kind == "not":
                ok = not passes(r, rest)
            elif kind == "tag":
                ok = value == "*" or r.tag == value
            elif kind == "cls":
                ok = value in (r.classes or [])
            elif kind == "id":
                ok = r.id == value
            else:
                name, op, want = rest
                have = attrs.get(name)
                ok = have is not None and {
                    "": lambda: True, "=": lambda: have == want, "^=": lambda: want != "" and have.startswith(want),
                    "$=": lambda: want != "" and have.endswith(want), "*=": lambda: want != "" and want in have,
                    "~=": lambda: want in have.split(), "|=": lambda: have == want or have.startswith(want + "-")}[op]()
            if not ok:
                return False
        return True

    def picked(r, k):
        if not passes(r, chain[k].tests):
            return False
        if k == 0:
            return True
        up = by.get(r.parent)
        while up is not None:
            if picked(up, k - 1):
                return True
            up = by.get(up.parent) if chain[k].link == "inside" else None
        return False

    return {r.start for r in rows if picked(r, len(chain) - 1)}


SELECTORS = [
    "div", "*", ".a", "#x", "div.a", "div .a", "div > .a", "div div > b", "div > div b.a", "b, i.a", "[title]", "[title=t1]", "[title^='t']", '[title$="1"]',
    "[title*='x']", "[title~=two]", "[lang|='en']", "div:not(.a)", "div:not(#x) > b:not([title])", "div.a.b", "i > *", "[title^='']", "b b b", "div>b,i >b",
]


def test_selectors_match_a_plain_model(nodes_of):
    rng = random.Random(6)

    def tree(depth):
        out = []
        for _ in range(rng.randint(0, 3)):
            attrs = rng.choice(["", " class=a", ' class="a b"', " id=x", " title=t1", ' title="one two"', ' lang=en-GB title="x"', ' lang="en" class=b'])
            t = rng.choice(["div", "b", "i"])
            out.append(f"<{t}{attrs}>{tree(depth - 1) if depth else 'text'}</{t}>")
        return "".join(out)

    pages = [tree(5) for _ in range(6)]
    nodes = nodes_of(*pages).persist()
    by_page = {}
    for r in nodes.collect():
        by_page.setdefault(r.page_id, []).append(r)
    for text in SELECTORS:
        want = {(p, s) for p, rows in by_page.items() for chain in sel.parse(text) for s in model(rows, chain)}
        got = [(r.page_id, r.start) for r in sel.select(nodes, text).collect()]
        assert sorted(got) == sorted(want), text


@pytest.mark.parametrize("text", ["", "div >", "> div", "div,,b", "div:hover", "[title", "a..b", "div + b", ":not(div b)", ".adiv#"])
def test_what_is_not_understood_is_an_error(text):
    with pytest.raises(ValueError):
        sel.parse(text)
