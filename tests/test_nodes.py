import random

from pyspark.sql import functions as F

from pageloom.operators import select as sel
from pageloom.operators.select import has_class, tag
from pageloom.operators.text import subtree_text, with_clean
from samples import content

MESSY = (
    '<html><head><script>var t="</p>";</script></head><body><p>one<b>bold<br><p>two &amp; three<!-- no --> four'
    "<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>x<td>y<tr><td>z</table></i>end"
)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_unclosed_tags(nodes_of):
    nodes = nodes_of(MESSY).where(~tag("#text", "#document"))
    counts = dict(rows(nodes.groupBy("tag").count(), "tag", "count"))
    assert counts["p"] == 2 and counts["li"] == 3 and counts["td"] == 3 and counts["tr"] == 2 and counts["tbody"] == 1
    text = subtree_text(nodes_of(MESSY), tag("p", "td", "li"), raw="raw")
    assert [r.raw for r in text.orderBy("start").collect()] == ["onebold", "two & three four", "a", "bc", "c", "x", "y", "z"]


def chain(page, r):
    """Starts of the elements around a node, by its parents."""
    return [] if r.parent is None else [*chain(page, page[r.parent]), r.parent]


def test_intervals_hold_for_every_node(nodes_of):
    got = nodes_of(MESSY, content("<i>x</i>"), None).collect()
    by_page = {}
    for r in got:
        by_page.setdefault(r.page_id, {})[r.start] = r
    for page in by_page.values():
        for r in page.values():
            path = chain(page, r)
            inside = [x.start for x in page.values() if r.start in chain(page, x)]
            assert r.end == max([r.start, *inside])
            assert r.depth == len(path) - 1
            assert r.parent is None or r.parent_tag == page[r.parent].tag


def test_bad_page_keeps_its_row(nodes_of):
    got = nodes_of(None).collect()
    assert len(got) == 1 and got[0].tag == "#document" and "no html" in got[0].attrs["error"]


def test_drop_is_idempotent_and_keeps_parents(nodes_of):
    nodes = nodes_of(content('<div class="ad">x<p class="ad">y</p></div><p>z<span class="ad">q</span></p>')).persist()
    once = sel.drop_subtrees(nodes, has_class("ad"))
    kept = {r.start: r for r in once.collect()}
    assert rows(sel.drop_subtrees(once, has_class("ad")), "start") == rows(once, "start")
    assert all(r.parent is None or r.parent in kept for r in kept.values())
    assert "".join(r.text or "" for _, r in sorted(kept.items())) == "z"


def test_hidden_needs_the_exact_style(nodes_of):
    page = content('<i style="display:none">a</i><i style="display: none">b</i><span class="sortkey">c</span><b class="sortkey">d</b>')
    text = subtree_text(sel.drop_hidden(nodes_of(page)), sel.content(), text="raw").first().text
    assert text == "bd"


def test_navigation_with_tabs_stays(nodes_of):
    page = content(
        '<div class="navigation-not-searchable">no</div><div class="navigation-not-searchable"><i class="show-all">yes</i></div>'
        '<div class="navigation-not-searchable tabs-dynamic">tabs</div><div class="toc">toc</div>')
    text = lambda keep: subtree_text(sel.drop_boilerplate(nodes_of(page), keep), sel.content(), text="raw").first().text
    assert text(True) == "yestabs" and text(False) == ""


def test_ads_are_counted_and_dropped(nodes_of):
    nodes = nodes_of(content('<iframe></iframe><div class="sponsored">a</div><div id="top-ad">b</div>c'))
    assert rows(sel.ad_counts(nodes), "kind", "n") == [("class sponsored", 1), ("id top-ad", 1), ("iframe", 1)]
    assert subtree_text(sel.drop_ads(nodes), sel.content(), text="raw").first().text == "c"


def test_nesting(nodes_of):
    nodes = nodes_of("<ul id=1><li><ul id=2><li>x</li></ul></li></ul><ul id=3></ul>").persist()
    assert rows(sel.innermost(nodes, tag("ul")), "id") == [("2",), ("3",)]
    assert rows(sel.outermost(nodes, tag("ul")), "id") == [("1",), ("3",)]
    pairs = sel.within(nodes, tag("ul"), tag("li"), "id")
    assert rows(pairs, "anc.id") == [("1",), ("1",), ("2",)]


def test_open_elements_match_brute_force(nodes_of):
    """Sweeps against the chains of parents, on random trees of two pages."""
    rng = random.Random(9)

    def tree(depth):
        return "".join(
            f'<{t}>{tree(depth - 1) if depth else "x"}</{t}>' for t in rng.choices(["div", "span", "b"], k=rng.randint(0, 4)))

    nodes = nodes_of(tree(6), "<div>" * 700 + tree(4) + "</div>" * 700, "").persist()
    pages = {}
    for r in nodes.collect():
        pages.setdefault(r.page_id, {})[r.start] = r
    around = {(p, r.start): [] for p, page in pages.items() for r in page.values()}
    for p, page in pages.items():
        for r in page.values():
            above = around[p, r.parent] + [r.parent] if r.parent is not None else []
            around[p, r.start] = above
    div = lambda p, starts: [s for s in starts if pages[p][s].tag == "div"]
    for r in sel.with_open(nodes, n=tag("div"), m=tag("b")).collect():
        mine = around[r.page_id, r.start]
        assert r.n == len(div(r.page_id, mine)) and r.m == sum(pages[r.page_id][s].tag == "b" for s in mine)
    for r in sel.nearest(nodes, tag("div"), "near", "tag").collect():
        mine = div(r.page_id, around[r.page_id, r.start])
        assert (r.near.start, r.near.end, r.near.tag) == (mine[-1], pages[r.page_id][mine[-1]].end, "div") if mine else r.near is None
    got = rows(sel.within(nodes, tag("div"), tag("b")), "page_id", "start", "anc.start", "anc.end")
    assert got == sorted((p, s, a, pages[p][a].end) for (p, s), up in around.items() if pages[p][s].tag == "b" for a in div(p, up))
    up = {(r.page_id, r.start): (r.one, r.three) for r in sel.ancestors(nodes, tag("b"), one=1, three=3).collect()}
    want = lambda p, up, k: (up[-k], pages[p][up[-k]].end) if len(up) >= k else None
    assert up == {(p, s): (want(p, a, 1), want(p, a, 3)) for (p, s), a in around.items() if pages[p][s].tag == "b"}


def test_inside_matches_brute_force(nodes_of):
    page = "<div>a<p>b</p><div>c<p>d</p></div></div><p>e</p><div>f</div>"
    got = sel.inside(nodes_of(page), tag("div"), "box").collect()
    for r in got:
        around = [x for x in got if x.tag == "div" and x.start <= r.start <= x.end]
        want = min(around, key=lambda x: x.start).start if around else None
        assert (r.box.start if r.box else None) == want


def test_first_inside_and_first_of_page(nodes_of):
    page = "<div><p>a</p><p>b</p></div><div>x<p>c</p></div><div>none</div>"
    nodes = sel.inside(nodes_of(page), tag("div"), "box")
    got = sel.first_inside(nodes, tag("p"), "first", "box").where("text is not null").orderBy("start").collect()
    assert [(r.text, r.first is not None) for r in got] == [("a", True), ("b", False), ("x", False), ("c", True), ("none", False)]
    page_first = sel.first_of_page(nodes_of(page), p=tag("p")).where("text is not null and p is not null").collect()
    assert [r.text for r in page_first] == ["a"]


def test_text_forms(nodes_of):
    page = '<div> a <b>b</b>c<br>d<p>e </p>f<abbr title="T"><i>t</i></abbr><img alt="pic"><span title="Yes">n</span></div>'
    nodes = with_clean(nodes_of(page), abbr=sel.has_attr("title"), span=sel.attr("title").isin("Yes", "No"))
    r = subtree_text(nodes, tag("div"), spaced="spaced", tight="tight", raw="raw", lines="lines", clean="spaced:clean").first()
    assert r.spaced == "a b c d e f t n" and r.tight == "abcdeftn" and r.raw == " a bcde ftn"
    assert r.lines == "a bc\nd\ne\nftn" and r.clean == "a b c · d e f T pic Yes"


def test_same_rows_on_shuffled_input(spark, nodes_of):
    from pageloom.sources.htmltree import html_nodes

    pages = spark.createDataFrame([(i, content(f"<h2>{i}</h2><p>x{i}</p>")) for i in range(20)], "page_id long, html string")
    text = lambda df: rows(subtree_text(html_nodes(df), sel.content(), text="raw"), "page_id", "text")
    assert text(pages) == text(pages.repartition(7, F.rand(1)))
