"""The fast reading of plain markup, and the number of tasks of a parse."""

from html.parser import HTMLParser

import pytest

from pageloom import bindings
from pageloom.sources import htmltree

COLUMNS = htmltree.NODE_SCHEMA.names[1:]
PAGES = [
    '<div class="a b" id="x" style="display:none">one &amp; two<br>three<br/><img alt="p" /></div>tail',
    "<ul><li>a<li>b</ul><p>c<p>d</p></table>e &lt f",
    '<a href="/x?a=1&amp;b=2">l</a><b>after</b>', "<p>a<!-- no -->b</p><script>if (a < b) '<p>'</script><i>c</i>",
    "<P Class=Up>x</P ><div a=1 b='2' c>y</div><td colspan=\"9999\">z", "a < b <3 <div>x</div", "", "no markup &amp", "<div", "<!DOCTYPE html><p>q</p>",
    '<textarea><b>t</b></textarea><p a="1" a="2">k</p><table><tr><td rowspan="2">v</td></tr></table>', '<b title="a<b">x</b>',
    '<iframe></iframe><title>t &amp; u</title><b x="">w</b>', "<h1 />z<br / >y</ p>", '<a  b="1"  c="2"   >t</a\n>',
]


class General(htmltree._Nodes):
    """The same nodes by the general parser alone."""

    feed = HTMLParser.feed


@pytest.mark.parametrize("page", PAGES)
def test_plain_markup_gives_the_nodes_of_the_general_parser(page):
    fast, slow = htmltree._Nodes(), General()
    for tree in (fast, slow):
        tree.feed(page)
        tree.finish()
    for name in COLUMNS:
        at = [list(v) if name in ("classes", "attrs") else v for v in getattr(fast, name)]
        assert at == [list(v) if name in ("classes", "attrs") else v for v in getattr(slow, name)], name


def test_plain_pages_do_not_reach_the_general_parser(monkeypatch):
    rest = []
    monkeypatch.setattr(HTMLParser, "feed", lambda self, data: rest.append(data))
    htmltree._parse('<div class="a"><p title="b">x &amp; y</p><br></div>')
    assert rest == [""]


def test_a_task_gets_a_bounded_number_of_pages(spark, tmp_path, monkeypatch):
    spark.range(50).selectExpr("id p_partkey", "'n' p_name", "'b' p_brand", "'t' p_type", "int(id) p_size").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(bindings, "PAGES_PER_TASK", 5)
    nodes = bindings.part_nodes(spark, str(tmp_path), bindings.markup.noisy_page())
    assert nodes.rdd.getNumPartitions() == 10
    assert nodes.select("page_id").distinct().count() == 50
