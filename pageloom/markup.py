"""Page tables built from relational tables.

The given pages carry no classes or tables, so the operators that need them
are run on pages that Spark builds from the rows of other tables, one page for
each row.  What the operators should find is then known from the source columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def html(*parts: str | Column) -> Column:
    """Concatenation of literal markup and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pages_from(rows: DataFrame, key: str, page: Column) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("page_id"), page.alias("html"))


def content(*parts: str | Column) -> Column:
    return html('<div class="mw-parser-output">', *parts, "</div>")


class _Part:
    """Columns of ``part`` by short name."""

    columns = {"key": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"}

    def __getattr__(self, name: str) -> Column:
        return F.col(self.columns[name])


PART = _Part()


def shop_page() -> Column:
    heading = F.when(PART.type == "ECONOMY", "Consumables").when(PART.type == "SMALL", "Secret Shop").otherwise(PART.type)
    return content(
        "<h3>", heading, "[edit]</h3><div>", PART.name, " (", PART.size, ")<br>", PART.brand, " (x)<br>", PART.type, " (12 )</div><p>end</p>",
    )


def tier_page() -> Column:
    span = F.when(PART.size % 2 == 0, "2-3").otherwise("7-9")
    return content(
        "<h3>Tier 1</h3><div>too early</div><h2>Active Artifacts[edit]</h2><h3>Tier ", PART.size % 7, "</h3><div> ", PART.name,
        " <br>", PART.brand, "</div><h2>Active Enchantments</h2><h3>Tier ", span, "[edit]</h3><div>", PART.type,
        "</div><h2>Other</h2><h3>Tier 1</h3><div>skip</div>",
    )


def topic_page() -> Column:
    name, segment, nation = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")
    hud = F.when(nation % 2 == 0, "Head-up display (HUD)").otherwise("Plain")
    return content(
        "<h2>", segment, "[edit]</h2><table><tr><td><b>old</b></td></tr></table><table><tbody><tr><td><b>", name, "/Alt ",
        nation, "</b><ul><li>Sub ", nation, "</li></ul></td><td><b>no</b></td></tr><tr><td>no bold</td></tr><tr><td><b>", hud,
        "</b></td></tr></tbody></table>",
    )


def grid_page() -> Column:
    name, key, nation = F.col("s_name"), F.col("s_suppkey"), F.col("s_nationkey")
    return content(
        '<table class="mw-datatable"><thead><tr><th><a title="Supplier">Who</a></th><th>Nation</th><th>Code</th></tr></thead>'
        '<tbody><tr><td><a title="', name, '">x</a><a title="', name, '">y</a></td><td><abbr title="Nation ', nation, '">',
        nation, '</abbr></td><td rowspan="2">a1 code', key, '<span class="sortkey">zz</span></td></tr>'
        '<tr><td><img alt="Pic ', key, '"></td><td></td></tr><tr><td>plain</td><td colspan="2">wide ', nation, "</td></tr></tbody></table>",
        "<table><tr><td>k</td><td>val ", key, "</td></tr></table>",
    )


def skill_page() -> Column:
    name, key, nation = F.col("s_name"), F.col("s_suppkey"), F.col("s_nationkey")
    return content(
        '<div class="skilllist"><div class="skilllist-title">Skills ', nation, '</div><ul><li class="skilllist-lite"><a href="#"><img></a><a>',
        name, "</a> x <a>Call ", key, '</a></li><li class="skilllist-lite">Hero ', nation, " – Fire ", key,
        '</li><li class="skilllist-rich"><div class="skilllist-rich-head"><a>Tiny</a><a>Toss ', key,
        '</a></div><div class="skilllist-rich-desc">Throws <b>', nation, '</b></div></li></ul></div>'
        '<div class="skilllist"><ul><li class="skilllist-lite"><a>A', key, "</a><a>B</a></li></ul></div>",
    )


def infobox(*classes: str) -> list[str | Column]:
    return [
        f'<table class="{" ".join(classes)}"><tr><th><div><div style="text-align:center">', PART.name, " ", PART.key,
        '</div></div></th></tr><tr><td style="font-style: italic">A ', PART.type, ' thing.</td></tr><tr><td><table style="text-align:left">'
        '<tr><th colspan="2">Costs</th></tr><tr><th>Stock</th><td>', PART.size, "</td></tr><tr><th>Brand</th><td>", PART.brand,
        "</td></tr><tr><td>+", PART.size, '</td></tr><tr><th colspan="2">Stats</th></tr><tr><td>more ', PART.key,
        '</td></tr><tr><th colspan="2">Recipe</th></tr><tr><td><a title="Great ', PART.name, ' (900)">g</a></td></tr><tr><td><a title="',
        PART.name, " ", PART.key, '">s</a></td></tr><tr><td><a title="Hilt ', PART.size, '">h</a><a title="Recipe (650)">r</a></td></tr>'
        '<tr><th>Type</th><td><abbr title="Type ', PART.type, '">t</abbr><br><span title="Yes"><img></span></td></tr></table></td></tr></table>',
    ]


def card(name: str | Column | None = None, wrapper_id: str | Column | None = None, tabs: bool = True) -> list[str | Column]:
    name = PART.name if name is None else name
    out: list[str | Column] = ['<div class="spellcard-wrapper"', *([] if wrapper_id is None else [' id="', wrapper_id, '"'])]
    out += [
        '><div class="spellcard"><div style="border-bottom:1px solid"><span style="font-weight:bold">', name,
        '</span><img alt="', PART.brand, '"><img alt="', PART.brand, '"><div title="Default Hotkey"><span>Q', PART.size % 9, '</span></div></div>'
        '<div><div class="spelltad">Ability</div><div class="spelltad_value">', PART.type,
        '</div><div class="spelltad">Affects</div><div class="spelltad_value"><abbr title="Enemies ', PART.size, '">En</abbr></div></div>'
        '<div style="display:flex;font-size:12px"><div class="target_x"><img alt=""></div><div>Moves ', PART.size, ' far</div></div>'
        '<div class="spelltrait_value"><b>Radius:</b> ', PART.size, '</div><div class="spelltrait_value">radius : 400</div>'
        '<div class="spelltrait_value">Radius: 5', PART.size, '</div><div class="spellcost_icon"><a title="Cooldown Time">c</a></div>'
        '<div class="spellcost_value">', PART.size, '</div><div class="spellcost_icon"><a title="Mana">m</a></div><div class="spellcost_value">60</div>'
        '<div class="spellcost_icon"><a title="Health">m</a></div><div class="spelldesc"><div>one</div><div>note ', PART.key,
        '</div></div><div class="spelllore">Lore of ', PART.type, "</div></div>",
    ]
    if tabs:
        out += [
            '<div class="tabs-dynamic navigation-not-searchable"><ul class="nav nav-tabs"><li data-count="1">Details</li><li data-count="2">Show All</li>'
            '<li data-count="3">Misc</li></ul><div class="tabs-content"><div class="content1"><ul><li>', PART.brand, "<ul><li>deep ", PART.size,
            '</li></ul></li></ul></div><div class="content2"><div><tt>mod_', PART.size, '</tt><div>effect</div></div></div></div></div>',
        ]
    return [*out, "</div>"]


def item_page() -> Column:
    missing = F.when(PART.type == "PROMO", F.lit("")).otherwise("mw-parser-output")
    return html(
        '<div class="', missing, '"><div id="toc">contents</div>', *infobox("fo-nttax-infobox-wrapper", "fo-nttax-infobox"),
        *infobox("fo-nttax-infobox"), *card(wrapper_id="Card"), "<h2>About ", PART.name,
        '<span class="mw-editsection">[edit]</span></h2><p>Body ', PART.key, '</p><div class="navigation-not-searchable">ad</div></div>',
    )


def mechanics_page() -> Column:
    """Topic page of a supplier: boilerplate, heading, text, a table and a skill list."""
    return content(
        '<div class="toc">contents</div><h2>On ', F.col("s_name"), '<span class="mw-editsection">[edit]</span></h2>intro <b>',
        F.col("s_suppkey"), "</b><table><thead><tr><th>K</th></tr></thead><tbody><tr><td>val ", F.col("s_nationkey"),
        '</td></tr></tbody></table>mid<div class="skilllist"><ul><li class="skilllist-lite"><a>A</a><a>B', F.col("s_nationkey"),
        '</a></li></ul></div><div class="navbox">nav</div>',
    )


def entity_page() -> Column:
    """Entity page of a part; some parts lack a biography or carry bad values."""
    value = '<div style="color:#FFF; text-shadow:1px 1px 2px #000;">'
    mana = F.when(PART.size % 5 == 0, F.lit("n/a")).otherwise(F.concat(PART.size.cast("string"), F.lit("7 + 0.5")))
    radius = F.when(PART.size % 3 == 0, F.lit("bad")).otherwise(PART.size.cast("string"))
    bio = F.when(PART.type == "PROMO", F.lit("")).otherwise(html(
        '<h2>Bio[edit]</h2><div><span class="quote-source">The ', PART.name, ' </span></div><div><div style="display:table-row">x</div>'
        '<div style="display:table-row">Lore: Born in ', PART.brand, ".</div></div>"))
    return content(
        '<div style="float:right; border:1px; float:right;border:1px solid grey;"><div style="color:white; text-align:center; font-weight:bold; text-shadow:1px 1px 2px #000;">'
        '<div id="primaryAttribute"><a title="Strength "></a></div><div id="second"><a title="Agility"></a></div>',
        value, PART.size, " + 2.8</div>", value, "20 + ", PART.size, "</div></div>",
        '<table><tr><td><a title="Health"></a>6', PART.size, " + 2.5</td></tr><tr><td><a title=\"Mana\"></a>", mana,
        '</td></tr><tr><td>', PART.size, '<br><a title="Armor">Armor</a><br>x</td></tr><tr><td>25%<br><a title="Magic Resistance"></a>Magic Resist<br>y</td></tr>'
        "<tr><td>", PART.size, '-99<br><a title="Main Attack Damage"></a>Damage<br>(', PART.size, ' Avg)</td></tr><tr><td><a title="Projectile Speed">9', PART.size,
        '</a></td></tr><tr><td><a title="Melee"></a>150<br>Attack Range<br>5', PART.size, '</td></tr><tr><td><a title="Attack Speed"></a><b>', PART.size,
        '</b> 1.7</td></tr><tr><td>0.4<br>Animation<a title="Attack Animation"></a></td></tr><tr><td>310/315<br>Move Speed</td></tr>'
        '<tr><td><a title="m"></a>3', PART.size, '/315<br>Move Speed</td></tr><tr><td>0.', PART.size, '<br>Turn Rate<a title="Turn Rate"></a></td></tr>'
        '<tr><td>0.9<br>Turn Rate<a title="Turn Rate"></a></td></tr><tr><td><a title="Collision Size"></a>24<br>Collision Size</td></tr>'
        '<tr><td><a title="Bound Radius"></a>', radius, '<br>Bound Radius</td></tr><tr><td><a title="q"></a>18', PART.size, '/800<br>Vision Range</td></tr></table></div>'
        '<div class="table-responsive"><table><tr><td>Roles <a title="Role">', PART.type, '</a> <a title="Role">Durable</a><a title="x">no</a></td></tr>'
        "<tr><th>Complexity</th><td>a</td><td>b</td></tr><tr><th>Adjectives</th><td>", PART.brand, ", Mean Legs 2</td></tr><tr><td>First ", PART.key,
        '</td></tr><tr><td>Second line</td></tr><tr><td><a href="#a" title="', PART.name, '"><img></a><a href="#b" title="Helix"><img></a><a href="#a" title="', PART.name,
        '"><img></a></td></tr></table></div><div class="facetBox" id="f1"><span class="facetLink">One</span><div class="facetCell">old</div></div>'
        '<div class="facetBox" id="f2"><span class="facetLink">One</span><div class="facetCell">new ', PART.key, '</div></div>'
        '<div class="facetBox"><span class="facetLink">No id</span><div class="facetCell">skip</div></div>'
        "<h3>Aghanim's upgrades</h3><div><div class=\"aghupgTitle\">Scepter</div><div class=\"aghupgShadow\"><div class=\"aghupgDesc\">s ", PART.key,
        '</div></div><div class="aghupgTitle">Shard</div><div class="aghupgShadow"><div class="aghupgDesc">h1</div><div class="aghupgDesc">h ', PART.size,
        '</div></div></div><h2>Talents</h2><div><table class="wikitable"><tr><td>x</td><th>9</th><td>y</td></tr></table></div>'
        '<h3>Talents tree</h3><div><table class="wikitable"><tr><th colspan="3">All</th></tr><tr><td>L', PART.size, '</td><th>25</th><td>R', PART.key,
        '</td></tr><tr><td>a</td><th>5</th><td>b</td><td>c</td></tr></table></div>', bio, "<h2>Innate</h2><p>t</p>",
        *card(F.concat(F.lit("Inn "), PART.type), tabs=False), "<h2>Abilities</h2><h3>", F.upper(PART.name), " II</h3>", *card(),
        "<h3>Other</h3><p>z</p><h3>helix</h3>", *card("Helix", tabs=False),
    )


def choice_page() -> Column:
    """A page with several tables, the one to read told by class, head or place."""
    kind = PART.size % 4
    cls = F.when(kind == 0, "mw-datatable").when(kind == 1, "sortable").otherwise("plain")
    head = F.when(kind == 2, "<thead><tr><th>h</th></tr></thead>").otherwise("")
    return content(
        '<table><tr><td>first</td></tr></table><table class="', cls, '">', head, "<tbody><tr><td>second ", PART.key,
        "</td></tr></tbody></table><table><tr><td>third", F.repeat(F.lit("<table><tr><td>more</td></tr></table>"), (PART.size % 3).cast("int") - 1),
        F.when(PART.size % 3 > 0, html("<table><tr><td>inner ", PART.size, "</td></tr></table>")).otherwise(html("inner ", PART.size)), "</td></tr></table>",
        "<ul><li>a<ul>", F.repeat(F.lit("<li>b</li>"), (PART.size % 4 + 1).cast("int")), "</ul></li></ul>",
        F.repeat(F.lit("<ul><li>c</li></ul>"), (PART.key % 2).cast("int")),
    )


def ad_page() -> Column:
    """A page of a part with as many ads of each kind as its key and size say."""
    many = lambda n, text: F.repeat(F.lit(text), n.cast("int"))
    return content(
        "<p>", PART.name, "</p>", many(PART.size % 3, "<iframe></iframe>"), many(PART.key % 4, '<div class="x sponsored">ad</div>'),
        '<div id="top-ad">ad</div>', many(PART.size % 2, '<div class="ad-wrapper"><p class="adsense">no</p></div>'),
    )


def selector_page() -> Column:
    """A page of a part whose lists, cards and table rows are as many as its key and size say."""
    many = lambda n, *parts: F.repeat(html(*parts), n.cast("int"))
    return content(
        '<nav><ul class="menu big">', many(PART.size % 5, '<li class="it">i</li>'), '<li>last<ul><li class="it">deep</li></ul></li></ul></nav>',
        many(PART.key % 3, '<div class="card"><p><span title="Armor of ', PART.type, '">s</span></p></div>'),
        many(PART.size % 2, '<div class="card promo"><span title="Other">t</span></div>'),
        '<table id="t', PART.size % 3, '" class="wikitable">', many(PART.size % 4 + 1, '<tr><td colspan="2">x</td><td>y</td></tr>'),
        '</table><div style="float:right;border:1px solid grey;" lang="en-GB">', many(PART.key % 2 + 1, '<a href="#', PART.key, '" title="go">g</a>'),
        '</div><h2 class="table-top">On ', PART.name, "</h2>",
    )


def conform_page() -> Column:
    """Entity page of a part on which, by its size, the summary, its roles or the gains of attributes are missing."""
    page = entity_page()
    return (
        F.when(PART.size % 4 == 0, F.replace(page, F.lit("table-responsive"), F.lit("other")))
        .when(PART.size % 4 == 1, F.replace(page, F.lit("<tr><td>Roles "), F.lit("<tr><td>Parts ")))
        .when(PART.size % 4 == 2, F.replace(page, F.lit(" + 2.8</div>"), F.lit("</div>")))
        .otherwise(page)
    )


def pairing_page() -> Column:
    """Page of a supplier whose card has its tabs inside, beside, beside its parent, ahead of itself or not at all."""
    kind = F.col("s_suppkey") % 5
    tabs = html('<div class="tabs-dynamic"><div class="tabs-content"><ul><li>item ', F.col("s_nationkey"), "</li></ul></div></div>")
    at = lambda n, *parts: F.when(kind == n, html(*parts)).otherwise("")
    return content(
        '<section><div class="cell">', at(3, tabs), '<div class="spellcard-wrapper" id="Card ', F.col("s_suppkey"), '"><div class="spellcard"><b>x</b>',
        at(0, tabs), "</div></div>", at(1, "<p>between</p>", tabs), "</div>", at(2, "<div><i>", tabs, "</i></div>"), "</section>", at(4, tabs),
    )


def leading_page() -> Column:
    """Page of a supplier with some paragraphs ahead of a heading and some after."""
    return html("<main>", F.repeat(F.lit("<p>a</p>"), (F.col("s_suppkey") % 4).cast("int")), "<h2>h</h2>",
                F.repeat(F.lit("<p>b</p>"), (F.col("s_nationkey") % 3).cast("int")), "</main>")


def noisy_page() -> Column:
    """Hidden parts, ads and navigation blocks around the text of a part."""
    return content(
        '<div id="toc">t</div><div class="toc"><div class="navbox">n</div></div><p>keep ', PART.name, '</p><div class="navigation-not-searchable">drop</div>'
        '<div class="navigation-not-searchable tabs-dynamic">tabs ', PART.brand, '</div><div class="navigation-not-searchable"><div class="tabs-content">panel ', PART.size,
        '</div></div><span class="sortkey">k</span><span style="display:none">h</span><span style="display: none">shown ', PART.key,
        '</span><iframe></iframe><div class="sponsored">ad</div><div id="top-ad">ad</div><div class="sponsored"><iframe></iframe></div>',
    )


def rich_page() -> Column:
    """Page of a part with a numbered list, a table, a quote and preformatted text."""
    return html(
        "<p>Part ", PART.key, "</p><ol><li>", PART.name, "</li><li>", PART.brand, "<ul><li>deep</li></ul></li></ol><table><tr><th>Size</th><th>Type</th></tr><tr><td>",
        PART.size, "</td><td>", PART.type, "</td></tr></table><blockquote><p>said ", PART.size, "</p><p>again</p></blockquote><pre>  a  b\n   ", PART.size, "</pre><p>end</p>",
    )


def flawed_entity_page() -> Column:
    """Entity page of a part on which, by its size, a statistic cannot be split or the row of abilities is missing."""
    page = entity_page()
    return (
        F.when(PART.size % 4 == 0, F.replace(page, F.lit(" + 2.5</td>"), F.lit("</td>")))
        .when(PART.size % 4 == 1, F.replace(page, F.lit("150<br>Attack Range<br>"), F.lit("150<br>Reach<br>")))
        .when(PART.size % 4 == 2, F.regexp_replace(page, '<tr><td><a href="#a".*?</td></tr>', ""))
        .otherwise(page)
    )
