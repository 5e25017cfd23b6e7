from pyspark.sql import functions as F

from pageloom.plans import cards, catalog, documents, infobox, tables
from samples import CARD, CATALOGUE, GRID, INFOBOX, SKILLS, TABS, content


def test_catalogues(nodes_of):
    nodes = nodes_of(CATALOGUE).persist()
    assert [r.name for r in catalog.shop_catalog(nodes).orderBy("pos").collect()] == ["Clarity", "Blink Dagger"]
    assert [(r.category, r.tier, r.name) for r in catalog.tier_catalog(nodes).orderBy("pos").collect()] == [
        ("neutral_items", "tier 1", "Alpha"), ("neutral_items", "tier 1", "Beta")]
    topics = catalog.topic_catalog(nodes)
    assert [(r.title, r.parent_title) for r in topics.orderBy("pos").collect()] == [
        ("Aa", None), ("sub", "Aa"), ("Bb", None), ("sub", "Bb"), ("HUD", None)]
    last = {r.title: r.parent_title for r in catalog.titles_to_fetch(topics).collect()}
    assert last["sub"] == "Bb" and len(last) == 4


def test_infobox(nodes_of):
    props = infobox.infobox_props(nodes_of(INFOBOX + '<table class="fo-nttax-infobox"><tr><td>x</td></tr></table>')).persist()
    got = [(r.kind, r.label, r.value) for r in props.orderBy("block", "pos").collect()]
    assert got == [
        ("head", "Sword", "Sharp."), ("section", "Costs", ""), ("row", "Stock", "60 seconds"), ("row", "Bonus", "+5 · +7"),
        ("row", "Builds From", "Hilt + Recipe"), ("row", "Upgrades Into", "Great Sword"), ("none", None, None)]
    markdown = [r.markdown for r in infobox.props_markdown(props).orderBy("start").collect()]
    assert markdown[0].startswith("### Sword\n\n> Sharp.\n\n| Property | Value |\n|---|---|\n| *Costs* | |\n")
    assert markdown[1] == ""


def test_infobox_without_details(nodes_of):
    box = '<table class="fo-nttax-infobox-wrapper fo-nttax-infobox"><tr><th><div><div style="text-align:center"><abbr title="Long">L</abbr></div></div></th></tr></table>'
    got = infobox.props_markdown(infobox.infobox_props(nodes_of(box))).first().markdown
    assert got == "### L\n\n"


def test_cards(nodes_of):
    nodes = nodes_of(content(CARD + TABS + "</div>"), content(CARD + "</div>", TABS)).persist()
    inner, outer = (r.card for r in cards.spellcards(nodes).orderBy("page_id").collect())
    assert inner.name == "Blink" and inner.hotkeys[0].key == "Q" and inner.description == "Teleports far"
    assert inner.metadata == {"Ability": "Point Target", "Affects": "En"}
    assert inner.traits == {"Radius": "500", "radius": "400"}
    assert inner.costs == {"Cooldown Time": "15", "Mana": "60"} and inner.lore == "Old lore"
    assert inner.tabs == {"Details": "a\nb\ntail"} and outer.tabs is None
    props = cards.card_props(nodes).persist()
    first = props.orderBy("page_id").first()
    assert first.title == "Id" and first.badges == ["Melee"] and first.notes == ["two pic"]
    assert [tuple(r) for r in first.rows] == [
        ("Ability", "Point Target"), ("Affects", "Enemies"), ("Radius", "300"), ("Cooldown", "15"), ("Mana Cost", "60")]
    both = [r.markdown for r in cards.card_markdown(props, cards.tab_blocks(nodes)).orderBy("page_id").collect()]
    assert both[0] == both[1]
    assert both[0].endswith("**Show All**\n\n- a tail\n  - b\n\n**Status Effects**\n\n- `mod_x` — effect")


def test_card_without_optional_parts(nodes_of):
    nodes = nodes_of(content('<div class="spellcard-wrapper"><div class="spellcard"></div></div><div class="spellcard-wrapper">no card</div>'))
    got = cards.spellcards(nodes).collect()
    assert len(got) == 1 and all(v is None for v in got[0].card)
    assert cards.card_markdown(cards.card_props(nodes)).first().markdown == ""


def test_grid(nodes_of):
    got = tables.table_markdown(tables.table_cells(nodes_of(GRID))).first().markdown
    assert got == (
        "\n\n| Hero Hero Name | Val | W |\n|---|---|---|\n| Axe | Twelve | foo |\n| Pic | - | tall |\n| Link | q r | tall |\n"
        "| plain | wide | wide |\n\n")


def test_grid_spans_match_brute_force(nodes_of):
    html = ('<table><tr><td>a</td><td rowspan=3 colspan=2>b</td><td>c</td></tr><tr><td rowspan=2>d</td><td>e</td></tr>'
            "<tr><td>f</td></tr><tr><td>g</td><td>h</td><td>i</td><td>j</td></tr></table>")
    cells = {(r.row, r.col): r.text for r in tables.table_cells(nodes_of(html)).collect()}
    want = ["abbc", "dbbe", "dbbf", "ghij"]
    assert cells == {(i, j): c for i, row in enumerate(want) for j, c in enumerate(row)}


def test_table_choice(nodes_of):
    pages = ["<table id=a></table><table id=b class=sortable></table>", "<table id=a></table><table id=b><thead></thead></table>",
             "<table id=a></table><table id=b></table>", "<table id=a class=sortable></table><table id=b class=mw-datatable></table>"]
    nodes = nodes_of(*pages).persist()
    picked = tables.choose_table(nodes).join(nodes.select("page_id", "start", "id"), ["page_id", "start"])
    assert {r.id for r in picked.collect()} == {"b"} and picked.count() == 4


def test_skills(nodes_of):
    rows = tables.skill_rows(nodes_of(SKILLS)).persist()
    got = [tuple(r) for r in rows.orderBy("block", "pos").select("title", "source", "ability", "details").collect()]
    assert got == [("Skills", "Axe", "Call", ""), ("Skills", "Lina", "Fire", ""), ("Skills", "Tiny", "Toss", "Throws far"), (None, "A", "B", "")]
    markdown = [r.markdown for r in tables.skill_markdown(rows).orderBy("start").collect()]
    assert "| Source | Ability | Details |" in markdown[0] and "Details" not in markdown[1]


def test_documents(nodes_of):
    page = content('<h2>One<span class="mw-editsection">[edit]</span></h2>intro <b>x</b>', GRID, "mid", SKILLS, "end")
    body = documents.topic_body(nodes_of(page, "<p>no content</p>", None)).persist()
    got = {r.page_id: r for r in documents.topic_markdown(body).collect()}
    assert got[0].markdown.startswith("\n\n## One\n\nintro x\n\n| Hero") and got[0].markdown.endswith("| A | B |\n\nend")
    assert got[1].markdown is None and got[1].error == documents.NO_CONTENT and "no html" in got[2].error
    body = documents.item_body(nodes_of(content(INFOBOX, CARD + "</div>", "<h3>T</h3>tail"))).persist()
    text = documents.item_markdown(body).first().markdown
    assert text.index("### Sword") < text.index("#### Id") < text.index("\n\n### T\n\ntail")


def test_html_to_markdown(nodes_of):
    page = '<div><h1>T</h1><p>some <b>bold</b> <a href="/x">link</a><br>x</p><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><img alt=p src=s></div>'
    nodes = nodes_of(page)
    assert documents.html_to_markdown(nodes).first().markdown == "# T\n\nsome **bold** link  \nx\n\n- a\n  - b\n- c"
    full = documents.html_to_markdown(nodes, strip_tags=()).first().markdown
    assert "[link](/x)" in full and full.endswith("![p](s)")
