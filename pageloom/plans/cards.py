"""Ability cards: nested records, property rows and Markdown."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import (
    after_label, clean_cell, cost_label, dash, label_of, non_empty, strip, value_of,
)
from pageloom.operators.match import last_of_keys, let
from pageloom.operators.order import pair_next, paired
from pageloom.operators.select import COLUMNS, blocks_of, flag_bits, has_attr, inside, nearest, page_rows, swept_blocks, tag, with_open
from pageloom.operators.text import block_pieces, block_text, with_clean
from pageloom.schema import SPELLCARD

# The sweeps travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOTKEYS = ("Default Hotkey", "Legacy Keys")
PARTS = (
    "spelltad", "spelltad_value", "spelltrait_value", "spelldesc", "spelllore",
    "spellcost_icon", "spellcost_value",
)
MARKUP = ("div", "span", "b", "strong", "a", "img", "tt", "li")


# ---- Helpers over ``els``, the ordered array of a card's elements -----------

def _below(els: Column, e: Column) -> Column:
    return F.filter(els, lambda x: (x["start"] > e["start"]) & (x["start"] <= e["end"]))


def _pick(els: Column, test) -> Column:
    return F.filter(els, lambda e: F.coalesce(test(e), F.lit(False)))


def _first(els: Column, test) -> Column:
    return F.get(_pick(els, test), F.lit(0))


def _is(e: Column, cls: str) -> Column:
    return F.array_contains(e["classes"], cls)


def _styled(e: Column, *parts: str) -> Column:
    found = e["style"].contains(parts[0])
    for part in parts[1:]:
        found = found & e["style"].contains(part)
    return found


def _last_map(pairs: Column) -> Column:
    """Map of an array of (k, v) in which the last value of a key stays; null when empty."""
    return last_of_keys(pairs, "k", "v")


def _pair(k: Column, v: Column) -> Column:
    return F.struct(k.alias("k"), v.alias("v"))


def _list(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


FLAGS = ("wrap", "card", "hidden", "shown", "meant", "text", "target", "element")


def _stand_ins(e) -> tuple[Column, Column]:
    """What a node shows in place of its text, as ``with_clean`` has it: the title of a span counts always, that of an abbreviation where it is meant."""
    attr = lambda name: e["attrs"].getItem(name)
    title = non_empty(strip(attr("title")))
    plain = F.when(e["tag"] == "br", F.lit(" · ")).when(e["tag"] == "img", attr("alt")).when(e["tag"] == "span", title)
    return plain, F.when(e["tag"] == "abbr", title)


def _card_flags(e, wrap: Column) -> dict[str, Column]:
    plain, meant = _stand_ins(e)
    hidden = _styled(e, "display:none") | _styled(e, "visibility:hidden") | ((e["tag"] == "span") & _is(e, "sortkey"))
    target = e["tag"].isin(*MARKUP) | ((F.size(e["classes"]) > 0) & F.arrays_overlap(
        e["classes"], F.array(*map(F.lit, (*PARTS, "tabs-dynamic", "tabs-content", "nav-tabs")))))
    return dict(zip(FLAGS, (
        wrap, _is(e, "spellcard"), hidden, plain.isNotNull(), meant.isNotNull(), e["text"].isNotNull() | e["tag"].isin("br", "td", "th"),
        target, e["tag"] != "#text")))


def card_row(e) -> list[Column]:
    """A node as ``_elements`` reads it: its place and what tests ask for."""
    attr = lambda name: e["attrs"].getItem(name)
    plain, meant = _stand_ins(e)
    return [
        *[e[n].alias(n) for n in ("start", "end", "depth", "parent", "tag", "id", "classes", "style", "text", "brk")],
        attr("title").alias("title"), attr("alt").alias("alt"), attr("class").alias("cls"), attr("data-count").alias("count"),
        plain.alias("plain"), meant.alias("meant"),
    ]


def _card_places(p):
    wrap = p.outermost(p["wrap"])
    inner = wrap >= 0
    card = p.first_inside(p["card"] & p.below(wrap), wrap)
    hidden, own = p["hidden"] & inner, wrap == p.row
    parent, grand = (p.above(own, steps, p["element"]) for steps in (1, 2))
    return {
        "_size": p.size_of(wrap), "parent": p.start_of(parent), "parent_end": p.end_of(parent),
        "grand": p.start_of(grand), "grand_end": p.end_of(grand), "of_card": card >= 0, "in_card": p.below(card), "target": p["target"],
        "text": p["text"], "no_seen": p.covered(hidden, inner & p["shown"]), "no_meant": p.covered(hidden, inner & (p["shown"] | p["meant"])),
    }


def card_places(p, wraps):
    """What ``CARD_KIND`` names, by the tests of ``_card_flags`` on whole columns; ``wraps`` are what a card lies in.  A wrapper without
    a target inside its card is none.
    """
    shown, target = p.tag("br") | p.stands("img", "span"), p.tag(*MARKUP) | p.has_class(*PARTS, "tabs-dynamic", "tabs-content", "nav-tabs")
    flags = {"wrap": wraps, "card": p.has_class("spellcard"), "hidden": p.hidden(), "shown": shown, "meant": p.stands("abbr"),
             "text": p.tag("#text", "br", "td", "th"), "target": target, "element": ~p.tag("#text")}
    p.flags.update(flags)
    found = _card_places(p)
    wrap = p.outermost(wraps)
    filled = np.zeros(len(wrap), bool)
    filled[wrap[target & found["of_card"]]] = True
    return found | {"_size": np.where(filled, found["_size"], -1)}


def _wrapper(e) -> Column:
    return _sure(_is(e, "spellcard-wrapper"))


CARD_KIND = (
    "_size int, parent int, parent_end int, grand int, grand_end int, "
    "of_card boolean, in_card boolean, target boolean, text boolean, no_seen boolean, no_meant boolean")


def _card_block(*forms: str):
    """``use`` of a card: see ``_elements``; null for a wrapper without a card."""
    kept = ("start", "end", "parent", "tag", "classes", "style", "title", "alt", "cls", "count")

    def block(own: Column, rows: Column) -> Column:
        r, f, first = own["r"], own["f"], own["r"]["start"]
        seen = lambda x: F.when(~x["f"]["no_seen"], F.coalesce(x["r"]["plain"], x["r"]["text"]))
        meant = lambda x: F.when(~x["f"]["no_meant"], F.coalesce(x["r"]["plain"], x["r"]["meant"], x["r"]["text"]))
        run = lambda x: F.struct(
            x["r"]["start"].alias("at"), x["r"]["tag"].alias("tag"), x["r"]["brk"].alias("brk"), x["r"]["text"].alias("lines"),
            seen(x).alias("seen"), meant(x).alias("meant"))
        runs = F.transform(F.filter(rows, lambda x: x["f"]["text"] | seen(x).isNotNull() | meant(x).isNotNull()), run)
        el = lambda x: F.struct(*[x["r"][n].alias(n) for n in kept])
        around = lambda n: F.when(f[n].isNotNull(), F.struct(f[n].alias("start"), f[f"{n}_end"].alias("end"))).alias(n)
        piece = lambda runs, form: block_pieces(runs, "lines" if form == "lines" else "spaced", form, first).alias(f"_{form}")
        # A card without a target inside it is none.
        return F.when(F.exists(rows, lambda x: x["f"]["target"] & x["f"]["of_card"]), let(runs, lambda runs: F.struct(
            first.alias("start"), r["end"].alias("end"), r["id"].alias("wrap_id"), around("parent"), around("grand"),
            F.transform(F.filter(rows, lambda x: x["f"]["target"] & x["f"]["in_card"]), el).alias("els"),
            *([F.transform(F.filter(rows, lambda x: x["f"]["target"]), el).alias("all")] if "lines" in forms else []),
            *[piece(runs, form) for form in forms],
        )))

    return block


record_block = _card_block("lines")


def _elements(nodes: DataFrame, wrap: Column | None, *forms: str) -> DataFrame:
    """Elements of every card in order.

    Result: page_id, start, end, wrap_id, parent, grand (intervals of the elements around), els, all, and the pieces of
    ``forms`` (lines, seen, meant) for ``_text``; ``els`` are the elements inside the first card of the wrapper, ``all`` (with lines) those
    of the whole wrapper.  A wrapper without a card is left out.  The page is swept once and its rows stay in their array, so
    nodes are dealt once at most; texts are put together for those elements alone that a plan picks.
    """
    if wrap is not None and "nodes" not in nodes.columns:
        nodes = nodes.withColumn("_wrap", wrap)
    flags = lambda e: _card_flags(e, _wrapper(e) if wrap is None else _sure(e["_wrap"]))
    pages = page_rows(nodes, lambda e: F.struct(*card_row(e), flag_bits(**flags(e)).alias("_bits")))
    use = _card_block(*forms)
    cards = swept_blocks(pages, list(FLAGS), _card_places, CARD_KIND, lambda own, rows: F.struct(use(own, rows).alias("_card")))
    return cards.where(F.col("_card").isNotNull()).select("page_id", "_card.*")


def _text(e: Column, form: str, card=COLUMNS) -> Column:
    """Text below an element of ``_elements``: ``lines`` as shown, ``seen`` and ``meant`` as a cell; null for no element."""
    if form == "lines":
        return F.when(e.isNotNull(), block_text(card["_lines"], "lines", e, card["start"]))
    return F.when(e.isNotNull(), clean_cell(block_text(card[f"_{form}"], "spaced", e, card["start"])))


# ---- The record form --------------------------------------------------------

def spellcards(nodes: DataFrame, wrap: Column | None = None) -> DataFrame:
    """One card record per wrapper: page_id, start, end, card.

    Groups without an entry are null; a key that comes up again keeps its last
    value; the tabs stop before the one that shows all.
    """
    return _elements(nodes, wrap, "lines").select("page_id", "start", "end", card_record(COLUMNS).alias("card"))


def card_record(card) -> Column:
    """The record of a card of ``_elements``."""
    lines = lambda e: _text(e, "lines", card)
    els, every = card["els"], card["all"]

    bars = _pick(els, lambda e: (e["tag"] == "div") & _styled(e, "border-bottom"))
    name = let(let(bars, lambda bars: _first(els, lambda s: (s["tag"] == "span") & _styled(s, "font-weight:bold")
                                             & F.exists(bars, lambda b: b["start"] == s["parent"]))), lines)
    hotkeys = F.transform(
        _pick(els, lambda e: (e["tag"] == "div") & e["title"].isin(*HOTKEYS)),
        lambda h: F.struct(h["title"].alias("type"),
                           let(_first(_below(els, h), lambda s: s["tag"] == "span"), lines).alias("key")),
    )
    metadata = _last_map(F.transform(
        _pick(els, lambda e: _is(e, "spelltad")),
        lambda t: _pair(lines(t), let(_first(els, lambda v: (v["parent"] == t["parent"]) & (v["start"] > t["start"])
                                             & (v["cls"] == "spelltad_value")), lines)),
    ))
    flex = _pick(els, lambda e: (e["tag"] == "div") & _styled(e, "display:flex")
                 & F.exists(_below(els, e), lambda x: x["tag"] == "img"))
    description = let(F.get(F.filter(
        F.transform(flex, lambda f: F.try_element_at(
            _pick(els, lambda d: (d["tag"] == "div") & (d["parent"] == f["start"])), F.lit(-1))),
        lambda d: d.isNotNull(),
    ), F.lit(0)), lines)
    traits = _last_map(F.transform(
        _pick(els, lambda e: _is(e, "spelltrait_value")),
        lambda t: let(lines(t), lambda x: _pair(label_of(x), value_of(x))),
    ))
    extras = F.flatten(F.transform(
        _pick(els, lambda e: _is(e, "spelldesc")),
        lambda b: let(_pick(_below(els, b), lambda d: d["tag"] == "div"), lambda divs: F.when(
            F.size(divs) >= 2, F.filter(F.transform(divs, lines), lambda d: d != ""),
        ).otherwise(F.array().cast("array<string>"))),
    ))
    icons = _pick(els, lambda e: _is(e, "spellcost_icon"))
    amounts = _pick(els, lambda e: _is(e, "spellcost_value"))
    linked = let(amounts, lambda amounts: F.transform(icons, lambda i, n: F.struct(
        _first(_below(els, i), lambda a: a["tag"] == "a").alias("a"), F.get(amounts, n).alias("amount"))))
    costs = _last_map(F.transform(
        F.filter(linked, lambda c: c["a"].isNotNull() & c["amount"].isNotNull()),
        lambda c: _pair(F.coalesce(c["a"]["title"], F.lit("")), lines(c["amount"])),
    ))
    lore = let(_first(els, lambda e: _is(e, "spelllore")), lines)

    within = lambda e, outer: F.exists(outer, lambda o: F.coalesce((e["start"] > o["start"]) & (e["start"] <= o["end"]), F.lit(False)))
    blocks = _pick(every, lambda e: _is(e, "tabs-dynamic"))
    navs = let(blocks, lambda blocks: _pick(every, lambda e: _is(e, "nav-tabs") & within(e, blocks)))
    heads = let(navs, lambda navs: _pick(every, lambda e: (e["tag"] == "li") & within(e, navs)))
    stop = lambda heads: F.array_position(F.transform(heads, lambda h: F.lower(lines(h))), F.lit("show all"))
    shown = let(heads, lambda heads: let(stop(heads), lambda at: F.when(
        at > 0, F.slice(heads, F.lit(1), (at - 1).cast("int"))).otherwise(heads)))
    contents = _pick(every, lambda e: _is(e, "tabs-content"))
    panels = let(contents, lambda contents: _pick(every, lambda p: within(p, contents)))
    tabs = _last_map(let(panels, lambda panels: F.transform(shown, lambda h: _pair(
        lines(h), let(_first(panels, lambda p: F.array_contains(p["classes"], F.concat(F.lit("content"), h["count"]))), lines)))))

    return F.struct(
        name.alias("name"), _list(hotkeys).alias("hotkeys"), metadata.alias("metadata"),
        description.alias("description"), traits.alias("traits"), _list(extras).alias("extra_descriptions"),
        costs.alias("costs"), lore.alias("lore"), tabs.alias("tabs"),
    ).cast(SPELLCARD)


# ---- The property form ------------------------------------------------------

def card_props(nodes: DataFrame, wrap: Column | None = None) -> DataFrame:
    """Properties of every card.

    Result: page_id, start, end, parent, grand (intervals of the elements around), title, description, badges,
    rows array<struct<label,value>>, notes.  Rows are the labelled data, then
    the traits (first of each label, case ignored), then the costs.
    """
    # A page without an id has no place among documents.
    cards = _elements(nodes, wrap, "seen", "meant").where(F.col("page_id").isNotNull())
    return cards.select("page_id", *_properties(COLUMNS))


def _properties(card) -> list[Column]:
    """Columns of ``card_props`` from a card of ``_elements``."""
    els = card["els"]
    seen, meant = (lambda e: _text(e, "seen", card)), (lambda e: _text(e, "meant", card))
    bar = _first(els, lambda e: (e["tag"] == "div") & _styled(e, "border-bottom"))
    filled = lambda text: let(text, non_empty)
    title = F.coalesce(
        filled(strip(card["wrap_id"])),
        filled(let(let(bar, lambda bar: _first(_below(els, bar), lambda s: s["tag"] == "span")), seen)),
        filled(let(_first(els, lambda b: b["tag"].isin("b", "strong")), seen)), F.lit(""),
    )
    badges = F.array_distinct(F.filter(
        F.transform(let(bar, lambda bar: _pick(_below(els, bar), lambda i: i["tag"] == "img")), lambda i: strip(i["alt"])),
        lambda a: F.coalesce(a != "", F.lit(False)),
    ))
    aim = _first(els, lambda e: (e["tag"] == "div") & e["cls"].startswith("target_"))
    beside = let(aim, lambda aim: _first(
        els, lambda d: (d["tag"] == "div") & (d["parent"] == aim["parent"]) & (d["start"] > aim["start"])))
    flex = F.transform(
        _pick(els, lambda e: (e["tag"] == "div") & F.lower(e["style"]).contains("display:flex")
              & F.lower(e["style"]).contains("font-size")),
        lambda f: F.get(_pick(_below(els, f), lambda d: d["tag"] == "div"), F.lit(1)),
    )
    second = F.get(F.filter(flex, lambda d: d.isNotNull()), F.lit(0))
    description = F.coalesce(let(beside, seen), let(second, seen), F.lit(""))

    tads = F.filter(F.transform(
        _pick(els, lambda e: _is(e, "spelltad")),
        lambda t: F.struct(seen(t).alias("label"), F.coalesce(
            let(_first(els, lambda v: (v["parent"] == t["parent"]) & (v["start"] > t["start"])
                       & _is(v, "spelltad_value")), meant), F.lit("")).alias("value")),
    ), lambda p: p["label"] != "")

    def trait(t: Column) -> Column:
        # Without a bold element inside, its text is null.
        bold = let(_first(_below(els, t), lambda b: b["tag"] == "b"), seen)
        return let(F.struct(F.regexp_replace(bold, ":+$", "").alias("label"), meant(t).alias("full")), lambda x: F.when(
            x["label"].isNotNull(), F.struct(x["label"].alias("label"), after_label(x["full"], x["label"]).alias("value")),
        ).otherwise(F.struct(label_of(x["full"]).alias("label"), value_of(x["full"]).alias("value"))))

    traits = F.filter(F.transform(_pick(els, lambda e: _is(e, "spelltrait_value")), trait),
                      lambda p: F.coalesce(p["label"] != "", F.lit(False)))
    traits = let(traits, lambda traits: let(
        F.transform(traits, lambda p: F.lower(p["label"])),
        lambda keys: F.filter(traits, lambda p, i: F.array_position(keys, F.lower(p["label"])) == i + 1)))

    amounts = _pick(els, lambda e: _is(e, "spellcost_value"))
    costs = let(amounts, lambda amounts: F.transform(_pick(els, lambda e: _is(e, "spellcost_icon")), lambda i, n: F.struct(
        let(F.struct(strip(_first(_below(els, i), lambda a: (a["tag"] == "a") & a["title"].isNotNull())["title"]).alias("title")), lambda of: let(
            F.when(of["title"] != "", of["title"]).otherwise(meant(i)), cost_label)).alias("label"),
        let(F.get(amounts, n), meant).alias("value"),
    )))
    costs = F.filter(costs, lambda c: c["value"].isNotNull() & (c["label"] != ""))

    notes = F.filter(
        F.transform(_pick(els, lambda e: _is(e, "spelldesc")), lambda d: F.coalesce(
            let(F.try_element_at(_pick(_below(els, d), lambda x: x["tag"] == "div"), F.lit(-1)), seen), seen(d))),
        lambda n: n != "",
    )
    return [
        *[card[n].alias(n) for n in ("start", "end", "parent", "grand")], title.alias("title"), description.alias("description"),
        badges.alias("badges"), F.concat(tads, traits, costs).alias("rows"), notes.alias("notes"),
    ]


# ---- Lists and status effects of tab blocks ---------------------------------

def bullets(nodes: DataFrame, area: Column, *fields: str) -> DataFrame:
    """List items inside the outermost matching elements, as Markdown lines.

    Result: page_id, area struct(start, end, fields) of the element, start,
    level, line.  Only lists that lie in no other ``ul`` start at level 0, only lists directly
    in an item go deeper, and an item's text leaves out the lists in it.

    Lists are followed by sweeps over the area: how many are open at a row tells its level, and whether one is open
    that stands elsewhere than directly in an item tells if it is reached.  Nesting may have any depth.
    """
    marked = inside(nodes, area, "area", *fields).where(F.col("area").isNotNull() & (F.col("start") > F.col("area.start")))
    marked = with_clean(marked, "seen", span=has_attr("title")).select("page_id", "area", "start", "end", "tag", "parent_tag", "seen")
    marked = inside(marked.where(tag("ul", "ol", "li") | F.col("seen").isNotNull()), tag("ul"), "top").where(F.col("top").isNotNull())
    below = F.col("start") > F.col("top.start")
    is_list, is_item = tag("ul", "ol"), tag("li")
    # Below the top list, lists stand in items and items in lists.
    apart = below & ((is_list & (F.col("parent_tag") != "li")) | (is_item & ~F.col("parent_tag").isin("ul", "ol")))
    marked = nearest(with_open(marked.withColumn("_apart", apart), _lists=is_list, _off=apart), is_list | is_item, "_in", "tag")
    item = F.when(is_item, F.col("start")).when(F.col("_in.tag") == "li", F.col("_in.start"))
    ok = is_item & ~F.col("_apart") & (F.col("_off") == 0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(~is_item, F.struct("start", F.nullif(strip("seen"), F.lit("")).alias("t")))
    )), lambda x: x["t"]), " ")
    return (
        marked.withColumn("_item", item).withColumn("_ok", ok).where(~is_list & F.col("_item").isNotNull())
        .groupBy("page_id", "area", F.col("_item").alias("start"))
        .agg(F.max(F.when(F.col("_ok"), F.col("_lists") - 1)).alias("level"), clean_cell(text).alias("_text"))
        .where(F.col("level").isNotNull() & (F.col("_text") != ""))
        .select("page_id", "area", "start", "level",
                F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("- "), F.col("_text")).alias("line"))
    )


TAB_FLAGS = ("tabs", "content", "hidden", "shown", "text", "list", "item", "ul", "apart", "target")


def _tab_flags(e) -> dict[str, Column]:
    plain, _ = _stand_ins(e)
    hidden = _styled(e, "display:none") | _styled(e, "visibility:hidden") | ((e["tag"] == "span") & _is(e, "sortkey"))
    is_list, is_item = e["tag"].isin("ul", "ol"), e["tag"] == "li"
    # Below the top list, lists stand in items and items in lists.
    apart = (is_list & (e["parent_tag"] != "li")) | (is_item & ~e["parent_tag"].isin("ul", "ol"))
    return dict(zip(TAB_FLAGS, (
        _is(e, "tabs-dynamic"), _is(e, "tabs-content"), hidden, plain.isNotNull(), e["text"].isNotNull(), is_list, is_item, e["tag"] == "ul", apart,
        e["tag"].isin("div", "tt"))))


def _tab_row(e) -> list[Column]:
    plain, _ = _stand_ins(e)
    return [*[e[n].alias(n) for n in ("start", "end", "depth", "tag", "brk")], F.coalesce(plain, e["text"]).alias("said")]


def _tab_places(p):
    tabs = p.outermost(p["tabs"])
    inner = tabs >= 0
    content = p.first_inside(p["content"] & inner, tabs)
    area = p.below(content)
    # As ``bullets`` follows lists, in the block's first content.
    top = p.outermost(p["ul"] & area)
    listed = area & (top >= 0)
    apart, lists, items = p["apart"] & p.below(top) & listed, p["list"] & listed, p["item"] & listed
    around = p.nearest(lists | items)
    item = np.where(items, p.row, np.where((around >= 0) & p["item"][around], around, -1))
    ok = items & ~apart & (p.open(apart) == 0)
    return {
        "_size": p.size_of(tabs), "item": p.start_of(np.where(listed & ~lists, item, -1)), "level": np.where(ok, p.open(lists) - 1, -1),
        "el": p["target"] & area, "no_line": p.covered(p["hidden"] & area, p["shown"] & area),
        "no_seen": p.covered(p["hidden"] & inner, p["shown"] & inner), "is_item": items,
    }


TAB_KIND = "_size int, item int, level int, el boolean, no_line boolean, no_seen boolean, is_item boolean"


def _tab_lines(words: Column) -> Column:
    """Lines of the items, whose words lie next to each other."""
    leads = F.filter(F.transform(words, lambda w, i: F.when(
        (i == 0) | (F.get(words, i - 1)["item"] != w["item"]), i)), lambda i: i.isNotNull())
    items = lambda leads: F.transform(leads, lambda at, k: let(
        F.slice(words, at + 1, F.coalesce(F.get(leads, k + 1), F.size(words)) - at), lambda mine: F.struct(
            F.array_max(F.transform(mine, lambda w: w["level"])).alias("level"),
            clean_cell(F.array_join(F.transform(mine, lambda w: w["t"]), " ")).alias("text"))))
    shown = F.filter(let(leads, items), lambda x: x["level"].isNotNull() & (x["text"] != ""))
    return F.transform(shown, lambda x: F.concat(F.repeat(F.lit("  "), x["level"]), F.lit("- "), x["text"]))


def _tab_block(own: Column, rows: Column) -> Column:
    first = own["r"]["start"]
    runs = F.filter(rows, lambda x: ~x["f"]["no_seen"] & x["r"]["said"].isNotNull())
    pieces = block_pieces(F.transform(runs, lambda x: F.struct(x["r"]["start"].alias("at"), x["r"]["said"].alias("said"))), "spaced", "said", first)
    els = F.transform(F.filter(rows, lambda x: x["f"]["el"] & (x["r"]["start"] > first)), lambda x: x["r"])

    def effect(box: Column, els: Column, pieces: Column) -> Column:
        seen = lambda e: F.when(e.isNotNull(), clean_cell(block_text(pieces, "spaced", e, first)))
        return let(_below(els, box), lambda within: F.struct(
            let(_first(within, lambda t: t["tag"] == "tt"), seen).alias("code"),
            F.coalesce(let(F.try_element_at(_pick(within, lambda d: d["tag"] == "div"), F.lit(-1)), seen), seen(box)).alias("text")))

    effects = let(els, lambda els: let(pieces, lambda pieces: F.array_distinct(F.filter(
        F.transform(_pick(els, lambda d: d["tag"] == "div"), lambda d: effect(d, els, pieces)),
        lambda e: F.coalesce((e["code"] != "") & (e["text"] != ""), F.lit(False)),
    ))))
    word = lambda x: F.when(~x["f"]["no_line"], non_empty(strip(x["r"]["said"])))
    words = F.transform(F.filter(rows, lambda x: x["f"]["item"].isNotNull() & (x["f"]["is_item"] | word(x).isNotNull())), lambda x: F.struct(
        x["f"]["item"].alias("item"), x["r"]["start"].alias("at"), x["f"]["level"].alias("level"),
        F.when(~x["f"]["is_item"], word(x)).alias("t")))
    return F.struct(first.alias("start"), let(F.array_sort(words), _tab_lines).alias("lines"), effects.alias("effects"))


def tab_blocks(nodes: DataFrame) -> DataFrame:
    """Tab blocks with what their panels say.

    Result: page_id, start, lines (bullets of all panels), effects
    (distinct code and description of every box with a code, in order).

    Lists go by the rules of ``bullets``; one sweep finds items and their levels, and a block takes its slice of the page.
    """
    pages = page_rows(nodes, lambda e: F.struct(*_tab_row(e), flag_bits(**_tab_flags(e)).alias("_bits")))
    return swept_blocks(pages, list(TAB_FLAGS), _tab_places, TAB_KIND, _tab_block)


def card_markdown(props: DataFrame, tabs: DataFrame | None = None) -> DataFrame:
    """Markdown of every card, with its tab block's content: page_id, start, end, markdown."""
    if tabs is not None:
        props = pair_next(props, tabs, "lines", "effects")
    text = _markdown(COLUMNS, None if tabs is None else F.col("tab"))
    return props.select("page_id", "start", "end", text.alias("markdown"))


def _markdown(card, tab: Column | None) -> Column:
    """Markdown of a card's properties and of the tab block it is paired with."""
    empty = F.lit("")

    def when_any(items: Column, text: Column) -> Column:
        return F.when(F.size(items) > 0, text).otherwise(empty)

    def each(items: Column, line) -> Column:
        return F.array_join(F.transform(items, line), "")

    parts = [
        F.coalesce(F.concat(F.lit("#### "), non_empty(card["title"]), F.lit("\n\n")), empty),
        F.coalesce(F.concat(F.lit("> "), non_empty(card["description"]), F.lit("\n\n")), empty),
        when_any(card["badges"], F.concat(F.lit("*Restrictions:* "), F.array_join(card["badges"], ", "), F.lit("\n\n"))),
        when_any(card["rows"], F.concat(
            F.lit("| Property | Value |\n|---|---|\n"),
            each(card["rows"], lambda r: F.concat(F.lit("| "), r["label"], F.lit(" | "), dash(r["value"]), F.lit(" |\n"))),
            F.lit("\n"),
        )),
        when_any(card["notes"], F.concat(
            F.lit("**Notes**\n\n"), each(card["notes"], lambda n: F.concat(F.lit("- "), n, F.lit("\n"))), F.lit("\n"),
        )),
    ]
    if tab is not None:
        lines, effects = tab["lines"], tab["effects"]
        boxes = when_any(effects, F.concat(
            F.lit("\n**Status Effects**\n\n"),
            each(effects, lambda e: F.concat(F.lit("- `"), e["code"], F.lit("` — "), e["text"], F.lit("\n"))),
        ))
        parts.append(F.when(
            (F.size(lines) > 0) | (F.size(effects) > 0),
            F.concat(F.lit("**Show All**\n\n"), each(lines, lambda x: F.concat(x, F.lit("\n"))), boxes, F.lit("\n")),
        ).otherwise(empty))
    return strip(F.concat(*parts))


# What ``swept_pages`` sweeps for cards and tab blocks.
CARD_SWEEP = (lambda e: _card_flags(e, _wrapper(e)), _card_places, CARD_KIND)
TAB_SWEEP = (_tab_flags, _tab_places, TAB_KIND)


def page_cards(cards: str, tabs: str) -> Column:
    """Cards of a page of ``swept_pages``, each with its tab block, as ``card_markdown(card_props, tab_blocks)`` has them: an array of
    at (the row in the page), size (its rows), start, end, markdown.  The columns hold what ``CARD_SWEEP`` and ``TAB_SWEEP`` found.
    """
    found = F.filter(blocks_of(cards, card_row, _card_block("seen", "meant")), lambda c: c["block"].isNotNull())
    props = F.transform(found, lambda c: F.struct(c["at"].alias("at"), c["size"].alias("size"), F.struct(*_properties(c["block"])).alias("props")))
    blocks = F.array_sort(F.transform(blocks_of(tabs, _tab_row, _tab_block), lambda t: t["block"]))
    text = lambda c, tabs: let(paired(c["props"], tabs), lambda tab: _markdown(c["props"], tab))
    return let(blocks, lambda tabs: F.transform(props, lambda c: F.struct(
        c["at"].alias("at"), c["size"].alias("size"), c["props"]["start"].alias("start"), c["props"]["end"].alias("end"),
        text(c, tabs).alias("markdown"))))
