"""Table grids, skill lists and their Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import collapse, dash, non_empty, strip, strip_sort_code
from pageloom.functions.spans import placed
from pageloom.operators.match import empty_columns, let, ordered_list
from pageloom.operators.select import (
    attr, contains_match, has_attr, has_class, inside, tag,
)
from pageloom.operators.text import subtree_text, with_clean
from pageloom.schema import INNER_LINK
from pageloom.sources.htmltree import MAX_SPAN

TABLE_KEY = ["page_id", "table_id"]


def choose_table(nodes: DataFrame) -> DataFrame:
    """The one table of each page to read: page_id, start, end.

    First data table, else first sortable one, else first with a ``thead``,
    else the last table.
    """
    rank = (
        F.when(has_class("mw-datatable"), 0).when(has_class("sortable"), 1)
        .when(F.col("_has_head"), 2).otherwise(3)
    )
    place = F.when(F.col("_rank") < 3, F.col("start")).otherwise(-F.col("start"))
    return (
        contains_match(nodes, tag("thead"), "_has_head").where(tag("table")).withColumn("_rank", rank)
        .groupBy("page_id").agg(F.min_by(F.struct("start", "end"), F.struct("_rank", place)).alias("_t"))
        .select("page_id", "_t.*")
    )


def _first_column_names(by_cell: Window) -> Column:
    """Names that stand for the first-column cell a row lies in.

    Link titles, else image texts, else the text of the first link to an inner
    page, else that of the last link, else the cell's text.
    """
    is_link, is_img = F.col("tag") == "a", F.col("tag") == "img"
    titles = F.collect_list(F.when(is_link, non_empty(strip("title")))).over(by_cell)
    alts = F.collect_list(F.when(is_img, non_empty(strip("alt")))).over(by_cell)
    shown = is_link & (F.col("tight") != "")
    inner = shown & F.col("title").isNotNull() & F.col("href").startswith(INNER_LINK)
    named = F.first(F.when(inner, F.col("tight")), ignorenulls=True).over(by_cell)
    last = F.last(F.when(shown, F.col("tight")), ignorenulls=True).over(by_cell)
    names = (
        F.when(F.size(titles) > 0, titles).when(F.size(alts) > 0, alts)
        .otherwise(F.array(F.coalesce(named, last, dash("spaced"))))
    )
    return F.array_join(F.array_distinct(names), ", ")


def _place_spans(rows: Column, spanned: Column) -> Column:
    """Grid cells of a section's rows when cells reach into later rows; null unless ``spanned``.

    ``rows`` is an array, one entry per row, of arrays of (text, colspan,
    rowspan).  Each row fills the columns that no cell from above still holds.  A negative colspan
    goes over so many columns less those held.
    """
    cells = F.flatten(rows)
    at = placed(*[F.when(spanned, c) for c in (
        F.transform(rows, F.size), F.transform(cells, lambda c: c["colspan"]), F.transform(cells, lambda c: c["rowspan"]))])
    return let(at, lambda at: let(cells, lambda cells: F.transform(
        F.when(F.size(at) > 0, F.sequence(F.lit(0), F.size(at) - 3, F.lit(3))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.get(at, i).alias("row"), F.get(at, i + 1).alias("col"), F.get(cells, F.get(at, i + 2))["text"].alias("text")))))


def _place_rows(rows: Column) -> Column:
    """Grid cells when no cell reaches into another row."""
    def flat(row: Column, r: Column) -> Column:
        wide = F.flatten(F.transform(row, lambda c: F.array_repeat(c["text"], F.abs(c["colspan"]))))
        return F.transform(wide, lambda t, i: F.struct(
            r.cast("int").alias("row"), i.cast("int").alias("col"), t.alias("text")
        ))
    return F.flatten(F.transform(rows, flat))


def _span(name: str) -> Column:
    """A cell's span; a number too long for an int is over any bound."""
    number = F.greatest(F.coalesce(F.expr(f"try_cast(attrs['{name}'] as int)"), F.lit(1)), F.lit(1))
    return F.when(attr(name).rlike(r"^\s*0*[1-9][0-9]{9,}\s*$"), 2**31 - 1).otherwise(number)


def _bounded(grid_rows: DataFrame) -> DataFrame:
    """Columns over the bound go as far as the rows without such cells; as far as the bound where a table has no such row."""
    over = lambda c: c["colspan"] > MAX_SPAN["colspan"]
    by_table = Window.partitionBy(*TABLE_KEY)
    own = F.aggregate("_cells", F.lit(0).cast("long"), lambda n, c: n + F.when(over(c), 0).otherwise(c["colspan"]))
    rows = grid_rows.withColumns({"_own": own, "_over": F.size(F.filter("_cells", over))})
    rows = rows.withColumn("_width", F.max(F.when(F.col("_over") == 0, F.col("_own"))).over(by_table))
    rows = rows.withColumn("_width", F.coalesce("_width", F.lit(MAX_SPAN["colspan"])))
    # The first such cell of a row takes what the others leave.
    first = F.array_position(F.transform("_cells", over), F.lit(True)) - 1
    rest = F.greatest(F.lit(1), (F.col("_width") - F.col("_own") - F.col("_over") + 1).cast("int"))
    bounded = F.transform("_cells", lambda c, i: c.withField(
        "colspan", F.when(~over(c), c["colspan"]).when(i == first, -rest).otherwise(1)))
    return rows.withColumn("_cells", F.when(F.col("_over") > 0, bounded).otherwise(F.col("_cells"))).drop("_own", "_over", "_width")


def table_cells(nodes: DataFrame) -> DataFrame:
    """Cells of every table that holds no other table.

    Result: page_id, table_id (start of the table), table_end, row, col,
    is_header, text.  Spans repeat the text over the cells they cover; header
    labels carry the title of their link; first-column cells are named by link
    titles, image texts or link texts; other body cells lose hidden parts and
    sort codes.  A cell over more than 1,000 columns goes as far as other rows do, or over 1,000.
    """
    marked = contains_match(nodes, tag("#text"), "_filled")
    marked = contains_match(marked, tag("table"), "_outer_table")
    wanted = tag("table") & F.col("_filled") & ~F.col("_outer_table")
    marked = inside(marked, wanted, "tab").where(F.col("tab").isNotNull())
    marked = inside(marked, tag("thead", "tbody", "tfoot"), "part", "tag", within=F.col("tab"))
    marked = inside(marked, tag("tr"), "tr", within=F.col("tab"))
    marked = inside(marked, tag("td", "th"), "cell", "tag", "sib", within=F.col("tr"))
    marked = with_clean(marked, abbr=has_attr("title"), img=False, br=False)
    marked = marked.withColumns({
        "title": attr("title"), "alt": attr("alt"), "href": attr("href"),
        "colspan": _span("colspan"), "rowspan": _span("rowspan"),
        "first_cell": (F.col("cell.tag") == "td") & (F.col("cell.sib") == 0)
        & (F.coalesce(F.col("part.tag"), F.lit("tbody")) == "tbody"),
    })
    is_cell = tag("td", "th") & (F.col("cell.start") == F.col("start"))
    target = (is_cell | (F.col("cell").isNotNull() & tag("a", "img"))) & F.col("tr").isNotNull()
    rows = subtree_text(
        marked, F.coalesce(target, F.lit(False)),
        "tag", "tab", "part", "tr", "cell", "first_cell", "title", "alt", "href", "colspan", "rowspan",
        spaced="spaced", tight="tight", clean="spaced:clean", raw="raw:clean",
    )

    by_cell = Window.partitionBy("page_id", "cell.start").orderBy("start").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    link = F.first(F.when((F.col("tag") == "a") & (F.col("title") != ""), F.col("title")), ignorenulls=True)
    rows = rows.withColumn("_link", link.over(by_cell))
    rows = rows.withColumn("names", F.when(F.col("first_cell"), _first_column_names(by_cell)))
    cells = rows.where(F.col("start") == F.col("cell.start"))

    section = F.coalesce(F.col("part.tag"), F.lit("tbody"))
    label = F.concat_ws(" ", non_empty("spaced"), F.when(~F.col("spaced").contains(F.col("_link")), F.col("_link")))
    plain = F.regexp_replace(strip("raw"), r"(?U)[\r\n]+|\s{2,}", " ")
    body = F.when(strip_sort_code("clean") != F.col("clean"), strip_sort_code("clean")).otherwise(plain)
    text = (
        F.when((section == "thead") & (F.col("tag") == "th"), label)
        .when(F.col("names").isNotNull(), strip_sort_code("names"))
        .when((section == "tbody") & (F.col("tag") == "td"), body)
        .otherwise(plain)
    )
    cells = cells.select(
        "page_id", F.col("tab.start").alias("table_id"), F.col("tab.end").alias("table_end"),
        section.alias("_part"), F.col("tr.start").alias("_tr"), "start", "colspan", "rowspan",
        (F.col("tag") == "th").alias("_th"), text.alias("text"),
    )
    grid_rows = (
        cells.groupBy("page_id", "table_id", "table_end", "_part", "_tr")
        .agg(
            ordered_list(F.struct("text", "colspan", "rowspan")).alias("_cells"),
            F.min("_th").alias("_all_th"), F.max("rowspan").alias("_reach"),
        )
    )
    grid_rows = _bounded(grid_rows)
    # Without a thead the leading rows made of th alone are the header.
    by_table = Window.partitionBy(*TABLE_KEY)
    has_head = F.max(F.col("_part") == "thead").over(by_table)
    leading = F.min("_all_th").over(
        by_table.orderBy("_tr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    grid_rows = grid_rows.withColumn("_has_head", has_head).withColumn("_leading", leading)
    head = F.when(F.col("_has_head"), F.col("_part") == "thead").otherwise(F.col("_leading"))
    place = F.when(head, 0).when(F.col("_part") == "tfoot", 2).otherwise(1)
    sections = (
        grid_rows.withColumn("_place", place)
        .groupBy("page_id", "table_id", "table_end", "_place")
        .agg(ordered_list("_cells", "_tr").alias("_rows"), F.max("_reach").alias("_reach"))
        .withColumn("_before", F.coalesce(
            F.sum(F.size("_rows")).over(
                by_table.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
            ), F.lit(0)))
    )
    reaches = F.col("_reach") > 1
    grid = F.when(reaches, _place_spans(F.col("_rows"), reaches)).otherwise(_place_rows(F.col("_rows")))
    return sections.withColumn("_grid", grid).select(
        "page_id", "table_id", "table_end", "_before", (F.col("_place") == 0).alias("is_header"),
        F.inline("_grid"),
    ).select(
        "page_id", "table_id", "table_end", (F.col("_before") + F.col("row")).cast("int").alias("row"),
        "col", "is_header", "text",
    )


def _pipe(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def pipe_table(header: Column, rows: Column) -> Column:
    """Markdown table from an array of labels and an array of formatted rows."""
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(header)))
    return F.array_join(F.concat(F.array(_pipe(header), rule), rows), "\n")


def table_markdown(cells: DataFrame) -> DataFrame:
    """One pipe table per grid: page_id, start, end, markdown; missing cells are ``-``."""
    width = F.max("col").over(Window.partitionBy(*TABLE_KEY)) + 1
    rows = (
        cells.withColumn("_width", width)
        .groupBy("page_id", "table_id", "table_end", "_width", "row", "is_header")
        .agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("_text"))
        .withColumn("_cells", F.transform(
            F.sequence(F.lit(0), F.col("_width") - 1), lambda c: dash(F.element_at("_text", c))
        ))
    )
    tables = rows.groupBy("page_id", "table_id", "table_end", "_width").agg(
        ordered_list(F.when(F.col("is_header"), F.col("_cells")), "row").alias("_heads"),
        ordered_list(F.when(~F.col("is_header"), _pipe(F.col("_cells"))), "row").alias("_rows"),
    )
    # Several header rows: the distinct labels of a column, joined.
    labels = F.transform(
        F.sequence(F.lit(0), F.col("_width") - 1),
        lambda c: F.array_join(F.array_distinct(F.transform("_heads", lambda h: F.get(h, c))), " "),
    )
    numbers = F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda c: c.cast("string"))
    header = F.when(F.size("_heads") > 0, labels).otherwise(numbers)
    body = F.concat(F.lit("\n\n"), pipe_table(header, F.col("_rows")), F.lit("\n\n"))
    return tables.select(
        "page_id", F.col("table_id").alias("start"), F.col("table_end").alias("end"), body.alias("markdown")
    )


def skill_rows(nodes: DataFrame) -> DataFrame:
    """Entries of every innermost skill list.

    Result: page_id, block, block_end, title, pos, source, ability, details.
    """
    is_list = tag("div") & has_class("skilllist")
    marked = contains_match(nodes, is_list, "_outer_list")
    marked = inside(marked, is_list & ~F.col("_outer_list"), "blk").where(F.col("blk").isNotNull())
    marked = marked.withColumn("lite", has_class("skilllist-lite"))
    entry = tag("li") & has_class("skilllist-lite", "skilllist-rich")
    marked = inside(marked, entry, "item", "lite", within=F.col("blk"))
    marked = inside(marked, has_class("skilllist-rich-head"), "head", within=F.col("item"))
    kind = (
        F.when(F.col("start") == F.col("item.start"), "item")
        .when(F.col("item").isNotNull() & tag("a"), F.when(F.col("head").isNotNull(), "head_link").otherwise("link"))
        .when(F.col("item").isNotNull() & has_class("skilllist-rich-desc"), "desc")
        .when(has_class("skilllist-title"), "title")
    )
    rows = subtree_text(
        marked.withColumn("kind", kind), F.col("kind").isNotNull(), "kind", "blk", "item", text="spaced"
    )
    title = F.first(F.when(F.col("kind") == "title", F.col("text")), ignorenulls=True).over(
        Window.partitionBy("page_id", "blk.start").orderBy("start").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)
    )
    is_link = F.col("kind").isin("link", "head_link")
    items = (
        rows.withColumn("title", title).where(F.col("item").isNotNull())
        .groupBy("page_id", F.col("blk.start").alias("block"), F.col("blk.end").alias("block_end"), "title",
                 F.col("item.start").alias("_at"), F.col("item.lite").alias("_lite"))
        .agg(
            ordered_list(F.when(is_link, non_empty("text"))).alias("_links"),
            ordered_list(F.when(F.col("kind") == "head_link", F.col("text"))).alias("_head"),
            F.min_by("text", F.when(F.col("kind") == "desc", F.col("start"))).alias("_desc"),
            F.max(F.when(F.col("kind") == "item", F.col("text"))).alias("_text"),
        )
    )
    two = F.size("_links") >= 2
    sides = F.split("_text", "–", 2)
    lite_source = F.when(two, F.get("_links", F.lit(0))).otherwise(strip(F.get(sides, F.lit(0))))
    lite_ability = F.when(two, F.element_at("_links", -1)).otherwise(strip(F.get(sides, F.lit(1))))
    rich_source = F.get("_head", F.lit(0))
    rich_ability = F.when(F.size("_head") >= 2, F.element_at("_head", -1))
    pos = F.row_number().over(Window.partitionBy("page_id", "block").orderBy("_at"))
    empty = F.lit("")
    return items.select(
        "page_id", "block", "block_end", "title", pos.alias("pos"),
        F.coalesce(F.when(F.col("_lite"), lite_source).otherwise(rich_source), empty).alias("source"),
        F.coalesce(F.when(F.col("_lite"), lite_ability).otherwise(rich_ability), empty).alias("ability"),
        F.coalesce(F.when(~F.col("_lite"), F.col("_desc")), empty).alias("details"),
    )


def skill_markdown(rows: DataFrame) -> DataFrame:
    """One table per skill list, columns without any text dropped: page_id, start, end, markdown."""
    names = ["source", "ability", "details"]
    rows = empty_columns(rows, ["page_id", "block"], names)
    used = [F.when(F.col(f"has_{n}"), F.col(n)) for n in names]
    label = [F.when(F.col(f"has_{n}"), F.lit(n.capitalize())) for n in names]
    tables = rows.groupBy("page_id", "block", "block_end", "title", *[f"has_{n}" for n in names]).agg(
        ordered_list(_pipe(F.array_compact(F.array(*used))), "pos").alias("_rows")
    )
    heading = F.coalesce(F.concat(F.lit("\n\n#### "), non_empty("title"), F.lit("\n\n")), F.lit("\n\n"))
    table = pipe_table(F.array_compact(F.array(*label)), F.col("_rows"))
    return tables.select(
        "page_id", F.col("block").alias("start"), F.col("block_end").alias("end"),
        F.concat(heading, table, F.lit("\n\n")).alias("markdown"),
    )
