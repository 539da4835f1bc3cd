"""Renderers of tables and documents: rows of cells or blocks to one text for each table or source."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _join(items: Column, sep: str) -> Column:
    return F.array_join(items, sep)


def grid(cells: DataFrame) -> DataFrame:
    """table_id, rows: an array of rows, each an array of texts from column 0 on; gaps are empty.

    One shuffle and one aggregation, by table; a table bounds the group. Of repeated cells the greatest text stays. Cells in order
    are laid out end to end, the gaps before each filled by what its place skips, and cut into rows."""
    number = lambda c: F.coalesce(F.col(c).cast("int"), F.raise_error(F.lit(f"a cell names no {c}")).cast("int")).alias(c)
    cell = F.struct(number("row"), number("col"), F.coalesce("raw_text", F.lit("")).alias("v"))
    t = cells.repartition("table_id").groupBy("table_id").agg(F.collect_list(cell).alias("l")).select("table_id", F.explode(F.array(F.sort_array("l"))).alias("l"))
    last = lambda x, i: (i == F.size("l") - 1) | (x["row"] != F.get("l", i + 1)["row"]) | (x["col"] != F.get("l", i + 1)["col"])
    t = t.select("table_id", F.explode(F.array(F.struct(F.filter("l", last).alias("l"), (F.array_max(F.transform("l", lambda x: x["col"])) + 1).alias("width"), (F.element_at("l", -1)["row"] + 1).alias("height")))).alias("t")).select("table_id", "t.*")
    place = lambda x: x["row"].cast("bigint") * F.col("width") + x["col"]
    gap = lambda here, before: F.array_repeat(F.lit(""), (here - before - 1).cast("int"))
    before = lambda i: F.when(i == 0, F.lit(-1).cast("bigint")).otherwise(place(F.get("l", i - 1)))
    laid = F.flatten(F.transform("l", lambda x, i: F.concat(gap(place(x), before(i)), F.array(x["v"]))))
    rest = gap(F.col("height").cast("bigint") * F.col("width"), place(F.element_at("l", -1)))
    # behind generators, as the optimiser would copy into a lambda what it names and have it made anew for each of its elements
    t = t.select("table_id", "width", "height", F.explode(F.array(F.concat(laid, rest))).alias("laid"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = F.transform(upto("height"), lambda r: F.transform(upto("width"), lambda c: F.get("laid", r * F.col("width") + c)))
    return t.select("table_id", F.explode(F.array(rows)).alias("rows"))


def _csv_cell(v: Column) -> Column:
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def _escaped(v: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


class Renderer:
    """cells to (table_id, body); `body` makes it of the rows of a table's grid."""

    def __init__(self, body: Callable[[Column], Column]):
        self.body = body

    def __call__(self, cells: DataFrame) -> DataFrame:
        return grid(cells).select("table_id", self.body(F.col("rows")).alias("body"))


def _csv(rows: Column) -> Column:
    return _join(F.transform(rows, lambda r: _join(F.transform(r, _csv_cell), ",")), "\n")


def _markdown(rows: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), _join(F.transform(r, lambda v: F.replace(v, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(rows, F.lit(0)))))
    return _join(F.flatten(F.transform(rows, lambda r, i: F.when(i == 0, F.array(line(r), rule)).otherwise(F.array(line(r))))), "\n")


def _html(rows: Column) -> Column:
    line = lambda r: F.concat(F.lit("<tr>"), _join(F.transform(r, lambda v: F.concat(F.lit("<td>"), _escaped(v), F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), _join(F.transform(rows, line), ""), F.lit("</table>"))


csv, markdown, json, html = Renderer(_csv), Renderer(_markdown), Renderer(F.to_json), Renderer(_html)


def rendered(cells: DataFrame, renderers: dict[str, Callable[[DataFrame], DataFrame]], of: Callable[[Column], Column]) -> DataFrame:
    """table_id, format, value: `of` the body that each renderer makes of each table.

    The grid is laid out once for all that are made of it; others are applied to the cells one by one."""
    shared = {name: r for name, r in renderers.items() if isinstance(r, Renderer)}
    each = [F.struct(F.lit(name).alias("format"), of(r.body(F.col("rows"))).alias("value")) for name, r in shared.items()]
    parts = [grid(cells).select("table_id", F.inline(F.array(*each)))] if shared else []
    parts += [cells.transform(r).select("table_id", F.lit(name).alias("format"), of(F.col("body")).alias("value")) for name, r in renderers.items() if name not in shared]
    return reduce(DataFrame.unionByName, parts)


def source_json(blocks: DataFrame, title: DataFrame) -> DataFrame:
    """source_id, body: each source of `title` (source_id, display_name) as JSON, its pages in order, their blocks in order of lines.

    A source without blocks has no pages; a null text is null."""
    page = blocks.groupBy("source_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("line_no", "block_id", "block_type", "text"))).alias("l"))
    page = page.withColumn("blocks", F.transform("l", lambda x: F.struct(x["block_id"].alias("block_id"), x["block_type"].alias("type"), x["text"].alias("text"))))
    pages = page.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "blocks"))).alias("pages"))
    body = F.struct("source_id", F.col("display_name").alias("title"), F.coalesce("pages", F.array().cast(pages.schema["pages"].dataType)).alias("pages"))
    return title.join(pages, "source_id", "left").select("source_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def source_csv(blocks: DataFrame) -> DataFrame:
    """source_id, body: a heading, then page, line, type and text of each block."""
    row = F.array_join(F.array(*[_csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("page_number", "line_no", "block_type", "text")]), ",")
    lines = blocks.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "line_no", row.alias("r")))).alias("l"))
    return lines.select("source_id", F.array_join(F.concat(F.array(F.lit("page,line,type,text")), F.transform("l", lambda x: x["r"])), "\n").alias("body"))


#: Format -> renderer of cells. More may be added; `df.transform(RENDERERS[name])` applies one.
RENDERERS: dict[str, Callable[[DataFrame], DataFrame]] = {"csv": csv, "markdown": markdown, "json": json, "html": html}


def document_markdown(blocks: DataFrame) -> DataFrame:
    """source_id, markdown: blocks in order of pages and lines, each page under a comment, parts apart by a blank line."""
    t = F.trim(F.coalesce("text", F.lit("")))
    body = (
        F.when(F.col("block_type") == "title", F.concat(F.lit("# "), t)).when(F.col("block_type") == "heading", F.concat(F.lit("## "), t))
        .when(F.col("block_type") == "equation", F.concat(F.lit("$$\n"), t, F.lit("\n$$"))).when(t != "", t)
    )
    page = blocks.groupBy("source_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("line_no", body.alias("b")))).alias("l"))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("<!-- page "), "page_number", F.lit(" -->"))), F.array_compact(F.transform("l", lambda x: x["b"]))), "\n\n")
    pages = page.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("page_number", text.alias("t")))).alias("p"))
    return pages.select("source_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("markdown"))
