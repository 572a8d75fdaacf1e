"""The tags of pages as rows: nesting by running sums, tables as cells and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talus.functions.columns import squeezed
from talus.functions.html import pieces, unescaped


def tag_stream(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, pos, name, closing, piece) of every piece of a page, in order: tags by lower-case name, texts without a name, comments and scripts left out."""
    each = pages.select(id_, F.posexplode(pieces(F.col(html))).alias("pos", "piece"))
    name = F.nullif(F.lower(F.regexp_extract("piece", r"^</?([a-zA-Z][^\s/>]*)", 1)), F.lit(""))
    out = each.select(id_, "pos", name.alias("name"), F.startswith("piece", F.lit("</")).alias("closing"), "piece")
    return out.where(F.coalesce(~F.col("name").isin("script", "style", "noscript", "template"), ~F.startswith("piece", F.lit("<!"))))


def table_cells(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, depth, table, row, cell, head, text) of every cell: table, row and cell are places in the page, nested tables have a greater depth.

    The depth of a piece is the number of open tables before it. End tags of
    cells and rows may be missing. The text of a cell includes that of tables
    inside of it.
    """
    tags = tag_stream(pages, id_, html).where("name IS NULL OR name IN ('table', 'tr', 'td', 'th')")
    in_page = Window.partitionBy(id_).orderBy("pos")
    is_table, opens = F.col("name") == "table", ~F.col("closing")
    step = F.when(is_table & opens, 1).when(is_table, -1).otherwise(0)
    after = F.sum(step).over(in_page)
    # a stray </table> would bring the sum below zero: count from the least so far
    depth = after - F.least(F.lit(0), F.min("after_").over(in_page))
    tags = tags.withColumn("after_", after).withColumn("depth_", depth)
    # a closing table ends the cell of its own depth; a text belongs to the cells of all open tables
    own = F.when(is_table & ~opens, F.col("depth_") + 1).otherwise(F.col("depth_"))
    levels = F.when(F.col("name").isNull(), F.when(own > 0, F.sequence(F.lit(1).cast("long"), own))).otherwise(F.array(own))
    at = tags.select(id_, "pos", "name", "closing", "piece", F.explode(levels).alias("depth"))
    level = Window.partitionBy(id_, "depth").orderBy("pos")
    cell_open = F.col("name").isin("td", "th") & opens
    state = F.when(cell_open, F.col("pos")).when(F.col("name").isNotNull(), F.lit(-1))
    at = at.withColumn("cell", F.last(state, True).over(level))
    at = at.withColumn("table", F.last(F.when(is_table & opens, F.col("pos")), True).over(level))
    at = at.withColumn("row", F.last(F.when((F.col("name").isin("tr", "table")) & opens, F.col("pos")), True).over(level))
    at = at.where("cell >= 0 AND table IS NOT NULL AND row IS NOT NULL")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("pos", "piece")))), lambda x: unescaped(x["piece"])), " ")
    head = F.coalesce(F.bool_or(F.when(F.col("pos") == F.col("cell"), F.col("name") == "th")), F.lit(False))
    return at.groupBy(id_, "depth", "table", "row", "cell").agg(head.alias("head"), squeezed(text).alias("text"))


def row_pairs(cells: DataFrame, id_: str) -> DataFrame:
    """(id, table, row, name, value) of rows with two filled cells or more: the first two."""
    two = cells.groupBy(id_, "table", "row").agg(F.array_sort(F.collect_list(F.struct("cell", "text"))).alias("c"))
    two = two.where(F.size("c") >= 2).select(id_, "table", "row", F.col("c")[0]["text"].alias("name"), F.col("c")[1]["text"].alias("value"))
    return two.where("name <> '' AND value <> ''")


def spec_pairs(cells: DataFrame, id_: str) -> DataFrame:
    """(id, table, name, value): one pair per table, its first two td cells, where both are filled."""
    two = cells.where("NOT head").groupBy(id_, "table").agg(F.min_by("text", "cell").alias("name"), F.array_sort(F.collect_list("cell"))[1].alias("second_"))
    second = cells.select(id_, F.col("cell").alias("second_"), F.col("table").alias("table_"), F.col("text").alias("value"))
    out = two.join(second, [id_, "second_"]).where("table = table_")
    return out.where("name <> '' AND value <> ''").select(id_, "table", "name", "value")
