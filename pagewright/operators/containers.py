"""Blocks, boxes and tables of a page as relations: who holds whom, what is shown, in which order.

Range joins are equi-joins on the page first; a page holds tens to hundreds of rows of either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..settings import Settings


def block_places(blocks: DataFrame, cells: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """Each block with the place of its centre: a cell (tbl, row, column), else the smallest box, else the smallest
    box whose top edge crosses it, else nothing.

    blocks: by, idx, x0, y0, x1, y1; cells: by, tbl, row, column, cx0, cy0, cx1, cy1; boxes: by, box, bx0, by0, bx1, by1.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    in_cell = x.between(F.col("cx0"), F.col("cx1")) & y.between(F.col("cy0"), F.col("cy1"))
    cell = blocks.join(cells, by).where(in_cell).groupBy(*by, "idx").agg(F.min(F.struct("tbl", "row", "column")).alias("cell"))
    inside = x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1"))
    crossed = (F.col("y0") < F.col("by1")) & (F.col("y1") > F.col("by1")) & (F.col("x1") > F.col("bx0")) & (F.col("x0") < F.col("bx1"))
    area = (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))
    rank = F.struct(F.when(inside, 0).otherwise(1).alias("how"), area.alias("area"), "box")
    box = blocks.join(boxes, by).where(inside | crossed).groupBy(*by, "idx").agg(F.min(rank).alias("b"))
    out = blocks.join(cell, [*by, "idx"], "left").join(box, [*by, "idx"], "left")
    return out.withColumn("box", F.when(F.col("cell").isNull(), F.col("b.box"))).drop("b")


def shown_boxes(boxes: DataFrame, tables: DataFrame, hidden: DataFrame, by: list[str], least: float = 20.0, slack: float = 3.0) -> DataFrame:
    """Boxes over ``least`` on both sides, out of hidden regions, with in_table: whether a table holds them.

    tables: by, tx0, ty0, tx1, ty1; hidden: by, rx0, ry0, rx1, ry1 (half open).
    """
    x, y = (F.col("bx0") + F.col("bx1")) / 2, (F.col("by0") + F.col("by1")) / 2
    key = [*by, "box"]
    sized = boxes.where((F.col("bx1") - F.col("bx0") > least) & (F.col("by1") - F.col("by0") > least))
    gone = sized.join(hidden, by).where((x >= F.col("rx0")) & (x < F.col("rx1")) & (y > F.col("ry0")) & (y <= F.col("ry1"))).select(key).distinct()
    held = sized.join(tables, by).where((F.col("bx0") >= F.col("tx0") - slack) & (F.col("bx1") <= F.col("tx1") + slack) & (F.col("by0") >= F.col("ty0") - slack) & (F.col("by1") <= F.col("ty1") + slack))
    return sized.join(gone, key, "left_anti").join(held.select(key).distinct().withColumn("in_table", F.lit(True)), key, "left").withColumn("in_table", F.coalesce("in_table", F.lit(False)))


def container_order(blocks: DataFrame, container: list[str]) -> DataFrame:
    """Add pos: blocks of a container from the top, those without a box last."""
    return blocks.withColumn("pos", F.row_number().over(Window.partitionBy(*container).orderBy(F.desc_nulls_last("y1"), "idx")))


def page_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that are laid out: no page breaks, no placeholders."""
    return blocks.where(~F.col("type").isin("pagebreak", "needs-ocr"))


def without_front_matter(blocks: DataFrame, settings: Settings) -> DataFrame:
    """Blocks without those of front-matter pages, where the setting says so."""
    return blocks.where(~F.col("front_matter")) if settings.skip_front_matter else blocks


def editable(blocks: DataFrame, settings: Settings) -> DataFrame:
    """Shown blocks with text that a user may edit."""
    shown = ~F.col("secondary") & ~F.col("duplicate") & (F.lit(settings.show_header_footer) | ~F.col("header_footer"))
    return without_front_matter(page_blocks(blocks), settings).where((F.col("type") != "image") & shown & (X.strip(F.col("text")) != ""))


def is_empty(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, chars, empty: whether a document has no text at all."""
    return blocks.groupBy(*by).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars")).withColumn("empty", F.col("chars") == 0)


def row_heights(cells: DataFrame, by: list[str], pad: float) -> DataFrame:
    """by, row, height: the highest cell and its padding."""
    return cells.groupBy(*by, "row").agg((F.max("height") + 2 * pad).alias("height"))


def header_rows(segments: DataFrame, by: list[str]) -> DataFrame:
    """by, row, header: rows with text whose text is all bold."""
    inked = segments.where(X.strip(F.col("text")) != "")
    found = inked.groupBy(*by, "row").agg(F.bool_and("bold").alias("header"))
    return segments.select(*by, "row").distinct().join(found, [*by, "row"], "left").withColumn("header", F.coalesce("header", F.lit(False)))


def captions(groups: DataFrame, by: list[str]) -> DataFrame:
    """Add caption: the table's title with (k/n) where there are several groups; untitled ones only then have one."""
    n, k = F.count("*").over(Window.partitionBy(*by)), F.row_number().over(Window.partitionBy(*by).orderBy("grp"))
    suffix = F.when(n > 1, F.concat(F.lit(" ("), k.cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))).otherwise("")
    return groups.withColumn("caption", F.when(F.col("title") != "", F.concat("title", suffix)).when(n > 1, F.concat(F.lit("Tableau"), suffix)).otherwise(""))


def rough_modal_size(items: DataFrame, by: list[str]) -> DataFrame:
    """The size that most lines have, whatever their length; of ties the one seen first."""
    key = items.groupBy(*by, (F.floor(F.col("size") * 2 + 0.5) / 2).alias("key")).agg(F.count("*").alias("n"), F.min("idx").alias("seen"))
    return key.groupBy(*by).agg(F.max_by("key", F.struct("n", (-F.col("seen")).alias("seen"))).alias("modal"))


def last_lines(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """Add last, and wrapped: lines that another of their block follows."""
    last = F.lead(order).over(Window.partitionBy(*by).orderBy(order)).isNull()
    return lines.withColumn("last", last).withColumn("wrapped", ~F.col("last"))


def first_of(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group, as the reports show them."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def block_union(kinds: list[tuple[str, DataFrame]], by: list[str]) -> DataFrame:
    """All kinds of a page's blocks in a fixed order of kinds, with pos."""
    rows = None
    for k, (name, part) in enumerate(kinds):
        one = part.withColumn("kind", F.lit(name)).withColumn("_k", F.lit(k))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("_k", "idx"))).drop("_k")


def to_hex(c: Column) -> Column:
    """A colour of 0-255 as #rrggbb."""
    two = lambda k: F.lpad(F.lower(F.hex(F.floor(F.get(c, F.lit(k)) + 0.5).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), two(0), two(1), two(2))
