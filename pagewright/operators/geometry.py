"""Lines, paragraphs, columns and containers from geometry.

Every ordered operator carries a tie-break key. Range joins are equi-joins on the page first; a
page holds tens to hundreds of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def half_points(size: Column) -> Column:
    return F.floor(size * 2 + 0.5) / 2


def modal_size(lines: DataFrame, by: list[str]) -> DataFrame:
    """The size that carries most text in each group; of ties the one seen first."""
    key = lines.groupBy(*by, half_points(F.col("size")).alias("key")).agg(F.sum(F.length("text")).alias("weight"), F.min(F.struct("page", "idx")).alias("seen"))
    first = Window.partitionBy(*by).orderBy(F.desc("weight"), "seen")
    return key.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*by, F.col("key").alias("modal"))


def heading_level(size: Column, modal: Column, text: Column) -> Column:
    return F.when(size > 1.45 * modal, "h1").when(size > 1.25 * modal, "h2").when(size > 1.15 * modal, "h3").when(X.is_list_item(text), "li").otherwise("p")


def reclassify_headings(blocks: DataFrame, container: list[str]) -> DataFrame:
    """Headings measured again against their container, where it has two blocks or more."""
    modal = modal_size(blocks, container).withColumnRenamed("modal", "own_modal")
    counted = blocks.join(modal, container, "left").withColumn("_n", F.count("*").over(Window.partitionBy(*container)))
    level = heading_level(F.col("size"), F.col("own_modal"), F.col("text"))
    heading = F.col("type").isin("h1", "h2", "h3")
    again = F.when((F.col("_n") >= 2) & F.col("own_modal").isNotNull() & (heading | level.isin("h1", "h2", "h3")), F.when(level == "li", "p").otherwise(level)).otherwise(F.col("type"))
    return counted.withColumn("type", again).drop("_n")


def header_footer(lines: DataFrame, height: float, band: float = 0.07, times: int = 3) -> DataFrame:
    """Add header_footer: near an edge, and repeated there or a page number."""
    near = (F.col("y") < height * band) | (F.col("y") > height * (1 - band))
    key = F.concat(X.repetition_key(F.col("text")), F.lit("|"), F.floor(F.col("y") / 10 + 0.5).cast("string"))
    keyed = lines.withColumn("_near", near).withColumn("_key", key)
    often = keyed.where("_near").groupBy("doc_id", "_key").count().where(F.col("count") >= times).select("doc_id", "_key", F.lit(True).alias("_often"))
    number = F.trim("text").rlike(r"^\d{1,4}$") | F.trim("text").rlike(X.PAGE_NUMBER)
    out = keyed.join(often, ["doc_id", "_key"], "left")
    return out.withColumn("header_footer", F.col("_near") & (F.coalesce("_often", F.lit(False)) | number)).drop("_near", "_key", "_often")


def is_secondary(size: Column, modal: Column, x0: Column, x1: Column, low: Column, high: Column, width: float, height: float) -> Column:
    """Clearly smaller than the body and near a margin."""
    near = (x0 < width * 0.08) | (x1 > width * 0.92) | (low < height * 0.08) | (high > height * 0.92)
    return (size < 0.75 * modal) & near


def paragraphs(lines: DataFrame, modal: float, by: list[str], interline: float = 1.2) -> DataFrame:
    """Lines of a flow joined to paragraphs: by, para, n_lines, text, type, x0, x1, y0, y1.

    A new paragraph starts at a style change, a gap of 1.6 interlines or none, a list marker, a
    line that opens a new fact, or a forced break. All depend on the line before only, so this is
    one window and a running sum.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("y"), "x0", "idx")
    before = lambda c: F.lag(c).over(order)
    right = F.max("x1").over(Window.partitionBy(*by))
    bare = F.regexp_replace("text", r"^\p{Zs}+|\p{Zs}+\z", "")  # no-break spaces go as well, tabs stay
    last = F.lag(bare).over(order)
    gap = before("y") - F.col("y")
    word = F.length(F.get(F.split(bare, r"[ \t\n\f\r]+"), F.lit(0)))
    advance = (F.col("x1") - F.col("x0")) / F.greatest(F.lit(1), F.length("text"))
    needed = word * 13 / 10 * advance  # the decimal 1.3 word, rounded once; 1.3 as a double moves lines that just fit
    forced = (before("size") <= modal * 1.15) & ~last.rlike(r"-\z") & (right - before("x1") > needed + 0.3 * before("size"))
    fact = ~last.rlike(r"[.!?][ \t\n\f\r]*\z") & ~bare.rlike("^[a-zà-öø-ÿ]")
    new = before("y").isNull() | (F.abs(before("size") - F.col("size")) >= 0.5) | (gap > 1.6 * interline * before("size")) | (gap <= 0) | X.is_list_item(F.col("text")) | fact | forced
    numbered = lines.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("para", F.sum("_new").over(order)).withColumn("_o", F.row_number().over(order))
    row = F.struct("_o", "text", "size", "x0", "x1", "y")
    rows = numbered.groupBy(*by, "para").agg(F.array_sort(F.collect_list(row)).alias("m"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y").alias("top"), F.min("y").alias("low"))
    first, final = F.get("m", F.lit(0)), F.element_at("m", -1)
    level = heading_level(first["size"], F.lit(modal), first["text"])
    joined = X.join_lines(F.transform("m", lambda r: r["text"]))
    return rows.select(*by, "para", F.size("m").alias("n_lines"), F.when(level == "li", X.strip_marker(joined)).otherwise(joined).alias("text"), level.alias("type"), "x0", "x1", (F.col("low") - 0.3 * final["size"]).alias("y0"), (F.col("top") + first["size"]).alias("y1"))


def column_split(lines: DataFrame, by: list[str], origin: float, width: float) -> DataFrame:
    """split_x for each group: two peaks of line starts with an empty valley between, else null."""
    n_bins = 20
    size = width / n_bins
    bin_ = F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), F.floor((F.col("x0") - origin) / size).cast("int")))
    bins = lines.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    peaks = bins.withColumn("total", total).withColumn("peak", F.col("n") > F.col("total") * 0.15)
    one = F.min(F.when(F.col("peak"), F.col("bin"))).over(Window.partitionBy(*by))
    peaks = peaks.withColumn("peak1", one)
    two = F.max(F.when(F.col("peak") & (F.col("bin") - F.col("peak1") > 3), F.col("bin"))).over(Window.partitionBy(*by))
    peaks = peaks.withColumn("peak2", two)
    full = F.max(F.when((F.col("bin") >= F.col("peak1") + 2) & (F.col("bin") < F.col("peak2") - 1) & (F.col("n") > F.col("total") * 0.05), 1).otherwise(0))
    found = peaks.groupBy(*by).agg(F.first("total").alias("total"), F.first("peak1").alias("peak1"), F.first("peak2").alias("peak2"), full.alias("full"))
    split = F.when((F.col("total") >= 6) & F.col("peak2").isNotNull() & (F.col("full") == 0), origin + (F.col("peak1") + F.col("peak2")) / 2 * size)
    sides = lines.join(found.select(*by, split.alias("split_x")), by).groupBy(*by).agg(F.first("split_x").alias("split_x"), F.count_if(F.col("x0") < F.col("split_x")).alias("left"), F.count_if(F.col("x0") >= F.col("split_x")).alias("right"))
    return sides.select(*by, F.when((F.col("left") >= 3) & (F.col("right") >= 3), F.col("split_x")).alias("split_x"))


def column_band(lines: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Add band: how many of the boundaries active at the line's height are left of it."""
    at = lines.join(bounds, [*by], "left").withColumn("_in", (F.col("bx") <= F.col("x0")) & (F.col("y") >= F.col("by0") - 2) & (F.col("y") <= F.col("by1") + 2))
    keys = [c for c in lines.columns]
    return at.groupBy(*keys).agg(F.count_if("_in").alias("band"))


def to_containers(points: DataFrame, boxes: DataFrame, by: list[str], slack: float = 2.0) -> DataFrame:
    """Each point row with the smallest box that holds it (ties: lowest index); box null: free flow."""
    inside = (F.col("x0") >= F.col("bx0") - slack) & (F.col("x1") <= F.col("bx1") + slack) & (F.col("y") >= F.col("by0") - slack) & (F.col("y") <= F.col("by1") + slack)
    hits = points.join(boxes, by).where(inside)
    area = (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))
    best = hits.groupBy(*by, "idx").agg(F.min(F.struct(area.alias("area"), "box")).alias("b")).select(*by, "idx", F.col("b.box").alias("box"))
    return points.join(best, [*by, "idx"], "left")


def wrappers(boxes: DataFrame, by: list[str]) -> DataFrame:
    """outer, inner, pad: boxes that hold exactly one other box; pad is the mean of the four gaps."""
    a, b = boxes.alias("a"), boxes.alias("b")
    col = lambda t, c: F.col(f"{t}.{c}")
    on = [col("a", k) == col("b", k) for k in by]
    holds = (col("a", "box") != col("b", "box")) & (col("a", "bx0") <= col("b", "bx0")) & (col("a", "bx1") >= col("b", "bx1")) & (col("a", "by0") <= col("b", "by0")) & (col("a", "by1") >= col("b", "by1"))
    pad = (col("b", "bx0") - col("a", "bx0") + col("a", "bx1") - col("b", "bx1") + col("b", "by0") - col("a", "by0") + col("a", "by1") - col("b", "by1")) / 4
    pairs = a.join(b, on).where(holds).select(*(col("a", k).alias(k) for k in by), col("a", "box").alias("outer"), col("b", "box").alias("inner"), pad.alias("pad"))
    return pairs.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "outer"))).where("_n = 1").drop("_n")


def cell_fills(cells: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """Each cell's fill: the first box that covers more than half of its area."""
    wide = F.greatest(F.lit(0.0), F.least("x1", "bx1") - F.greatest("x0", "bx0"))
    high = F.greatest(F.lit(0.0), F.least("y1", "by1") - F.greatest("y0", "by0"))
    hits = cells.join(boxes, by).where(wide * high > 0.5 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return cells.join(hits.groupBy(*by, "cell").agg(F.min("box").alias("box")), [*by, "cell"], "left")


def titles(tables: DataFrame, headings: DataFrame, by: list[str]) -> DataFrame:
    """Each table's title: the nearest heading above it, from 4 points below its top to 150 above."""
    gap = F.col("hy0") - F.col("by1")
    hits = tables.join(headings, by).where(gap.between(-4, 150) & (F.col("hx0") < F.col("bx1")) & (F.col("hx1") > F.col("bx0")))
    return hits.groupBy(*by, "box").agg(F.min(F.struct(gap.alias("gap"), F.col("heading"))).alias("t")).select(*by, "box", F.col("t.heading").alias("heading"))


def overlap_pairs(items: DataFrame, by: list[str], least: float = 1.0) -> DataFrame:
    """Pairs of items of a page that overlap by more than ``least`` on both axes."""
    a, b = items.alias("a"), items.alias("b")
    col = lambda t, c: F.col(f"{t}.{c}")
    axis = lambda lo, hi: F.least(col("a", hi), col("b", hi)) - F.greatest(col("a", lo), col("b", lo)) > least
    return a.join(b, [col("a", k) == col("b", k) for k in by]).where((col("a", "idx") < col("b", "idx")) & axis("x0", "x1") & axis("y0", "y1")).select(*(col("a", k).alias(k) for k in by), col("a", "idx").alias("first"), col("b", "idx").alias("second"))


def cut_groups(segments: DataFrame, by: list[str], gap: float = 10.0) -> DataFrame:
    """Chains of thin segments on one line: a chain ends where the gap to all before exceeds ``gap``."""
    order = Window.partitionBy(*by).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("x0") - reach > gap), 1).otherwise(0)
    chained = segments.withColumn("_new", new).withColumn("chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy(*by, "chain").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("members"))


def gap_segments(items: DataFrame, by: list[str]) -> DataFrame:
    """Add segment: a new one where the gap to the right edge so far exceeds max(15, 1.8 size)."""
    order = Window.partitionBy(*by).orderBy("x0", "idx")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("x0") - reach > F.greatest(F.lit(15.0), 1.8 * F.col("size")), 1).otherwise(0)
    return items.withColumn("_new", new).withColumn("segment", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def wide_table_groups(rows: DataFrame, by: list[str], per_page: int = 3) -> DataFrame:
    """Header rows open blocks (when there are two or more); data columns go by threes.

    rows: by, row, cells array<string>. Result: by, row, block, cells of the first column kept out.
    """
    order = Window.partitionBy(*by).orderBy("row")
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    header = (F.size(filled) >= 2) & F.forall(filled, lambda c: X.is_all_caps(c) & (X.word_count(c) <= 2))
    marked = rows.withColumn("header", header).withColumn("_n", F.count_if("header").over(Window.partitionBy(*by)))
    block = F.when(F.col("_n") >= 2, F.greatest(F.lit(1), F.count_if("header").over(order))).otherwise(F.lit(1)).cast("int")
    cells = marked.withColumn("block", block).select(*by, "row", "block", "header", F.posexplode("cells").alias("column", "text")).where("column > 0")
    return cells.withColumn("group", F.floor((F.col("column") - 1) / per_page).cast("int"))


def row_header_is_redundant(cells: DataFrame, by: list[str]) -> DataFrame:
    """Whether every filled cell starts with one of its row's labels (split at /); two cells at least.

    cells: by, row, label, text.
    """
    full = cells.where(F.trim("text") != "")
    fits = F.exists(F.split(F.lower("label"), "/"), lambda x: F.startswith(F.lower(F.trim("text")), F.trim(x)))
    return full.groupBy(*by).agg(F.bool_and(fits).alias("fits"), F.count("*").alias("n")).select(*by, (F.col("fits") & (F.col("n") >= 2)).alias("redundant"))


def shrink_columns(columns: DataFrame, by: list[str], available: float) -> DataFrame:
    """Add width: columns take what they want; an overflow is taken from slack over the minimum,
    in proportion; if the minima overflow, they are scaled. columns: by, column, want, least."""
    w = Window.partitionBy(*by)
    raw = F.greatest("want", "least")
    over = F.sum(raw).over(w) - available
    slack = raw - F.col("least")
    total = F.sum(slack).over(w)
    scaled = F.col("least") * available / F.sum("least").over(w)
    return columns.withColumn("width", F.when(over <= 0, raw).when(total >= over, raw - slack * over / F.nullif(total, F.lit(0.0))).otherwise(scaled))
