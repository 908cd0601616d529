"""Blocks, boxes and tables: containers, filters, orders, captions, and the laid-out pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import containers as K
from ..operators import pages as P
from ..settings import Settings
from .adapters import LINES_SQL, TYPESET_SQL, lines, table, typeset
from .geometry_queries import _BOXES_SQL, _body, _boxes
from .registry import query

_T = "WITH " + TYPESET_SQL
_CELLS = ", cells AS (SELECT doc_id, page, 0 AS tbl, (k // 2)::INTEGER AS row, (k % 2)::INTEGER AS col, CASE k % 2 WHEN 0 THEN 300.0 ELSE 420.0 END::DOUBLE AS cx0, CASE k % 2 WHEN 0 THEN 420.0 ELSE 540.0 END::DOUBLE AS cx1, 600.0::DOUBLE - 80 * (k // 2) AS cy0, 680.0::DOUBLE - 80 * (k // 2) AS cy1 FROM (SELECT DISTINCT doc_id, page FROM body), range(6) AS r(k)), blocks AS (SELECT doc_id, page, idx, x0, x1, y - 4 AS y0, y + 12 AS y1 FROM body)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body(spark, sf_dir).select("doc_id", "page", "idx", "x0", "x1", (F.col("y") - 4).alias("y0"), (F.col("y") + 12).alias("y1"), "text", "size")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body(spark, sf_dir).select("doc_id", "page").distinct()


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    left = F.when(k % 2 == 0, 300.0).otherwise(420.0)
    row = F.floor(k / 2).cast("int")
    return _pages(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("doc_id", "page", F.lit(0).alias("tbl"), row.alias("row"), (k % 2).cast("int").alias("column"), left.alias("cx0"), (left + 120).alias("cx1"), (600.0 - 80 * row).alias("cy0"), (680.0 - 80 * row).alias("cy1"))


@query("block_places", _T + _BOXES_SQL + _CELLS + ", c AS (SELECT b.doc_id, b.page, b.idx, min(row * 10 + col) AS cell FROM blocks b JOIN cells USING (doc_id, page) WHERE (x0 + x1) / 2 BETWEEN cx0 AND cx1 AND (y0 + y1) / 2 BETWEEN cy0 AND cy1 GROUP BY 1, 2, 3), h AS (SELECT b.doc_id, b.page, b.idx, box, (bx1 - bx0) * (by1 - by0) AS area, CASE WHEN (x0 + x1) / 2 BETWEEN bx0 AND bx1 AND (y0 + y1) / 2 BETWEEN by0 AND by1 THEN 0 ELSE 1 END AS how FROM blocks b JOIN boxes USING (doc_id, page) WHERE ((x0 + x1) / 2 BETWEEN bx0 AND bx1 AND (y0 + y1) / 2 BETWEEN by0 AND by1) OR (y0 < by1 AND y1 > by1 AND x1 > bx0 AND x0 < bx1)), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, idx ORDER BY how, area, box) AS r FROM h) SELECT b.doc_id, b.page, b.idx, (c.cell // 10)::INTEGER AS \"row\", (c.cell % 10)::INTEGER AS column_no, CASE WHEN c.cell IS NULL THEN f.box END AS box FROM blocks b LEFT JOIN c USING (doc_id, page, idx) LEFT JOIN f ON f.r = 1 AND f.doc_id = b.doc_id AND f.page = b.page AND f.idx = b.idx")
def block_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.block_places(_blocks(spark, sf_dir), _cells(spark, sf_dir), _boxes(spark, sf_dir), ["doc_id", "page"])
    return out.select("doc_id", "page", "idx", F.col("cell.row").alias("row"), F.col("cell.column").alias("column_no"), "box")


@query("shown_boxes", _T + _BOXES_SQL + ", o AS (SELECT doc_id, page, box, bx0, by0, bx0 + CASE WHEN (doc_id + box) % 5 = 0 THEN 15 ELSE bx1 - bx0 END AS bx1, by1 FROM boxes) SELECT doc_id, page, box, bx0 >= 40 AND bx1 <= 558 AND by0 >= 96 AND by1 <= 790 AS in_table FROM o WHERE bx1 - bx0 > 20 AND by1 - by0 > 20 AND NOT (page % 3 = 1 AND (bx0 + bx1) / 2 >= 0 AND (bx0 + bx1) / 2 < 300 AND (by0 + by1) / 2 > 420 AND (by0 + by1) / 2 <= 900)")
def shown_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.when((F.col("doc_id") + F.col("box")) % 5 == 0, F.col("bx0") + 15).otherwise(F.col("bx1"))
    pages = _pages(spark, sf_dir)
    number = lambda *v: [F.lit(float(x)).alias(n) for x, n in v]
    tables = pages.select("doc_id", "page", *number((43, "tx0"), (99, "ty0"), (555, "tx1"), (787, "ty1")))
    hidden = pages.where("page % 3 = 1").select("doc_id", "page", *number((0, "rx0"), (420, "ry0"), (300, "rx1"), (900, "ry1")))
    return K.shown_boxes(_boxes(spark, sf_dir).withColumn("bx1", small), tables, hidden, ["doc_id", "page"]).select("doc_id", "page", "box", "in_table")


@query("container_order", _T + ", b AS (SELECT doc_id, page, idx % 3 AS box, idx, CASE WHEN idx % 7 <> 6 THEN y + 12 END AS y1 FROM body) SELECT doc_id, page, idx, CAST(row_number() OVER (PARTITION BY doc_id, page, box ORDER BY y1 DESC NULLS LAST, idx) AS INTEGER) AS pos FROM b")
def container_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).withColumn("box", F.col("idx") % 3).withColumn("y1", F.when(F.col("idx") % 7 != 6, F.col("y1")))
    return K.container_order(rows, ["doc_id", "page", "box"]).select("doc_id", "page", "idx", "pos")


_KINDS = "k AS (SELECT conv_id, turn, text, CASE turn % 6 WHEN 3 THEN 'image' WHEN 4 THEN 'pagebreak' WHEN 5 THEN 'needs-ocr' ELSE 'p' END AS type, role = 'system' AS header_footer, turn % 7 = 3 AS secondary, turn % 5 = 4 AS duplicate, conv_id % 3 = 0 AND turn < 2 AS front_matter FROM conversations)"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    kind = F.when(t % 6 == 3, "image").when(t % 6 == 4, "pagebreak").when(t % 6 == 5, "needs-ocr").otherwise("p")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", kind.alias("type"), (F.col("role") == "system").alias("header_footer"), (t % 7 == 3).alias("secondary"), (t % 5 == 4).alias("duplicate"), ((F.col("conv_id") % 3 == 0) & (t < 2)).alias("front_matter"))


@query("page_blocks", "WITH " + _KINDS + " SELECT conv_id, turn, type FROM k WHERE type NOT IN ('pagebreak', 'needs-ocr')")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.page_blocks(_kinds(spark, sf_dir)).select("conv_id", "turn", "type")


@query("front_matter_filter", "WITH " + _KINDS + " SELECT conv_id, turn FROM k WHERE NOT front_matter")
def front_matter_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.without_front_matter(_kinds(spark, sf_dir), Settings()).select("conv_id", "turn")


@query("editable_blocks", "WITH " + _KINDS + " SELECT conv_id, turn FROM k WHERE type = 'p' AND NOT front_matter AND NOT header_footer AND NOT secondary AND NOT duplicate AND trim(text) <> ''")
def editable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.editable(_kinds(spark, sf_dir), Settings()).select("conv_id", "turn")


@query("empty_documents", "SELECT doc_id, sum(length(coalesce(CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END, '')))::BIGINT AS chars, sum(length(coalesce(CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END, ''))) = 0 AS empty FROM documents GROUP BY doc_id")
def empty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("text")).otherwise("").alias("text"))
    return K.is_empty(rows, ["doc_id"])


@query("row_heights", "SELECT l_orderkey AS tbl, l_linenumber // 3 AS \"row\", max(l_quantity * 1.5) + 14.0 AS height FROM lineitem GROUP BY 1, 2")
def row_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tbl"), F.expr("l_linenumber div 3").cast("int").alias("row"), (F.col("l_quantity") * 1.5).alias("height"))
    return K.row_heights(cells, ["tbl"], 7.0)


@query("header_rows", "WITH s AS (SELECT l_orderkey AS tbl, l_linenumber // 2 AS \"row\", CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE l_returnflag END AS text, l_returnflag <> 'N' AS bold FROM lineitem) SELECT tbl, \"row\", coalesce(bool_and(bold) FILTER (trim(text) <> ''), false) AS header FROM s GROUP BY 1, 2")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tbl"), F.expr("l_linenumber div 2").cast("int").alias("row"), F.when(n % 3 == 0, " ").otherwise(F.col("l_returnflag")).alias("text"), (F.col("l_returnflag") != "N").alias("bold"))
    return K.header_rows(rows, ["tbl"])


@query("table_captions", "WITH g AS (SELECT o_custkey AS tbl, o_orderkey AS grp, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'Titre ' || o_custkey END AS title, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT tbl, grp, CASE WHEN title <> '' THEN title || CASE WHEN n > 1 THEN ' (' || k || '/' || n || ')' ELSE '' END WHEN n > 1 THEN 'Tableau (' || k || '/' || n || ')' ELSE '' END AS caption FROM g")
def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("Titre "), F.col("o_custkey").cast("string")))
    groups = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tbl"), F.col("o_orderkey").alias("grp"), title.alias("title"))
    return K.captions(groups, ["tbl"]).select("tbl", "grp", "caption")


@query("rough_modal_size", _T + ", k AS (SELECT doc_id, page, floor(size * 2 + 0.5) / 2 AS key, count(*) AS n, min(idx) AS seen FROM typeset GROUP BY 1, 2, 3) SELECT doc_id, page, key AS modal FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, seen) AS r FROM k) WHERE r = 1")
def rough_modal_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rough_modal_size(typeset(spark, sf_dir), ["doc_id", "page"])


@query("last_lines", "WITH " + LINES_SQL + " SELECT doc_id, line_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) IS NULL AS last, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) IS NOT NULL AS wrapped FROM lines")
def last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.last_lines(lines(spark, sf_dir), ["doc_id"], "line_no").select("doc_id", "line_no", "last", "wrapped")


@query("report_rows", _T + ", f AS (SELECT doc_id, page, count(*) AS n FROM body GROUP BY 1, 2) SELECT doc_id, page, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM f) WHERE r <= 12")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve pages of a document, which is what a report lists."""
    counts = _body(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    return K.first_of(counts, ["doc_id"], ["page"], 12)


@query("block_union", _T + ", u AS (SELECT doc_id, page, idx, 'paragraph' AS kind, 0 AS k FROM body UNION ALL SELECT doc_id, page, idx, 'secondary', 1 FROM typeset WHERE idx = -1 UNION ALL SELECT doc_id, page, idx, 'header_footer', 2 FROM typeset WHERE idx = 1000) SELECT doc_id, page, idx, kind, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY k, idx) AS INTEGER) AS pos FROM u")
def block_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typeset(spark, sf_dir).select("doc_id", "page", "idx")
    kinds = [("paragraph", rows.where(F.col("idx").between(0, 999))), ("secondary", rows.where("idx = -1")), ("header_footer", rows.where("idx = 1000"))]
    return K.block_union(kinds, ["doc_id", "page"])


@query("color_hex", "SELECT p_partkey, '#' || lpad(lower(hex((p_partkey * 7 + 3) % 256)), 2, '0') || lpad(lower(hex((p_partkey * 13 + 40) % 256)), 2, '0') || lpad(lower(hex((p_partkey * 29 + 90) % 256)), 2, '0') AS hex FROM part")
def color_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    c = F.array(*(((k * a + b) % 256).cast("double") for a, b in ((7, 3), (13, 40), (29, 90))))
    return table(spark, sf_dir, "part").select("p_partkey", K.to_hex(c).alias("hex"))


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all typeset documents: every line a block, a box around lines 5 to 9 and a ruled table below."""
    k, body = F.col("idx"), _blocks(spark, sf_dir)
    inside = k.between(20, 31)
    at = F.when(inside, 56.0 + 120 * (k % 4)).otherwise(F.col("x0"))
    low = F.when(inside, 400.0 - 30 * F.floor((k - 20) / 4)).otherwise(F.col("y0"))
    kind = F.when((F.col("page") == 0) & (k == 0), "h2").otherwise("p")
    blocks = body.select("doc_id", "page", "idx", kind.alias("type"), "text", F.col("size"), (k == 0).alias("bold"), at.alias("x0"), F.when(inside, at + 100).otherwise(F.col("x1")).alias("x1"), low.alias("y0"), (low + 16).alias("y1"))
    pages = _pages(spark, sf_dir).withColumn("width", F.lit(595.28)).withColumn("height", F.lit(841.89))
    boxes = pages.select("doc_id", "page", F.lit(0).alias("box"), F.lit(50.0).alias("x0"), F.lit(630.0).alias("y0"), F.lit(540.0).alias("x1"), F.lit(724.0).alias("y1"))
    bounds = lambda *v: F.array(*map(F.lit, v))
    tables = pages.select("doc_id", "page", F.lit(50.0).alias("x0"), F.lit(330.0).alias("y0"), F.lit(536.0).alias("x1"), F.lit(420.0).alias("y1"), bounds(420, 390, 360, 330).alias("row_bounds"), bounds(50, 170, 290, 410, 536).alias("col_bounds"))
    return P.lay_out(P.source_pages(blocks, pages, boxes, tables), Settings(font_size=24.0))


@query("document_layout")
def document_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every output page; tests hold cuts, order and sizes against their rules."""
    out = P.document_pages(laid_out(spark, sf_dir))
    return out.select("doc_id", "page", "out_number", "pos", "kind", "landscape", "x", "y", "width", "height", "box", F.size("lines").alias("n_lines"), F.size("cells").alias("n_cells"))


@query("layout_lines")
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_lines(laid_out(spark, sf_dir)).select("doc_id", "page", "out_page", "pos", "kind", "line", "x", "y", "size", "text")


@query("layout_statistics")
def layout_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.line_statistics(P.page_lines(laid_out(spark, sf_dir)))
