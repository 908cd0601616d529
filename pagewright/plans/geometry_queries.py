"""Geometry operators over typeset documents and small computed boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as G
from .adapters import TYPESET_SQL, table, typeset
from .registry import query

WIDTH, HEIGHT = 595.28, 841.89
_T = "WITH " + TYPESET_SQL
_KEY = "regexp_replace(lower(trim(text)), '\\d+', '#', 'g') || '|' || CAST(CAST(floor(y / 10 + 0.5) AS BIGINT) AS VARCHAR)"
_LEVEL = "CASE WHEN size > 1.45 * {m} THEN 'h1' WHEN size > 1.25 * {m} THEN 'h2' WHEN size > 1.15 * {m} THEN 'h3' WHEN regexp_matches(text, '^\\s*([•\\-–*▪]|\\d+[.)])\\s+') THEN 'li' ELSE 'p' END"
_MODAL = ", mk AS (SELECT doc_id, floor(size * 2 + 0.5) / 2 AS key, sum(length(text)) AS weight, min(page * 10000 + idx) AS seen FROM body GROUP BY 1, 2), modal AS (SELECT doc_id, key AS modal FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, seen) AS r FROM mk) WHERE r = 1)"


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typeset(spark, sf_dir).where(F.col("idx").between(0, 999))


@query("typeset_lines", _T + " SELECT doc_id, page, count(*) AS n, sum(length(text))::BIGINT AS chars, max(x1) AS x1 FROM typeset GROUP BY doc_id, page")
def typeset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typeset(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("x1").alias("x1"))


@query("header_footer", _T + f", k AS (SELECT *, y < 841.89 * 0.07 OR y > 841.89 * (1 - 0.07) AS near, {_KEY} AS key FROM typeset), o AS (SELECT doc_id, key FROM k WHERE near GROUP BY 1, 2 HAVING count(*) >= 3) SELECT k.doc_id, page, idx, k.near AND (o.key IS NOT NULL OR regexp_matches(trim(text), '^\\d{{1,4}}$') OR regexp_matches(trim(text), '(?i)^((page\\s*)?\\d{{1,4}}\\s*(/|sur|of)\\s*\\d{{1,4}}|page\\s*\\d{{1,4}})$')) AS header_footer FROM k LEFT JOIN o ON o.doc_id = k.doc_id AND o.key = k.key WHERE near")
def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = (F.col("y") < HEIGHT * 0.07) | (F.col("y") > HEIGHT * 0.93)
    return G.header_footer(typeset(spark, sf_dir), HEIGHT).where(near).select("doc_id", "page", "idx", "header_footer")


@query("modal_size", _T + _MODAL + " SELECT doc_id, modal FROM modal")
def modal_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.modal_size(_body(spark, sf_dir), ["doc_id"])


@query("heading_levels", _T + _MODAL + ", l AS (SELECT " + _LEVEL.format(m="modal") + " AS type FROM body JOIN modal USING (doc_id)) SELECT type, count(*) AS n FROM l GROUP BY type")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _body(spark, sf_dir)
    rows = body.join(G.modal_size(body, ["doc_id"]), "doc_id")
    return rows.select(G.heading_level(F.col("size"), F.col("modal"), F.col("text")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query("container_headings", _T + ", b AS (SELECT doc_id, page, idx, text, size, 'p' AS type FROM body), mk AS (SELECT doc_id, page, floor(size * 2 + 0.5) / 2 AS key, sum(length(text)) AS weight, min(idx) AS seen FROM b GROUP BY 1, 2, 3), modal AS (SELECT doc_id, page, key AS m FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY weight DESC, seen) AS r FROM mk) WHERE r = 1), c AS (SELECT b.*, m, count(*) OVER (PARTITION BY doc_id, page) AS n FROM b JOIN modal USING (doc_id, page)) SELECT doc_id, page, idx, CASE WHEN n >= 2 AND size > 1.45 * m THEN 'h1' WHEN n >= 2 AND size > 1.25 * m THEN 'h2' WHEN n >= 2 AND size > 1.15 * m THEN 'h3' ELSE 'p' END AS type FROM c")
def container_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reclassify_headings(_body(spark, sf_dir).withColumn("type", F.lit("p")), ["doc_id", "page"]).select("doc_id", "page", "idx", "type")


@query("secondary_lines", _T + " SELECT doc_id, page, idx FROM typeset WHERE size < 0.75 * 12.5 AND (x0 < 595.28 * 0.08 OR x1 > 595.28 * 0.92 OR y - 0.3 * size < 841.89 * 0.08 OR y + size > 841.89 * 0.92)")
def secondary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, y = F.col("size"), F.col("y")
    return typeset(spark, sf_dir).where(G.is_secondary(size, F.lit(12.5), F.col("x0"), F.col("x1"), y - 0.3 * size, y + size, WIDTH, HEIGHT)).select("doc_id", "page", "idx")


_PARA = """, w AS (SELECT *, lag(y) OVER o AS py, lag(size) OVER o AS ps, lag(x1) OVER o AS px1, trim(lag(text) OVER o) AS pt, max(x1) OVER (PARTITION BY doc_id, page) AS rgt, row_number() OVER o AS ord FROM body WINDOW o AS (PARTITION BY doc_id, page ORDER BY y DESC, x0, idx)),
f AS (SELECT *, CASE WHEN py IS NULL OR abs(ps - size) >= 0.5 OR py - y > 1.6 * 1.2 * ps OR py - y <= 0 OR regexp_matches(text, '^\\s*([•\\-–*▪]|\\d+[.)])\\s+') OR (NOT regexp_matches(pt, '[.!?]\\s*$') AND NOT regexp_matches(ltrim(text), '^[a-zà-öø-ÿ]')) OR (ps <= 12.0 * 1.15 AND NOT regexp_matches(pt, '-$') AND rgt - px1 > 1.3 * length(string_split_regex(trim(text), '\\s+')[1]) * ((x1 - x0) / greatest(1, length(text))) + 0.3 * ps) THEN 1 ELSE 0 END AS new FROM w),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY ord) AS para FROM f)"""


_JOINED = "replace(regexp_replace(string_agg(text, chr(1) ORDER BY ord), '([a-zà-ÿ])-\\x01([a-zà-ÿ])', '\\1\\2', 'g'), chr(1), ' ')"


@query("paragraphs", _T + _PARA + " SELECT doc_id, page, CAST(para AS BIGINT) AS para, CAST(count(*) AS INTEGER) AS n_lines, arg_min(" + _LEVEL.format(m="12.0") + ", ord) AS type, min(x0) AS x0, max(x1) AS x1, min(y) - 0.3 * arg_max(size, ord) AS y0, max(y) + arg_min(size, ord) AS y1, md5(CASE WHEN arg_min(" + _LEVEL.format(m="12.0") + ", ord) = 'li' THEN regexp_replace(" + _JOINED + ", '^\\s*([•\\-–*▪]|\\d+[.)])\\s+', '') ELSE " + _JOINED + " END) AS digest FROM p GROUP BY doc_id, page, para")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.paragraphs(_body(spark, sf_dir), 12.0, ["doc_id", "page"]).withColumn("digest", F.md5("text")).drop("text")


_COL = ", c AS (SELECT doc_id, page, idx, CASE WHEN idx % 2 = 1 THEN 320.0::DOUBLE ELSE 56.0::DOUBLE END AS x0 FROM body), b AS (SELECT doc_id, page, least(19, greatest(0, CAST(floor(x0 / (595.28::DOUBLE / 20)) AS INTEGER))) AS bin, count(*) AS n FROM c GROUP BY 1, 2, 3)"


@query("column_histogram", _T + _COL + " SELECT doc_id, page, bin, n FROM b")
def column_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _columns(spark, sf_dir)
    bin_ = F.least(F.lit(19), F.greatest(F.lit(0), F.floor(F.col("x0") / (WIDTH / 20)).cast("int")))
    return rows.groupBy("doc_id", "page", bin_.alias("bin")).agg(F.count("*").alias("n"))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body(spark, sf_dir).select("doc_id", "page", "idx", "y", F.when(F.col("idx") % 2 == 1, 320.0).otherwise(56.0).alias("x0"))


@query("column_split", _T + _COL + ", t AS (SELECT *, sum(n) OVER g AS total FROM b WINDOW g AS (PARTITION BY doc_id, page)), k AS (SELECT *, n > total * 0.15 AS peak FROM t), k1 AS (SELECT *, min(bin) FILTER (peak) OVER g AS p1 FROM k WINDOW g AS (PARTITION BY doc_id, page)), k2 AS (SELECT *, max(bin) FILTER (peak AND bin - p1 > 3) OVER g AS p2 FROM k1 WINDOW g AS (PARTITION BY doc_id, page)), s AS (SELECT doc_id, page, CASE WHEN first(total) >= 6 AND first(p2) IS NOT NULL AND max(CASE WHEN bin >= p1 + 2 AND bin < p2 - 1 AND n > total * 0.05 THEN 1 ELSE 0 END) = 0 THEN 0.0 + (first(p1) + first(p2)) / 2 * (595.28::DOUBLE / 20) END AS sx FROM k2 GROUP BY 1, 2), z AS (SELECT c.doc_id, c.page, first(sx) AS sx, count(*) FILTER (x0 < sx) AS l, count(*) FILTER (x0 >= sx) AS r FROM c JOIN s USING (doc_id, page) GROUP BY 1, 2) SELECT doc_id, page, CASE WHEN l >= 3 AND r >= 3 THEN sx END AS split_x FROM z")
def column_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.column_split(_columns(spark, sf_dir), ["doc_id", "page"], 0.0, WIDTH)


@query("column_band", _T + ", bounds AS (SELECT unnest([100.0, 300.0, 320.0])::DOUBLE AS bx, unnest([0.0, 200.0, 500.0])::DOUBLE AS by0, unnest([900.0, 700.0, 790.0])::DOUBLE AS by1) SELECT doc_id, page, idx, (SELECT count(*) FROM bounds WHERE bx <= x0 AND y >= by0 - 2 AND y <= by1 + 2) AS band FROM (SELECT doc_id, page, idx, y, CASE WHEN idx % 2 = 1 THEN 320.0 ELSE 56.0 END AS x0 FROM body)")
def column_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _columns(spark, sf_dir).withColumn("k", F.lit(1))
    bounds = spark.sql("SELECT 1 AS k, CAST(bx AS DOUBLE) bx, CAST(by0 AS DOUBLE) by0, CAST(by1 AS DOUBLE) by1 FROM VALUES (100, 0, 900), (300, 200, 700), (320, 500, 790) AS t(bx, by0, by1)")
    return G.column_band(rows, bounds, ["k"]).select("doc_id", "page", "idx", "band")


_BOXES_SQL = ", boxes AS (SELECT doc_id, page, k::INTEGER AS box, 40.0::DOUBLE + 5 * k AS bx0, 560.0::DOUBLE - 20 * k AS bx1, 60.0::DOUBLE + 40 * k AS by0, 790.0::DOUBLE - 30 * k AS by1 FROM (SELECT DISTINCT doc_id, page FROM body), range(4) AS r(k))"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("box")
    pages = _body(spark, sf_dir).select("doc_id", "page").distinct().withColumn("box", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return pages.select("doc_id", "page", "box", (40.0 + 5 * k).alias("bx0"), (560.0 - 20 * k).alias("bx1"), (60.0 + 40 * k).alias("by0"), (790.0 - 30 * k).alias("by1"))


@query("container_assign", _T + _BOXES_SQL + ", h AS (SELECT b.doc_id, b.page, b.idx, arg_min(box, (bx1 - bx0) * (by1 - by0) * 100 + box) AS box FROM body b JOIN boxes c ON b.doc_id = c.doc_id AND b.page = c.page AND x0 >= bx0 - 2 AND x1 <= bx1 + 2 AND y >= by0 - 2 AND y <= by1 + 2 GROUP BY 1, 2, 3) SELECT b.doc_id, b.page, b.idx, h.box FROM body b LEFT JOIN h ON b.doc_id = h.doc_id AND b.page = h.page AND b.idx = h.idx")
def container_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.to_containers(_body(spark, sf_dir), _boxes(spark, sf_dir), ["doc_id", "page"]).select("doc_id", "page", "idx", "box")


@query("box_wrappers", _T + _BOXES_SQL + ", p AS (SELECT a.doc_id, a.page, a.box AS \"outer\", b.box AS \"inner\", (b.bx0 - a.bx0 + a.bx1 - b.bx1 + b.by0 - a.by0 + a.by1 - b.by1) / 4 AS pad, count(*) OVER (PARTITION BY a.doc_id, a.page, a.box) AS n FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page AND a.box <> b.box AND a.bx0 <= b.bx0 AND a.bx1 >= b.bx1 AND a.by0 <= b.by0 AND a.by1 >= b.by1) SELECT doc_id, page, \"outer\", \"inner\", pad FROM p WHERE n = 1")
def box_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.wrappers(_boxes(spark, sf_dir), ["doc_id", "page"])


@query("cell_fills", _T + _BOXES_SQL + ", cells AS (SELECT DISTINCT doc_id, page, idx AS cell, 56.0::DOUBLE AS x0, 300.0::DOUBLE AS x1, 700.0::DOUBLE - 17 * idx AS y0, 720.0::DOUBLE - 17 * idx AS y1 FROM body), h AS (SELECT c.doc_id, c.page, cell, min(box) AS box FROM cells c JOIN boxes b ON b.doc_id = c.doc_id AND b.page = c.page AND greatest(0.0, least(x1, bx1) - greatest(x0, bx0)) * greatest(0.0, least(y1, by1) - greatest(y0, by0)) > 0.5 * (x1 - x0) * (y1 - y0) GROUP BY 1, 2, 3) SELECT c.doc_id, c.page, c.cell, h.box FROM cells c LEFT JOIN h ON h.doc_id = c.doc_id AND h.page = c.page AND h.cell = c.cell")
def cell_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("idx")
    cells = _body(spark, sf_dir).select("doc_id", "page", k.alias("cell"), F.lit(56.0).alias("x0"), F.lit(300.0).alias("x1"), (700.0 - 17 * k).alias("y0"), (720.0 - 17 * k).alias("y1"))
    return G.cell_fills(cells, _boxes(spark, sf_dir), ["doc_id", "page"]).select("doc_id", "page", "cell", "box")


@query("table_titles", _T + _BOXES_SQL + ", g AS (SELECT b.doc_id, b.page, box, arg_min(idx, (y - by1) * 1000 + idx) AS heading FROM boxes b JOIN body h ON h.doc_id = b.doc_id AND h.page = b.page AND y - by1 BETWEEN -4 AND 150 AND x0 < bx1 AND x1 > bx0 GROUP BY 1, 2, 3) SELECT * FROM g")
def table_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _body(spark, sf_dir).select("doc_id", "page", F.col("idx").alias("heading"), F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y").alias("hy0"))
    return G.titles(_boxes(spark, sf_dir), heads, ["doc_id", "page"])


@query("overlap_pairs", _T + ", i AS (SELECT doc_id, page, idx, x0, x1, y - 8 AS y0, y + 14 AS y1 FROM body) SELECT a.doc_id, a.page, a.idx AS first, b.idx AS second FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.page = b.page AND a.idx < b.idx AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 1 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 1")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _body(spark, sf_dir).select("doc_id", "page", "idx", "x0", "x1", (F.col("y") - 8).alias("y0"), (F.col("y") + 14).alias("y1"))
    return G.overlap_pairs(items, ["doc_id", "page"])


@query("cut_groups", _T + ", s AS (SELECT doc_id, idx AS line, 40.0::DOUBLE + page * 30 + length(text) % 7 AS x0, 40.0::DOUBLE + page * 30 + 12 + length(text) % 13 AS x1 FROM body), r AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, line ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), c AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS chain FROM r) SELECT doc_id, line, CAST(chain AS BIGINT) AS chain, min(x0) AS x0, max(x1) AS x1, count(*) AS members FROM c GROUP BY 1, 2, 3")
def cut_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = 40.0 + 30 * F.col("page")
    segments = _body(spark, sf_dir).select("doc_id", F.col("idx").alias("line"), (base + F.length("text") % 7).alias("x0"), (base + 12 + F.length("text") % 13).alias("x1"))
    return G.cut_groups(segments, ["doc_id", "line"])


@query("gap_segments", _T + ", i AS (SELECT doc_id, page, idx, 50.0::DOUBLE + 40 * (idx % 12) + length(text) % 9 AS x0, 50.0::DOUBLE + 40 * (idx % 12) + length(text) % 37 AS x1, size, idx // 12 AS line FROM body), r AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page, line ORDER BY x0, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i) SELECT doc_id, page, idx, CAST(sum(CASE WHEN x0 - reach > greatest(15.0, 1.8 * size) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line ORDER BY x0, idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment FROM r")
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = 50.0 + 40 * (F.col("idx") % 12)
    items = _body(spark, sf_dir).select("doc_id", "page", "idx", (at + F.length("text") % 9).alias("x0"), (at + F.length("text") % 37).alias("x1"), "size", F.floor(F.col("idx") / 12).alias("line"))
    return G.gap_segments(items, ["doc_id", "page", "line"]).select("doc_id", "page", "idx", "segment")


@query("wide_table_groups", "WITH r AS (SELECT o_custkey AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row, o_orderkey FROM orders), c AS (SELECT t, row, row % 4 = 1 AS header, unnest(range(1, 8)) AS col FROM r), m AS (SELECT *, sum(CASE WHEN header AND col = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY t) AS n, sum(CASE WHEN header AND col = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY row) AS k FROM c) SELECT t, CAST(row AS INTEGER) AS row, CAST(CASE WHEN n >= 2 THEN greatest(1, k) ELSE 1 END AS INTEGER) AS block, CAST(col AS INTEGER) AS column_no, CAST((col - 1) // 3 AS INTEGER) AS column_group FROM m")
def wide_table_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("t"), row.alias("row"))
    names = F.array(F.lit("pronoun"), *(F.lit(f"verb {k}") for k in range(1, 8)))
    cells = F.when(F.col("row") % 4 == 1, F.transform(names, lambda x: F.upper(x))).otherwise(names)
    out = G.wide_table_groups(rows.withColumn("cells", cells), ["t"])
    return out.select("t", "row", "block", F.col("column").alias("column_no"), F.col("group").alias("column_group"))


@query("row_headers", "WITH c AS (SELECT l_orderkey AS t, CASE l_returnflag WHEN 'A' THEN 'je / j''' WHEN 'N' THEN 'nous' ELSE 'il/elle' END AS label, CASE WHEN l_linenumber % 5 = 0 THEN '' WHEN l_returnflag = 'A' THEN 'J''ai' WHEN l_returnflag = 'N' THEN 'nous avons' WHEN l_linenumber % 3 = 0 THEN 'tu as' ELSE 'Elle a' END AS text FROM lineitem) SELECT t, bool_and(len(list_filter(string_split(lower(label), '/'), lambda x: starts_with(lower(trim(text)), trim(x)))) > 0) AND count(*) >= 2 AS redundant FROM c WHERE trim(text) <> '' GROUP BY t")
def row_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    label = F.when(flag == "A", "je / j'").when(flag == "N", "nous").otherwise("il/elle")
    text = F.when(n % 5 == 0, "").when(flag == "A", "J'ai").when(flag == "N", "nous avons").when(n % 3 == 0, "tu as").otherwise("Elle a")
    return G.row_header_is_redundant(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), label.alias("label"), text.alias("text")), ["t"])


@query("column_widths", "WITH c AS (SELECT l_orderkey AS t, l_linenumber AS col, l_quantity * 4 AS want, 20.0 + l_quantity AS least FROM lineitem), r AS (SELECT *, greatest(want, least) AS raw FROM c), s AS (SELECT *, sum(raw) OVER (PARTITION BY t) - 400 AS over, raw - least AS slack, sum(raw - least) OVER (PARTITION BY t) AS total, sum(least) OVER (PARTITION BY t) AS mins FROM r) SELECT t, col, floor(CASE WHEN over <= 0 THEN raw WHEN total >= over THEN raw - slack * over / nullif(total, 0.0) ELSE least * 400 / mins END * 1e4 + 0.5) / 1e4 AS width FROM s")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("col"), (F.col("l_quantity") * 4).alias("want"), (20.0 + F.col("l_quantity")).alias("least"))
    return G.shrink_columns(columns, ["t"], 400.0).select("t", "col", (F.floor(F.col("width") * 1e4 + 0.5) / 1e4).alias("width"))
