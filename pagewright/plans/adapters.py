"""Driver tables as inputs of the document model.

``documents`` are texts of lines; ``typeset`` sets each line in 80-character pieces on pages of 40,
18 points apart, with a header and a numbered footer, so that layout operators have geometry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PER_PAGE, PITCH, TOP, LEFT, ADVANCE = 40, 18.0, 800.0, 56.0, 6.0

LINES_SQL = """lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM documents WHERE text IS NOT NULL)"""
TYPESET_SQL = (
    LINES_SQL
    + """, pieces AS (SELECT doc_id, source, lang, line_no, CAST(k AS INTEGER) AS k, substr(text, CAST(80 * k + 1 AS BIGINT), 80) AS text FROM (SELECT *, unnest(range(greatest(1, CAST(ceil(length(text) / 80.0) AS BIGINT)))) AS k FROM lines)),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1 AS n FROM pieces),
body AS (SELECT doc_id, source, CAST(n // 40 AS INTEGER) AS page, CAST(n % 40 AS INTEGER) AS idx, text, 800.0::DOUBLE - 18 * (n % 40) AS y, 56.0::DOUBLE AS x0, 56.0::DOUBLE + 6 * length(text) AS x1, CASE WHEN n = 0 THEN 16.0::DOUBLE ELSE 12.0::DOUBLE END AS size FROM placed),
typeset AS (SELECT * FROM body UNION ALL SELECT DISTINCT doc_id, source, page, -1, source, 820.0::DOUBLE, 56.0::DOUBLE, 56.0::DOUBLE + 6 * length(source), 9.0::DOUBLE FROM body
UNION ALL SELECT doc_id, source, page, 1000, 'Page ' || CAST(page + 1 AS VARCHAR) || ' sur ' || CAST(max(page) OVER (PARTITION BY doc_id) + 1 AS VARCHAR), 20.0::DOUBLE, 56.0::DOUBLE, 140.0::DOUBLE, 9.0::DOUBLE FROM (SELECT DISTINCT doc_id, source, page FROM body))"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, line_no, text."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def typeset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, page, idx, text, y, x0, x1, size; headers have idx -1, footers 1000."""
    size = F.greatest(F.lit(1), F.ceil(F.length("text") / 80.0).cast("int"))
    pieces = lines(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), size - 1))).withColumn("text", F.substring("text", 80 * F.col("k") + 1, F.lit(80)))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "k")) - 1
    body = pieces.withColumn("n", n).select(
        "doc_id", "source", F.floor(F.col("n") / PER_PAGE).cast("int").alias("page"), (F.col("n") % PER_PAGE).cast("int").alias("idx"), "text",
        (F.lit(TOP) - PITCH * (F.col("n") % PER_PAGE)).alias("y"), F.lit(LEFT).alias("x0"), (F.lit(LEFT) + ADVANCE * F.length("text")).alias("x1"), F.when(F.col("n") == 0, 16.0).otherwise(12.0).alias("size"),
    )
    pages = body.groupBy("doc_id", "page").agg(F.first("source").alias("source"))
    head = pages.select("doc_id", "source", "page", F.lit(-1).alias("idx"), F.col("source").alias("text"), F.lit(820.0).alias("y"), F.lit(LEFT).alias("x0"), (F.lit(LEFT) + ADVANCE * F.length("source")).alias("x1"), F.lit(9.0).alias("size"))
    last = F.max("page").over(Window.partitionBy("doc_id")) + 1
    text = F.concat(F.lit("Page "), (F.col("page") + 1).cast("string"), F.lit(" sur "), last.cast("string"))
    foot = pages.select("doc_id", "source", "page", F.lit(1000).alias("idx"), text.alias("text"), F.lit(20.0).alias("y"), F.lit(LEFT).alias("x0"), F.lit(140.0).alias("x1"), F.lit(9.0).alias("size"))
    return body.unionByName(head).unionByName(foot)
