"""Recognised trees to blocks, and blocks put in place of pages that need recognition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

#: blocks > paragraphs > lines > words, as recognisers give them.
TREE = "array<struct<blocktype: int, paragraphs: array<struct<y0: double, y1: double, lines: array<struct<words: array<string>>>>>>>"
TEXT_BLOCKS = 8


def tree_blocks(pages: DataFrame, modal: float) -> DataFrame:
    """doc_id, page, idx, type, text, rejected of recognised pages (doc_id, page, blocks as TREE).

    A page number that ends the page is dropped; lines lose noise tokens and join at hyphens; long
    paragraphs that fail the quality rule stay, marked as rejected.
    """
    paras = pages.select("doc_id", "page", F.posexplode("blocks").alias("b", "block")).where(F.col("block.blocktype").between(0, TEXT_BLOCKS)).select("doc_id", "page", "b", F.posexplode("block.paragraphs").alias("p", "para"))
    order = Window.partitionBy("doc_id", "page").orderBy("b", "p")
    paras = paras.withColumn("idx", F.row_number().over(order) - 1).withColumn("final", F.lead("b").over(order).isNull())
    words = F.transform("para.lines", lambda line: line["words"])
    last = F.element_at(F.element_at(words, -1), -1)
    folio = F.col("final") & F.trim(last).rlike(r"^\d{1,4}$")
    lines = F.transform(words, lambda w, k: F.when(folio & (k == F.size(words) - 1), F.slice(w, F.lit(1), F.size(w) - 1)).otherwise(w))
    clean = F.filter(F.transform(lines, lambda w: X.clean_ocr_noise(F.array_join(w, " "))), lambda t: t != "")
    text = X.drop_tail_residue(X.isolated_dashes(X.french_quotes(X.rejoin_hyphens(X.strip(X.join_lines(clean))))))
    rows = paras.select("doc_id", "page", "idx", text.alias("text"), F.size("para.lines").alias("n"), (F.col("para.y1") - F.col("para.y0")).alias("height")).where((F.col("text") != "") & ~F.col("text").rlike(r"^\d{1,4}$"))
    heading = X.is_conservative_heading(F.col("text"), F.col("n"), F.col("height"), F.lit(modal))
    tokens = X.tokens(F.col("text"))
    length = F.aggregate(F.transform(tokens, lambda t: F.length(t)), F.lit(0), lambda a, n: a + n) / F.size(tokens)
    bad = (F.size(tokens) == 0) | (length < 2.5) | (X.symbol_count(F.col("text")) / F.length("text") > 0.20)
    return rows.select("doc_id", "page", "idx", F.when(heading, "h2").otherwise("p").alias("type"), "text", ((X.word_count(F.col("text")) >= 12) & bad & ~heading).alias("rejected"))


def substitute(blocks: DataFrame, recognised: DataFrame) -> DataFrame:
    """Blocks with each page's ``needs-ocr`` placeholder replaced by its recognised blocks, in order."""
    native = blocks.where(F.col("type") != "needs-ocr").select("doc_id", "page", F.col("idx").alias("_a"), F.lit(0).alias("_b"), "type", "text")
    places = blocks.where(F.col("type") == "needs-ocr").select("doc_id", "page", F.col("idx").alias("_a"))
    put = recognised.where(~F.col("rejected")).select("doc_id", "page", F.col("idx").alias("_b"), "type", "text").join(places, ["doc_id", "page"])
    both = native.unionByName(put)
    return both.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "_a", "_b")) - 1).drop("_a", "_b")
