"""Blocks of text: quality, repetition, merging of neighbours, numbering, duplicates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X


def vocabulary(docs: DataFrame, lang: str, size: int) -> DataFrame:
    """The most frequent words of three letters or more in a language: word, n."""
    words = docs.where(F.col("lang") == lang).select(F.explode(X.tokens(F.col("text"))).alias("t")).where(F.length("t") >= 3)
    return words.groupBy(F.lower("t").alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)


def text_quality(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Token count, mean token length, symbol and vocabulary ratios, and whether the text is usable.

    Words are counted once for each document before they meet the vocabulary, so the join
    handles distinct words, not the text; its small side is a list of ``known`` size.
    """
    docs = docs.where(F.col("text").isNotNull())
    found = docs.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("t")).groupBy("doc_id", F.lower("t").alias("word"), (F.length("t") >= 3).alias("long")).agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))
    hits = found.join(known.select("word", F.lit(True).alias("hit")), "word", "left")
    sums = hits.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum(F.when(F.col("long"), F.col("n")).otherwise(0)).alias("longs"), F.sum(F.when(F.col("long") & F.col("hit"), F.col("n")).otherwise(0)).alias("hits"))
    ratio = X.symbol_count(F.col("text")) / F.greatest(F.length("text"), F.lit(1)).cast("double")
    out = docs.select("doc_id", "lang", ratio.alias("symbol_ratio")).join(sums, "doc_id", "left").select(
        "doc_id", "lang", F.coalesce("n", F.lit(0)).alias("token_count"), F.coalesce(F.col("chars") / F.col("n"), F.lit(0.0)).alias("avg_token_len"), "symbol_ratio",
        F.when(F.col("longs") > 0, F.col("hits") / F.col("longs")).otherwise(0.0).alias("word_ratio"),
    )
    bad = (F.col("avg_token_len") < 2.5) | ((F.col("symbol_ratio") > 0.20) & (F.col("word_ratio") < 0.15))
    return out.withColumn("usable", (F.col("token_count") > 0) & ~bad)


def drop_folio(lines: DataFrame, last: str) -> DataFrame:
    """Without a page number at the end of the ``last`` line; a line of nothing else goes."""
    only = F.col(last) & F.trim("text").rlike(r"^\d{1,4}$")
    return lines.where(~only).withColumn("text", F.when(F.col(last), F.regexp_replace("text", r"(^|\s)\d{1,4}\s*$", "")).otherwise(F.col("text")))


def _islands(lines: DataFrame, joins) -> DataFrame:
    """Number runs of lines: a line starts a new one unless joins(previous text, text)."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    new = F.when(F.coalesce(joins(F.lag("text").over(order), F.col("text")), F.lit(False)), 0).otherwise(1)
    return lines.withColumn("_new", new).withColumn("block", F.sum("_new").over(order))


def _merged(lines: DataFrame, end, glue: str) -> DataFrame:
    """One row a block; ``end`` maps the text of members that another follows."""
    last = F.max("line_no").over(Window.partitionBy("doc_id", "block"))
    parts = lines.withColumn("text", F.when(F.col("line_no") < last, end(F.col("text"))).otherwise(F.col("text")))
    member = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    rows = parts.groupBy("doc_id", "block").agg(F.min("line_no").alias("first_line"), F.count("*").alias("members"), member.alias("m"))
    return rows.select("doc_id", "first_line", "members", F.array_join(F.transform("m", lambda x: x["text"]), glue).alias("text"))


def merge_sentences(lines: DataFrame) -> DataFrame:
    """Join a line to the one before if that has no strong end and this starts in lower case."""
    joins = lambda a, b: ~a.rlike("[.!?…:»\"]['\"’]?\\s*$") & b.rlike("^[a-zà-ÿ]")
    return _merged(_islands(lines, joins), lambda t: F.rtrim(t), " ")


def merge_hyphenated(lines: DataFrame) -> DataFrame:
    """Join a line to the one before where a word is hyphenated between them."""
    joins = lambda a, b: a.rlike("[a-zà-ÿ]-$") & b.rlike("^[a-zà-ÿ]")
    return _merged(_islands(lines, joins), lambda t: F.expr("left(text, length(text) - 1)"), "")


def restore_dashes(lines: DataFrame, most_words: int = 8) -> DataFrame:
    """Give short lines after a dialogue dash one of their own; it cascades to further lines."""
    eligible = ~F.trim("text").rlike("^[—«]") & (X.word_count(F.col("text")) <= most_words) & (F.col("line_no") > 0)
    order = Window.partitionBy("doc_id").orderBy("line_no")
    grouped = lines.withColumn("_on", eligible).withColumn("_grp", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(order))
    head = F.first("text").over(Window.partitionBy("doc_id", "_grp").orderBy("line_no"))
    text = F.when(F.col("_on") & F.trim(head).rlike("^—"), F.concat(F.lit("— "), F.ltrim("text"))).otherwise(F.col("text"))
    return grouped.withColumn("text", text).drop("_on", "_grp")


def number_paragraphs(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add n: the running number within each run of ``number`` markers, else 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    on = F.col("marker") == "number"
    isle = rows.withColumn("_isle", F.sum(F.when(on, 0).otherwise(1)).over(w))
    n = F.when(on, F.row_number().over(Window.partitionBy(*by, "_isle", "marker").orderBy(*order))).otherwise(0)
    return isle.withColumn("n", n).drop("_isle")


@F.pandas_udf(T.StringType())
def normalize_nfd(texts: pd.Series) -> pd.Series:
    """Lower-cased letters and digits without accents (canonical decomposition)."""
    keep = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if c.isalpha() or unicodedata.category(c)[0] == "N")
    return texts.map(keep)


@F.pandas_udf(T.StringType())
def normalize_nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def normalize_nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
