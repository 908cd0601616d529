"""Quality metrics between a source and an output, and their regression rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X


def coverage(source: DataFrame, output: DataFrame, by: str) -> DataFrame:
    """by, coverage, duplication, from texts: shares of source words that the output keeps, and repeats beyond."""
    count = lambda df, n: df.select(by, F.explode(X.metric_words(F.col("text"))).alias("w")).groupBy(by, "w").agg(F.count("*").alias(n))
    both = count(source, "a").join(count(output, "b"), [by, "w"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    sums = both.groupBy(by).agg(F.sum(F.least(a, b)).alias("kept"), F.sum(F.greatest(b - a, F.lit(0))).alias("more"), F.sum(a).alias("n"))
    share = lambda c, empty: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(F.lit(empty))
    return source.select(by).distinct().join(sums, by, "left").select(by, share("kept", 1.0).alias("coverage"), share("more", 0.0).alias("duplication"))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row at a time over numpy."""
    if not len(a) or not len(b):
        return 0
    codes = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([codes[w] for w in b])
    row = np.zeros(len(y) + 1, np.int32)
    for w in a:
        hit = row[:-1] + (y == codes[w])
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], hit))
    return int(row[-1])


@F.pandas_udf(T.DoubleType())
def word_order(source: pd.Series, output: pd.Series) -> pd.Series:
    """Share of source words in the longest common subsequence with the output."""
    return pd.Series([1.0 if not len(a) else lcs_length(list(a), list(b)) / len(a) for a, b in zip(source, output)])


def bigram_pairs(items: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs of texts whose bigram multisets have a Dice similarity of ``least`` or more.

    Bigrams meet on an equi-join; a pair's lengths alone bound its similarity, so pairs whose
    bound is too low go before the sum.
    """
    low = items.select(key, F.lower("text").alias("t")).where(F.length("t") >= 2)
    grams = low.select(key, F.length("t").alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda k: F.substring(F.col("t"), k, F.lit(2)))).alias("g"))
    counted = grams.groupBy(key, "len", "g").agg(F.count("*").alias("n"))
    a, b = counted.select(F.col(key).alias("first"), F.col("len").alias("la"), "g", F.col("n").alias("na")), counted.select(F.col(key).alias("second"), F.col("len").alias("lb"), "g", F.col("n").alias("nb"))
    bound = 2 * (F.least("la", "lb") - 1) / (F.col("la") + F.col("lb") - 2)
    met = a.join(b, "g").where((F.col("first") < F.col("second")) & (bound >= least))
    sums = met.groupBy("first", "second", "la", "lb").agg((2 * F.sum(F.least("na", "nb")) / (F.col("la") + F.col("lb") - 2)).alias("dice"))
    return sums.where(F.col("dice") >= least).select("first", "second", "dice")


def regressions(reference: DataFrame, current: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """nom, rules: the names of the rules that a document's metrics break; exempt names are left out."""
    r, c = reference.alias("r"), current.alias("c")
    ref, cur = (lambda k: F.col(f"r.{k}")), (lambda k: F.col(f"c.{k}"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    more = lambda k: zero(cur(k)) > zero(ref(k))
    rules = {
        "couverture": cur("couverture") < ref("couverture") - 1e-9,
        "ordre": cur("ordre") < ref("ordre") - 0.02,
        "duplication": cur("duplication") > ref("duplication") + 1e-9,
        "debordement": zero(cur("debordement_cadre")) + zero(cur("debordement_zone_utile")) > zero(ref("debordement_cadre")) + zero(ref("debordement_zone_utile")),
        **{k: more(k) for k in ("n_sous_contraste", "n_glyphes_absents", "n_sous_20pt")},
        "statut": (ref("statut") == "ok") & (cur("statut") != "ok"),
        "pages": cur("pages") > ref("pages") + 1,
    }
    broken = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())), lambda x: x.isNotNull())
    out = r.join(c, F.col("r.nom") == F.col("c.nom")).select(F.col("r.nom").alias("nom"), broken.alias("rules")).where(F.size("rules") > 0)
    return out.where(~F.col("nom").isin(exempt)) if exempt else out


def missing_characters(texts: DataFrame, covered: DataFrame) -> DataFrame:
    """Distinct characters above space that the output font lacks, with how often they occur."""
    used = texts.select(F.explode(F.split("text", "")).alias("ch")).where(F.col("ch") > " ").groupBy("ch").agg(F.count("*").alias("n"))
    return used.join(covered, "ch", "left_anti")


def median_line_length(items: DataFrame, by: list[str]) -> DataFrame:
    """Median length of lines put together from items of nearly equal height."""
    key = F.floor(F.col("y") / 2 + 0.5)
    lines = items.groupBy(*by, "page", key.alias("row")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "idx", "text"))), lambda x: x["text"]), "").alias("text"))
    return lines.select(*by, F.length(F.trim("text")).alias("n")).where("n > 0").groupBy(*by).agg(F.percentile("n", 0.5).alias("median"))


def page_fill(items: DataFrame, by: list[str], top: float, bottom: float) -> DataFrame:
    low = F.min("y").alias("low")
    return items.groupBy(*by, "page").agg(low).select(*by, "page", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (top - F.col("low")) / (top - bottom))).alias("fill"))


def overflow(items: DataFrame, by: list[str], width: float, height: float, margin: float, slack: float = 0.5) -> DataFrame:
    """Items beyond the page, items beyond its margins, the least size, items under 20 points."""
    beyond = lambda m: (F.col("x0") < m - slack) | (F.col("x1") > width - m + slack) | (F.col("y") < m - slack) | (F.col("y") > height - m + slack)
    return items.groupBy(*by).agg(F.count_if(beyond(0.0)).alias("frame"), F.count_if(beyond(margin)).alias("usable"), F.min("size").alias("least_size"), F.count_if((F.col("size") < 20) & (F.trim("text") != "")).alias("small"))


def index_percentile(values: Column, p: float) -> Column:
    """The value at place floor(n p) of the sorted array; no interpolation."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * p).cast("int")))


def stretch(values: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Values stretched so that the two percentiles become 0 and 255."""
    a, b = index_percentile(values, low), index_percentile(values, high)
    return F.transform(values, lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v - a) * 255.0 / F.greatest(b - a, F.lit(1.0)))))


def otsu(bins: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold: the bin that parts a histogram (bin, n) with the largest variance between."""
    w = Window.partitionBy(*by)
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    n, s = F.sum("n").over(upto), F.sum(F.col("n") * F.col("bin")).over(upto)
    total, whole = F.sum("n").over(w), F.sum(F.col("n") * F.col("bin")).over(w)
    parts = bins.select(*by, "bin", n.alias("a"), (total - n).alias("b"), s.alias("s"), (whole - s).alias("t")).where("a > 0 AND b > 0")
    between = F.col("a").cast("double") * F.col("b") * F.pow(F.col("s") / F.col("a") - F.col("t") / F.col("b"), F.lit(2.0))
    best = Window.partitionBy(*by).orderBy(F.desc(between), "bin")
    return parts.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*by, F.col("bin").alias("threshold"))
