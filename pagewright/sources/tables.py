"""Word lists, manifests and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: The metric columns that a stored reference keeps.
REFERENCE = ("nom", "famille", "statut", "pages", "couverture", "ordre", "duplication", "debordement_cadre", "debordement_zone_utile", "n_sous_contraste", "n_glyphes_absents", "n_sous_20pt")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lower-case words of a text file, a word a line."""
    return spark.read.text(path).select(F.lower(X.strip(F.col("value"))).alias("word")).where("word <> ''").distinct()


def manifest(spark: SparkSession, path: str, families: DataFrame, own: DataFrame) -> DataFrame:
    """PDF files under a folder with family (their folder) and all capabilities of family and file.

    families: famille, capacites; own: nom, capacites.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "length")
    named = files.select("path", "length", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("famille"), F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("nom"))
    joined = named.join(families.withColumnRenamed("capacites", "_f"), "famille", "left").join(own.withColumnRenamed("capacites", "_o"), "nom", "left")
    empty = F.array().cast("array<string>")
    return joined.select("path", "famille", "nom", "length", F.array_sort(F.array_union(F.coalesce("_f", empty), F.coalesce("_o", empty))).alias("capacites"))


def write_metrics(metrics: DataFrame, path: str, reference: bool = False) -> None:
    """Metric rows as JSON; a reference keeps the listed columns only."""
    (metrics.select([c for c in REFERENCE if c in metrics.columns]) if reference else metrics).write.mode("overwrite").json(path)
