"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, secrets, packing.

Every stage takes all that its predecessor kept, as a written table. A row is told apart by
its id and text together, so null and repeated ids do no harm.

Edge cases, for all stages: a null or empty text has no words, so the quality rules reject it; given to a later
stage by itself, it is in no group of near copies, holds no item and no secret, and packs as its end id alone.
Very long texts are handled whole. Of rows alike in id and text the near-duplicate stage keeps one; the others keep or
reject them alike. Of ties the smallest id stays, null ids last. Other columns pass through, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, jaccard_join, packing, quality, secrets
from pagewright.llm._scratch import drop, written
from pagewright.llm._tokens import CACHE

#: SQL has no SimHash, trained vocabulary or packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


#: So many rejected rows at most are broadcast, 8 bytes each; more meet the documents in a shuffle.
FEW = 500_000


def _uid() -> Column:
    return F.xxhash64("doc_id", "text")


def _as_rows(docs: DataFrame) -> DataFrame:
    """The operators' view of documents, with the row's fingerprint as its id."""
    return docs.withColumn("doc_id", _uid())


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    gone = written(rejected.select(F.col("doc_id").alias("uid")).distinct(), "rejected")
    few = F.broadcast(gone) if gone.count() <= FEW else gone
    kept = docs.select(F.struct("*").alias("row"), _uid().alias("uid")).join(few, "uid", "left_anti")
    return kept.select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _without(docs, quality.judge(_as_rows(docs)).where("NOT kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, 0.8).

    Rows are joined by their fingerprints, so each has its own verdict where ids are null or repeat; a
    null id comes last in its group. Documents with an empty set are in no group. Of rows alike in id and
    text one stays.
    """
    found = jaccard_join.join(_as_rows(docs), 5, 80, 100).select(F.col("doc_id").alias("uid"), "component_id").distinct()
    named = written(docs.select("doc_id", _uid().alias("uid")).distinct().join(found, "uid"), "named")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"].alias("uid"))
    kept = _without(docs, named.join(first, "uid", "left_anti").select(F.col("uid").alias("doc_id")))
    return kept.select(F.struct("*").alias("row"), "doc_id", _uid().alias("uid")).dropDuplicates(["doc_id", "uid"]).select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontaminate.matches(_as_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placed token pieces of all documents."""
    return packing.pack_documents(docs, remembered=CACHE)  # workers hold what four stages left


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:  # a stage's result goes when the next one's is stored; the input stays
            drop(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
