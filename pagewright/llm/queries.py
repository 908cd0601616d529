"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, jaccard_join, licenses, packing, quality, secrets, sharding, suffix_dedup, token_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated(_table(spark, sf_dir, "documents")).drop("uid")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"), 3, 90, 100)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_decontamination, op3_suffix_dedup, op4_secret_scan, op5_html_text, op6_kd_sharding, op7_token_store, op8_license_scan, op9_jaccard_join, op10_quality_rules)}
#: The whole result in SQL. The other operators need a tokenizer, a trained model, SimHash, a tree
#: builder, match positions or a packing; tests/llm holds those against brute force.
ORACLES: dict[str, str] = {
    "op3_suffix_dedup": r"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos + 1, pos + 50), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM w WHERE len(w) >= 50)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) > 1 AS again, count(*) OVER (PARTITION BY h) AS n FROM p),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS isle FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) < 50 THEN 0 ELSE 1 END AS new FROM r WHERE n > 1)),
spans AS (SELECT doc_id, isle, min(pos) AS a, max(pos) + 50 AS b FROM s GROUP BY 1, 2),
g AS (SELECT doc_id, isle, sum(length) AS gone FROM (SELECT doc_id, isle, least(50, coalesce(lead(pos) OVER (PARTITION BY doc_id, isle ORDER BY pos) - pos, 50)) AS length FROM s WHERE again) GROUP BY 1, 2)
SELECT doc_id, a::BIGINT AS start_word, b::BIGINT AS end_word, (b - a)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS removable_words FROM spans LEFT JOIN g USING (doc_id, isle)""",
    "op9_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(s) AS s FROM (SELECT doc_id, array_to_string(list_slice(w, k + 1, k + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 2))) AS k FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS c FROM w UNION SELECT l.y, r.c FROM reach r JOIN links l ON l.x = r.x),
least AS (SELECT x, min(c) AS c FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN least ON least.x = w.doc_id""",
}
