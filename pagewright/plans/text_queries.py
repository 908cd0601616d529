"""Text operators over the driver's tables: quality, lines, markers, hyphens, OCR clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import blocks as B
from ..operators.contained import contained_duplicates
from .adapters import LINES_SQL, lines, table
from .registry import query

_VOCABULARY = """tok AS (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ''-]+')) AS t, lang FROM documents),
vocab AS (SELECT lower(t) AS word, count(*) AS n FROM tok WHERE lang = 'fr' AND length(t) >= 3 GROUP BY 1 ORDER BY n DESC, word LIMIT 2000)"""
_QUALITY = (
    "WITH "
    + _VOCABULARY
    + """, d AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ''-]+') AS tk FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(tk) AS t FROM d),
h AS (SELECT doc_id, count(*) AS n, sum(length(t)) AS chars, count(*) FILTER (length(t) >= 3) AS longs, count(*) FILTER (length(t) >= 3 AND v.word IS NOT NULL) AS hits FROM e LEFT JOIN vocab v ON v.word = lower(t) GROUP BY doc_id),
q AS (SELECT d.doc_id, d.lang, CAST(coalesce(n, 0) AS BIGINT) AS token_count, coalesce(chars / n, 0.0)::DOUBLE AS avg_token_len, length(regexp_replace(text, '[\\p{L}\\p{N}\\s\\x{a0}]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS symbol_ratio, CASE WHEN longs > 0 THEN hits / longs::DOUBLE ELSE 0.0 END AS word_ratio FROM d LEFT JOIN h USING (doc_id)),
r AS (SELECT *, token_count > 0 AND NOT (avg_token_len < 2.5 OR (symbol_ratio > 0.20 AND word_ratio < 0.15)) AS usable FROM q)"""
)


@query("vocabulary_topk", "WITH " + _VOCABULARY + " SELECT word, n FROM vocab")
def vocabulary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.vocabulary(table(spark, sf_dir, "documents"), "fr", 2000)


@query("text_quality_by_doc", _QUALITY + " SELECT doc_id, token_count, floor(avg_token_len * 1e6 + 0.5) / 1e6 AS avg_token_len, floor(symbol_ratio * 1e6 + 0.5) / 1e6 AS symbol_ratio, floor(word_ratio * 1e6 + 0.5) / 1e6 AS word_ratio, usable FROM r")
def text_quality_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = B.text_quality(docs, B.vocabulary(docs, "fr", 2000))
    six = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return out.select("doc_id", "token_count", six("avg_token_len"), six("symbol_ratio"), six("word_ratio"), "usable")


@query("text_quality_by_lang", _QUALITY + " SELECT lang, count(*) AS documents, count(*) FILTER (usable) AS usable, sum(token_count)::BIGINT AS tokens FROM r GROUP BY lang")
def text_quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = B.text_quality(docs, B.vocabulary(docs, "fr", 2000))
    return out.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if("usable").alias("usable"), F.sum("token_count").alias("tokens"))


@query("line_explode", "WITH " + LINES_SQL + " SELECT doc_id, line_no, length(text)::BIGINT AS n FROM lines WHERE NOT regexp_full_match(text, '[\\s\\x{a0}]*')")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where(X.strip(F.col("text")) != "").select("doc_id", "line_no", F.length("text").cast("long").alias("n"))


@query("paragraph_parse", "SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, md5(unnest(p)) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n[ \\t]*\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents)")
def paragraph_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.parse_paragraphs(doubled)).alias("pos", "p")).select("doc_id", "pos", F.md5("p").alias("digest"))


_DECORATED = "WITH " + LINES_SQL + ", decorated AS (SELECT doc_id, line_no, CASE WHEN line_no % 5 = 0 THEN '• ' ELSE '' END || CASE line_no % 7 WHEN 1 THEN '★ ' WHEN 2 THEN '✂' WHEN 3 THEN '12. ' WHEN 4 THEN '➜ ' ELSE '' END || text AS text FROM lines)"


def _decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("line_no") % 7
    sign = F.when(k == 1, "★ ").when(k == 2, "✂").when(k == 3, "12. ").when(k == 4, "➜ ").otherwise("")
    return lines(spark, sf_dir).select("doc_id", "line_no", F.concat(F.when(F.col("line_no") % 5 == 0, "• ").otherwise(""), sign, F.col("text")).alias("text"))


@query("glyph_substitute", _DECORATED + " SELECT doc_id, line_no, md5(replace(replace(replace(text, '★', '*'), '✂', ''), '➜', '→')) AS digest FROM decorated")
def glyph_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decorated(spark, sf_dir).select("doc_id", "line_no", F.md5(X.substitute_glyphs(F.col("text"))).alias("digest"))


@query("list_items", _DECORATED + " SELECT doc_id, line_no, md5(regexp_replace(text, '^\\s*([•\\-–*▪]|\\d+[.)])\\s+', '')) AS digest FROM decorated WHERE regexp_matches(text, '^\\s*([•\\-–*▪]|\\d+[.)])\\s+')")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decorated(spark, sf_dir).where(X.is_list_item(F.col("text"))).select("doc_id", "line_no", F.md5(X.strip_marker(F.col("text"))).alias("digest"))


@query("embedded_marker_split", "WITH " + LINES_SQL + ", m AS (SELECT doc_id, line_no, replace(text, ', ', ' • ') AS text FROM lines) SELECT doc_id, line_no, len(string_split(regexp_replace(text, '(\\s)([•▪]\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)))::INTEGER AS pieces, md5(array_to_string(list_transform(string_split(regexp_replace(text, '(\\s)([•▪]\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: ltrim(x)), '|')) AS digest FROM m")
def embedded_marker_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = X.split_embedded_markers(F.replace(F.col("text"), F.lit(", "), F.lit(" • ")))
    return lines(spark, sf_dir).select("doc_id", "line_no", pieces.alias("p")).select("doc_id", "line_no", F.size("p").alias("pieces"), F.md5(F.array_join("p", "|")).alias("digest"))


@query("column_gap_split", "WITH " + LINES_SQL + ", s AS (SELECT doc_id, line_no, list_filter(string_split(text, '. '), lambda x: trim(x) <> '') AS p FROM lines), k AS (SELECT doc_id, line_no, p, len(p) >= 3 AND len(list_filter(p, lambda x: regexp_matches(trim(x), '\\s') OR length(trim(x)) > 12)) = 0 AS one FROM s) SELECT doc_id, line_no, CASE WHEN one THEN 1 ELSE len(p) END::INTEGER AS pieces FROM k")
def column_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split("text", r"\. "), lambda x: F.trim(x) != "")
    return lines(spark, sf_dir).select("doc_id", "line_no", F.size(X.split_gaps(parts)).alias("pieces"))


@query("hyphen_rejoin", "SELECT doc_id, md5(regexp_replace(replace(text, 'e ', 'e- '), '([a-zà-ÿ])-\\s+([a-zà-ÿ])', '\\1\\2', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def hyphen_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with a hyphen put after words in -e."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.md5(X.rejoin_hyphens(F.replace(F.col("text"), F.lit("e "), F.lit("e- ")))).alias("digest"))


@query("repeated_lines", "WITH " + LINES_SQL + " SELECT source, regexp_replace(lower(trim(text)), '\\d+', '#', 'g') AS template, count(*) AS n FROM lines WHERE trim(text) <> '' GROUP BY 1, 2 HAVING count(*) >= 3")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = lines(spark, sf_dir).where(F.trim("text") != "").select("source", X.repetition_key(F.col("text")).alias("template"))
    return keyed.groupBy("source", "template").agg(F.count("*").alias("n")).where("n >= 3")


_NOISY = "WITH " + LINES_SQL + ", noisy AS (SELECT doc_id, line_no, CASE line_no % 6 WHEN 0 THEN text || ' |_' WHEN 1 THEN '< ' || text || ' >' WHEN 2 THEN '- ' || text WHEN 3 THEN text || ' 18 Et' ELSE '( ' || text || ' ~~ )' END AS text FROM lines)"


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("line_no") % 6, F.col("text")
    text = F.when(k == 0, F.concat(t, F.lit(" |_"))).when(k == 1, F.concat(F.lit("< "), t, F.lit(" >"))).when(k == 2, F.concat(F.lit("- "), t)).when(k == 3, F.concat(t, F.lit(" 18 Et"))).otherwise(F.concat(F.lit("( "), t, F.lit(" ~~ )")))
    return lines(spark, sf_dir).select("doc_id", "line_no", text.alias("text"))


@query("ocr_noise", _NOISY + " SELECT doc_id, line_no, md5(trim(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda t: NOT regexp_full_match(t, '[_|\\\\^~`]{1,4}[()]{0,2}') AND t NOT IN ('(', ')')), ' '))) AS digest FROM noisy")
def ocr_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir).select("doc_id", "line_no", F.md5(X.clean_ocr_noise(F.col("text"))).alias("digest"))


@query("french_quotes", _NOISY + " SELECT doc_id, line_no, md5(regexp_replace(regexp_replace(text, '(^|[\\s(])<\\s*', '\\1« ', 'g'), '\\s*>([\\s.,!?;:)…]|$)', ' »\\1', 'g')) AS digest FROM noisy WHERE NOT regexp_matches(text, '>>|> >')")
def french_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir).where(~F.col("text").rlike(">>|> >")).select("doc_id", "line_no", F.md5(X.french_quotes(F.col("text"))).alias("digest"))


@query("isolated_dash", _NOISY + " SELECT doc_id, line_no, md5(regexp_replace(text, '(^|\\s)-(\\s)', '\\1—\\2', 'g')) AS digest FROM noisy")
def isolated_dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir).select("doc_id", "line_no", F.md5(X.isolated_dashes(F.col("text"))).alias("digest"))


@query("tail_residue", _NOISY + " , t AS (SELECT doc_id, line_no, text, regexp_extract(text, '[.!?…»]\\s+([^.!?…]{1,25})$', 1) AS tail FROM noisy) SELECT doc_id, line_no, md5(CASE WHEN tail <> '' AND regexp_matches(tail, '\\d') AND len(list_filter(string_split_regex(tail, '\\s+'), lambda w: w <> '')) <= 3 THEN regexp_replace(text, '([.!?…»])\\s+[^.!?…]{1,25}$', '\\1') ELSE text END) AS digest FROM t")
def tail_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir).select("doc_id", "line_no", F.md5(X.drop_tail_residue(F.col("text"))).alias("digest"))


@query("folio_drop", "WITH " + LINES_SQL + ", f AS (SELECT doc_id, line_no, text || CASE WHEN doc_id % 2 = 0 AND line_no = max(line_no) OVER (PARTITION BY doc_id) THEN ' ' || CAST(doc_id % 1000 AS VARCHAR) ELSE '' END AS text, line_no = max(line_no) OVER (PARTITION BY doc_id) AS last FROM lines) SELECT doc_id, line_no, md5(CASE WHEN last THEN regexp_replace(text, '(^|\\s)\\d{1,4}\\s*$', '') ELSE text END) AS digest FROM f WHERE NOT (last AND regexp_full_match(trim(text), '\\d{1,4}'))")
def folio_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.col("line_no") == F.max("line_no").over(Window.partitionBy("doc_id"))
    made = lines(spark, sf_dir).withColumn("last", last).withColumn("text", F.concat("text", F.when((F.col("doc_id") % 2 == 0) & F.col("last"), F.concat(F.lit(" "), (F.col("doc_id") % 1000).cast("string"))).otherwise("")))
    return B.drop_folio(made, "last").select("doc_id", "line_no", F.md5("text").alias("digest"))


@query("all_caps_headings", "WITH " + LINES_SQL + ", l AS (SELECT doc_id, line_no, text, regexp_replace(text, '[^\\p{L}]', '', 'g') AS letters, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words FROM lines) SELECT doc_id, line_no, words::INTEGER AS words FROM l WHERE length(letters) >= 2 AND letters = upper(letters) AND letters <> lower(letters) AND words BETWEEN 1 AND 5")
def all_caps_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return lines(spark, sf_dir).where(X.is_conservative_heading(t, F.lit(1), F.lit(18.0), F.lit(12.0))).select("doc_id", "line_no", X.word_count(t).alias("words"))


@query("front_matter", "WITH p AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' ISBN 978 Tous droits réservés. Dépôt légal 2001, imprimé en France. Tél. : 01 02 03 04 05' WHEN doc_id % 3 = 1 THEN ' © Éditions du lac, 75001 Paris' ELSE '' END AS text FROM documents), s AS (SELECT doc_id, " + " + ".join(f"CAST(regexp_matches(text, '{('' if k == 5 else '(?i)') + p.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for k, p in enumerate(X.FRONT_MATTER)) + " AS score FROM p) SELECT doc_id, score, score >= 3 AS flagged FROM s")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    extra = F.when(k == 0, " ISBN 978 Tous droits réservés. Dépôt légal 2001, imprimé en France. Tél. : 01 02 03 04 05").when(k == 1, " © Éditions du lac, 75001 Paris").otherwise("")
    out = table(spark, sf_dir, "documents").select("doc_id", X.front_matter_score(F.concat("text", extra)).alias("score"))
    return out.withColumn("flagged", F.col("score") >= 3)


_NORM = "regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]', '', 'g')"


@query("region_duplicates", f"WITH n AS (SELECT source, doc_id, {_NORM} AS norm FROM documents), ok AS (SELECT * FROM n WHERE length(norm) >= 10) SELECT b.doc_id, min(a.doc_id) AS duplicate_of FROM ok a JOIN ok b ON a.source = b.source AND a.doc_id < b.doc_id AND contains(a.norm, b.norm) WHERE NOT EXISTS (SELECT 1 FROM ok c WHERE c.source = a.source AND c.doc_id < a.doc_id AND contains(c.norm, a.norm)) GROUP BY b.doc_id")
def region_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_duplicates(table(spark, sf_dir, "documents"))


@query("sentence_merge", "WITH " + LINES_SQL + ", l AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 1 THEN lower(left(text, 1)) || substr(text, 2) ELSE CASE WHEN line_no % 3 = 0 THEN rtrim(text, '.') ELSE text END END AS text FROM lines), f AS (SELECT *, CASE WHEN NOT regexp_matches(lag(text) OVER w, '[.!?…:»\"][''\"’]?\\s*$') AND regexp_matches(text, '^[a-zà-ÿ]') THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM f) SELECT doc_id, CAST(min(line_no) AS INTEGER) AS first_line, count(*) AS members, md5(string_agg(CASE WHEN keep THEN rtrim(text) ELSE text END, ' ' ORDER BY line_no)) AS digest FROM (SELECT *, line_no < max(line_no) OVER (PARTITION BY doc_id, block) AS keep FROM g) GROUP BY doc_id, block")
def sentence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("line_no") % 3, F.col("text")
    made = lines(spark, sf_dir).withColumn("text", F.when(k == 1, F.concat(F.lower(F.left(t, F.lit(1))), F.substring(t, 2, 1 << 30))).when(k == 0, F.rtrim(t, F.lit("."))).otherwise(t))
    return B.merge_sentences(made).select("doc_id", "first_line", "members", F.md5("text").alias("digest"))


@query("dialogue_dash", "WITH " + LINES_SQL + ", l AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 0 THEN '— ' || text ELSE text END AS text FROM lines), e AS (SELECT *, NOT regexp_matches(trim(text), '^[—«]') AND len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) <= 8 AND line_no > 0 AS eligible FROM l), g AS (SELECT *, sum(CASE WHEN eligible THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM e) SELECT doc_id, line_no, md5(CASE WHEN eligible AND regexp_matches(trim(first_value(text) OVER (PARTITION BY doc_id, grp ORDER BY line_no)), '^—') THEN '— ' || ltrim(text) ELSE text END) AS digest FROM g")
def dialogue_dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("line_no") % 4 == 0, F.concat(F.lit("— "), "text")).otherwise(F.col("text"))
    return B.restore_dashes(lines(spark, sf_dir).withColumn("text", t)).select("doc_id", "line_no", F.md5("text").alias("digest"))


@query("block_hyphen_merge", "WITH " + LINES_SQL + ", l AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN rtrim(text, '.') || '-' WHEN line_no % 3 = 1 THEN lower(left(text, 1)) || substr(text, 2) ELSE text END AS text FROM lines), f AS (SELECT *, CASE WHEN regexp_matches(lag(text) OVER w, '[a-zà-ÿ]-$') AND regexp_matches(text, '^[a-zà-ÿ]') THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM f) SELECT doc_id, CAST(min(line_no) AS INTEGER) AS first_line, count(*) AS members, md5(string_agg(CASE WHEN more THEN left(text, length(text) - 1) ELSE text END, '' ORDER BY line_no)) AS digest FROM (SELECT *, line_no < max(line_no) OVER (PARTITION BY doc_id, block) AS more FROM g) GROUP BY doc_id, block")
def block_hyphen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("line_no") % 3, F.col("text")
    made = lines(spark, sf_dir).withColumn("text", F.when(k == 0, F.concat(F.rtrim(t, F.lit(".")), F.lit("-"))).when(k == 1, F.concat(F.lower(F.left(t, F.lit(1))), F.substring(t, 2, 1 << 30))).otherwise(t))
    return B.merge_hyphenated(made).select("doc_id", "first_line", "members", F.md5("text").alias("digest"))


@query("numbering", "WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'bullet' WHEN 'assistant' THEN 'number' ELSE 'none' END AS marker FROM conversations), i AS (SELECT *, sum(CASE WHEN marker = 'number' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS isle FROM c), n AS (SELECT conv_id, turn, marker, CASE WHEN marker = 'number' THEN row_number() OVER (PARTITION BY conv_id, isle, marker ORDER BY turn) ELSE 0 END AS n FROM i) SELECT conv_id, turn, marker, CAST(n AS INTEGER) AS n, CASE marker WHEN 'bullet' THEN '•' WHEN 'number' THEN CAST(n AS VARCHAR) || '.' ELSE '' END AS label FROM n")
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.when(F.col("role") == "user", "bullet").when(F.col("role") == "assistant", "number").otherwise("none")
    rows = B.number_paragraphs(table(spark, sf_dir, "conversations").select("conv_id", "turn", marker.alias("marker")), ["conv_id"], ["turn"])
    return rows.withColumn("label", X.marker_label(F.col("marker"), F.col("n")))


@query("output_names", "SELECT doc_id, regexp_replace(source || '.PDF', '(?i)\\.pdf$', '') || '-large-' || CAST(CAST(floor(20 + doc_id % 9 / 2.0 + 0.5) AS BIGINT) AS VARCHAR) || 'pt.pdf' AS name FROM documents")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.output_file_name(F.concat("source", F.lit(".PDF")), F.lit(20) + (F.col("doc_id") % 9) / 2.0, "large").alias("name"))
