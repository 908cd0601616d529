"""Metrics, colours, settings and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import color as C
from ..functions import text as X
from ..operators import metrics as M
from .adapters import LINES_SQL, TYPESET_SQL, lines, table, typeset
from .registry import query

_T = "WITH " + TYPESET_SQL


def _six(c: str):
    return (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)


_W = "list_filter(string_split_regex(regexp_replace(lower({t}), '\\p{{P}}', ' ', 'g'), '\\s+'), lambda w: w <> '')"


@query("coverage_duplication", "WITH o AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 400) WHEN doc_id % 3 = 1 THEN text || ' ' || substr(text, 1, 100) ELSE text END AS text FROM documents), a AS (SELECT doc_id, w, count(*) AS a FROM (SELECT doc_id, unnest(" + _W.format(t="text") + ") AS w FROM documents) GROUP BY 1, 2), b AS (SELECT doc_id, w, count(*) AS b FROM (SELECT doc_id, unnest(" + _W.format(t="text") + ") AS w FROM o) GROUP BY 1, 2), s AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, sum(least(coalesce(a, 0), coalesce(b, 0))) AS kept, sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0)) AS more, sum(coalesce(a, 0)) AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.w = b.w GROUP BY 1) SELECT d.doc_id, CASE WHEN n > 0 THEN floor(kept / n::DOUBLE * 1e6 + 0.5) / 1e6 ELSE 1.0 END AS coverage, CASE WHEN n > 0 THEN floor(more / n::DOUBLE * 1e6 + 0.5) / 1e6 ELSE 0.0 END AS duplication FROM documents d LEFT JOIN s USING (doc_id)")
def coverage_duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    k, head = F.col("doc_id") % 3, lambda n: F.substring("text", 1, n)
    out = docs.withColumn("text", F.when(k == 0, head(400)).when(k == 1, F.concat("text", F.lit(" "), head(100))).otherwise(F.col("text")))
    return M.coverage(docs, out, "doc_id").select("doc_id", _six("coverage"), _six("duplication"))


@query("word_order")
def word_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: the longest common subsequence isn't SQL's; tests hold it against a plain table."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    words = X.metric_words(F.col("text"))
    half = F.floor(F.size(words) / 2).cast("int")
    moved = F.concat(F.slice(words, half + 1, F.size(words)), F.slice(words, F.lit(1), half))
    return docs.select("doc_id", M.word_order(words, moved).alias("word_order"))


_GRAMS = "g AS (SELECT item_id, length(text) AS len, substr(lower(text), CAST(unnest(range(1, length(text))) AS BIGINT), 2) AS g FROM benchmark WHERE length(text) >= 2), c AS (SELECT item_id, len, g, count(*) AS n FROM g GROUP BY 1, 2, 3)"


@query("dice_pairs", "WITH " + _GRAMS + ", s AS (SELECT a.item_id AS first, b.item_id AS second, 2 * sum(least(a.n, b.n)) / (a.len + b.len - 2)::DOUBLE AS dice FROM c a JOIN c b ON a.g = b.g AND a.item_id < b.item_id GROUP BY a.item_id, b.item_id, a.len, b.len) SELECT first, second, floor(dice * 1e6 + 0.5) / 1e6 AS dice FROM s WHERE dice >= 0.35")
def dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bigram_pairs(table(spark, sf_dir, "benchmark"), "item_id", 0.35).select("first", "second", _six("dice"))


_METRICS = "CAST(c_custkey AS VARCHAR) AS nom, CASE WHEN c_custkey % 11 = {k} THEN 'erreur' ELSE 'ok' END AS statut, floor((c_custkey + {k}) % 7) / 8.0 AS couverture, ((c_custkey * 3 + {k}) % 9) / 9.0 AS ordre, ((c_custkey + {k} * 2) % 5) / 10.0 AS duplication, (c_custkey + {k}) % 2 AS debordement_cadre, c_custkey % 3 AS debordement_zone_utile, (c_custkey + {k}) % 4 AS n_sous_contraste, c_custkey % 2 AS n_glyphes_absents, (c_custkey + {k} * 3) % 6 AS n_sous_20pt, (c_custkey + {k} * 5) % 8 AS pages"


@query("regression_rules", "WITH r AS (SELECT " + _METRICS.format(k=0) + " FROM customer), c AS (SELECT " + _METRICS.format(k=1) + " FROM customer), x AS (SELECT r.nom, list_filter([CASE WHEN c.couverture < r.couverture - 1e-9 THEN 'couverture' END, CASE WHEN c.ordre < r.ordre - 0.02 THEN 'ordre' END, CASE WHEN c.duplication > r.duplication + 1e-9 THEN 'duplication' END, CASE WHEN c.debordement_cadre + c.debordement_zone_utile > r.debordement_cadre + r.debordement_zone_utile THEN 'debordement' END, CASE WHEN c.n_sous_contraste > r.n_sous_contraste THEN 'n_sous_contraste' END, CASE WHEN c.n_glyphes_absents > r.n_glyphes_absents THEN 'n_glyphes_absents' END, CASE WHEN c.n_sous_20pt > r.n_sous_20pt THEN 'n_sous_20pt' END, CASE WHEN r.statut = 'ok' AND c.statut <> 'ok' THEN 'statut' END, CASE WHEN c.pages > r.pages + 1 THEN 'pages' END], lambda x: x IS NOT NULL) AS rules FROM r JOIN c ON r.nom = c.nom) SELECT nom, array_to_string(rules, ',') AS rules FROM x WHERE len(rules) > 0 AND nom NOT IN ('3', '5')")
def regression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    made = [rows.selectExpr(*_split(_METRICS.format(k=k).replace("VARCHAR", "STRING"))) for k in (0, 1)]
    return M.regressions(*made, exempt=["3", "5"]).select("nom", F.array_join("rules", ",").alias("rules"))


def _split(sql: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, ch in enumerate(sql):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(sql[start:k])
            start = k + 1
    return [*out, sql[start:]]


@query("status_counts", "SELECT CASE WHEN doc_id % 11 = 0 THEN 'erreur-js' WHEN doc_id % 13 = 0 THEN 'sans-sortie' ELSE 'ok' END AS statut, count(*) AS n FROM documents GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").groupBy(F.when(k % 11 == 0, "erreur-js").when(k % 13 == 0, "sans-sortie").otherwise("ok").alias("statut")).agg(F.count("*").alias("n"))


@query("median_line_length", _T + ", l AS (SELECT doc_id, page, floor(y / 2 + 0.5) AS row, string_agg(text, '' ORDER BY x0, idx) AS text FROM typeset GROUP BY 1, 2, 3) SELECT doc_id, median(length(trim(text)))::DOUBLE AS median FROM l WHERE length(trim(text)) > 0 GROUP BY doc_id")
def median_line_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.median_line_length(typeset(spark, sf_dir), ["doc_id"])


@query("fill_rate", _T + " SELECT doc_id, page, floor(least(1.0, greatest(0.0, (785.2 - min(y)) / (785.2 - 56.7))) * 1e6 + 0.5) / 1e6 AS fill FROM body GROUP BY doc_id, page")
def fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.page_fill(typeset(spark, sf_dir).where(F.col("idx").between(0, 999)), ["doc_id"], 785.2, 56.7).select("doc_id", "page", _six("fill"))


@query("overflow_counts", _T + " SELECT doc_id, count(*) FILTER (x0 < -0.5 OR x1 > 595.78 OR y < -0.5 OR y > 842.39) AS frame, count(*) FILTER (x0 < 56.2 OR x1 > 539.08 OR y < 56.2 OR y > 785.69) AS usable, min(size) AS least_size, count(*) FILTER (size < 20 AND trim(text) <> '') AS small FROM typeset GROUP BY doc_id")
def overflow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overflow(typeset(spark, sf_dir), ["doc_id"], 595.28, 841.89, 56.7)


@query("missing_characters", "WITH u AS (SELECT unnest(string_split(text, '')) AS ch FROM documents) SELECT ch, count(*) AS n FROM u WHERE ch > ' ' AND NOT regexp_matches(ch, '[!-~]') GROUP BY ch")
def missing_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = spark.range(0x21, 0x7F).select(F.chr("id").alias("ch"))
    return M.missing_characters(table(spark, sf_dir, "documents"), covered)


def _colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    channel = lambda a, b: ((k * a + b) % 256).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.array(channel(7, 3), channel(13, 40), channel(29, 90)).alias("c"), F.when(k % 2 == 0, F.array(*[F.lit(255.0)] * 3)).otherwise(F.array(F.lit(10.0), F.lit(26.0), F.lit(60.0))).alias("bg"))


_CHANNEL = "CASE WHEN {v} / 255 <= 0.03928 THEN {v} / 255 / 12.92 ELSE pow(({v} / 255 + 0.055) / 1.055, 2.4) END"
_LUM = lambda c: "(" + " + ".join(f"{w} * (" + _CHANNEL.format(v=f"{c}[{k + 1}]") + ")" for k, w in enumerate((0.2126, 0.7152, 0.0722))) + ")"
_COLORS = "k AS (SELECT p_partkey, [((p_partkey * 7 + 3) % 256)::DOUBLE, ((p_partkey * 13 + 40) % 256)::DOUBLE, ((p_partkey * 29 + 90) % 256)::DOUBLE] AS c, CASE WHEN p_partkey % 2 = 0 THEN [255.0, 255.0, 255.0]::DOUBLE[] ELSE [10.0, 26.0, 60.0]::DOUBLE[] END AS bg FROM part)"
_RATIO = lambda a, b: f"((greatest({_LUM(a)}, {_LUM(b)}) + 0.05) / (least({_LUM(a)}, {_LUM(b)}) + 0.05))"


@query("contrast_ratio", "WITH " + _COLORS + " SELECT p_partkey, floor(" + _RATIO("c", "bg") + " * 1e6 + 0.5) / 1e6 AS ratio FROM k")
def contrast_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _colors(spark, sf_dir).select("p_partkey", C.contrast(F.col("c"), F.col("bg")).alias("ratio")).select("p_partkey", _six("ratio"))


_ENSURED = ", t AS (SELECT *, CASE WHEN " + _LUM("bg") + " > 0.18 THEN 0.0::DOUBLE ELSE 255.0::DOUBLE END AS tg FROM k), s AS (SELECT p_partkey, c, bg, tg, unnest(range(0, 21)) AS n FROM t), m AS (SELECT p_partkey, bg, n, tg, CASE WHEN n = 0 THEN c ELSE list_transform(c, lambda v: floor(v + (tg - v) * (n * 0.05::DOUBLE) + 0.5)) END AS x FROM s), ok AS (SELECT p_partkey, arg_min(x, n) AS x FROM m WHERE " + _RATIO("x", "bg") + " >= 5.0 GROUP BY 1)"


@query("ensure_contrast", "WITH " + _COLORS + _ENSURED + " SELECT k.p_partkey, coalesce(x[1], 0) AS r, coalesce(x[2], 0) AS g, coalesce(x[3], 0) AS b FROM k LEFT JOIN ok ON ok.p_partkey = k.p_partkey")
def ensure_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _colors(spark, sf_dir).select("p_partkey", C.ensure_contrast(F.col("c"), F.col("bg")).alias("x"))
    return out.select("p_partkey", *(F.get("x", F.lit(k)).alias(n) for k, n in enumerate("rgb")))


@query("resolve_color", "WITH k0 AS (SELECT p_partkey, [((p_partkey * 7 + 3) % 256)::DOUBLE, ((p_partkey * 13 + 40) % 256)::DOUBLE, ((p_partkey * 29 + 90) % 256)::DOUBLE] AS c0, [255.0, 255.0, 255.0]::DOUBLE[] AS bg FROM part), k1 AS (SELECT p_partkey, bg, CASE WHEN p_partkey % 5 = 0 OR (c0[1] < 20 AND c0[2] < 20 AND c0[3] < 20) THEN [0.0, 0.0, 0.0]::DOUBLE[] ELSE c0 END AS c1 FROM k0), k AS (SELECT p_partkey, bg, CASE WHEN list_max(c1) - list_min(c1) <= 40 AND " + _RATIO("c1", "bg") + " < 5.0 THEN [0.0, 0.0, 0.0]::DOUBLE[] ELSE c1 END AS c FROM k1)" + _ENSURED + " SELECT p_partkey, x[1] AS r, x[2] AS g, x[3] AS b FROM ok")
def resolve_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    black, white = (F.array(*[F.lit(v)] * 3) for v in (0.0, 255.0))
    rows = _colors(spark, sf_dir).withColumn("run", F.when(F.col("p_partkey") % 5 != 0, F.col("c")))
    out = rows.select("p_partkey", C.resolve_text_color(F.col("run"), white, black).alias("x"))
    return out.select("p_partkey", *(F.get("x", F.lit(k)).alias(n) for k, n in enumerate("rgb")))


@query("theme_colors", "SELECT name, ('0x' || substr(bg, 2, 2))::INTEGER::DOUBLE AS r, ('0x' || substr(bg, 4, 2))::INTEGER::DOUBLE AS g, ('0x' || substr(bg, 6, 2))::INTEGER::DOUBLE AS b FROM (VALUES " + ", ".join(f"('{k}', '{v[0]}')" for k, v in S.THEMES.items()) + ") AS t(name, bg)")
def theme_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, v[0]) for k, v in S.THEMES.items()], "name string, bg string").select("name", C.from_hex(F.col("bg")).alias("x"))
    return rows.select("name", *(F.get("x", F.lit(k)).alias(n) for k, n in enumerate("rgb")))


@query("stretch_percentile", "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 100) AS v FROM embeddings), o AS (SELECT vec_id, v, list_sort(v) AS z FROM s), p AS (SELECT vec_id, v, z[least(len(z), CAST(floor(len(z) * 0.01) AS BIGINT) + 1)] AS a, z[least(len(z), CAST(floor(len(z) * 0.99) AS BIGINT) + 1)] AS b FROM o) SELECT vec_id, floor(list_sum(list_transform(v, lambda x: floor(least(255.0, greatest(0.0, (x - a) * 255.0 / greatest(b - a, 1.0)))))))::BIGINT AS total FROM p")
def stretch_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 100).alias("v"))
    out = rows.select("vec_id", F.transform(M.stretch(F.col("v")), lambda x: F.floor(x)).alias("s"))
    return out.select("vec_id", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("otsu_threshold", "WITH b AS (SELECT o_orderpriority AS k, CAST(floor(o_totalprice) AS BIGINT) % 256 AS bin, count(*) AS n FROM orders GROUP BY 1, 2), c AS (SELECT k, bin, sum(n) OVER u AS a, sum(n) OVER w - sum(n) OVER u AS b, sum(n * bin) OVER u AS s, sum(n * bin) OVER w - sum(n * bin) OVER u AS t FROM b WINDOW w AS (PARTITION BY k), u AS (PARTITION BY k ORDER BY bin ROWS UNBOUNDED PRECEDING)), v AS (SELECT k, bin, a::DOUBLE * b * pow(s / a::DOUBLE - t / b::DOUBLE, 2.0) AS v FROM c WHERE a > 0 AND b > 0) SELECT k, bin AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, bin) AS r FROM v) WHERE r = 1")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), (F.floor("o_totalprice") % 256).alias("bin")).agg(F.count("*").alias("n"))
    return M.otsu(bins, ["k"])


_BLOCKS = "b AS (SELECT conv_id, turn, text, role = 'system' AS header_footer, turn % 7 = 3 AS secondary, turn % 5 = 4 AS duplicate, CASE WHEN turn % 3 = 0 THEN turn * 2 END AS rank FROM conversations)"


@query("visible_blocks", "WITH " + _BLOCKS + ", v AS (SELECT *, coalesce(rank, last_value(rank IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) + 0.5, -1.0) AS k FROM b WHERE NOT secondary AND NOT duplicate AND NOT header_footer AND trim(text) <> '') SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k, turn) AS INTEGER) AS pos FROM v")
def visible_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.edit import visible

    t = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("role") == "system").alias("header_footer"), (t % 7 == 3).alias("secondary"), (t % 5 == 4).alias("duplicate"), F.when(t % 3 == 0, t * 2).alias("rank"))
    return visible(rows, ["conv_id"], "turn", S.Settings()).select("conv_id", "turn", "pos")


@query("settings_clamp", "SELECT p_partkey, greatest(20.0::DOUBLE, coalesce(nullif(p_size::DOUBLE, 0.0), 20.0)) AS font_size, CASE WHEN p_size / 20.0 IN (1.5, 1.75, 2.0) THEN p_size / 20.0 ELSE 1.5 END::DOUBLE AS line_height FROM part")
def settings_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", S.clamp_font_size(size).alias("font_size"), S.clamp_line_height(size / 20).alias("line_height"))


@query("spacing_width", "SELECT doc_id, 10.0 * length(source) + length(source) * 24 * 0.05::DOUBLE + (length(source) - length(replace(source, ' ', ''))) * 24 * 0.25::DOUBLE AS width FROM documents")
def spacing_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.measure import with_spacing

    settings = S.Settings(font_size=24.0, letter_spacing="0.05em", word_spacing="elargi")
    return table(spark, sf_dir, "documents").select("doc_id", with_spacing(10.0 * F.length("source"), F.col("source"), settings).alias("width"))


@query("line_alignment", "WITH " + LINES_SQL + " SELECT doc_id, line_no, CASE line_no % 4 WHEN 1 THEN (482.0::DOUBLE - least(482.0, 6.0 * length(text))) / 2 WHEN 2 THEN 482.0::DOUBLE - least(482.0, 6.0 * length(text)) ELSE 0.0 END AS shift, CASE WHEN line_no % 4 = 3 AND line_no < max(line_no) OVER (PARTITION BY doc_id) AND length(text) > length(replace(text, ' ', '')) THEN floor((482.0::DOUBLE - least(482.0, 6.0 * length(text))) / (length(text) - length(replace(text, ' ', ''))) * 1e6 + 0.5) / 1e6 ELSE 0.0 END AS per_space FROM lines")
def line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    from ..operators.layout import aligned

    kinds = F.get(F.array(*map(F.lit, ("left", "center", "right", "justify"))), F.col("line_no") % 4)
    last = F.col("line_no") == F.max("line_no").over(Window.partitionBy("doc_id"))
    rows = lines(spark, sf_dir).select("doc_id", "line_no", "text", kinds.alias("align"), last.alias("last"), F.least(F.lit(482.0), 6.0 * F.length("text")).alias("width"))
    return aligned(rows, 482.0).select("doc_id", "line_no", "shift", _six("per_space"))


@query("capability_union", "SELECT c_custkey, array_to_string(list_sort(list_distinct([c_mktsegment, 'image', 'table', CASE WHEN c_nationkey % 2 = 0 THEN 'image' ELSE 'scan' END])), ',') AS capacities FROM customer")
def capability_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    family, own = F.array(F.col("c_mktsegment"), F.lit("image"), F.lit("table")), F.array(F.when(F.col("c_nationkey") % 2 == 0, "image").otherwise("scan"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(F.array_union(family, own)), ",").alias("capacities"))


@query("rounded_bounds", "WITH v AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(floor(l_quantity * 3.7 + 0.5) AS BIGINT)))) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: i = 1 OR v[i] - v[i - 1] > 2), lambda i: v[i]), ',') AS bounds FROM v")
def rounded_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rounded bounds, each kept if over 2 from the one before it in the array."""
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.floor(F.col("l_quantity") * 3.7 + 0.5))).alias("v"))
    kept = F.filter("v", lambda x, i: (i == 0) | (x - F.get("v", i - 1) > 2))
    return v.select("l_orderkey", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("bounds"))


@query("average_chars", "WITH " + LINES_SQL + " SELECT doc_id, floor(avg(length(text)) * 1e6 + 0.5) / 1e6 AS average, avg(length(text)) > 0 AND avg(length(text)) < 35 AS warn FROM lines WHERE text <> '' GROUP BY doc_id")
def average_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines(spark, sf_dir).where("text <> ''").groupBy("doc_id").agg(F.avg(F.length("text")).alias("average"))
    return out.select("doc_id", _six("average"), ((F.col("average") > 0) & (F.col("average") < 35)).alias("warn"))
