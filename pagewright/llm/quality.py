"""Quality rules: base counts, and divergence from the histograms of a document's language.

Each document has a histogram of character classes and one of common words (all others are one
bin). A language's reference is the mean of its documents' normalised histograms, over all
documents that pass the base rule and are long enough for the histogram to count. A document goes where its Jensen-Shannon
distance (root of the divergence in bits, 0 to 1) from its language's reference exceeds a limit;
shorter documents are not judged by that histogram. A language with fewer than ``SUPPORT`` such
documents has no reference: its distances are null and only the base rule judges its documents.

Edge cases: null or empty text has no words, so it fails the base rule; a null language is a
language of its own; repeated rows are judged alike; an empty table gives an empty result.
Words and windows are compared by 64-bit fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import written
from ._words import LOWER, SPACE, blocks, cut, fingerprints, freeing, grams, raw

# Symbols of the base rule, and common words of four languages.
SYMBOLS = b"#*$%&|<>"
COMMON = {
    "en": "the of and to in a is that for it as was with be on are by this or an at from not have",
    "fr": "le la les de des du un une et en est que qui dans pour pas sur au par ce il je ne se avec",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "es": "el la los las de que y en un una por con para se del no es al lo su como más o pero",
}
WORDS = sorted({w for line in COMMON.values() for w in line.split()})
CLASSES = ("lower", "upper", "digit", "space", "stop", "quote", "symbol", "other", "letter")

#: Least code points for the character classes, least words for the common words, and the limits.
#: WORD_LIMIT is set from the labels of sf0.1: a text without a common word lies at 0.36 to 0.38.
MIN_CHARS, MIN_WORDS, CLASS_LIMIT, WORD_LIMIT, SUPPORT = 400, 50, 0.32, 0.31, 50
#: References of so many languages at most are broadcast, 1 kB each; more are joined by a shuffle.
LANGUAGES = 10_000


def _classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.uint8)
    for name, chars in (("lower", range(0x61, 0x7B)), ("upper", range(0x41, 0x5B)), ("digit", range(0x30, 0x3A)), ("space", [0x20, *range(9, 14)]), ("stop", b".,;:!?"), ("quote", b"\"'()-"), ("symbol", SYMBOLS), ("letter", range(0xC0, 0x100))):
        table[list(chars)] = CLASSES.index(name)
    return table


def features(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, lang, the base counts, and the two histograms of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")

    def run(batches):
        table, lead, sign = _classes(), np.ones(256, bool), np.zeros(256, bool)
        lead[0x80:0xC0] = False
        sign[list(SYMBOLS)] = True
        cased = [w.encode() for w in WORDS]
        cuts = np.cumsum([0, *map(len, cased)])
        prints = fingerprints(np.frombuffer(b"".join(cased), np.uint8), cuts[:-1], cuts[1:])
        order = np.argsort(prints)
        prints = prints[order]
        for batch in batches:
            buf, offs = raw(batch.column(2))
            for i, j in blocks(offs):
                own, at, n = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], j - i
                per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])  # noqa: E731, B023
                chars = lead[own]
                starts, ends, row = cut(own, at)
                out = {k: np.zeros(n, np.int64) for k in counts}
                out["n_words"] = np.bincount(row, minlength=n)
                out["word_chars"] = per(chars & ~SPACE[own])
                out["n_symbols"] = per(sign[own])
                flat = own.tobytes()
                for k in range(n):
                    lines = flat[at[k] : at[k + 1]].split(b"\n")
                    if len(lines) > len(set(lines)):
                        seen = set()
                        for x in lines:
                            if x in seen:
                                out["n_dup_lines"][k] += 1
                            elif x.strip():
                                seen.add(x)
                h = fingerprints(own, starts, ends)
                g = grams(h, window)
                first = np.searchsorted(row, np.arange(n + 1))
                for k in np.flatnonzero(out["n_words"] > window):
                    x = g[first[k] : first[k + 1] - window + 1]
                    s = np.sort(x)
                    again = s[1:][s[1:] == s[:-1]]
                    if len(again):
                        hit = np.flatnonzero(np.isin(x, again))
                        marks = np.zeros(out["n_words"][k] + 1, np.int64)
                        np.add.at(marks, hit, 1)
                        np.add.at(marks, hit + window, -1)
                        out["n_repeat_words"][k] = (np.cumsum(marks) > 0).sum()
                doc = np.repeat(np.arange(n), np.diff(at))
                shown = chars & (table[own] != 255)
                out["n_chars"] = per(shown)
                cls = np.bincount(doc[shown] * len(CLASSES) + table[own[shown]], minlength=n * len(CLASSES)).reshape(n, -1)
                bare = ends - ((own[ends - 1] == 0x2E) | (own[ends - 1] == 0x2C)) if len(ends) else ends
                low = fingerprints(LOWER[own], starts, bare)
                place = np.minimum(np.searchsorted(prints, low), len(prints) - 1)
                bin_ = np.where(prints[place] == low, order[place], len(WORDS))
                wrd = np.bincount(row * (len(WORDS) + 1) + bin_, minlength=n * (len(WORDS) + 1)).reshape(n, -1)
                arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).ravel()), x.shape[1]).cast(pa.list_(pa.int32())) for x in (cls, wrd)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), *(pa.array(out[k], pa.int64()) for k in counts), *arrays], ["doc_id", "lang", *counts, "classes", "words"])

    return docs.select("doc_id", "lang", "text").mapInArrow(freeing(run), f"doc_id {kind}, lang string, {' long, '.join(counts)} long, classes array<int>, words array<int>")


def js_distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram of a known total from shares that sum to 1; null for total 0 or no reference."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(counts, reference, lambda x, y: F.struct((x / total).alias("x"), y.alias("y")))
    gone = F.aggregate(both, F.lit(0.0), lambda s, b: s + term(b["x"], (b["x"] + b["y"]) / 2) + term(b["y"], (b["x"] + b["y"]) / 2))
    return F.when((total > 0) & reference.isNotNull(), F.sqrt(F.greatest(gone / 2, F.lit(0.0))))


def references(found: DataFrame) -> DataFrame:
    """For each language the mean histograms as shares that sum to 1; null without SUPPORT.

    Sums are of whole millionths of each document's share, so their order has no part in them.
    """
    totals = {"classes": F.col("n_chars"), "words": F.col("n_words")}

    def sums(name: str, n: int, enough: Column) -> list[Column]:
        total = totals[name]
        return [F.sum(F.when(enough, F.floor(F.col(name)[k].cast("double") * 1_000_000 / total)).otherwise(0)).alias(f"{name}{k}") for k in range(n)]

    long_enough = {"classes": ~_failed() & (F.col("n_chars") >= MIN_CHARS), "words": ~_failed() & (F.col("n_words") >= MIN_WORDS)}
    each = found.groupBy(F.coalesce("lang", F.lit("")).alias("language")).agg(
        *sums("classes", len(CLASSES), long_enough["classes"]), *sums("words", len(WORDS) + 1, long_enough["words"]),
        F.sum(F.when(long_enough["classes"], 1).otherwise(0)).alias("docs_classes"), F.sum(F.when(long_enough["words"], 1).otherwise(0)).alias("docs_words"),
    )
    sizes = (("classes", len(CLASSES)), ("words", len(WORDS) + 1))
    total_of = lambda name, n: sum((F.col(f"{name}{k}") for k in range(1, n)), F.col(f"{name}0")).cast("double")
    each = each.select("*", *(total_of(name, n).alias(f"total_{name}") for name, n in sizes))
    pick = [F.when(F.col(f"docs_{name}") >= SUPPORT, F.array(*(F.col(f"{name}{k}") / F.col(f"total_{name}") for k in range(n)))).alias(f"ref_{name}") for name, n in sizes]
    return each.select("language", *pick)


def _failed() -> Column:
    """The base rule."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, class_js, word_js, kept."""
    found = written(features(docs), "quality")
    ref = written(references(found), "references")
    joined = found.withColumn("language", F.coalesce("lang", F.lit(""))).join(F.broadcast(ref) if ref.count() <= LANGUAGES else ref, "language")
    class_js = F.when(F.col("n_chars") >= MIN_CHARS, js_distance(F.col("classes"), F.col("n_chars"), F.col("ref_classes")))
    word_js = F.when(F.col("n_words") >= MIN_WORDS, js_distance(F.col("words"), F.col("n_words"), F.col("ref_words")))
    out = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed().alias("base_failed"), class_js.alias("class_js"), word_js.alias("word_js"))
    fits = F.coalesce(F.col("class_js") <= CLASS_LIMIT, F.lit(True)) & F.coalesce(F.col("word_js") <= WORD_LIMIT, F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & fits)
