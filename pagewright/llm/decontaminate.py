"""Benchmark decontamination with DataFrame functions only.

A document is contaminated by an item if one of its windows of as many words as the item has a
weighted shingle similarity of ``SIMILARITY`` or more with the item: the sum of the smaller counts
of each shingle over the sum of the larger ones. Words are lower-cased runs of letters and
digits; shingles are of ``N`` words (an item of fewer words: of all its words).

1. A window shares most shingles with a similar item, so windows are taken only where a document holds enough
   of one item's shingles. A bitmap of the items' shingles (three probes, at most ``BITS`` bits, so bounded
   whatever the benchmark's size) passes over the texts once without a shuffle; the shingles that it lets through
   meet the items' shingles in an equi-join, which is exact.
2. Each item-sized window there, and each item, gets a 64-bit SimHash of its shingles.
3. Fingerprints are cut into ``RADIUS + 1`` blocks; two within ``RADIUS`` bits agree in one block at
   least, so an equi-join on (item, block, value) finds all of them: a window only meets items whose shingles it
   holds. A pair is taken at its first equal block only, and only if its distance is within the radius.
4. The exact similarity of the pair decides.

At a similarity of 0.8 the expected distance is 10 bits with a deviation of 3, so a radius
of 20 leaves out about one such pair in thousands; equal windows have distance 0.

Edge cases: null or empty text, and items without words, match nothing; a document shorter than
an item is one window; repeated rows give one result row, of equal windows the first is reported; rows with a
null id are reported under a null id; items with a null id match as one; texts and items of any length are
handled whole; other columns are ignored, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import written

N = 5
SIMILARITY = (80, 100)
RADIUS = 20
#: The bitmap's most bits: 8 MB. Up to 65,000 shingles have 1,024 each.
BITS = 1 << 26
#: So many item shingles at most are broadcast, 16 bytes each; more are joined by a shuffle.
SET = 200_000
_CUT = r"[^\p{L}\p{N}]+"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _CUT), "")


def shingles(tokens: Column, n: int) -> Column:
    """Hashes of all runs of n words, in order."""
    gram = lambda w, i: F.xxhash64(w, *(F.get(tokens, i + k) for k in range(1, n)))
    return F.when(F.size(tokens) >= n, F.transform(F.slice(tokens, F.lit(1), F.size(tokens) - (n - 1)), gram)).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes; equal hashes weigh as often as they occur.

    Thirty-two longs count the bits, two of them each in lanes of 32 bits, more than an array holds.
    """
    lanes = F.aggregate(hashes, F.array_repeat(F.lit(0).cast("long"), 32), lambda acc, h: F.transform(acc, lambda a, k: a + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(0x0000000100000001))))
    lane = lambda counts, k: F.call_function("shiftrightunsigned", F.get(counts, k % 32), F.floor(k / 32).cast("int") * 32).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)

    def assembled(counts: Column) -> Column:
        bits = F.sequence(F.lit(0), F.lit(63))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(F.when(2 * lane(counts, k) >= F.size(hashes), one(k)).otherwise(F.lit(0).cast("long"))))

    return _let(lanes, assembled)


def _blocks() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    cuts = [round(k * 64 / (RADIUS + 1)) for k in range(RADIUS + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _block(fingerprint: Column, k: int) -> Column:
    first, bits = _blocks()[k]
    return F.call_function("shiftrightunsigned", fingerprint, F.lit(first)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _all_blocks(df: DataFrame) -> DataFrame:
    values = F.array(*(_block(F.col("fingerprint"), k) for k in range(RADIUS + 1)))
    return df.select("*", F.posexplode(values).alias("block", "value"))


def overlap(a: Column, b: Column) -> Column:
    """The multiset intersection's size of two arrays."""
    count = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_distinct(b), F.lit(0), lambda acc, s: acc + F.least(count(a, s), count(b, s))))


def _items(items: DataFrame, n: int) -> DataFrame:
    """item_id, n_words, n (of its shingles), shingles, fingerprint; items without words go."""
    cut = items.select("item_id", words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    sized = F.lit(None).cast("array<bigint>")
    for k in range(1, n + 1):
        sized = F.when(F.least(F.size("_w"), F.lit(n)) == k, shingles(F.col("_w"), k)).otherwise(sized)
    return cut.select("item_id", F.size("_w").alias("n_words"), F.least(F.size("_w"), F.lit(n)).alias("n"), sized.alias("shingles")).withColumn("fingerprint", simhash(F.col("shingles")))


def _probes(h: Column, bits: int) -> list[Column]:
    """Places of a shingle in the bitmap."""
    return [F.call_function("shiftrightunsigned", h, F.lit(k)).bitwiseAND(F.lit(bits - 1).cast("long")) for k in (0, 13, 26)]


def _bitmap(shingles: DataFrame, bits: int) -> DataFrame:
    """One row: the longs of the bitmap of h (a driver-sized constant, however many shingles)."""
    at = shingles.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    words = at.groupBy(F.floor(F.col("bit") / 64).alias("id")).agg(F.bit_or(one).alias("word"))
    full = shingles.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]).alias("bitmap"))


def _matches(docs: DataFrame, items: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """Matches of items whose shingles have n words."""
    num, den = similarity
    known = items.select("item", F.explode("shingles").alias("h")).distinct()
    count = known.select("h").distinct().count()
    bits = min(BITS, 1 << max(16, (1024 * count - 1).bit_length()))
    bitmap = written(_bitmap(known.select("h").distinct(), bits), "bitmap")
    listed = F.broadcast(known) if count <= SET and known.count() <= SET else known

    def held(h: Column) -> Column:
        test = lambda at: F.call_function("shiftrightunsigned", F.get("bitmap", F.floor(at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
        a, b, c = (test(at) for at in _probes(h, bits))
        return a & b & c

    sh = _let(words(F.col("text")), lambda w: shingles(w, n))
    cut = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), F.array(sh).alias("_a"), bitmap.scalar().alias("bitmap"))
    # The lambda's variable stands for the shingles, so that they are computed once.
    anchors = lambda s: F.filter(F.transform(s, lambda h, i: F.when(held(h), i)), lambda i: i.isNotNull())
    cut = cut.select("doc_id", "uid", F.filter(F.transform("_a", lambda s: F.struct(s.alias("shingles"), anchors(s).alias("anchors"))), lambda x: F.size(x["anchors"]) > 0).alias("_x"))
    rows = written(cut.select("doc_id", "uid", F.inline("_x")), "anchored")
    each = rows.dropDuplicates(["uid"])
    at = each.select("uid", F.explode("anchors").alias("p"), F.col("shingles")).select("uid", "p", F.size("shingles").alias("held"), F.get("shingles", F.col("p")).alias("h"))
    near = at.join(listed, "h").groupBy("uid", "item", "held").agg(F.sort_array(F.collect_set("p")).alias("places"))
    near = near.join(items.select("item", F.size("shingles").alias("span")), "item")
    # Of a window's shingles so many at least are the item's.
    window = F.least("span", "held")
    need = F.ceil((F.col("span") + window) * num / F.lit(num + den)).cast("int")
    last = F.greatest(F.col("held") - F.col("span"), F.lit(0))
    # Windows whose first anchor is the k-th and that reach the need-th from there.
    low = lambda p, k: F.greatest(F.lit(0), F.when(k > 0, F.get("places", k - 1) + 1).otherwise(0), F.get("places", k + F.col("need") - 1) - F.col("span") + 1)
    none = F.array().cast("array<int>")
    starts = F.flatten(F.transform("places", lambda p, k: F.when((k + F.col("need") <= F.size("places")) & (low(p, k) <= F.least(p, F.col("last"))), F.sequence(low(p, k), F.least(p, F.col("last")))).otherwise(none)))
    found = near.withColumn("need", F.greatest(need, F.lit(1))).withColumn("last", last).select("uid", "item", "span", F.explode(starts).alias("start"))
    windows = found.join(each.select("doc_id", "uid", "shingles"), "uid").select("doc_id", "item", "start", F.slice("shingles", F.col("start") + 1, F.col("span")).alias("window")).withColumn("fingerprint", simhash(F.col("window")))
    sides = _all_blocks(items.select("item", "item_id", F.col("shingles").alias("own"), "fingerprint")).withColumnRenamed("fingerprint", "item_print")
    differ = F.col("fingerprint").bitwiseXOR(F.col("item_print"))
    first = F.lit(RADIUS + 1)
    for k in reversed(range(RADIUS + 1)):
        first = F.when(_block(differ, k) == 0, F.lit(k)).otherwise(first)
    pairs = _all_blocks(written(windows, "windows")).join(sides, ["item", "block", "value"]).where((F.bit_count(differ) <= RADIUS) & (first == F.col("block")))
    both = pairs.withColumn("_o", overlap(F.col("window"), F.col("own")))
    union = F.size("window") + F.size("own") - F.col("_o")
    return both.where(den * F.col("_o") >= num * union).select("doc_id", "item_id", "start", (F.col("_o") / union).alias("similarity"))


def matches(docs: DataFrame, items: DataFrame, n: int = N, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Contaminated documents: doc_id, item_id, windows, similarity and start word of the best window."""
    items = written(_items(items, n).withColumn("item", F.xxhash64("item_id", "shingles")).dropDuplicates(["item"]), "items")
    out = None
    for size in sorted(r["n"] for r in items.select("n").distinct().collect()):  # n rows at most
        one = _matches(docs, items.where(F.col("n") == size), size, similarity)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = docs.where(F.lit(False)).select("doc_id").withColumn("item_id", F.lit(None).cast(items.schema["item_id"].dataType)).withColumn("start", F.lit(0)).withColumn("similarity", F.lit(0.0))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start")))
    return out.groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"), best.alias("b")).select("doc_id", "item_id", "windows", F.col("b.similarity").alias("similarity"), (-F.col("b.start")).cast("long").alias("start"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones; rows with a null id stay unless their text matches."""
    bad = written(matches(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")
