"""N-gram Jaccard join of documents by grouped prefixes.

1. Every document becomes its set of n-word shingles (64-bit tokens). Equal sets are one class
   with a representative; they link with one another whatever the threshold.
2. Tokens are ordered: the most frequent last, by ascending frequency; before them long
   shingles first. Linked sets share ``shared_tokens`` tokens at least among the first of each
   (its prefix). Any order gives the same links; this one keeps frequent tokens out.
   Frequencies come from all documents: a token counts where a task holds it ``LOCAL`` times,
   and the ``FREQUENT`` most frequent of these are kept, which bounds what tasks load.
3. Classes with equal prefix and size are collapsed into one group. An index holds each group under
   the prefix tokens that another group has too; groups with too few of those have no link.
4. Group pairs come in two turns, as the result is components, not links. First every group meets
   the leader of most of its tokens (a token's leader is the group of near size that has it foremost), and leaders
   of neighbouring sizes meet where a token is frequent: two pairs a group at most, however many groups share a token. Then
   groups that share a token and aren't connected yet meet, except within the component that most of the
   token's groups belong to: pairs are filtered by size, and by what their positions leave after a token, which at
   a link's first shared token is enough. No pair that may be a link between components is left out.
5. Group pairs are expanded to their classes and verified: sets meet in joins, intersections are exact.

Edge cases: null text, and text without words, has an empty set and links with nothing, so each
such row is its own component; a text of fewer than n words has its whole sequence as one
shingle; repeated rows are copies; ids may repeat with different texts; rows with a null id link
like others but can't name a component (a component of nulls only has none); other columns have no part; an
empty table gives an empty result.

Classes and groups are named by 64-bit fingerprints, sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._scratch import drop, written
from ._words import blocks, freeing, raw, shingle_sets
from .components import components

LOCAL = 8
FREQUENT = 1 << 17
SHARED = 16
#: A token of so many groups has its largest component told apart; of fewer, all groups meet.
MAJOR = 32
#: Tokens that a task counts at a time: 12 MB.
HELD = 1_500_000
#: Ids of classes that may link: so many at most are broadcast, 8 bytes each; more meet the texts in a shuffle.
FEW = 500_000
_BITS = 18
_NULL = -(1 << 63)


def shared_tokens(size: int) -> int:
    """How many prefix tokens two linked sets share at least; it grows with the size."""
    return max(1, min(SHARED, size // 4), size // SHARED)


def _sets(batch: pa.RecordBatch, column: int, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    buf, offs = raw(batch.column(column))
    for i, j in blocks(offs):
        yield i, shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)


def frequent_tokens(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and the rank of each in ascending frequency."""

    def run(batches):
        counts = np.zeros(1 << _BITS, np.int32)
        held: list[np.ndarray] = []
        size = 0
        shift = np.uint64(58 - _BITS)
        place = lambda x: ((x >> shift) & np.uint64((1 << _BITS) - 1)).astype(np.int64)

        def flush():
            nonlocal held, size, counts
            x = np.concatenate(held)
            x = x[counts[place(x)] >= LOCAL]
            x.sort()
            edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
            many = np.diff(edge)
            keep = many >= LOCAL
            held, size, counts = [], 0, np.zeros(1 << _BITS, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x[edge[:-1][keep]].view(np.int64)), pa.array(many[keep].astype(np.int64))], ["token", "many"])

        for batch in batches:
            for _, sets in _sets(batch, 0, n):
                x = np.concatenate(sets)
                counts += np.bincount(place(x), minlength=1 << _BITS).astype(np.int32)
                held.append(x)
                size += len(x)
                if size >= HELD:
                    yield flush()
        if size:
            yield flush()

    counted = docs.select("text").mapInArrow(freeing(run), "token long, many long").groupBy("token").agg(F.sum("many").alias("many"))
    rows = counted.orderBy(F.desc("many"), "token").limit(FREQUENT).collect()  # FREQUENT rows at most
    tokens = np.array([r["token"] for r in rows[::-1]], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], order


def _prefixes(docs: DataFrame, n: int, num: int, den: int, shared) -> DataFrame:
    """Every row's set size, a 128-bit fingerprint of its set, and its prefix in the order (shared: a broadcast of
    ``frequent_tokens``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tokens, rank = shared.value
        for batch in batches:
            for i, sets in _sets(batch, 1, n):
                size, marks, prefix = [], [], []
                for x in sets:
                    s = len(x)
                    size.append(s)
                    marks.append(_marks(x))
                    first = min(s, s - -(-s * num // den) + shared_tokens(s)) if s else 0
                    head = x
                    if len(tokens) and s:
                        at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
                        often = tokens[at] == x
                        head = x[~often][:first]
                        if len(head) < first:
                            late = x[often][np.argsort(rank[at[often]], kind="stable")]
                            head = np.concatenate([head, late[: first - len(head)]])
                    prefix.append(head[:first].view(np.int64))
                cuts = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(sets)), pa.array(size, pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(prefix)))],
                    ["doc_id", "n_shingles", "one", "two", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(freeing(run), f"doc_id {kind}, n_shingles long, one long, two long, prefix array<long>")


def _set_rows(docs: DataFrame, n: int) -> DataFrame:
    """one, two, set of every row of docs (text)."""

    def run(batches):
        for batch in batches:
            for _, sets in _sets(batch, 0, n):
                marks = [_marks(x) for x in sets]
                cuts = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), flat], ["one", "two", "set"])

    return docs.select("text").mapInArrow(freeing(run), "one long, two long, set array<long>")


def _marks(x: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set, as two signed 64-bit integers."""
    if not len(x):
        return 0, 0
    one, two = np.bitwise_xor.reduce(x * np.uint64(0x9FB21C651E98DF25) ^ (x >> np.uint64(29))), x.sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _enough(size: Column) -> Column:
    """``shared_tokens`` of a size."""
    return F.greatest(F.lit(1), F.least(F.lit(SHARED), F.floor(size / 4)), F.floor(size / SHARED))


def _index(groups: DataFrame, num: int, den: int) -> DataFrame:
    """token, many (groups that have it), pos, grp, size: groups by the prefix tokens that they share with others."""
    entries = groups.select("grp", F.posexplode("prefix").alias("pos", "token"), "size").select("token", "grp", _packed(F.col("size"), F.col("pos")).alias("at"))
    shared = written(entries.groupBy("token").agg(F.count("*").alias("many")).where("many > 1"), "tokens")
    left = F.count("*").over(Window.partitionBy("grp"))  # a prefix at most
    least = F.ceil(F.shiftright("at", 32) * num / F.lit(den))  # the size of the sets that it may link with
    return entries.join(shared, "token").withColumn("_left", left).where(F.col("_left") >= _enough(least)).select("token", "many", (F.col("at") % (1 << 32)).cast("int").alias("pos"), "grp", F.shiftright("at", 32).alias("size"))


def _packed(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32) + low


def _near(a: Column, b: Column, num: int, den: int) -> Column:
    """Whether two sizes allow a link."""
    return num * F.greatest(a, b) <= den * F.least(a, b)


def _star_pairs(index: DataFrame, num: int, den: int) -> DataFrame:
    """Group pairs (a, b): every group and the leader of most of its tokens, of its own band of size and of the next."""
    band = F.floor(F.log("size") / float(np.log(den / num)) + 1e-9).cast("int")
    index = index.select("token", band.alias("band"), "pos", "grp", "size", "many")
    first = index.groupBy("token", "band").agg(F.min(F.struct("pos", "grp", "size")).alias("l"), F.count("*").alias("n"), F.first("many").alias("many"))
    leaders = written(first.select("token", "band", F.col("l.grp").alias("leader"), F.col("l.size").alias("leader_size"), "n", "many"), "leaders")
    met = index.join(leaders.where("n > 1"), ["token", "band"]).where(F.col("grp") != F.col("leader"))
    own = met.where(_near(F.col("size"), F.col("leader_size"), num, den)).select(F.col("grp").alias("a"), F.col("leader").alias("b"))
    often = leaders.where(F.col("many") >= MAJOR)
    above = often.select("token", (F.col("band") - 1).alias("band"), F.col("leader").alias("a"), F.col("leader_size").alias("_size"))
    beside = often.join(above, ["token", "band"]).where((F.col("a") != F.col("leader")) & _near(F.col("_size"), F.col("leader_size"), num, den))
    most = lambda pairs: pairs.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    return most(own).union(most(beside.select("a", F.col("leader").alias("b"))))


def _rest_pairs(index: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of unconnected parts (ga, ca, gb, cb) that may link; parts: grp, comp, the components of each group."""
    held = written(index.join(parts, "grp"), "held")
    # Where a token has many groups, those of its largest component don't meet each other.
    major = held.where(F.col("many") >= MAJOR).groupBy("token", "comp").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"))
    major = written(major, "major")
    a = held.select("token", F.col("pos").alias("pa"), F.col("grp").alias("ga"), F.col("comp").alias("ca"), F.col("size").alias("sa")).join(major, "token", "left").where("major IS NULL OR ca <> major")
    b = held.select("token", F.col("pos").alias("pb"), F.col("grp").alias("gb"), F.col("comp").alias("cb"), F.col("size").alias("sb"))
    # A link's first shared token has enough tokens from there on in both sets; at least there the pair is met.
    enough = (num + den) * F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) >= num * (F.col("sa") + F.col("sb"))
    met = a.join(b, "token").where((F.col("ca") != F.col("cb")) & ((F.col("ca") < F.col("cb")) | F.coalesce(F.col("cb") == F.col("major"), F.lit(False))) & _near(F.col("sa"), F.col("sb"), num, den) & enough)
    # Which side a part is on depends on the token.
    ordered = F.when(F.col("ca") < F.col("cb"), F.struct("ga", "ca", "gb", "cb")).otherwise(F.struct(F.col("gb").alias("ga"), F.col("cb").alias("ca"), F.col("ga").alias("gb"), F.col("ca").alias("cb")))
    found = met.select(ordered.alias("pair")).select("pair.*").distinct()
    # Parts of one group share the whole prefix.
    within = parts.groupBy("grp").agg(F.min("comp").alias("ca"), F.max("comp").alias("_top")).where("ca <> _top")
    own = parts.join(within, "grp").where("comp <> ca").select("grp", "ca", F.col("comp").alias("cb"))
    rest = parts.join(within.select("grp", F.col("ca").alias("least")), "grp").where("comp <> least")
    both = rest.select("grp", F.col("comp").alias("ca")).join(rest.select("grp", F.col("comp").alias("cb")), "grp").where("ca < cb")
    return found.union(own.unionByName(both).select(F.col("grp").alias("ga"), "ca", F.col("grp").alias("gb"), "cb"))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The links among pairs of classes (a, b)."""
    met = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return met.select("a", "b", (F.size("x") + F.size("y")).alias("both"), common.alias("common")).where((num + den) * F.col("common") >= num * F.col("both")).select("a", "b")


def _rep() -> Column:
    """The name of a class."""
    return F.xxhash64("one", "two", "n_shingles")


def join(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; two link when den * common >= num * union."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_tokens(docs, n))  # FREQUENT tokens at most
    prefixes = written(_prefixes(docs.select("doc_id", "text"), n, num, den, shared).withColumn("grp", F.xxhash64("prefix", "n_shingles")), "prefixes")
    shared.destroy()
    full = prefixes.where("n_shingles > 0")
    same = ["one", "two", "n_shingles"]
    classes = full.groupBy(*same).agg(F.min(F.col("doc_id").cast("long")).alias("least"), F.min("grp").alias("grp")).withColumn("rep", _rep())
    classes = written(classes, "classes")
    groups = written(full.groupBy("grp").agg(F.min("n_shingles").alias("size"), F.first("prefix").alias("prefix")), "groups")
    table = written(prefixes.select("doc_id", *same), "marks")
    drop(spark, prefixes)
    index = written(_index(groups, num, den), "index")
    drop(spark, groups)
    led = classes.groupBy("grp").agg(F.min("rep").alias("leader"), F.count("*").alias("many"))
    wide = classes.select("grp", "rep", "least").join(led, "grp")
    indexed = index.select("grp").distinct().withColumn("_in", F.lit(True))
    members = written(wide.join(indexed, "grp", "left").where("many > 1 OR _in").select("grp", "rep", "leader", "least"), "members")
    # The sets of classes that may link, each from the text of its least id.
    wanted = members.select(F.coalesce("least", F.lit(_NULL)).alias("least")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("least"), "text").join(wanted, "least")
    found = _set_rows(texts, n).select(F.xxhash64("one", "two", F.size("set").cast("long")).alias("rep"), "set")
    sets = written(found.where(F.size("set") > 0).dropDuplicates(["rep"]), "sets")
    name = members.select("grp", "rep", "leader")
    own = name.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    stars = _star_pairs(index, num, den).join(name.select(F.col("grp").alias("a"), F.col("rep").alias("_a")), "a").join(name.where("rep = leader").select(F.col("grp").alias("b"), F.col("leader").alias("_b")), "b")
    pairs = written(own.union(stars.select("_a", "_b")).distinct(), "pairs")
    found = components(_verified(pairs, sets, num, den))
    named = written(name.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("grp", "rep", F.coalesce("component", "rep").alias("comp")), "named")
    rest = written(_rest_pairs(index, named.select("grp", "comp").distinct(), num, den), "rest")
    side = lambda x: named.select(F.col("grp").alias(f"g{x}"), F.col("comp").alias(f"c{x}"), F.col("rep").alias(x))
    more = rest.join(side("a"), ["ga", "ca"]).join(side("b"), ["gb", "cb"])
    at = named.select("rep", "comp")
    links = _verified(more.select("a", "b").distinct(), sets, num, den).join(at.select(F.col("rep").alias("a"), F.col("comp").alias("_a")), "a").join(at.select(F.col("rep").alias("b"), F.col("comp").alias("_b")), "b")
    joined = components(links.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    last = at.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("component", "comp").alias("component"))
    ended = classes.select(*same, "rep", "least").join(last, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = ended.groupBy("component").agg(F.min("least").alias("component_id"))
    ended = ended.join(least, "component").select(*same, "component_id")
    alone = F.col("n_shingles") == 0
    out = table.select("doc_id", *same).join(ended, same, "left").select("doc_id", "n_shingles", F.when(alone, F.col("doc_id").cast("long")).otherwise(F.col("component_id")).alias("component_id"))
    out = written(out, "joined")
    for done in (table, classes, index, members, sets, pairs, named, rest):
        drop(spark, done)
    return out
