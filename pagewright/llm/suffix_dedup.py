"""Sparse suffix-array dedup: passages of at least ``MIN_WORDS`` words that occur twice or more.

1. Of all suffixes (one from each word on) only those at minimisers are kept: a position whose
   25-word fingerprint is the least of 26 in a row. Any 50 words hold one, chosen by the words
   alone, so two copies of a passage keep the same suffixes.
2. The kept suffixes are sorted by their first words, and neighbours that agree on 25 words
   are candidates. Suffixes are sorted first within a task, which sends one row for each distinct start;
   a second sort of those rows finds agreement between tasks. So however often a
   passage occurs, a task sends it once.
3. Candidates are extended left and right: every window of 50 words around one is fingerprinted,
   and the windows are sorted and compared in the same two steps. The union of repeated
   windows is exact: the maximal passages of 50 words or more that occur elsewhere.

The first occurrence, by smallest id, then place, stays; all other windows are removable.

Words are runs without ASCII white space, compared byte for byte through 64-bit fingerprints.
Edge cases: null, empty and short texts (under 50 words) have no passage; a passage that
repeats within one text counts; two rows alike in id and text are one document; a null id
comes after all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._scratch import written
from ._words import _BASE, _INV, blocks, cut, fingerprints, freeing, mix, raw

MIN_WORDS = 50
_HELD = 1_000_000
_NONE = np.uint64(2**64 - 1)
_I32, _I64 = pa.list_(pa.int32()), pa.list_(pa.int64())


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of n values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.full(len(h), _BASE, np.uint64))
    down = np.cumprod(np.full(len(h) - n + 1, _INV, np.uint64))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=total[1:])
    return mix((total[n:] - total[:-n]) * down)


def slide(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over every n values in a row."""
    k = 1
    while 2 * k <= n:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (n - k)], x[n - k :]) if k < n else x


def minimisers(g: np.ndarray, n: int) -> np.ndarray:
    """Places of values that are the least of some n in a row; ``_NONE`` never is."""
    if len(g) < n:
        return np.zeros(0, np.int64)
    least = slide(g, n, np.minimum)
    edge = np.zeros(n - 1, np.uint64)
    return np.flatnonzero((slide(np.concatenate([edge, least, edge]), n, np.maximum) == g) & (g != _NONE))


def _groups(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in ``order``, sorted by key: where groups begin, their sizes, each row's group."""
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    begin = np.flatnonzero(new)
    return begin, np.diff(np.concatenate([begin, [len(k)]])), np.cumsum(new) - 1


def _lists(n: int, doc: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values by document; doc ascends."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind.value_type))


def _starts(docs: DataFrame, size: int) -> DataFrame:
    """Kept suffixes: uid, sure (candidates within the task), keys, counts, places (the others)."""
    half = size // 2

    def run(batches):
        held: list[tuple] = []
        count = 0

        def flush():
            nonlocal held, count
            uid = pa.concat_arrays([x[0] for x in held])
            base = np.cumsum([0, *(len(x[0]) for x in held)])
            doc = np.concatenate([x[1] + b for x, b in zip(held, base)])
            place, key = (np.concatenate([x[k] for x in held]) for k in (2, 3))
            held, count = [], 0
            order = np.argsort(key, kind="stable")
            begin, many, _ = _groups(key, order)
            alone = np.sort(order[begin])
            counts = np.zeros(len(key), np.int32)
            counts[order[begin]] = many
            sure = np.ones(len(key), bool)
            sure[order[begin[many == 1]]] = False
            n = len(uid)
            return pa.RecordBatch.from_arrays([uid, _lists(n, doc[sure], place[sure], _I32), _lists(n, doc[alone], key[alone].view(np.int64), _I64), _lists(n, doc[alone], counts[alone], _I32), _lists(n, doc[alone], place[alone], _I32)], ["uid", "sure", "keys", "counts", "places"])

        for batch in batches:
            buf, offs = raw(batch.column(1))
            for i, j in blocks(offs):
                own, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts, ends, row = cut(own, at)
                g = rolling(fingerprints(own, starts, ends), half)
                first = np.searchsorted(row, np.arange(j - i + 1))
                total = np.diff(first)
                if len(g):
                    g[(row[: len(g)] != row[half - 1 :]) | (total[row[: len(g)]] < size)] = _NONE
                kept = minimisers(g, size - half + 1)
                if len(kept):
                    held.append((batch.column(0).slice(i, j - i), row[kept], (kept - first[row[kept]]).astype(np.int32), g[kept]))
                    count += len(kept)
                    if count >= _HELD:
                        yield flush()
        if count:
            yield flush()

    return docs.select("uid", "text").mapInArrow(freeing(run), "uid long, sure array<int>, keys array<long>, counts array<int>, places array<int>")


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of ascending places in a row."""
    if not len(places):
        return places, places
    gap = np.flatnonzero(np.diff(places) > 1)
    return np.concatenate([places[:1], places[gap + 1]]), np.concatenate([places[gap], places[-1:]]) + 1


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """Windows around candidates (places): those repeated within the task as runs, the first of each as rows."""
    half = size // 2

    def run(batches):
        held: list[tuple] = []
        count = 0

        def flush():
            nonlocal held, count
            table = pa.concat_tables([pa.table({"uid": x[0], "doc_id": x[1]}) for x in held]).combine_chunks()
            uid, ids = table["uid"].combine_chunks(), table["doc_id"].combine_chunks()
            base = np.cumsum([0, *(len(x[0]) for x in held)])
            doc = np.concatenate([x[2] + b for x, b in zip(held, base)])
            place, key = (np.concatenate([x[k] for x in held]) for k in (3, 4))
            held, count = [], 0
            value = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            rank = np.argsort(np.argsort(value, kind="stable"), kind="stable")
            order = np.argsort(rank[doc], kind="stable")  # places ascend within a document
            order = order[np.argsort(key[order], kind="stable")]
            begin, many, group = _groups(key, order)
            counts = np.zeros(len(key), np.int32)
            counts[order[begin]] = many
            sure, again = np.zeros(len(key), bool), np.ones(len(key), bool)
            sure[order] = many[group] > 1
            again[order[begin]] = False
            first = np.flatnonzero(counts)
            n = len(uid)
            columns = [uid, ids, _lists(n, doc[first], key[first].view(np.int64), _I64), _lists(n, doc[first], counts[first], _I32), _lists(n, doc[first], place[first], _I32)]
            for mask in (sure, again):
                at = np.flatnonzero(mask)
                wide = doc[at] * (1 << 40) + place[at]
                a, b = _runs(wide)
                columns += [_lists(n, a >> 40, a & ((1 << 40) - 1), _I32), _lists(n, a >> 40, (b - a) + (a & ((1 << 40) - 1)), _I32)]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            buf, offs = raw(batch.column(2))
            flat, cuts = batch.column(3).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy())])
            for i, j in blocks(offs):
                own, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts, ends, row = cut(own, at)
                g = rolling(fingerprints(own, starts, ends), size)
                first = np.searchsorted(row, np.arange(j - i + 1))
                if not len(g):
                    continue
                near = np.zeros(len(starts) + 1, np.int32)
                mine = flat[cuts[i] : cuts[j]] + np.repeat(first[:-1], np.diff(cuts[i : j + 1]))
                low = np.maximum(mine - (size - half), np.repeat(first[:-1], np.diff(cuts[i : j + 1])))
                np.add.at(near, low, 1)
                np.add.at(near, mine + 1, -1)
                ok = (np.cumsum(near)[: len(g)] > 0) & (row[: len(g)] == row[size - 1 :])
                kept = np.flatnonzero(ok)
                if len(kept):
                    held.append((batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), row[kept], (kept - first[row[kept]]).astype(np.int64), g[kept]))
                    count += len(kept)
                    if count >= _HELD:
                        yield flush()
        if count:
            yield flush()

    schema = "uid long, doc_id long, keys array<long>, counts array<int>, places array<int>, sure_from array<int>, sure_to array<int>, again_from array<int>, again_to array<int>"
    return docs.select("uid", "doc_id", "text", "places").mapInArrow(freeing(run), schema)


def repeated(docs: DataFrame, size: int = MIN_WORDS) -> DataFrame:
    """Maximal repeated passages: doc_id, uid, start_word, end_word (exclusive), n_words, removable_words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("uid"))
    starts = written(_starts(docs, size), "suffixes")
    zipped = starts.select("uid", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("counts").alias("many"), F.col("places").alias("place"))))
    between = zipped.withColumn("total", F.sum("many").over(Window.partitionBy("key"))).where("total > 1").select("uid", "place")
    sure = starts.select("uid", F.explode("sure").alias("place"))
    places = written(between.union(sure).groupBy("uid").agg(F.sort_array(F.collect_set("place")).alias("places")), "candidates")
    texts = docs.join(places, "uid").dropDuplicates(["uid"])
    found = written(_windows(texts, size), "windows")
    zipped = found.select("uid", "doc_id", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("counts").alias("many"), F.col("places").alias("place"))))
    same = Window.partitionBy("key")
    me = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "uid", "place")
    between = zipped.select("uid", "place", F.sum("many").over(same).alias("total"), (me != F.min(me).over(same)).alias("again")).where("total > 1")
    merged = between.groupBy("uid").agg(F.collect_list("place").alias("repeat"), F.collect_list(F.when(F.col("again"), F.col("place"))).alias("again"))
    table = found.select("uid", "doc_id", "sure_from", "sure_to", "again_from", "again_to").join(merged, "uid", "left")

    def union(places, begin, end):
        """Merged [start, end) of the windows at places and at runs of places."""
        marks = np.concatenate([np.asarray(places, np.int64), np.asarray(begin, np.int64)])
        stops = np.concatenate([np.asarray(places, np.int64) + size, np.asarray(end, np.int64) - 1 + size])
        order = np.argsort(marks, kind="stable")
        out: list[list[int]] = []
        for a, b in zip(marks[order].tolist(), stops[order].tolist()):
            if out and a < out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                gone = union(r["again"] or [], r["again_from"], r["again_to"])
                for a, b in union(r["repeat"] or [], r["sure_from"], r["sure_to"]):
                    rows.append((r["doc_id"], r["uid"], a, b, b - a, sum(max(0, min(b, y) - max(a, x)) for x, y in gone)))
            names = ("doc_id", "uid", "start_word", "end_word", "n_words", "removable_words")
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names)

    return table.mapInArrow(freeing(run), "doc_id long, uid long, start_word long, end_word long, n_words long, removable_words long")
