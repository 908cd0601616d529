"""Token ids on disk as directly addressable codes.

A segment splits its ids into 8-bit chunk levels. Level k holds, for each id that reaches it,
one chunk, one continuation bit, and a rank directory over those bits (a 32-bit count for every
512). Token i is read at level 0 place i; while its bit is set, the next level's place is the
rank of the bit. So any token is read from a few bytes, and nothing around it is decoded.

Segment layout, little-endian: ``DAC1``, u32 levels, then u64 (entries, chunk place, bitmap
place, rank place) for each level, then the arrays.

The store is a Parquet table without compression whose rows are segments in ascending doc_id
order, written by Spark's committer (lost executors leave no partial files, and any store that
Spark reads will do). Segments hold whole documents up to about ``SEGMENT`` tokens; a document
of more than ``LONGEST`` is cut into parts.

Edge cases: null text counts as empty and holds the end id alone; null ids sort first; rows alike
in doc_id stay, in the order of their texts; other columns have no part;
an empty table gives an empty store.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._scratch import fresh
from ._tokens import default_vocabulary, encoder
from ._words import blocks, freeing, raw

#: Bytes of remembered runs: ranges of ids mix sources, so runs recur later than in the packing's scans.
REMEMBERED = 48 << 20
SEGMENT = 1 << 18
LONGEST = 1 << 21
_SCHEMA = "part int, segment int, start long, n long, codes binary, doc_ids array<long>, nulls array<boolean>, cuts array<long>, docs array<long>, more array<int>, split array<boolean>"


def encode(ids: np.ndarray) -> bytes:
    """A segment of unsigned 32-bit ids."""
    ids = np.ascontiguousarray(ids, np.uint32)
    heads, arrays, rest = [], [], ids
    while True:
        on = rest > 255
        bits = np.packbits(on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits.reshape(-1, 64)).sum(1))])[:-1].astype("<u4")
        heads.append(len(rest))
        arrays.append(((rest & np.uint32(255)).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[on] >> np.uint32(8)
        if not len(rest):
            break
    at, out, body = 8 + 32 * len(heads), [b"DAC1", struct.pack("<I", len(heads))], []
    for n, level in zip(heads, arrays):
        places = []
        for x in level:
            places.append(at)
            body.append(x)
            at += len(x)
        out.append(struct.pack("<4Q", n, *places))
    return b"".join(out + body)


def _level(codes: bytes, k: int) -> tuple[int, int, int, int]:
    return struct.unpack_from("<4Q", codes, 8 + 32 * k)


def access(codes: bytes, i: int) -> int:
    """Id number i of a segment, from its own chunks alone."""
    levels = struct.unpack_from("<I", codes, 4)[0]
    if not 0 <= i < _level(codes, 0)[0]:
        raise IndexError(i)
    value = 0
    for k in range(levels):
        _, chunk, bits, ranks = _level(codes, k)
        value |= codes[chunk + i] << (8 * k)
        if not codes[bits + i // 8] >> (i % 8) & 1:
            break
        block = i // 512
        before = int.from_bytes(codes[bits + 64 * block : bits + i // 8], "little").bit_count()
        before += (codes[bits + i // 8] & ((1 << (i % 8)) - 1)).bit_count()
        i = struct.unpack_from("<I", codes, ranks + 4 * block)[0] + before
    return value


def decode(codes: bytes) -> np.ndarray:
    """All ids of a segment."""
    levels = struct.unpack_from("<I", codes, 4)[0]
    n = _level(codes, 0)[0]
    out, at = np.zeros(n, np.uint32), np.arange(n)
    for k in range(levels):
        m, chunk, bits, _ = _level(codes, k)
        out[at] |= np.frombuffer(codes, np.uint8, m, chunk).astype(np.uint32) << np.uint32(8 * k)
        at = at[np.unpackbits(np.frombuffer(codes, np.uint8, -(-m // 8), bits), bitorder="little")[:m].astype(bool)]
    return out


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1) -> None:
    """Encode every text, append ``end_id``, and store all ids in ascending doc_id order."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        enc = encoder(vocabulary, REMEMBERED)
        end = np.array([end_id], np.uint32)
        part, start, segment, number = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []
        size, names, docs, more, split = 0, [], [], [], []

        def flush():
            nonlocal held, size, names, docs, more, split, start, segment
            ids = np.concatenate(held)
            cuts = np.cumsum([0, *map(len, held)])
            row = [part, segment, start, size, encode(ids), [x or 0 for x in names], [x is None for x in names], cuts.tolist(), docs, more, split]
            start, segment = start + size, segment + 1
            held, size, names, docs, more, split = [], 0, [], [], [], []
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_())))],
                [x.split()[0] for x in _SCHEMA.split(", ")],
            )

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, j in blocks(raw(batch.column(1))[1]):
                ids, cuts = enc.column(batch.column(1).slice(i, j - i))
                for k in range(j - i):
                    own = np.concatenate([ids[cuts[k] : cuts[k + 1]], end])
                    for p, s in enumerate(range(0, len(own), LONGEST)):
                        if size >= SEGMENT or p:
                            yield flush()
                        held.append(own[s : s + LONGEST])
                        size += len(held[-1])
                        names.append(doc_ids[i + k])
                        docs.append(number)
                        more.append(p)
                        split.append(len(own) > LONGEST)
                    number += 1
        if held:
            yield flush()

    spark, rows = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Ranges follow the input's size; a repeated or null id is parted by how its texts begin.
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    rows = rows.repartitionByRange(ranges, F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(freeing(run), _SCHEMA).write.option("compression", "none").parquet(path)


def crc32_join(first: int, second: int, n: int) -> int:
    """crc32 of two byte strings one after the other, from theirs; n: bytes of the second."""

    def times(m, v):
        out, k = 0, 0
        while v:
            if v & 1:
                out ^= m[k]
            v, k = v >> 1, k + 1
        return out

    square = lambda m: [times(m, x) for x in m]
    m = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        m = square(m)  # one zero byte
    while n:
        if n & 1:
            first = times(m, first)
        n >>= 1
        m = square(m) if n else m
    return first ^ second


def read(spark: SparkSession, path: str) -> DataFrame:
    """What a store holds, one row for each document: doc_id, start, n_tokens, ids_crc32."""
    store = spark.read.parquet(path)

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):  # a segment at a time
                r = batch.slice(k, 1).to_pylist()[0]
                flat = decode(r["codes"]).tobytes()
                cuts = r["cuts"]
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
                ids = [None if z else x for x, z in zip(r["doc_ids"], r["nulls"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.full(len(ids), r["part"], np.int32)), pa.array(r["docs"], pa.int64()), pa.array(r["start"] + np.array(cuts[:-1])), pa.array(np.diff(cuts)), pa.array(crc, pa.int64()), pa.array(r["more"], pa.int32()), pa.array(r["split"], pa.bool_())],
                    ["doc_id", "part", "doc", "own_start", "n_tokens", "ids_crc32", "more", "split"],
                )

    places = "doc_id long, part int, doc long, own_start long, n_tokens long, ids_crc32 long, more int, split boolean"
    # Ranges ascend with their number, so what lies before a part is the sum over lower numbers: a row a part.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = store.groupBy("part").agg(F.sum("n").alias("_n")).select("part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_base"))

    def entries(segments: DataFrame) -> DataFrame:
        found = segments.select("part", "start", "codes", "doc_ids", "nulls", "cuts", "docs", "more", "split").mapInArrow(freeing(run), places)
        return found.join(bases, "part").withColumn("start", F.col("own_start") + F.col("_base"))

    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    # Only documents cut into parts are grouped: a row a part, LONGEST tokens each.
    cut = entries(store.where(F.exists("split", lambda x: x))).where("split").groupBy("part", "doc").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("more", F.col("n_tokens").alias("n"), F.col("ids_crc32").alias("crc")))).alias("parts"))

    def joined(batches):
        for batch in batches:
            out = []
            for parts in batch.column(3).to_pylist():
                crc = 0
                for p in parts:
                    crc = crc32_join(crc, p["crc"], 4 * p["n"])
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(out, pa.int64())], columns)

    whole = cut.select(*columns[:3], "parts").mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return entries(store).where("NOT split").select(columns).unionByName(whole)


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Write a store in the shared folder and read it back."""
    path = fresh(docs.sparkSession, "tokens")
    write(docs, path, vocabulary, end_id)
    return read(docs.sparkSession, path)
