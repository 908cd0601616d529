"""Best-fit packing of token sequences by linear grouping.

Every decision depends on the histogram of piece lengths, which has at most ``capacity``
entries whatever the corpus holds; so the driver plans on the histogram and executors place
pieces by their rank among those of equal length.

1. Large lengths (over a share of the capacity, see ``SHARES``), in descending order, are parted into ``groups`` of equal cardinality; each is
   rounded up to the largest of its group.
2. The few rounded sizes are packed by configurations: the linear programme over all
   configurations, by column generation, rounded down to whole sequences.
3. Actual lengths take the slots of their groups. They never exceed the rounded size.
4. What the rounding down left, and all small lengths, go best-fit, longest first, into the
   gaps; a new sequence opens only where no gap is large enough.

Edge cases: null text counts as empty, and an empty text is one piece of the end id alone;
repeated rows and null ids are packed like any others; an empty table gives an empty result; other
columns of ``docs`` have no part, and a table given to ``pack`` must not name one ``_salt``, ``_salts``
or ``_rank``.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._scratch import written
from ._tokens import default_vocabulary, encoder
from ._words import blocks, freeing, raw

CAPACITY = 2048
GROUPS = 128
#: Shares of the capacity above which a length may count as large: at most 4, 3, 2 or no items a configuration.
SHARES = (0.2, 0.25, 0.34, 1.0)
#: Pieces of one length that one task ranks, about.
RANKED = 1 << 18
#: Bytes of encoded runs that a worker remembers; it has no part in the result.
REMEMBERED = 48 << 20


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoder(vocabulary, remembered)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            offs = raw(batch.column(1))[1]
            for i, j in blocks(offs):
                ids, cuts = enc.column(batch.column(1).slice(i, j - i))
                flat, cuts = ids.tobytes(), cuts.tolist()
                row, piece, start, length, crc = [], [], [], [], []
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    own = flat[4 * a : 4 * b] + end
                    n = b - a + 1
                    for p, s in enumerate(range(0, n, capacity)):
                        row.append(i + k)
                        piece.append(p)
                        start.append(s)
                        length.append(min(capacity, n - s))
                        crc.append(zlib.crc32(own[4 * s : 4 * (s + capacity)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(freeing(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _inverse(a: np.ndarray) -> np.ndarray:
    """By elimination with row pivots, without the linear algebra library, whose threads may stall beside a JVM."""
    k = len(a)
    wide = np.concatenate([a, np.eye(k)], 1)
    for j in range(k):
        p = j + int(np.abs(wide[j:, j]).argmax())
        wide[[j, p]] = wide[[p, j]]
        wide[j] /= wide[j, j]
        rest = wide[:, j].copy()
        rest[j] = 0.0
        wide -= rest[:, None] * wide[j][None, :]
    return wide[:, k:]


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> tuple[float, list[tuple[int, np.ndarray]]]:
    """A lower bound of the configuration programme, and (whole multiplicity, slots of each size) from it.

    Column generation stops at the optimum, or where turns no longer gain; every turn's prices give a bound.
    """
    size, b = np.array(sizes), np.array(demand, float)
    k = len(size)
    basis = np.diag(capacity // size).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    room = np.arange(capacity + 1)[None, :] - size[:, None]
    fits, at = room >= 0, np.maximum(room, 0)
    bound, value_then, idle = 0.0, np.inf, 0
    for turn in range(8 * k):
        price = inverse.sum(0)
        now = float((price * b).sum())
        idle = 0 if now < value_then * (1 - 1e-6) else idle + 1
        value_then = min(value_then, now)
        if not np.isfinite(price).all() or idle > 40:
            break
        # The best value of at most 1, 2, ... items of large size, for every capacity at once.
        best, picks = np.zeros(capacity + 1), []
        for _ in range(capacity // int(size.min())):
            value = np.where(fits, best[at] + price[:, None], 0.0)
            g = value.argmax(0)
            top = value[g, np.arange(capacity + 1)]
            picks.append(np.where(top > best + 1e-12, g, -1))
            best = np.maximum(best, top)
        if price.min() >= 0:
            bound = max(bound, now / max(1.0, best[capacity]))
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                column[pick[c]] += 1
                c -= int(size[pick[c]])
        level, step = (inverse * b).sum(1), (inverse * column).sum(1)
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        if turn % 16 == 15 or step[out] < 1e-6:
            inverse = _inverse(basis)
        else:  # the new column enters the inverse
            row = inverse[out] / step[out]
            inverse -= step[:, None] * row[None, :]
            inverse[out] = row
    level = (_inverse(basis) * b).sum(1)
    found, left = [], b.copy()
    for j in np.argsort(-level):
        slots = np.maximum(basis[:, j], 0).round().astype(int)
        used = slots > 0
        whole = int(min(np.floor(level[j] + 1e-9), (left[used] // slots[used]).min())) if used.any() else 0
        if whole > 0:
            found.append((whole, slots))
            left -= whole * slots
    return bound, found


def _grouped(left: dict[int, int], large: list[int], groups: int) -> list[list[list[int]]]:
    """Runs of [length, how many] of equal cardinality, longest first."""
    card = -(-sum(left[n] for n in large) // groups)
    runs: list[list[list[int]]] = [[]]
    room = card
    for n in large:
        c = left[n]
        while c:
            if not room:
                runs.append([])
                room = card
            take = min(c, room)
            runs[-1].append([n, take])
            c, room = c - take, room - take
    return runs


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SHARES[0]) -> int:
    """Sequences that any packing needs: by volume, or by the programme with large lengths rounded down."""
    counts = np.asarray(counts, np.int64)
    volume = -(-int((counts * np.arange(len(counts))).sum()) // capacity)
    left = {int(n): int(counts[n]) for n in np.flatnonzero(counts) if n > capacity * small}
    if not left:
        return volume
    by_size: dict[int, int] = defaultdict(int)
    for g in _grouped(left, sorted(left, reverse=True), groups):
        by_size[g[-1][0]] += sum(c for _, c in g)
    sizes = sorted(by_size, reverse=True)
    return max(volume, int(np.ceil(_configurations(sizes, [by_size[s] for s in sizes], capacity)[0] - 1e-6)))


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences as (how many alike, [(length, how many of it in each)]) for a histogram of lengths.

    The share of the capacity above which a length is large is the one of ``SHARES`` that needs the fewest
    sequences; at the last, 1, no length is, so the plan never needs more than best-fit decreasing.
    """
    return min((_plan(counts, capacity, groups, share) for share in SHARES), key=lambda found: sum(many for many, _ in found))


def _plan(counts: np.ndarray, capacity: int, groups: int, small: float) -> list[tuple[int, list[tuple[int, int]]]]:
    counts = np.asarray(counts, np.int64)
    left = {int(n): int(counts[n]) for n in np.flatnonzero(counts) if n}
    done: list[tuple[int, list[tuple[int, int]]]] = []
    if left.get(capacity):
        done.append((left.pop(capacity), [(capacity, 1)]))
    large = sorted((n for n in left if n > capacity * small), reverse=True)
    open_bins: list[tuple[int, list[tuple[int, int]]]] = []
    if large:
        by_size: dict[int, list[list[int]]] = defaultdict(list)
        for g in _grouped(left, large, groups):  # groups whose largest lengths are equal are one size
            by_size[g[0][0]] += g
        sizes = sorted(by_size, reverse=True)
        for n in large:
            del left[n]
        for many, slots in _configurations(sizes, [sum(c for _, c in by_size[s]) for s in sizes], capacity)[1]:
            while many:
                alike = many
                for g in np.flatnonzero(slots):
                    alike = min(alike, max(1, by_size[sizes[g]][0][1] // int(slots[g])))
                content: list[tuple[int, int]] = []
                for g in np.flatnonzero(slots):
                    own, need = by_size[sizes[g]], int(slots[g])
                    while need:
                        take = min(need, own[0][1]) if alike == 1 else need
                        content.append((own[0][0], take))
                        own[0][1] -= take * alike
                        need -= take
                        if not own[0][1]:
                            own.pop(0)
                open_bins.append((alike, content))
                many -= alike
        for own in by_size.values():
            for n, c in own:
                left[n] = left.get(n, 0) + c
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    for many, content in open_bins:
        gaps[capacity - sum(n * c for n, c in content)].append((many, content))
    keys = sorted(gaps)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            at = bisect.bisect_left(keys, n)
            if at < len(keys):
                gap = keys[at]
                many, content = gaps[gap].pop()
            else:
                gap, content = capacity, []
                many = -(-c // (capacity // n))
            each = gap // n
            alike = min(many, c // each)
            each, alike = (each, alike) if alike else (c, 1)
            if at < len(keys):
                if many > alike:
                    gaps[gap].append((many - alike, content))
                if not gaps[gap]:
                    del gaps[gap]
                    keys.pop(at)
            rest = gap - n * each
            if rest not in gaps:
                bisect.insort(keys, rest)
            gaps[rest].append((alike, [*content, (n, each)]))
            c -= alike * each
    return done + [x for gap in sorted(gaps) for x in gaps[gap]]


def _places(classes: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, how many in each sequence), sorted."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for many, content in classes:
        offset = 0
        for n, c in content:
            rows.append((n, rank[n], sequence, offset, c))
            rank[n] += many * c
            offset += n * c
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(table: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces (see ``pieces``).

    ``table`` must read alike each time, as one of ``written`` does.
    """
    sizes = table.groupBy("length").count().collect()  # a row a length
    salts = {r["length"]: -(-r["count"] // RANKED) for r in sizes}
    spread = table.sparkSession.createDataFrame(sorted(salts.items()), "length long, _salts int")
    salted = table.join(F.broadcast(spread), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_salts")).cast("int")).drop("_salts").select(*table.columns, "_salt")
    found = salted.groupBy("length", "_salt").count().collect()  # capacity rows, and one for RANKED pieces
    counts, before = np.zeros(capacity + 1, np.int64), {}
    for n, k, many in sorted(found):
        before[n, k] = int(counts[n])
        counts[n] += many
    places = _places(plan(counts, capacity, groups))
    sc = table.sparkSession.sparkContext
    shared = sc.broadcast((np.array([(n * (1 << 32) + k, x) for (n, k), x in sorted(before.items())], np.int64).reshape(-1, 2), places))  # as many rows; a few entries for each length
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(own).cast("long") - 1)
    schema = T.StructType([*table.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        before, places = shared.value
        key = places[:, 0] * (1 << 44) + places[:, 1]
        for b in batches:
            n = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy() + before[np.searchsorted(before[:, 0], n * (1 << 32) + b.column("_salt").to_numpy()), 1]
            at = np.searchsorted(key, n * (1 << 44) + rank, side="right") - 1
            _, first, sequence, offset, each = places[at].T
            more = [pa.array(sequence + (rank - first) // each), pa.array(offset + (rank - first) % each * n)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in schema.fields[:-2]), *more], schema.names)

    return ranked.mapInArrow(freeing(run), schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, remembered: int = REMEMBERED) -> DataFrame:
    """Cut documents into pieces of ``capacity`` tokens at most and pack them all."""
    return pack(written(pieces(docs, vocabulary or default_vocabulary(), capacity, remembered=remembered), "pieces"), capacity, groups)
