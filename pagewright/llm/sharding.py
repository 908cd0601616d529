"""K-d tree partitioning of rows into shards of near equal bytes.

A node holding k shards is split where the weight reaches the left half's share, along the dimension
whose span, as a share of its span in the whole table, is widest; leaves are single shards, which is
when their bytes reach the target (total / shards). The weighted median is found by rounds of
histograms over the distributed rows: each round buckets the keys between the current bounds,
sums the weights, and narrows to the bucket that holds the cut. Where ``BUCKETS`` rows at most are left
between the bounds, these rows decide the cut themselves. The driver sees ``BUCKETS`` rows a node and round
at most. A cut is lexicographic (dimension, other dimensions, group, id), so that ties
of any size are cut too.

Groups (equal texts) stay together. Those of at least ``SINGLE`` of a shard's target go, heaviest first,
into the shard with most room left, and the tree splits the rest by the room that remains in each shard;
lighter groups go whole to the nearer side of a cut. A group that no shard has room for, as one over
a whole target, is parted: its rows go through the tree one by one.

Edge cases: null text weighs ``overhead`` bytes; null dimensions and ids count as -1; repeated rows
with the same id can't be parted; columns of the input named ``shard`` or ``slot`` give way to the
results, other names don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._scratch import written

BUCKETS = 4096
SINGLE = 0.01
#: A cut may miss the weighted median by half this share of a shard's target.
NEAR = 0.0025
#: Rows of a shard that one task numbers, about.
NUMBERED = 1 << 18


@dataclass
class _Node:
    """The rows between lexicographic bounds; ``cut``: the last key that goes left."""

    shards: int
    weight: int
    first: int
    keys: list[str] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    span: tuple[int, int] | None = None
    rows: int = 0
    left: _Node | None = None
    right: _Node | None = None


def _goes_left(keys: list[str], cut: list[int]) -> str:
    """SQL: key <= cut, lexicographically; the cut may be shorter than the keys."""
    at = len(cut) - 1
    test = f"{keys[at]} <= {cut[at]}L"
    for k, v in list(zip(keys, cut))[-2::-1]:
        test = f"({k} < {v}L OR ({k} = {v}L AND {test}))"
    return test


def _place(node: _Node, of) -> Column:
    """An expression over the tree, parsed once; ``of`` gives a leaf's value."""

    def sql(n: _Node) -> str:
        if n.left is None:
            return str(of(n))
        return f"CASE WHEN {_goes_left(n.keys, n.cut)} THEN {sql(n.left)} ELSE {sql(n.right)} END"

    return F.expr(sql(node))


def _values(table: DataFrame, rows: list[tuple], kinds: str) -> DataFrame:
    """A small table from literals."""
    sql = lambda x: "null" if x is None else f"array({', '.join(map(str, x))})" if isinstance(x, list) else str(x)
    columns = [x.split() for x in kinds.split(", ")]
    lines = ", ".join(f"({', '.join(map(sql, r))})" for r in rows) or f"({', '.join('null' for _ in columns)})"
    names = ", ".join(f"_c{i}" for i in range(len(columns)))
    casts = ", ".join(f"CAST(_c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(columns))
    return table.sparkSession.sql(f"SELECT {casts} FROM VALUES {lines} AS t({names})")


def _between(rows: DataFrame, state: list[tuple]) -> DataFrame:
    """Rows (_node, _weight, _tail: keys after the cut so far) that lie within their node's bounds, with these."""
    asked = F.broadcast(_values(rows, state, "_node int, _order array<int>, _cut array<bigint>, _low bigint, _high bigint"))  # a row a node
    mine = F.transform("_order", lambda i: F.get("_keys", i))
    own = rows.join(asked, "_node").withColumn("_mine", mine).where(F.slice("_mine", 1, F.size("_cut")) == F.col("_cut"))
    own = own.select("_node", "_weight", "_low", "_high", F.slice("_mine", F.size("_cut") + 1, F.size("_mine")).alias("_tail"))
    return own.where(F.col("_low").isNull() | F.get("_tail", F.lit(0)).between(F.col("_low"), F.col("_high")))


def _finish(rows: list[tuple[list[int], int]], below: int, want: float, whole: float) -> tuple[list[int], int]:
    """The cut among rows (keys, weight) and the weight at or below it; rows alike in all keys but the last
    stay together where they weigh less than ``whole``."""
    groups: dict[tuple, dict[int, int]] = {}
    for tail, w in rows:
        ids = groups.setdefault(tuple(tail[:-1]), {})
        ids[tail[-1]] = ids.get(tail[-1], 0) + w
    units: list[tuple[tuple, int]] = []
    for g in sorted(groups):
        w = sum(groups[g].values())
        units += [(g, w)] if g and w < whole else [((*g, i), groups[g][i]) for i in sorted(groups[g])]
    for k, (unit, w) in enumerate(units):
        if below + w >= want or k == len(units) - 1:
            break
        below += w
    if below + w - want >= want - below and below > 0:  # the nearer side: this one goes right
        return [*unit[:-1], unit[-1] - 1], below
    return list(unit), below + w


def _cuts(table: DataFrame, root: _Node, nodes: list[_Node], room: list[float], target: float) -> None:
    """Find the cut of every node, a histogram for all of them in each round; room: what each shard can take."""
    names = nodes[0].keys
    at = {id(n): k for k, n in enumerate(nodes)}
    rows = table.select(_place(root, lambda n: at.get(id(n), -1)).cast("int").alias("_node"), "_weight", F.array(*names).alias("_keys"))
    share = lambda n: sum(room[n.first : n.first + n.shards // 2]) / (sum(room[n.first : n.first + n.shards]) or 1)
    want = {k: n.weight * share(n) for k, n in enumerate(nodes)}
    below = dict.fromkeys(want, 0)
    bounds: dict[int, tuple[int, int] | None] = {k: n.span for k, n in enumerate(nodes)}
    state = lambda ks: [(k, [names.index(x) for x in nodes[k].keys], nodes[k].cut, *(bounds[k] or (None, None))) for k in sorted(ks)]
    few = {k for k, n in enumerate(nodes) if n.rows <= BUCKETS}
    going = set(want) - few
    while going:
        asked = state(going)
        own = _between(rows, asked).withColumn("_key", F.get("_tail", F.lit(0)))
        # doubles are exact enough for buckets: bounds come from the keys found in them
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("_key") - F.col("_low")).cast("double") * BUCKETS / ((F.col("_high") - F.col("_low")).cast("double") + 1)))
        found: dict[int, list] = {}
        for r in own.groupBy("_node", F.coalesce(bucket, F.lit(0)).alias("_bucket")).agg(F.sum("_weight").alias("w"), F.min("_key").alias("a"), F.max("_key").alias("b"), F.count("*").alias("n")).collect():
            found.setdefault(r["_node"], []).append((r["_bucket"], r["w"], r["a"], r["b"], r["n"]))
        for k, _, _, a, _ in asked:
            n = nodes[k]
            for _, w, x, y, many in sorted(found[k]):
                if a is None or below[k] + w >= want[k]:
                    break
                below[k] += w
            bounds[k] = (x, y)
            over = below[k] + w - want[k] >= want[k] - below[k] and below[k] > 0
            if x < y and w <= NEAR * target:  # the bucket goes whole to the nearer side
                n.cut.append(x - 1 if over else y)
                below[k] += 0 if over else w
                going.discard(k)
            elif x == y:  # one value: the next key decides among its rows
                n.cut.append(x)
                bounds[k] = None
                small = len(n.cut) == len(n.keys) - 1 and w < SINGLE * target
                if len(n.cut) == len(n.keys) or small:
                    if over:
                        n.cut[-1] -= 1  # the nearer side: these rows go right
                    else:
                        below[k] += w
                    going.discard(k)
            if k in going and many <= BUCKETS:
                few.add(k)
                going.discard(k)
    left: dict[int, list] = {k: [] for k in few}
    for r in _between(rows, state(few)).select("_node", "_tail", "_weight").collect() if few else []:  # BUCKETS rows a node at most
        left[r["_node"]].append((r["_tail"], r["_weight"]))
    for k in few:
        tail, below[k] = _finish(left[k], below[k], want[k], SINGLE * target)
        nodes[k].cut += tail
    for k, n in enumerate(nodes):
        h = n.shards // 2
        n.left, n.right = _Node(h, below[k], n.first), _Node(n.shards - h, n.weight - below[k], n.first + h)


def _roomy(groups: list[tuple], shards: int, target: float) -> tuple[list[tuple], list[float]]:
    """Groups (..., weight) that fit a shard whole, with it, and the room left in each shard."""
    room, placed = [target] * shards, []
    for g in sorted(groups, key=lambda g: (-g[-1], g)):
        s = max(range(shards), key=lambda s: room[s])
        if g[-1] <= room[s]:
            room[s] -= g[-1]
            placed.append((*g[:-1], s))
    return placed, room


def shard(rows: DataFrame, shards: int, dimensions: list[str], weight: str, row_id: str, group: list[str]) -> DataFrame:
    """Add shard and slot (gapless from 0 within the shard) to ``rows``.

    ``rows`` must read alike each time, as a table of ``written`` does; ``dimensions``, ``weight`` and
    ``group`` are numeric columns, and rows of a group must agree in ``dimensions``.
    """
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1))
    own = [f"k{i}" for i in range(len(dimensions))]
    ties = [f"g{i}" for i in range(len(group))]
    keys = [*own, *ties]
    table = rows.select(F.struct(*(c for c in rows.columns if c not in ("shard", "slot"))).alias("row"), *(number(c).alias(k) for c, k in zip([*dimensions, *group], keys)), number(row_id).alias("_id"), F.col(weight).cast("long").alias("_weight"))
    ends = [f(k).alias(f"{n}{k}") for k in own for f, n in ((F.min, "a"), (F.max, "b"))]
    whole = table.agg(F.sum("_weight").alias("w"), F.count("*").alias("n"), *ends).first()
    target = (whole["w"] or 0) / shards
    heavy = table.groupBy(*ties).agg(F.sum("_weight").alias("w")).where(F.col("w") >= SINGLE * target).collect() if whole["n"] else []  # shards / SINGLE rows at most
    placed, room = _roomy([tuple(r) for r in heavy], shards, target)
    home = F.broadcast(rows.sparkSession.createDataFrame(placed, ", ".join(f"{k} long" for k in ties) + ", home int"))  # as many rows at most
    table = table.join(home, ties, "left")
    loose = table.where("home IS NULL")
    weight_left = (whole["w"] or 0) - sum(target - r for r in room)
    root = _Node(shards, round(weight_left), 0)
    level = [root] if root.weight > 0 and shards > 1 else []
    while level:
        at = {id(n): k for k, n in enumerate(level)}
        spans = {r["_node"]: r for r in loose.withColumn("_node", _place(root, lambda n: at.get(id(n), -1))).where("_node >= 0").groupBy("_node").agg(F.count("*").alias("n"), *ends).collect()}
        level = [n for k, n in enumerate(level) if k in spans]
        if not level:
            break
        for n in level:
            r = spans[at[id(n)]]
            share = {k: (r[f"b{k}"] - r[f"a{k}"]) / max(1, whole[f"b{k}"] - whole[f"a{k}"]) for k in own}
            widest = max(own, key=lambda k: share[k])
            n.span, n.rows = (r[f"a{widest}"], r[f"b{widest}"]), r["n"]
            n.keys = [widest, *(k for k in own if k != widest), *ties, "_id"]
        _cuts(loose, root, level, room, target)
        level = [x for n in level for x in (n.left, n.right) if x.shards > 1 and x.weight]
    salts = max(1, -(-whole["n"] // shards // NUMBERED))
    marked = table.withColumn("shard", F.coalesce("home", _place(root, lambda n: n.first)).cast("int")).withColumn("_salt", F.pmod(F.xxhash64("_id", *keys), F.lit(salts)).cast("int"))
    before, offsets = dict.fromkeys(range(shards), 0), []
    for s, k, many in sorted(tuple(r) for r in marked.groupBy("shard", "_salt").count().collect()):  # shards * salts rows
        offsets.append((s, k, before[s]))
        before[s] += many
    base = F.broadcast(rows.sparkSession.createDataFrame(offsets, "shard int, _salt int, _before long"))  # as many
    mine = Window.partitionBy("shard", "_salt").orderBy("_id", *keys)
    return marked.join(base, ["shard", "_salt"]).select("row.*", "shard", (F.col("_before") + F.row_number().over(mine) - 1).alias("slot"))


def code(name: Column) -> Column:
    """A number that orders strings as their first seven bytes do."""
    return F.conv(F.rpad(F.hex(F.substring(name.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """Shards of near equal bytes: doc_id, size, text_crc32, shard, slot.

    The dimensions are the documents' metadata: source, language and text size. Copies under several sources
    or languages take the least of each, so a group of equal texts is one point of the space.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = lambda c: F.coalesce(code(F.col(c).cast("string")), F.lit(-1)) if c in docs.columns else F.lit(-1).cast("long")
    table = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash"), named("source").alias("source"), named("lang").alias("lang"))
    table = written(table, "shard")
    group = ["size", "text_crc32", "hash"]
    mixed = table.groupBy(*group).agg(F.min("source").alias("_source"), F.min("lang").alias("_lang"), (F.max("source") > F.min("source")).alias("_a"), (F.max("lang") > F.min("lang")).alias("_b")).where("_a OR _b").drop("_a", "_b")
    table = table.join(mixed, group, "left").select("doc_id", *group, F.coalesce("_source", "source").alias("source"), F.coalesce("_lang", "lang").alias("lang"))
    out = shard(written(table, "shard"), shards, ["source", "lang", "size"], "size", "doc_id", group)
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
