"""Text edits: visible blocks in reading order, paragraph alignment, and edits applied to runs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..settings import Settings


def visible(blocks: DataFrame, by: list[str], order: str, settings: Settings) -> DataFrame:
    """Blocks that are shown, with pos: by rank; one without a rank follows the last that has one."""
    shown = ~F.col("secondary") & ~F.col("duplicate") & (F.trim("text") != "")
    if not settings.show_header_footer:
        shown = shown & ~F.col("header_footer")
    rows = blocks.where(shown)
    before = F.last("rank", ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    key = F.coalesce(F.col("rank").cast("double"), before + 0.5, F.lit(-1.0))
    return rows.withColumn("_k", key).withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("_k", order))).drop("_k")


def similarity(a: str, b: str) -> float:
    """Dice similarity of bigram multisets, case folded."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = (Counter(zip(s, s[1:])) for s in (a, b))
    return 2 * (x & y).total() / (len(a) + len(b) - 2)


def _gap(old: list[str], new: list[str], i0: int, j0: int, most: int, least: float) -> list[tuple[str, int | None, int | None]]:
    """Operations between two anchors."""
    n, m = len(old), len(new)
    if not n or not m:
        return [("del", i0 + i, None) for i in range(n)] + [("add", None, j0 + j) for j in range(m)]
    if n == m:
        return [("edit", i0 + k, j0 + k) for k in range(n)]
    if n * m > most:
        both = min(n, m)
        return [("edit", i0 + k, j0 + k) for k in range(both)] + [("del", i0 + k, None) for k in range(both, n)] + [("add", None, j0 + k) for k in range(both, m)]
    near = [[similarity(a, b) for b in new] for a in old]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], near[i][j] + best[i + 1][j + 1] if near[i][j] >= least else 0.0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if near[i][j] >= least and best[i][j] == near[i][j] + best[i + 1][j + 1]:
            out.append(("edit", i0 + i, j0 + j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            out.append(("del", i0 + i, None))
            i += 1
        else:
            out.append(("add", None, j0 + j))
            j += 1
    return out + [("del", i0 + k, None) for k in range(i, n)] + [("add", None, j0 + k) for k in range(j, m)]


def align(old: list[str], new: list[str], most: int = 250_000, least: float = 0.35) -> list[tuple[str, int | None, int | None]]:
    """keep, edit, del and add operations that turn paragraphs ``old`` into ``new``."""
    codes = {t: k for k, t in enumerate(dict.fromkeys([*old, *new]))}
    y = np.array([codes[t] for t in new], np.int64)
    table = np.zeros((len(old) + 1, len(new) + 1), np.int32)  # common paragraphs from (i, j) on
    for i in range(len(old) - 1, -1, -1):
        best = np.maximum(table[i + 1, :-1], table[i + 1, 1:] + (y == codes[old[i]]))
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out: list[tuple[str, int | None, int | None]] = []
    i = j = si = sj = 0
    while i < len(old) and j < len(new):
        if old[i] == new[j]:
            out += [*_gap(old[si:i], new[sj:j], si, sj, most, least), ("keep", i, j)]
            i, j = i + 1, j + 1
            si, sj = i, j
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out + _gap(old[si:], new[sj:], si, sj, most, least)


def paragraph_diff(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """by, seq, op, i, j: the alignment of each document's paragraphs (columns pos, text)."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        key = (a if len(a) else b)[by].iloc[0]
        ops = align(a.sort_values("pos")["text"].tolist(), b.sort_values("pos")["text"].tolist())
        return pd.DataFrame({by: key, "seq": range(len(ops)), "op": [o[0] for o in ops], "i": pd.array([o[1] for o in ops], "Int32"), "j": pd.array([o[2] for o in ops], "Int32")})

    kind = old.schema[by].dataType.simpleString()
    return old.select(by, "pos", "text").groupBy(by).cogroup(new.select(by, "pos", "text").groupBy(by)).applyInPandas(run, f"{by} {kind}, seq int, op string, i int, j int")


def apply_text(runs: list[dict], text: str) -> list[dict]:
    """Runs with a new text: common ends keep their runs, what is put between takes the replaced
    style, or, as a pure insertion, that of the character before."""
    old = "".join(r["text"] for r in runs)
    if old == text or not runs:
        return runs if runs else [{"text": text}]
    head = 0
    while head < min(len(old), len(text)) and old[head] == text[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(text)) - head and old[-1 - tail] == text[-1 - tail]:
        tail += 1
    stop = len(old) - tail
    styles = [k for k, r in enumerate(runs) for _ in r["text"]]
    at = styles[head] if stop > head else styles[head - 1] if head else 0
    chars = [(c, styles[k]) for k, c in enumerate(old[:head])] + [(c, at) for c in text[head : len(text) - tail]] + [(c, styles[stop + k]) for k, c in enumerate(old[stop:])]
    out: list[dict] = []
    last = None
    for c, k in chars:
        if k == last:
            out[-1]["text"] += c
        else:
            out.append({**runs[k], "text": c})
            last = k
    return out


def apply_edits(blocks: DataFrame, ops: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Edited blocks: kept ones as they are, edited ones with the new text, deleted ones gone, added
    ones after the block before them; columns by, order, text, edited, added."""
    joined = ops.join(blocks.select(by, F.col("pos").alias("i"), F.col("text").alias("old")), [by, "i"], "left").join(new.select(by, F.col("pos").alias("j"), F.col("text").alias("now")), [by, "j"], "left")
    text = F.when(F.col("op") == "keep", F.col("old")).otherwise(F.col("now"))
    return joined.where("op <> 'del'").select(by, F.col("seq").alias("order"), text.alias("text"), (F.col("op") == "edit").alias("edited"), (F.col("op") == "add").alias("added"))
