"""Ruled tables, cut lines, regions and shape classes of a page; folds over tens of shapes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECORATIVE = 26.0


def _round(x: float) -> int:
    return math.floor(x + 0.5)


def classify_shapes(shapes: list[dict]) -> dict[str, list[dict]]:
    """Painted shapes as boxes (fill and stroke of the same box joined), thin lines, and decorations."""
    out: dict[str, list[dict]] = {"boxes": [], "lines": [], "decorative": []}
    left = [s for s in shapes if s["x1"] - s["x0"] >= 1 or s["y1"] - s["y0"] >= 1]
    while left:
        s, *left = left
        w, h = s["x1"] - s["x0"], s["y1"] - s["y0"]
        if min(w, h) < 1.5:
            out["lines"].append({**s, "color": s.get("stroke") or s.get("fill")})
        elif max(w, h) <= DECORATIVE:
            out["decorative"].append(s)
        else:
            near = max(1.5, 0.01 * max(w, h))
            twin = next((k for k, o in enumerate(left) if all(abs(s[e] - o[e]) < near for e in ("x0", "x1", "y0", "y1"))), None)
            other = left.pop(twin) if twin is not None else {}
            out["boxes"].append({**s, "fill": s.get("fill") or other.get("fill"), "stroke": s.get("stroke") or other.get("stroke")})
    return out


def _groups(linked: np.ndarray) -> list[np.ndarray]:
    """Connected groups of a symmetric boolean matrix, by spreading the least label."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        spread = np.where(linked, label[None, :], len(linked)).min(1)
        if (spread == label).all():
            return [np.flatnonzero(label == k) for k in np.unique(label)]
        label = spread


def detect_tables(lines: list[dict], boxes: list[dict] | None = None, modal: float | None = None, texts: list[dict] | None = None) -> list[dict]:
    """Tables from rules: x0, y0, x1, y1, row_bounds from the top, col_bounds from the left.

    Horizontal rules belong together if they touch in x, neither lies inside the other, and they
    are within three body sizes or joined by an upright.
    """
    boxes = boxes or []
    flat = [x for x in lines if abs(x["y1"] - x["y0"]) < 1.5 and x["x1"] - x["x0"] > 15]
    upright = [x for x in lines if abs(x["x1"] - x["x0"]) < 1.5 and x["y1"] - x["y0"] > 15]
    if len(flat) < 2:
        return []
    a, b, y = (np.array([f(x) for x in flat]) for f in (lambda x: x["x0"], lambda x: x["x1"], lambda x: (x["y0"] + x["y1"]) / 2))
    touch = np.minimum(b[:, None], b[None]) - np.maximum(a[:, None], a[None]) > -3
    shorter = (b - a)[:, None] <= (b - a)[None]
    inside = (a[:, None] > a[None] + 3) & (b[:, None] < b[None] - 3)
    swallowed = (shorter & inside) | (shorter & inside).T
    posts = [((v["x0"] + v["x1"]) / 2, v["y0"], v["y1"]) for v in upright] + [(x, o["y0"], o["y1"]) for o in boxes for x in (o["x0"], o["x1"])]
    joined = np.abs(y[:, None] - y[None]) <= (3 * modal if modal else np.inf)
    low, high = np.minimum(y[:, None], y[None]), np.maximum(y[:, None], y[None])
    left, right = np.maximum(a[:, None], a[None]) - 3, np.minimum(b[:, None], b[None]) + 3
    for x, y0, y1 in posts:
        joined |= (left <= x) & (x <= right) & (y0 <= low + 2) & (y1 >= high - 2)
    found = []
    for group in _groups(touch & ~swallowed & joined):
        if len(group) < 2:
            continue
        x0, x1 = float(a[group].min()), float(b[group].max())
        rows = sorted({_round(flat[k]["y0"]) for k in group}, reverse=True)
        if texts is not None and modal:
            empty = lambda hi, lo: not any(lo < t["y"] < hi and x0 - 2 <= t["x0"] <= x1 + 2 for t in texts)
            while len(rows) > 2 and rows[0] - rows[1] < modal and empty(rows[0], rows[1]):
                rows = rows[1:]
            while len(rows) > 2 and rows[-2] - rows[-1] < modal and empty(rows[-2], rows[-1]):
                rows = rows[:-1]
        if len(rows) < 2 or rows[0] - rows[-1] < 8:
            continue
        ups = [v for v in upright if v["y1"] >= rows[-1] - 2 and v["y0"] <= rows[0] + 2 and x0 - 3 <= v["x0"] <= x1 + 3]
        beside = [x for o in boxes if o["y1"] >= rows[-1] and o["y0"] <= rows[0] for x in (o["x0"], o["x1"]) if x0 - 2 <= x <= x1 + 2]
        all_x = sorted({_round(x) for x in (x0, x1, *(v["x0"] for v in ups), *beside)})
        columns = [x for k, x in enumerate(all_x) if not k or x - all_x[k - 1] > 2]
        if len(columns) < 2 or modal and len(columns) == 2 and not ups:
            continue
        found.append({"x0": x0, "y0": float(rows[-1]), "x1": x1, "y1": float(rows[0]), "row_bounds": rows, "col_bounds": columns})
    return found


def cut_lines(shapes: list[dict], width: float, height: float, scissors: list[dict] | None = None) -> list[dict]:
    """Dashed lines across a page: orient, pos, start, end; groups of parallel ones are for writing."""
    spans = []
    for orient, (a, b), (c, d) in (("h", ("x0", "x1"), ("y0", "y1")), ("v", ("y0", "y1"), ("x0", "x1"))):
        rows: dict[int, list[dict]] = {}
        for s in shapes:
            along, across = s[b] - s[a], s[d] - s[c]
            if across < 1.5 and along >= across or max(along, across) <= 4:
                rows.setdefault(_round((s[c] + s[d]) / 2), []).append(s)
        for pos, row in rows.items():
            chain: dict | None = None
            for s in sorted(row, key=lambda s: s[a]):
                if chain and s[a] - chain["end"] <= 10:
                    chain["end"], chain["n"] = max(chain["end"], s[b]), chain["n"] + 1
                    chain["dashed"] |= bool(s.get("dashed"))
                else:
                    chain = {"orient": orient, "pos": pos, "start": s[a], "end": s[b], "n": 1, "dashed": bool(s.get("dashed"))}
                    spans.append(chain)

    def near(s: dict) -> bool:
        x, y = ("x", "y") if s["orient"] == "h" else ("y", "x")
        return any(abs(p[y] - s["pos"]) < 20 and s["start"] - 30 <= p[x] <= s["end"] + 30 for p in scissors or [])

    long_enough = lambda s: s["end"] - s["start"] >= (0.8 * width if s["orient"] == "h" else 0.6 * height)
    held = [s for s in spans if long_enough(s) and (s["dashed"] or s["n"] >= 8 or near(s))]
    twin = lambda s, o: o is not s and o["orient"] == s["orient"] and abs(o["pos"] - s["pos"]) <= 40 and abs(o["start"] - s["start"]) < 6 and abs(o["end"] - s["end"]) < 6
    return [{k: s[k] for k in ("orient", "pos", "start", "end")} for s in held if near(s) or not any(twin(s, o) for o in held)]


def regions(cuts: list[dict], width: float, height: float) -> list[dict]:
    """Bands between horizontal cuts, each parted by the vertical ones that cover over half of it."""
    edges = [height + 1, *sorted((c["pos"] for c in cuts if c["orient"] == "h"), reverse=True), -1]
    out = []
    for top, low in zip(edges, edges[1:]):
        if top - low < 2:
            continue
        across = sorted(c["pos"] for c in cuts if c["orient"] == "v" and min(top, c["end"]) - max(low, c["start"]) > 0.5 * (top - low))
        sides = [-1, *across, width + 1]
        out += [{"x0": a, "x1": b, "y0": low, "y1": top} for a, b in zip(sides, sides[1:])]
    return out


def region_of(x: float, y: float, found: list[dict]) -> int:
    """The first region that holds a point, half open; -1: none."""
    return next((k for k, r in enumerate(found) if r["x0"] <= x < r["x1"] and r["y0"] < y <= r["y1"]), -1)


def page_tables(shapes: DataFrame, modal: float | None = None) -> DataFrame:
    """path, page, idx, x0, y0, x1, y1, row_bounds, col_bounds of every page's painted shapes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = classify_shapes(pdf.sort_values("idx")[["x0", "y0", "x1", "y1", "fill", "stroke", "dashed"]].to_dict("records"))
        found = detect_tables(own["lines"], own["boxes"], modal)
        out = pd.DataFrame(found, columns=["x0", "y0", "x1", "y1", "row_bounds", "col_bounds"])
        out.insert(0, "path", pdf["path"].iloc[0])
        out.insert(1, "page", pdf["page"].iloc[0])
        out.insert(2, "idx", range(len(out)))
        return out

    return shapes.where(F.col("kind") == "shape").select("path", "page", "idx", "x0", "y0", "x1", "y1", "fill", "stroke", "dashed").groupBy("path", "page").applyInPandas(run, "path string, page int, idx int, x0 double, y0 double, x1 double, y1 double, row_bounds array<int>, col_bounds array<int>")


def cells(tables: DataFrame) -> DataFrame:
    """A row a cell: path, page, idx, row, column and its box."""
    rows = F.posexplode(F.arrays_zip(F.slice("row_bounds", F.lit(1), F.size("row_bounds") - 1).alias("y1"), F.slice("row_bounds", F.lit(2), F.size("row_bounds") - 1).alias("y0")))
    columns = F.posexplode(F.arrays_zip(F.slice("col_bounds", F.lit(1), F.size("col_bounds") - 1).alias("x0"), F.slice("col_bounds", F.lit(2), F.size("col_bounds") - 1).alias("x1")))
    return tables.select("path", "page", "idx", "col_bounds", rows.alias("row", "r")).select("path", "page", "idx", "row", "r", columns.alias("column", "c")).select("path", "page", "idx", "row", "column", "c.x0", "c.x1", "r.y0", "r.y1")
