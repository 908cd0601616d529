"""Text items of a page to lines: grouping by baseline, columns, assembly, superscripts, badges.

Items: idx, text, x, y, width, size, bold. The rules change what later items see (a superscript
takes its host's baseline, a line's size grows), so they fold over one page at a time.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_bold_font(name: Column) -> Column:
    return name.rlike("(?i)bold|black|heavy")


def is_italic_font(name: Column) -> Column:
    return name.rlike("(?i)italic|oblique")


def enrich(items: DataFrame) -> DataFrame:
    """Add size, x and y from the transform array of six numbers; items without text go."""
    t = lambda k: F.get("transform", F.lit(k))
    size = F.coalesce(F.nullif(F.hypot(t(0), t(1)), F.lit(0.0)), F.lit(1.0))
    return items.where("text IS NOT NULL").withColumn("size", size).withColumn("x", t(4)).withColumn("y", t(5))


def snap_superscripts(items: list[dict]) -> None:
    """Small raised items take the baseline of the first larger item that they follow closely."""
    for e in items:
        if not e["text"].strip():
            continue
        for host in items:
            h = host["size"]
            if host is e or not host["text"].strip() or h <= e["size"] / 0.7:
                continue
            rise, gap = e["y"] - host["y"], e["x"] - (host["x"] + host["width"])
            if 0.12 * h <= rise <= 0.7 * h and -0.5 * h <= gap <= 0.4 * h:
                e["y"], e["superscript"] = host["y"], True
                break


def snap_badges(items: list[dict], discs: list[dict]) -> None:
    """A short number inside a filled disc takes the baseline of the nearest item on its left."""
    for e in items:
        if not re.fullmatch(r"\d{1,3}", e["text"].strip()):
            continue
        cx, cy = e["x"] + e["width"] / 2, e["y"] + 0.35 * e["size"]
        if not any(d["x0"] <= cx <= d["x1"] and d["y0"] <= cy <= d["y1"] for d in discs):
            continue
        near = [(e["x"] - h["x"] - h["width"], k) for k, h in enumerate(items) if h is not e and h["text"].strip() and -2 <= e["x"] - h["x"] - h["width"] <= 4 * h["size"] and abs(h["y"] - e["y"]) <= 1.2 * h["size"]]
        if near:
            e["y"], e["badge"] = items[min(near)[1]]["y"], True


def strike_line(strikes: list[dict], y: float, size: float, x0: float, x1: float) -> dict | None:
    """The first rule that crosses a run at half height and isn't much longer than it."""
    for s in strikes:
        shared = min(s["x1"], x1) - max(s["x0"], x0)
        if 0.18 * size <= s["y"] - y <= 0.48 * size and shared > 0.5 * (x1 - x0) and s["x1"] - s["x0"] < 4 * (x1 - x0):
            return s
    return None


def physical_lines(items: list[dict]) -> list[list[dict]]:
    """Items by baseline: a line takes items within 0.3 of the larger size of its first item's height."""
    out: list[list[dict]] = []
    size = 0.0
    for e in sorted(items, key=lambda e: (-e["y"], e["x"], e["idx"])):
        if not out or abs(out[-1][0]["y"] - e["y"]) > 0.3 * max(e["size"], size):
            out.append([])
            size = 0.0
        out[-1].append(e)
        size = max(size, e["size"])
    return out


def split_at_columns(line: list[dict], bounds: list[float]) -> list[list[dict]]:
    """Pieces of a line (items from the left), cut where a boundary lies between two items."""
    out: list[list[dict]] = [[]]
    end = None
    for e in line:
        blank = not e["text"].strip()
        if blank and any(e["x"] < b < e["x"] + e["width"] for b in bounds):
            continue
        if end is not None and not blank and any(end <= b + 1 and e["x"] >= b - 1 for b in bounds):
            out.append([])
        out[-1].append(e)
        end = end if blank else e["x"] + e["width"]
    return [x for x in out if x]


def assemble(line: list[dict], strikes: list[dict] | None = None) -> dict:
    """One line: spaces put in at gaps, runs of equal style joined, large gaps noted in gap_splits."""
    runs: list[dict] = []
    text, splits = "", []
    mean, seen, end, ink = 0.0, 0, None, None
    for e in line:
        if end is not None:
            gap = e["x"] - end
            wide = max(0.25 * mean, 0.2 * e["size"]) if seen else 0.2 * e["size"]
            if gap > wide and not text.endswith(" ") and not e["text"].startswith(" "):
                text += " "
                runs[-1]["text"] += " "
            if e["text"].strip() and ink is not None and e["x"] - ink > 0.9 * e["size"]:
                splits.append(len(text))
        hit = strike_line(strikes or [], e["y"], e["size"], e["x"], e["x"] + e["width"])
        style = {"bold": e.get("bold", False), "italic": e.get("italic", False), "color": e.get("color"), "strikethrough": hit is not None}
        if runs and all(runs[-1][k] == v for k, v in style.items()):
            runs[-1]["text"] += e["text"]
        else:
            runs.append({"text": e["text"], **style})
        text += e["text"]
        if e["text"].strip():
            mean, seen = (mean * seen + e["width"] / max(1, len(e["text"]))) / (seen + 1), seen + 1
            ink = e["x"] + e["width"]
        end = e["x"] + e["width"]
    while runs and not runs[-1]["text"].strip():
        runs.pop()
    if runs:
        runs[-1]["text"] = runs[-1]["text"].rstrip()
    text = "".join(r["text"] for r in runs)
    return {"y": line[0]["y"], "x0": line[0]["x"], "x1": max(e["x"] + e["width"] for e in line), "size": max(e["size"] for e in line), "text": text, "runs": runs, "gap_splits": [k for k in splits if 0 < k < len(text)]}


def slice_line(line: dict, cuts: list[int]) -> list[dict]:
    """A line cut at offsets of its text: runs are cut alike, pieces trimmed on the left; all but the
    first are marked after_split."""
    out, bounds = [], [0, *sorted({c for c in cuts if 0 < c < len(line["text"])}), len(line["text"])]
    per = (line["x1"] - line["x0"]) / max(1, len(line["text"]))
    for a, b in zip(bounds, bounds[1:]):
        piece = line["text"][a:b]
        lead = len(piece) - len(piece.lstrip())
        if lead == len(piece):
            continue
        runs, at = [], 0
        for r in line["runs"]:
            lo, hi = max(a + lead, at), min(b, at + len(r["text"]))
            if hi > lo:
                runs.append({**r, "text": r["text"][lo - at : hi - at]})
            at += len(r["text"])
        own = [c - a - lead for c in line["gap_splits"] if a + lead < c < b]
        out.append({**line, "text": piece[lead:], "runs": runs, "gap_splits": own, "x0": line["x0"] + per * (a + lead), "x1": line["x0"] + per * b, "after_split": a > 0})
    return out


def page_lines(items: list[dict], bounds: list[float] | None = None, discs: list[dict] | None = None, strikes: list[dict] | None = None) -> list[dict]:
    """All lines of a page from its items."""
    items = [dict(e) for e in items if e["text"] == " " or e["text"].strip()]
    snap_superscripts(items)
    snap_badges(items, discs or [])
    pieces = (p for line in physical_lines(items) for p in split_at_columns(sorted(line, key=lambda e: (e["x"], e["idx"])), bounds or []))
    lines = [assemble(p, strikes) for p in pieces]
    return [x for x in lines if x["text"].strip()]


def lines(items: DataFrame) -> DataFrame:
    """doc_id, page, idx, y, x0, x1, size, text of every page's items (doc_id, page, idx, text, x, y, width, size)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = page_lines(pdf[["idx", "text", "x", "y", "width", "size"]].to_dict("records"))
        out = pd.DataFrame([(k, r["y"], r["x0"], r["x1"], r["size"], r["text"]) for k, r in enumerate(rows)], columns=["idx", "y", "x0", "x1", "size", "text"])
        out.insert(0, "doc_id", pdf["doc_id"].iloc[0])
        out.insert(1, "page", pdf["page"].iloc[0])
        return out

    return items.select("doc_id", "page", "idx", "text", "x", "y", "width", "size").groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, idx int, y double, x0 double, x1 double, size double, text string")


def match_colors(items: list[dict], samples: list[dict], reach: float = 6.0) -> None:
    """Each item takes the nearest colour sample that no other took, or the colour of the one before."""
    used: set[int] = set()
    last = None
    for e in items:
        best, at = reach, None
        for k, s in enumerate(samples):
            d = math.hypot(s["x"] - e["x"], s["y"] - e["y"])
            if k not in used and d < best:
                best, at = d, k
        if at is not None:
            used.add(at)
            last = samples[at]["color"]
        e["color"] = last
