"""Runs of a block: text, display in black and white, editing state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import text as X


def block_text(runs: Column) -> Column:
    return X.collapse(F.array_join(F.transform(runs, lambda r: r["text"]), ""))


def run_style(run: Column) -> Column:
    """Italic is known but never shown."""
    return F.when(run["bold"], "bold").otherwise("normal")


def dominant_color(runs: Column) -> Column:
    """The colour with most characters other than space; colours within 8 of an earlier run's are one."""
    weight = lambda c: F.aggregate(F.filter(runs, lambda r: C.same_color(r["color"], c)), F.lit(0), lambda a, r: a + F.length(F.regexp_replace(r["text"], r"\s", "")))
    weighed = F.transform(runs, lambda r, k: F.struct(weight(r["color"]).alias("n"), (-k).alias("k"), r["color"].alias("color")))
    return F.array_max(weighed)["color"]


def for_display(runs: Column, black_white: bool) -> Column:
    """In black and white a run told apart by colour becomes bold, underlined if it is bold already."""
    if not black_white:
        return runs
    main = dominant_color(runs)

    def shown(r: Column) -> Column:
        apart = C.is_chromatic(r["color"]) & ~C.same_color(r["color"], main) & (X.strip(r["text"]) != "")
        apart = F.coalesce(apart, F.lit(False))
        return F.struct(r["text"].alias("text"), (r["bold"] | apart).alias("bold"), r["color"].alias("color"), (apart & r["bold"]).alias("underline"))

    return F.transform(runs, shown)


def widest_word(text: Column, size: Column) -> Column:
    """Width of a text's widest word, by the advance table."""
    from ..functions.measure import text_width

    return F.array_max(F.transform(F.split(text, r"\s+"), lambda w: text_width(w, size)))


def normalise_paragraph(rows: DataFrame) -> DataFrame:
    """Unknown alignments and markers become null."""
    return rows.withColumn("align", F.when(F.col("align").isin("left", "center", "right", "justify"), F.col("align"))).withColumn("marker", F.when(F.col("marker").isin("none", "bullet", "dash", "number"), F.col("marker")))


def is_dirty(before: DataFrame, after: DataFrame) -> bool:
    """Whether an edit session changed any paragraph (pos, text, align, marker)."""
    columns = ["pos", "text", "align", "marker"]
    return not (before.select(columns).exceptAll(after.select(columns)).isEmpty() and after.select(columns).exceptAll(before.select(columns)).isEmpty())


def baseline_clusters(items: list[dict], reach: float = 2.0) -> list[list[dict]]:
    """Items by baseline: each joins the first cluster whose first item is within ``reach``."""
    out: list[list[dict]] = []
    for e in items:
        home = next((c for c in out if abs(c[0]["y"] - e["y"]) <= reach), None)
        if home is None:
            out.append([e])
        else:
            home.append(e)
    return out
