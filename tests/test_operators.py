"""Folds and functions on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.operators import edit, layout, lines, metrics, ocr, raster, tables
from pagewright.settings import Settings
from pagewright.sources import pdf


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (X.substitute_glyphs, "★ a ➜ b ✂", "* a → b "),
        (X.strip_marker, " 12. mot", "mot"),
        (X.rejoin_hyphens, "gron- dait", "grondait"),
        (X.clean_ocr_noise, "a |_ b ( ~~)", "a b"),
        (X.french_quotes, "< oui > dit-il", "« oui » dit-il"),
        (X.isolated_dashes, "- oui", "— oui"),
        (X.drop_tail_residue, "fin. 18 Et", "fin."),
        (X.drop_tail_residue, "fin. la suite longue 18", "fin. la suite longue 18"),
        (X.strip, "  x﻿", "x"),
    ],
)
def test_text(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_paragraphs_parse_and_join(spark):
    assert one(spark, "a\n b\n \t\nc\r\n\r\n\n", X.parse_paragraphs) == ["a b", "c"]


def test_hyphens_join_in_chains(spark):
    df = spark.createDataFrame([(["la gron-", "dait et", "Fin-", "Suite"],)], "l array<string>")
    assert df.select(X.join_lines(F.col("l"))).first()[0] == "la grondait et Fin- Suite"


def test_settings():
    assert Settings(font_size=12).clamped().font_size == 20
    assert Settings(line_height=3).clamped().line_height == 1.5
    assert Settings(simplified=True).effective().color_mode == "nb" and Settings(simplified=True).color_mode == "couleur"


def test_align():
    assert edit.align(list("abcd"), list("acd")) == [("keep", 0, 0), ("del", 1, None), ("keep", 2, 1), ("keep", 3, 2)]
    assert edit.align(["a", "old text", "c"], ["a", "new text", "c"])[1] == ("edit", 1, 1)
    assert edit.align(["x", "a", "a"], ["a"]) == [("del", 0, None), ("keep", 1, 0), ("del", 2, None)]
    assert edit.align(list("aab"), list("ab")) == [("keep", 0, 0), ("del", 1, None), ("keep", 2, 1)]
    assert edit.align([], ["x"]) == [("add", None, 0)] and edit.align(["x"], []) == [("del", 0, None)] and edit.align([], []) == []


def test_apply_text_keeps_styles():
    runs = [{"text": "Il faut ", "bold": False}, {"text": "accorder", "bold": True}, {"text": " le verbe.", "bold": False}]
    out = edit.apply_text(runs, "Il faut bien accorder le verbe.")
    assert "".join(r["text"] for r in out) == "Il faut bien accorder le verbe." and [r["text"] for r in out if r["bold"]] == ["accorder"]
    assert edit.apply_text(runs, "Il faut accorder le verbe.") is runs


def test_apply_edits(spark):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "doc_id long, pos int, text string")
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "b b"), (1, 2, "c"), (1, 3, "d")], "doc_id long, pos int, text string")
    out = edit.apply_edits(old, edit.paragraph_diff(old, new, "doc_id"), new, "doc_id").orderBy("order").collect()
    assert [(r.text, r.edited, r.added) for r in out] == [("a", False, False), ("b b", True, False), ("c", False, False), ("d", False, True)]


def test_wrap():
    found = layout.wrap_runs([{"text": "un deux ", "bold": False}, {"text": "tr", "bold": True}, {"text": "ois", "bold": False}], 60, 12)
    texts = ["".join(s["text"] for s in line) for line in found]
    assert " ".join(texts) == "un deux trois" and "trois" in texts[-1]
    long = layout.wrap_runs([{"text": "x" * 40}], 50, 12)
    assert len(long) > 1 and "".join(s["text"] for line in long for s in line) == "x" * 40


def test_linear_pages_keep_all_words_within_the_page():
    s = Settings(font_size=24)
    blocks = [{"type": "h2", "text": "Titre"}, *({"type": "p", "text": f"mot{k} " * 60} for k in range(20))]
    rows = layout.linear_pages(blocks, s)
    height = s.page_dims()[1] - 2 * 20 * 2.83464567
    assert all(r["y"] <= height + 1e-6 for r in rows)
    assert " ".join(r["text"] for r in rows).split() == " ".join(b["text"] for b in blocks).split()
    assert [r["page"] for r in rows] == sorted(r["page"] for r in rows)


def test_band_order():
    items = [{"x0": 300, "y0": 700, "y1": 800}, {"x0": 50, "y0": 690, "y1": 790}, {"x0": 50, "y0": 100, "y1": 200}]
    assert layout.band_order(items) == [1, 0, 2]


def item(k, text, x, y, size=12.0):
    return {"idx": k, "text": text, "x": float(x), "y": float(y), "width": 6.0 * len(text), "size": size}


def test_lines_and_superscripts():
    found = lines.page_lines([item(0, "1", 50, 700), item(1, "re", 56, 704, 7.0), item(2, "personne", 75, 700), item(3, "suite", 50, 680)])
    assert [x["text"] for x in found] == ["1re personne", "suite"]
    assert all("".join(r["text"] for r in x["runs"]) == x["text"] for x in found)


def test_badges_and_columns():
    found = lines.page_lines([item(0, "Orthographe", 50, 700), item(1, "7", 125, 706, 9.0)], discs=[{"x0": 120, "y0": 700, "x1": 140, "y1": 720}])
    assert [x["text"] for x in found] == ["Orthographe 7"]
    two = lines.page_lines([item(0, "gauche", 50, 700), item(1, "droite", 300, 700)], bounds=[200.0])
    assert [x["text"] for x in two] == ["gauche", "droite"]


def test_slices_keep_runs():
    line = lines.assemble([item(0, "Farine", 50, 700), item(1, "Sucre", 200, 700)])
    assert line["gap_splits"] == [7]
    parts = lines.slice_line(line, line["gap_splits"])
    assert [p["text"] for p in parts] == ["Farine ", "Sucre"] and parts[1]["after_split"]


def test_tables_cuts_regions():
    grid = [{"x0": 50, "x1": 350, "y0": y, "y1": y} for y in (700, 660, 620, 580)] + [{"x0": x, "x1": x, "y0": 580, "y1": 700} for x in (50, 150, 250, 350)]
    found = tables.detect_tables(grid, modal=12)
    assert len(found) == 1 and found[0]["row_bounds"] == [700, 660, 620, 580] and found[0]["col_bounds"] == [50, 150, 250, 350]
    dotted = [{"x0": 10 + 20 * k, "x1": 20 + 20 * k, "y0": 400, "y1": 400} for k in range(29)]
    cuts = tables.cut_lines(dotted, 595, 842)
    assert [(c["orient"], c["pos"]) for c in cuts] == [("h", 400)]
    assert tables.cut_lines(dotted + [{**s, "y0": 380, "y1": 380} for s in dotted], 595, 842) == []
    parts = tables.regions(cuts, 595, 842)
    assert len(parts) == 2 and tables.region_of(100, 500, parts) == 0 and tables.region_of(100, 300, parts) == 1
    kinds = tables.classify_shapes([{"x0": 0, "y0": 0, "x1": 100, "y1": 50, "fill": [1.0], "stroke": None}, {"x0": 0.5, "y0": 0, "x1": 100, "y1": 50, "fill": None, "stroke": [2.0]}, {"x0": 0, "y0": 0, "x1": 9, "y1": 9, "fill": [3.0]}])
    assert [(b["fill"], b["stroke"]) for b in kinds["boxes"]] == [([1.0], [2.0])] and len(kinds["decorative"]) == 1


def test_raster():
    g = np.full((200, 300), 230.0, np.float32)
    g[20:180:10, 20:130] = 10
    g[20:180:10, 170:280] = 10
    at, clear, ink = raster.gutter(g)
    assert clear and 130 <= at < 170
    assert raster.skew_angle(g) == 0 and 10 <= raster.otsu(g) < 230
    assert raster.connected_components(g < 100)[0][:2] == (20, 20) and len(raster.connected_components(g < 100)) == 32
    assert not raster.is_mostly_blank(g - 200) and raster.is_mostly_blank(np.full((40, 40), 250.0))
    dark = g.copy()
    dark[:5] = 5
    assert raster.shadow_crop(dark)[0] == 5
    assert raster.sauvola(g)[20, 50] and not raster.sauvola(g)[5, 5]
    assert raster.upscale(g).shape == (400, 600) and raster.turn(g, 1).shape == (300, 200)


def test_lcs_and_coverage(spark):
    assert metrics.lcs_length(list("abcde"), list("xbdey")) == 3 and metrics.lcs_length([], ["a"]) == 0
    a = spark.createDataFrame([(1, "Le chat, le chien"), (2, "")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "le chat chat"), (2, "x")], "doc_id long, text string")
    out = {r.doc_id: (r.coverage, r.duplication) for r in metrics.coverage(a, b, "doc_id").collect()}
    assert out == {1: (0.5, 0.25), 2: (1.0, 0.0)}


def test_ocr_tree(spark):
    para = lambda lines, y1=20.0: {"y0": 0.0, "y1": y1, "lines": [{"words": w.split()} for w in lines]}
    tree = [{"blocktype": 1, "paragraphs": [para(["CHAPITRE UN"], 30.0), para(["Il gron-", "dait |_ < fort >", "12"])]}, {"blocktype": 12, "paragraphs": [para(["image"])]}]
    pages = spark.createDataFrame([(1, 1, tree)], f"doc_id long, page int, blocks {ocr.TREE}")
    rows = ocr.tree_blocks(pages, 12.0).orderBy("idx").collect()
    assert [(r.type, r.text, r.rejected) for r in rows] == [("h2", "CHAPITRE UN", False), ("p", "Il grondait « fort »", False)]
    native = spark.createDataFrame([(1, 1, 0, "needs-ocr", ""), (1, 2, 0, "p", "suite")], "doc_id long, page int, idx int, type string, text string")
    assert [r.text for r in ocr.substitute(native, ocr.tree_blocks(pages, 12.0)).orderBy("idx").collect()] == ["CHAPITRE UN", "Il grondait « fort »", "suite"]


def test_pdf_round_trip_and_errors(spark, tmp_path):
    page = [{"x0": 50, "y0": 600, "x1": 250, "y1": 700, "fill": (255, 0, 0), "stroke": (0, 0, 255)}, {"text": "Été (1) \\ fin", "x": 60.0, "y": 650.0, "size": 24, "bold": True, "color": (0, 128, 0), "underline": True}]
    data = pdf.write_pdf([page, [{"text": "deux", "x": 10.0, "y": 20.0, "size": 12}]], 595.28, 841.89, "titre")
    rows = [dict(zip(pdf._FIELDS, r)) for r in pdf.read_bytes("f", data)]
    items = [r for r in rows if r["kind"] == "item"]
    assert [(r["page"], r["text"], r["font"]) for r in items] == [(1, "Été (1) \\ fin", "Helvetica-Bold"), (2, "deux", "Helvetica")]
    assert items[0]["x"] == pytest.approx(60) and items[0]["size"] == pytest.approx(24) and items[0]["color"] == pytest.approx([0, 128, 0], abs=0.1)
    assert any(r["kind"] == "shape" and r["fill"] and r["x1"] == pytest.approx(250) for r in rows)
    kinds = [next(pdf.read_bytes("f", d))[-1] for d in (b"junk", b"%PDF-1.4\nbroken", data.replace(b"/Root", b"/Encrypt 9 0 R /Root"))]
    assert kinds == ["invalid", "invalid", "password"]
    (tmp_path / "a.pdf").write_bytes(data)
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4 x")
    scanned = pdf.scan(spark, str(tmp_path))
    assert scanned.where("kind = 'item'").count() == 2 and scanned.where("error = 'invalid'").count() == 1
    pdf.register(spark)
    assert [r.text for r in spark.read.format("pdfdoc").load(str(tmp_path)).where("kind = 'item' AND page = 2").collect()] == ["deux"]


def test_nested_matrices():
    body = b"q 2 0 0 2 50 50 cm 1 0 0 1 25 25 cm 0 0 100 50 re B Q"
    page = pdf.write_pdf([[]], 595, 842)
    doc = pdf.Document(page)
    number = next(k for k in doc.streams)
    doc.stream = lambda ref: body
    shape = next(r for r in pdf.page_rows(doc, doc.pages()[0]) if r["kind"] == "shape")
    assert (shape["x0"], shape["y0"], shape["x1"], shape["y1"]) == (100, 100, 300, 200) and shape["fill"] and shape["stroke"] and number
