"""Made-up documents for which a query once differed from its SQL, or did its job in an unfit way."""

import re

import duckdb

from pagewright.operators import layout
from pagewright.plans import registry
from pagewright.settings import MARGIN_MM, MM_TO_PT, Settings
from pagewright.sources import pdf


def both(spark, folder, name, texts):
    """Rows of a query and of its SQL over documents of these texts."""
    rows = [(k, t, "fr", "web") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = c.execute(registry.ORACLES[name])
    columns = [x[0] for x in found.description]
    return sorted((tuple(r[x] for x in columns) for r in registry.QUERIES[name](spark, str(folder)).collect()), key=repr), sorted(found.fetchall(), key=repr)


def test_paragraphs_where_a_word_just_fits_or_spaces_do_not_break(spark, tmp_path):
    full = "mot " * 20
    fits = [full[:80] + "a" * 79 + " " + "b" * (n - 1) + ".\n" + "E" * w + "x" + " suite" * 12 for w in range(1, 40) for n in range(20, 80, 4)]
    odd = ["un mot" + end + "\n" + start + "deux mots" for end in (". ", ".\r", "-\r", "- ", " ", ".\x0b") for start in ("", " ", "\t", "　", "E")]
    spark_rows, sql_rows = both(spark, tmp_path, "paragraphs", fits + odd)
    assert spark_rows == sql_rows


def test_region_duplicates_without_a_row_a_place(spark, tmp_path):
    base = ["Élan vital n° " + str(k) * 9 + " et la suite du texte " * (k % 7) for k in range(30)]
    odd = [None, "", "court", "𝒳" * 12 + "abcdefghij", "𝒳" * 11 + "abc", "aba" * 700, "ab" * 10, "ABAABAABAABAABA!", "a" * 3000, "a" * 10, "a" * 11, "xx" + "a" * 9]
    texts = [*base, *(t[3 : 14 + k] for k, t in enumerate(base)), *odd, *("devant " + t for t in base), *(t[:-2] for t in base), "x".join(base), *base[:5]]
    spark_rows, sql_rows = both(spark, tmp_path, "region_duplicates", [*texts, *reversed(texts)])
    assert spark_rows == sql_rows and len(sql_rows) > 60
    plan = registry.QUERIES["region_duplicates"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan  # ten-character pieces of all texts were exploded and joined


def test_shown_texts_are_read_at_once_and_as_by_tokens(monkeypatch):
    texts = ["mot", "a (b) \\ c)", "été » –", "", "  deux  ", "(", "\\", "fin\\("]
    data = pdf.write_pdf([[{"text": t, "x": 10.5 + k, "y": 700.25 - 9 * k, "size": 12 + k % 3, "bold": k % 2 == 0, "color": (k, 7, 255), "underline": k == 3} for k, t in enumerate(texts * 9)]], 595.28, 841.89)
    doc, parse, seen = pdf.Document(data), pdf.parse, []

    def counted(*args, **kwargs):
        for x in parse(*args, **kwargs):
            seen.append(x)
            yield x

    monkeypatch.setattr(pdf, "parse", counted)
    fast = list(pdf.page_rows(doc, doc.pages()[0]))
    few = len(seen)
    monkeypatch.setattr(pdf, "_SHOWN", re.compile(rb"(?!)"))
    assert fast == list(pdf.page_rows(doc, doc.pages()[0])) and [r["text"] for r in fast if r["kind"] == "item"] == [t for t in texts * 9 if t]
    assert few < 200 < 17 * len(texts) * 9 <= len(seen)
    odd = b"BT /F1 12 Tf 0 0 0 rg 1 0 0 1 5 6 Tm (a\\\nb) Tj ET %BT x\nq BT /F#31 9 Tf 0 g 2 0 0 2 5 6 Tm [(c) -300 (d)] TJ ET Q BT /F2 8 Tf .5 +1. 0 rg 1 0 0 1 -5 6 Tm (e(f)g) Tj ET BT /F2 8 Tf 1 1 1 rg 1 0 0 1 5 6 Tm (h) Tj T* ET"
    doc.stream = lambda ref: odd
    slow = list(pdf.page_rows(doc, doc.pages()[0]))
    monkeypatch.undo()
    assert list(pdf.page_rows(doc, doc.pages()[0])) == slow and "".join(r["text"] for r in slow) == "abcde(f)gh"


def test_words_measured_at_once_wrap_as_runs():
    texts = ["", " ", "un  mot — plus   long", "x" * 90, "Été " * 30, "a " + "mot" * 40 + " b c", "fin\t\r\nde ligne 😀 " * 9, "I" * 7 + " " + "W" * 50 + " i"]
    words = layout.Words(texts)
    for width, size, bold in ((481.88, 24.0, False), (481.88, 32.4, True), (100.0, 20.0, False), (99.99, 20.0, False), (66.71, 20.0, True), (3.0, 20.0, False)):
        for k, text in enumerate(texts):
            assert words.wrapped(k, width, size, bold) == ["".join(p["text"] for p in line) for line in layout.wrap_runs([{"text": text, "bold": bold}], width, size)]


def test_runs_of_shown_texts_are_read_as_one_by_one(monkeypatch):
    shown = b"\nBT /F%d 12 Tf 0 0 0 rg 1 0 0 1 %s Tm (%s) Tj ET"
    lines = [shown % (1 + (k % 7 == 6), b"56.693 %d.5" % (700 - k), t) for k, t in enumerate([b"mot", b"\xe9t\xe9 \x81 \x80", b"", b"a\\(b\\)", b"c\\\\", b"a\\051\\nb", b"d (e) f", b"  "] * 5)]
    odd = [shown % (1, b"1 2 3", b"no place"), b"\nBT /F1 12 Tf 0 0 0 rg 1 0 0 1 56.693 +.5 Tm (g) Tj ETX", b"\nBT (after) Tj", b" (again) Tj ET", b"\nq 2 0 0 2 5 7 cm 3 Ts" + b"".join(lines[:9]) + b" (further) Tj Q"]
    doc = pdf.Document(pdf.write_pdf([[]], 595.28, 841.89))
    doc.stream = lambda ref: b"0 g" + b"".join(lines) + b" (ends) Tj" + b"".join(lines[:3]) + b"".join(odd) + b"".join(lines[3:])
    page, found = doc.pages()[0], []
    for row in pdf.page_rows(doc, page, brief=True):
        found += zip(*(row[c] for c in ("text", "x", "y", "size"))) if row["kind"] == "run" else [tuple(row[c] for c in ("text", "x", "y", "size"))]
    monkeypatch.setattr(pdf, "_SHOWN", re.compile(rb"(?!)"))
    slow = [tuple(row[c] for c in ("text", "x", "y", "size")) for row in pdf.page_rows(doc, page)]
    assert found == slow and slow[35][0] == "ends" and {"again", "further", "a)\nb"} <= {t[0] for t in slow}


def test_pdf_round_trip_deals_documents_once(spark, tmp_path):
    texts = [None, "", "\n\n", "Titre (un) \\ deux\n" + "mot  à mot — 😀 " * 90 + "\n\nfin", "x" * 400 + "\n" + "une ligne\n" * 70, *(f"tête {k}\ncorps " * 9 for k in range(40))]
    spark.createDataFrame([(7 * k % 45, t, "s", "fr", 0) for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.QUERIES["pdf_round_trip"](spark, str(tmp_path))
    s = Settings(font_size=24.0)
    (width, height), margin, rows = s.page_dims(), MARGIN_MM * MM_TO_PT, []
    for k, t in enumerate(texts):
        lines = layout.linear_pages([{"type": "p" if n else "h2", "text": x} for n, x in enumerate(t.split("\n"))], s) if t else []
        pages = [[{"text": r["text"], "x": r["x"], "y": height - margin - r["y"], "size": r["size"], "bold": r["type"] == "h2"} for r in lines if r["page"] == p] for p in range(1 + max((r["page"] for r in lines), default=-1))]
        rows += [r for r in (dict(zip(pdf._FIELDS, x)) for x in pdf.read_bytes(str(7 * k % 45), pdf.write_pdf(pages, width, height))) if r["kind"] == "item"]
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r[c] for c in out.columns) for r in rows) and len(rows) > 200
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "FlatMapGroups" not in plan  # placed lines were rows, grouped again by document


def test_tokens_after_comments_and_references():
    found = list(pdf.parse(b" % 7 a )\n) 2 0 R [1 0 R 3 0 Rx %]\n] << /A#20b 4 0 R /C -.5 >> x % end"))
    assert found == [pdf.Ref((2, 0)), [pdf.Ref((1, 0)), 3, 0, "Rx"], {"A b": pdf.Ref((4, 0)), "C": -0.5}, "x"]
