"""Text functions of the document model, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the document model defines it, no-break space and byte order mark included.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Pictographs and what stands for them; the empty string drops them.
GLYPHS = {"*": "✶✱✳✴✵★☆", "→": "➜➔➝➞➡", "▶": "►▸", "•": "‣▪■", "☐": "□", "☑": "✓✔", "x": "✗✘", "": "✂✄✁✃"}
#: The nine signals of a front-matter page.
FRONT_MATTER = (
    r"(^|[^A-Za-z0-9_])isbn($|[^A-Za-z0-9_])", r"droits r[ée]serv[ée]s", r"d[ée]p[ôo]t l[ée]gal|num[ée]ro d['’]?[ée]dition", r"(^|[^A-Za-z0-9_])t[ée]l\.?\s*:|(^|[^A-Za-z0-9_])fax\s*:", r"\d{2}[\s.]\d{2}[\s.]\d{2}[\s.]\d{2}[\s.]\d{2}",
    r"(^|[^A-Za-z0-9_])\d{5}\s+[A-ZÀ-Ý]", r"©|copyright", r"imprim[ée]\s*(et\s*reli[ée]\s*)?en", r"[ée]ditions?($|[^A-Za-z0-9_])",
)
_CASED = 5  # the postcode signal looks at capitals
MARKER = r"^\s*([•\-–*▪]|\d+[.)])\s+"
PAGE_NUMBER = r"(?i)^((page\s*)?\d{1,4}\s*(/|sur|of)\s*\d{1,4}|page\s*\d{1,4})$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿ'-]+"), F.lit(0))


def symbol_count(c: Column) -> Column:
    """Characters that are neither letters, numbers nor white space."""
    return F.length(F.regexp_replace(c, r"[\p{L}\p{N}\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]", ""))


def substitute_glyphs(c: Column) -> Column:
    single = [(ch, to) for to, chars in GLYPHS.items() for ch in chars]
    keep = [(a, b) for a, b in single if b]
    out = F.translate(c, "".join(a for a, _ in keep), "".join(b for _, b in keep))
    return F.translate(out, "".join(a for a, b in single if not b), "")


def is_list_item(c: Column) -> Column:
    return c.rlike(MARKER)


def strip_marker(c: Column) -> Column:
    return F.regexp_replace(c, MARKER, "")


def split_embedded_markers(c: Column) -> Column:
    """Pieces of a line, cut before bullets that stand between spaces, trimmed on the left."""
    return F.transform(F.split(c, r"(?<=\s)(?=[•▪]\s)"), lambda x: F.regexp_replace(x, rf"^{WS}+", ""))


def split_gaps(pieces: Column) -> Column:
    """Pieces at column gaps stay one line if they are three or more short single words."""
    single = F.forall(pieces, lambda x: (strip(x) != "") & ~strip(x).rlike(r"\s") & (F.length(strip(x)) <= 12))
    return F.when((F.size(pieces) >= 3) & single, F.array(F.array_join(pieces, ""))).otherwise(F.transform(pieces, strip))


def join_lines(lines: Column) -> Column:
    """One text of several lines: a hyphen between lower-case letters joins, else a space."""
    marked = F.array_join(lines, "\u0001")
    return F.replace(F.regexp_replace(marked, "(?<=[a-zà-ÿ])-\u0001(?=[a-zà-ÿ])", ""), F.lit("\u0001"), F.lit(" "))


def rejoin_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-zà-ÿ])-\s+([a-zà-ÿ])", "$1$2")


def repetition_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"\d+", "#")


def front_matter_score(c: Column) -> Column:
    hits = [c.rlike(p if k == _CASED else "(?iu)" + p).cast("int") for k, p in enumerate(FRONT_MATTER)]
    return sum(hits[1:], hits[0])


def clean_ocr_noise(c: Column) -> Column:
    kept = F.filter(F.split(c, r"\s+"), lambda t: ~t.rlike(r"^[_|\\^~`]{1,4}[()]{0,2}$") & ~t.isin("(", ")"))
    return strip(F.array_join(kept, " "))


def french_quotes(c: Column) -> Column:
    opened = F.regexp_replace(c, r"(^|[\s(])<\s*", "$1« ")
    return F.regexp_replace(opened, r"\s*>(?=[\s.,!?;:)…]|$)", " »")


def isolated_dashes(c: Column) -> Column:
    return F.regexp_replace(c, r"(^|\s)-(\s)", "$1—$2")


def is_all_caps(c: Column) -> Column:
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & (letters == F.upper(letters)) & (letters != F.lower(letters))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, rf"{WS}+"), lambda w: w != ""))


def is_conservative_heading(text: Column, lines: Column, height: Column, modal: Column) -> Column:
    return (lines == 1) & word_count(text).between(1, 5) & is_all_caps(text) & (modal > 0) & (height > 1.4 * modal)


def drop_tail_residue(c: Column) -> Column:
    """Without up to three words, a digit among them, that trail after the last strong stop."""
    tail = F.regexp_extract(c, r"[.!?…»]\s+([^.!?…]{1,25})$", 1)
    gone = (tail != "") & tail.rlike(r"\d") & (word_count(tail) <= 3)
    return F.when(gone, F.regexp_replace(c, r"([.!?…»])\s+[^.!?…]{1,25}$", "$1")).otherwise(c)


def marker_label(kind: Column, n: Column) -> Column:
    return F.when(kind == "bullet", "•").when(kind == "dash", "–").when(kind == "number", F.concat(F.coalesce(F.nullif(n, F.lit(0)), F.lit(1)).cast("string"), F.lit("."))).otherwise("")


def marker_kind(label: Column) -> Column:
    return F.when(label == "", "none").when(label == "–", "dash").when(label.rlike(r"^\d+\.$"), "number").otherwise("bullet")


def parse_paragraphs(c: Column) -> Column:
    parts = F.split(F.regexp_replace(c, r"\r\n?", "\n"), r"\n[ \t]*\n")
    return F.filter(F.transform(parts, collapse), lambda p: p != "")


def metric_words(c: Column) -> Column:
    """Lower-case words with punctuation as space."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"\p{P}", " "), r"\s+"), lambda w: w != "")


def output_file_name(name: Column, size: Column, label: str) -> Column:
    return F.concat(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit(f"-{label}-"), F.floor(size + 0.5).cast("string"), F.lit("pt.pdf"))
