"""PDF pages as rows: a content-stream reader, a Python data source over it, and a writer.

The reader covers what layout needs: classic and stream cross-references found by scanning
objects, Flate streams, object streams, simple fonts with ToUnicode maps and widths, text
operators, graphics state, painted paths, image placements. Encrypted and broken files give a row
with an error class instead of an exception. Files of over 300 MB are refused.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..functions.measure import ADVANCES, DEFAULT, advance
from ..operators.layout import HEADING, linear_pages
from ..settings import MARGIN_MM, MM_TO_PT, Settings

MOST_BYTES = 300_000_000
#: A batch of Arrow rows ends after so many bytes of files, or so many items.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 20_000
SCHEMA = (
    "path string, page int, kind string, idx int, text string, font string, x double, y double, width double, size double, "
    "transform array<double>, color array<double>, x0 double, y0 double, x1 double, y1 double, fill array<double>, stroke array<double>, dashed boolean, data binary, error string"
)
_FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
_TOKEN = re.compile(
    rb"(?:\s++|%[^\r\n]*+)*+(?:(<<|>>|\[|\]|\{|\})|/([^\s<>\[\](){}/%]*)|(\d+)\s+(\d+)\s+R(?=[\s<>\[\](){}/%]|\Z)|([+-]?(?:\d+\.?\d*|\.\d+))(?=[\s<>\[\](){}/%]|\Z)|<([0-9A-Fa-f\s]*)>|(\()|([^\s<>\[\](){}/%]+)|\Z)"
)
#: An object begins after the word and two numbers before it; looking for the word first is faster.
_OBJ, _OBJ_NUMBER = re.compile(rb"obj\b"), re.compile(rb"(?<!\d)(\d++)\s++(\d++)\s++\Z")
_ENDSTREAM = re.compile(rb"\s*endstream")
_BLANK = re.compile(rb"(?:\s++|%[^\r\n]*+)*+")
_HEX_NAME = re.compile(rb"#([0-9A-Fa-f]{2})")
_WORDS = {"true": True, "false": False, "null": None}

_NUMBER = rb"([+-]?(?:\d+\.?\d*|\.\d+))\s+"
#: One shown text with its font, colour and place, as most writers have it; whatever differs goes through the tokens.
_SHOWN = re.compile(rb"\s*BT\s+(/([^\s<>\[\](){}/%#]+)\s+" + _NUMBER + rb"Tf\s+" + _NUMBER * 3 + rb"rg\s+" + _NUMBER * 4 + rb")" + _NUMBER * 2 + rb"Tm\s+\(((?:[^()\\]++|\\.)*+)\)\s*Tj\s+ET(?=\s|\Z)", re.S)

_PLAIN = re.compile(r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)) ([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))")
#: What a task remembers of files: short objects by their bytes, places by how they are written; at most so many.
_OBJECTS: dict[bytes, object] = {}
_PLACES: dict[str, tuple[float, float]] = {}
MOST_KEPT = 10_000
#: Escapes of what stands for itself, and those of codes, control characters and line ends.
_ESCAPE, _ODD_ESCAPE = re.compile(rb"\\([^\dnrtbf\r\n])", re.S), re.compile(rb"\\[\dnrtbf\r\n]")


class Name(str):
    pass


class Ref(tuple):
    pass


class Op(str):
    pass


class PdfError(Exception):
    """error_class: one of password, invalid, too-large, other."""

    def __init__(self, error_class: str):
        super().__init__(error_class)
        self.error_class = error_class


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose opening parenthesis is before ``at``."""
    out, depth = bytearray(), 1
    codes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            n = data[at + 1 : at + 2]
            if m := re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4]):
                out.append(int(m[0], 8) & 255)
                at += 1 + len(m[0])
                continue
            out += b"" if n in b"\r\n" else codes.get(n, n)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def _unescaped(raw: bytes) -> bytes:
    """The inner part of a literal string."""
    if b"\\" not in raw:
        return raw
    return _string(raw + b")", 0)[0] if _ODD_ESCAPE.search(raw) else _ESCAPE.sub(rb"\1", raw)


def parse(data: bytes, at: int = 0, end: int | None = None, place: list[int] | None = None) -> Iterator[object]:
    """Objects and operators of a token stream; references as Ref, dictionaries as dict.

    ``place`` holds where an operator ends while it is yielded; who moves it moves the parser.
    """
    stack: list[list] = []
    flat: list = []
    end = len(data) if end is None else end
    while at < end:
        m = _TOKEN.match(data, at, end)
        if not m:  # nothing begins after white space and comments
            at = _BLANK.match(data, at, end).end() + 1
            continue
        at, kind = m.end(), m.lastindex
        if kind == 2:
            name = m[2]
            value: object = Name((_HEX_NAME.sub(lambda h: bytes([int(h[1], 16)]), name) if b"#" in name else name).decode("latin-1"))
        elif kind == 5:
            value = float(m[5]) if b"." in m[5] else int(m[5])
        elif kind == 4:
            value = Ref((int(m[3]), int(m[4])))
        elif kind == 8:
            word = m[8].decode("latin-1")
            target = stack[-1] if stack else flat
            if word == "R" and len(target) >= 2 and isinstance(target[-1], int) and isinstance(target[-2], int):
                value = Ref((target.pop(-2), target.pop()))
            else:
                value = _WORDS[word] if word in _WORDS else Op(word)
        elif kind == 1:
            if m[1] in (b"<<", b"["):
                stack.append([m[1]])
                continue
            if m[1] not in (b">>", b"]") or not stack:
                continue
            opened, *items = stack.pop()
            value = items if opened == b"[" else {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, str)}
        elif kind == 6:
            raw = re.sub(rb"\s", b"", m[6])
            value = bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode())
        elif kind == 7:
            value, at = _string(data, at)
        else:
            continue
        if stack:
            stack[-1].append(value)
        else:
            flat.append(value)
            if isinstance(value, Op):
                if place is not None:
                    place[0] = at
                yield from flat
                flat = []
                at = at if place is None else place[0]
            elif len(flat) > 3:
                yield flat.pop(0)
    yield from flat


def _object(data: bytes, at: int, end: int) -> object:
    """The first object there. Short ones without strings are remembered, as files of one writer share most of
    theirs; nobody changes them."""
    short = data[at:end] if end - at <= 400 else b"("
    if b"(" in short:
        return next(parse(data, at, end), None)
    if short not in _OBJECTS:
        if len(_OBJECTS) >= MOST_KEPT:
            _OBJECTS.clear()
        _OBJECTS[short] = next(parse(short), None)
    return _OBJECTS[short]


class Document:
    """Objects of a file by number; streams are decoded when asked for."""

    def __init__(self, data: bytes):
        if len(data) > MOST_BYTES:
            raise PdfError("too-large")
        if not data.lstrip()[:5].startswith(b"%PDF-"):
            raise PdfError("invalid")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise PdfError("password")
        self.data, self.objects, self.streams, self.fonts = data, {}, {}, {}
        for m in _OBJ.finditer(data):
            head = _OBJ_NUMBER.search(data, max(0, m.start() - 64), m.start()) or data[m.start() - 1 : m.start()].isspace() and _OBJ_NUMBER.search(data, max(0, m.start() - 4096), m.start())
            if not head:
                continue
            stop = data.find(b"endobj", m.end())
            body_end = stop if stop >= 0 else len(data)
            s = data.find(b"stream", m.end(), body_end)
            value = _object(data, m.end(), s if s >= 0 else body_end)
            number = int(head[1])
            if s >= 0 and isinstance(value, dict):
                begin = s + 6 + (2 if data[s + 6 : s + 8] == b"\r\n" else 1)
                self.streams[number] = begin
            self.objects[number] = value
        for number in list(self.streams):
            head = self.objects[number]
            if head.get("Type") == "ObjStm":
                body = self.stream(Ref((number, 0)))
                count, first = self.get(head.get("N")), self.get(head.get("First"))
                table = [int(x) for x in body[:first].split()[: 2 * count]]
                for k, at in zip(table[::2], table[1::2]):
                    self.objects.setdefault(k, next(parse(body, first + at), None))
        if not any(isinstance(v, dict) and v.get("Type") == "Page" for v in self.objects.values()):
            raise PdfError("invalid")

    def get(self, value):
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value[0])
        return None

    def stream(self, ref) -> bytes:
        number = ref[0]
        head, begin = self.objects[number], self.streams[number]
        length = self.get(head.get("Length"))
        stop = begin + length if isinstance(length, int) and _ENDSTREAM.match(self.data, begin + length) else self.data.find(b"endstream", begin)
        raw = self.data[begin:stop]
        kinds = self.get(head.get("Filter")) or []
        for kind in kinds if isinstance(kinds, list) else [kinds]:
            if kind == "FlateDecode":
                raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> list[dict]:
        root = next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        out: list[dict] = []

        def walk(node, inherited: dict, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 64:
                return
            inherited = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if node.get("Type") == "Page":
                out.append(inherited | node)
            for kid in self.get(node.get("Kids")) or []:
                walk(kid, inherited, depth + 1)

        walk(root.get("Pages"), {}, 0)
        return out or [v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Page"]


def _to_unicode(body: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    args: list = []
    text = lambda b: b.decode("utf-16-be", "ignore")
    code = lambda b: int.from_bytes(b, "big")
    for x in parse(body):
        if isinstance(x, Op):
            if x == "endbfchar":
                out.update({code(a): text(b) for a, b in zip(args[::2], args[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)})
            elif x == "endbfrange":
                for a, b, c in zip(args[::3], args[1::3], args[2::3]):
                    for k in range(code(b) - code(a) + 1):
                        out[code(a) + k] = text(c[k]) if isinstance(c, list) else text(c[:-2] + (code(c[-2:]) + k).to_bytes(2, "big"))
            args = []
        else:
            args.append(x)
    return out


class Font:
    def __init__(self, doc: Document, spec: dict):
        self.name = str(doc.get(spec.get("BaseFont")) or "")
        self.two_bytes = spec.get("Subtype") == "Type0"
        ref = spec.get("ToUnicode")
        self.map = _to_unicode(doc.stream(ref)) if isinstance(ref, Ref) and ref[0] in doc.streams else {}
        self.first = doc.get(spec.get("FirstChar")) or 0
        self.widths = [doc.get(w) for w in doc.get(spec.get("Widths")) or []]
        self.wide: dict[tuple, list] = {}

    def decode(self, raw: bytes) -> list[tuple[int, str]]:
        step = 2 if self.two_bytes else 1
        codes = [int.from_bytes(raw[k : k + step], "big") for k in range(0, len(raw) - step + 1, step)]
        return [(c, self.map.get(c) or ("" if self.two_bytes else bytes([c]).decode("cp1252", "replace"))) for c in codes]

    def text(self, raw: bytes) -> str:
        return "".join(ch for _, ch in self.decode(raw)) if self.two_bytes or self.map else raw.decode("cp1252", "replace")

    def one(self, code: int) -> tuple[int, str]:
        return code, self.map.get(code) or bytes([code]).decode("cp1252", "replace")

    def single(self, size: float, cs: float, ws: float, scale: float) -> list[tuple[str, float]]:
        """Text and width of each code of a font of one byte a character."""
        key = (size, cs, ws, scale)
        if key not in self.wide:
            self.wide[key] = [(ch, (self.advance(c, ch) / 1000 * size + cs + (ws if ch == " " else 0.0)) * scale) for c, ch in map(self.one, range(256))]
        return self.wide[key]

    def advance(self, code: int, text: str) -> float:
        k = code - self.first
        return float(self.widths[k]) if 0 <= k < len(self.widths) else float(ADVANCES.get(text, DEFAULT))


def times(m: tuple, n: tuple) -> tuple:
    """m applied before n (row vectors)."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def apply(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def _rgb(args: list) -> list[float] | None:
    n = [float(x) for x in args if isinstance(x, (int, float))]
    if len(n) == 1:
        return [255 * n[0]] * 3
    if len(n) == 3:
        return [255 * v for v in n]
    if len(n) == 4:
        return [255 * (1 - min(1.0, v + n[3])) for v in n[:3]]
    return None


def page_rows(doc: Document, page: dict, brief: bool = False) -> Iterator[dict]:
    """Items, painted shapes and images of a page, in drawing order. ``brief``: a run of items that
    are read in one match each is one row of kind run, with lists of text, x, y and size; no width is summed up."""
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    state = {"ctm": unit, "fill": [0.0] * 3, "stroke": [0.0] * 3, "dashed": False, "font": None, "size": 1.0, "leading": 0.0, "rise": 0.0, "cs": 0.0, "ws": 0.0, "scale": 1.0}
    saved: list[dict] = []
    resources = doc.get(page.get("Resources")) or {}
    fonts: dict[str, Font] = {}
    contents = page.get("Contents")
    refs = contents if isinstance(contents, list) else doc.get(contents) if isinstance(doc.get(contents), list) else [contents]
    body = b"\n".join(doc.stream(r) for r in refs if isinstance(r, Ref) and r[0] in doc.streams)
    tm = line = unit
    path: list[tuple[float, float]] = []
    args: list = []

    def font(name: str) -> Font:
        if name not in fonts:
            spec = (doc.get(resources.get("Font")) or {}).get(name)
            known = doc.fonts.get(spec) if isinstance(spec, Ref) else None
            fonts[name] = known or Font(doc, doc.get(spec) or {})
            if isinstance(spec, Ref):
                doc.fonts[spec] = fonts[name]
        return fonts[name]

    def show(raw: bytes) -> dict | None:
        nonlocal tm
        f = state["font"]
        if f is None:
            return None
        text, wide = "", 0.0
        if f.two_bytes:
            for code, ch in f.decode(raw):
                text += ch
                wide += (f.advance(code, ch) / 1000 * state["size"] + state["cs"] + (state["ws"] if ch == " " else 0.0)) * state["scale"]
        else:
            known = f.single(state["size"], state["cs"], state["ws"], state["scale"])
            for code in raw:
                ch, w = known[code]
                text += ch
                wide += w
        m = times((state["size"] * state["scale"], 0.0, 0.0, state["size"], 0.0, state["rise"]), times(tm, state["ctm"]))
        tm = times((1.0, 0.0, 0.0, 1.0, wide, 0.0), tm)
        k = math.hypot(state["ctm"][0], state["ctm"][1])
        return {"kind": "item", "text": text, "font": f.name, "x": m[4], "y": m[5], "width": wide * k, "size": math.hypot(m[0], m[1]) or 1.0, "transform": list(m), "color": state["fill"]} if text else None

    def painted(fill: bool, stroke: bool) -> dict | None:
        if not path:
            return None
        xs, ys = [p[0] for p in path], [p[1] for p in path]
        return {"kind": "shape", "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "fill": state["fill"] if fill else None, "stroke": state["stroke"] if stroke else None, "dashed": state["dashed"]}

    def style(m: re.Match) -> None:
        nonlocal tm, line
        state["font"], state["size"] = font(m[2].decode("latin-1")), float(m[3])
        state["fill"] = [255 * float(v) for v in m.group(4, 5, 6)]
        tm = line = tuple(float(v) for v in m.group(7, 8, 9, 10, 11, 12))

    def shown_run(m: re.Match | None, place: list[int]) -> dict:
        """Texts from the place on that are shown in one match each. After a match, texts that differ in
        place and characters only are found by their equal parts."""
        nonlocal tm, line, late, plain
        texts, xs, ys, sizes = [], [], [], []
        while m:
            start, place[0] = place[0], m.end()
            style(m)
            late, f = _unescaped(m[13]), state["font"]
            row = times((state["size"] * state["scale"], 0.0, 0.0, state["size"], 0.0, state["rise"]), times(tm, state["ctm"]))
            size = math.hypot(row[0], row[1]) or 1.0
            if text := f.text(late):
                texts.append(text)
                xs.append(row[4])
                ys.append(row[5])
                sizes.append(size)
            before = body[start : m.start(11)].decode("latin-1")
            alike = not (f.two_bytes or f.map) and before.isascii() and before[0].isspace()
            if alike and plain is None:
                plain = body.decode("cp1252", "replace")  # a character a byte
            turned, at, n = times((*tm[:4], 0.0, 0.0), state["ctm"]), place[0], len(before)
            kx, ky, (a, b, c, d, u, v) = 0.0 * turned[0] + state["rise"] * turned[2], 0.0 * turned[1] + state["rise"] * turned[3], state["ctm"]
            last = None
            while alike and plain.startswith(before, at):
                stop = plain.find(" Tm (", at + n, at + n + 64)
                end = plain.find(") Tj ET", stop)
                if stop < 0 or end < 0 or not (plain[end + 7 : end + 8] or " ").isspace():
                    break
                text, where = plain[stop + 5 : end], plain[at + n : stop]
                if "\\" in text or "(" in text or ")" in text:
                    break
                xy = _PLACES.get(where)
                if xy is None:
                    if not (plainly := _PLAIN.fullmatch(where)):
                        break
                    if len(_PLACES) >= MOST_KEPT:
                        _PLACES.clear()
                    xy = _PLACES[where] = float(plainly[1]), float(plainly[2])
                x, y = xy
                if text:
                    texts.append(text)
                    xs.append(kx + (x * a + y * c + u))
                    ys.append(ky + (x * b + y * d + v))
                    sizes.append(size)
                last, at = (x, y, stop + 5, end), end + 7
            if last:
                place[0], late, tm = at, body[last[2] : last[3]], (*tm[:4], *last[:2])
                line = tm
            m = _SHOWN.match(body, place[0])
        return {"kind": "run", "text": texts, "x": xs, "y": ys, "size": sizes}

    place, late, plain = [0], None, None
    for x in parse(body, place=place):
        if not isinstance(x, Op):
            args.append(x)
            continue
        if late is not None:  # where the last text read in brief ends may count from here on
            show(late)
            late = None
        row, n = None, [float(a) for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
        if x == "q":
            saved.append(dict(state))
        elif x == "Q" and saved:
            state = saved.pop()
        elif x == "cm" and len(n) == 6:
            state["ctm"] = times(tuple(n), state["ctm"])
        elif x in ("rg", "g", "k", "sc", "scn"):
            state["fill"] = _rgb(args) or state["fill"]
        elif x in ("RG", "G", "K", "SC", "SCN"):
            state["stroke"] = _rgb(args) or state["stroke"]
        elif x == "d":
            state["dashed"] = bool(args and isinstance(args[0], list) and args[0])
        elif x in ("m", "l") and len(n) == 2:
            path.append(apply(state["ctm"], *n))
        elif x in ("c", "v", "y"):
            path += [apply(state["ctm"], a, b) for a, b in zip(n[::2], n[1::2])]
        elif x == "re" and len(n) == 4:
            path += [apply(state["ctm"], n[0] + i * n[2], n[1] + j * n[3]) for i in (0, 1) for j in (0, 1)]
        elif x in ("f", "F", "f*", "S", "s", "B", "B*", "b", "b*", "n"):
            row = painted(x[0] in "fFBb", x[0] in "SsBb") if x != "n" else None
            path = []
        elif x == "BT":
            tm = line = unit
        elif x == "Tf" and args:
            state["font"], state["size"] = font(str(args[0])), n[-1] if n else 1.0
        elif x in ("TL", "Ts", "Tc", "Tw", "Tz") and n:
            key = {"TL": "leading", "Ts": "rise", "Tc": "cs", "Tw": "ws", "Tz": "scale"}[x]
            state[key] = n[0] / 100 if x == "Tz" else n[0]
        elif x in ("Td", "TD") and len(n) == 2:
            if x == "TD":
                state["leading"] = -n[1]
            tm = line = times((1.0, 0.0, 0.0, 1.0, *n), line)
        elif x == "Tm" and len(n) == 6:
            tm = line = tuple(n)
        elif x in ("T*", "'", '"'):
            tm = line = times((1.0, 0.0, 0.0, 1.0, 0.0, -state["leading"]), line)
            if x != "T*" and args and isinstance(args[-1], bytes):
                row = show(args[-1])
        elif x == "Tj" and args and isinstance(args[-1], bytes):
            row = show(args[-1])
        elif x == "TJ" and args and isinstance(args[-1], list):
            for part in args[-1]:
                if isinstance(part, bytes):
                    if item := show(part):
                        yield item
                elif isinstance(part, (int, float)):
                    tm = times((1.0, 0.0, 0.0, 1.0, -part / 1000 * state["size"] * state["scale"], 0.0), tm)
        elif x == "Do" and args:
            ref = (doc.get(resources.get("XObject")) or {}).get(args[0])
            head = doc.get(ref)
            if isinstance(head, dict) and head.get("Subtype") == "Image":
                ends = [apply(state["ctm"], i, j) for i in (0, 1) for j in (0, 1)]
                row = {"kind": "image", "x0": min(p[0] for p in ends), "y0": min(p[1] for p in ends), "x1": max(p[0] for p in ends), "y1": max(p[1] for p in ends), "data": doc.stream(ref)}
        if row:
            yield row
        args = []
        if brief:
            if (m := _SHOWN.match(body, place[0])) and (run := shown_run(m, place))["text"]:
                yield run
            continue
        while m := _SHOWN.match(body, place[0]):
            place[0] = m.end()
            style(m)
            if row := show(_unescaped(m[13])):
                yield row


def _rows(path: str, data: bytes, pages: set[int] | None = None, brief: bool = False) -> Iterator[dict]:
    """Rows of a file with the fields that they have; an error row if it can't be read."""
    try:
        doc = Document(data)
        for number, page in enumerate(doc.pages(), 1):
            if pages and number not in pages:
                continue
            box = [float(doc.get(v)) for v in doc.get(page.get("MediaBox")) or [0, 0, 595.28, 841.89]]
            rows = [{"kind": "page", "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3]}, *page_rows(doc, page, brief)]
            k = 0
            for row in rows:
                row["path"], row["page"], row["idx"] = path, number, k
                k += len(row["text"]) if row["kind"] == "run" else 1
                yield row
    except PdfError as e:
        yield {"path": path, "kind": "error", "error": e.error_class}
    except Exception:  # noqa: BLE001  a broken file is a row, not a failed job
        yield {"path": path, "kind": "error", "error": "other"}


def read_bytes(path: str, data: bytes, pages: set[int] | None = None) -> Iterator[tuple]:
    """All rows of a file; an error row if it can't be read."""
    for row in _rows(path, data, pages):
        yield tuple(row.get(f) for f in _FIELDS)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all PDF files under a path, read by Spark's own file source, so from any store."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)

    def run(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                rows = list(read_bytes(p, bytes(data)))
                yield pd.DataFrame(rows, columns=_FIELDS)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.pages: set[int] = set()

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page",):
                self.pages = {f.value}
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(x.path) for x in found if x.is_file and x.path.lower().endswith(".pdf")]

    def read(self, partition):
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_file(partition.path) as f:
            yield from read_bytes(partition.path, f.read(), self.pages or None)


class PdfSource(DataSource):
    """``spark.read.format("pdfdoc").load(folder)``; filters on page are pushed to the reader."""

    @classmethod
    def name(cls) -> str:
        return "pdfdoc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known; its reader takes pushed filters, which the session must allow."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)


def _escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")


def write_pdf(pages: list[list[dict]], width: float, height: float, title: str = "", background: tuple = (1.0, 1.0, 1.0)) -> bytes:
    """A PDF of pages of items: text (x, y up, size, bold, color, strikethrough, underline) and boxes
    (x0, y0, x1, y1, fill, stroke). Colours are 0-255."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R /Lang (fr) >>", b""]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % n for n in (b"Helvetica", b"Helvetica-Bold")]
    objects.append(b"<< /Title (%s) /Producer (pagewright) >>" % _escape(title).encode("cp1252", "replace"))
    kids = []
    color = lambda c: "%g %g %g" % tuple(v / 255 for v in c)
    heads: dict[tuple, str] = {}
    for page in pages:
        out = ["%g %g %g rg 0 0 %g %g re f" % (*background, width, height)]
        for it in page:
            if "text" in it:
                c, size, bold = tuple(it.get("color") or (0, 0, 0)), it["size"], bool(it.get("bold"))
                head = heads.get((c, size, bold))
                if head is None:
                    head = heads[c, size, bold] = "BT /F%d %g Tf %s rg 1 0 0 1" % (2 if bold else 1, size, color(c))
                out.append(f"{head} {it['x']:.3f} {it['y']:.3f} Tm ({_escape(it['text'])}) Tj ET")
                for key, up in (("strikethrough", 0.3), ("underline", -0.12)):
                    if it.get(key):
                        w = advance(it["text"], size, bold)
                        out.append("%s RG %.3f %.3f m %.3f %.3f l S" % (color(c), it["x"], it["y"] + up * size, it["x"] + w, it["y"] + up * size))
            else:
                box = "%.3f %.3f %.3f %.3f re" % (it["x0"], it["y0"], it["x1"] - it["x0"], it["y1"] - it["y0"])
                if it.get("fill"):
                    out.append(color(it["fill"]) + " rg " + box + " f")
                if it.get("stroke"):
                    out.append(color(it["stroke"]) + " RG " + box + " S")
        body = zlib.compress("\n".join(out).encode("cp1252", "replace"))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (width, height, len(objects)))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, x in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, x)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R /Info 5 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))


def render(lines: DataFrame, width: float, height: float, margin: float) -> DataFrame:
    """doc_id, content: a PDF of each document's placed lines (doc_id, page, seq, y down, x, size, type, text)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pages = [[{"text": r.text, "x": r.x, "y": height - margin - r.y, "size": r.size, "bold": r.type in ("h1", "h2", "h3")} for r in part.sort_values("seq").itertuples()] for _, part in pdf.groupby("page")]
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "content": [write_pdf(pages, width, height, str(pdf["doc_id"].iloc[0]))]})

    return lines.select("doc_id", "page", "seq", "y", "x", "size", "type", "text").groupBy("doc_id").applyInPandas(run, "doc_id long, content binary")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[dict]]]:
    """Each document's blocks, of rows (doc_id, type, text) that are sorted by document."""
    doc, blocks = None, []
    for batch in batches:
        for d, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
            if d != doc and blocks:
                yield doc, blocks
                blocks = []
            doc = d
            blocks.append({"type": kind, "text": text or ""})
    if blocks:
        yield doc, blocks


def written(blocks: DataFrame, settings: Settings) -> DataFrame:
    """path, content: a PDF of each document's blocks (doc_id, idx, type, text), laid out in one column.

    A task takes its documents as they come sorted from one exchange; placed lines never are rows."""
    settings = settings.clamped()
    (width, height), margin = settings.page_dims(), MARGIN_MM * MM_TO_PT

    def document(doc: int | None, rows: list[dict]) -> bytes:
        pages: list[list[dict]] = []
        for r in rows:
            pages += [[] for _ in range(r["page"] + 1 - len(pages))]
            r["y"], r["bold"] = height - margin - r["y"], r["type"] in HEADING
            pages[r["page"]].append(r)
        return write_pdf(pages, width, height, str(doc))

    def run(batches):
        paths, files, held = [], [], 0
        for doc, rows in _documents(batches):
            lines = linear_pages(rows, settings)
            if not lines:
                continue
            paths.append(None if doc is None else str(doc))
            files.append(document(doc, lines))
            held += len(files[-1])
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary())], ["path", "content"])
                paths, files, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary())], ["path", "content"])

    dealt = blocks.select("doc_id", "idx", "type", "text").repartition("doc_id").sortWithinPartitions("doc_id", "idx")
    return dealt.select("doc_id", "type", "text").mapInArrow(run, "path string, content binary")


def items(files: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns of the text items that the reader finds in files (path, content)."""
    kinds = {x.split()[0]: x for x in SCHEMA.split(", ")}
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    of = [types[kinds[c].split()[1]] for c in columns]
    brief = set(columns) <= {"path", "page", "kind", "idx", "text", "x", "y", "size"}

    def batch_of(found: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[c], t) for c, t in zip(columns, of)], list(columns))

    def run(batches):
        found: dict[str, list] = {c: [] for c in columns}
        n = 0
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in _rows(path, data.as_py(), brief=brief):
                    if row["kind"] == "run":
                        k = len(row["text"])
                        row |= {"path": [path] * k, "page": [row["page"]] * k, "idx": range(row["idx"], row["idx"] + k), "kind": ["item"] * k}
                        for c, values in found.items():
                            values += row[c]
                        n += k
                    elif row["kind"] == "item":
                        for c, values in found.items():
                            values.append(row.get(c))
                        n += 1
                if n >= BATCH_ROWS:
                    yield batch_of(found)
                    found, n = {c: [] for c in columns}, 0
        yield batch_of(found)

    return files.select("path", "content").mapInArrow(run, ", ".join(kinds[c] for c in columns))


def round_trip(blocks: DataFrame, settings: Settings, columns: Sequence[str]) -> DataFrame:
    """Text items that the reader finds in the documents laid out and written from their blocks."""
    return items(written(blocks, settings), columns)
