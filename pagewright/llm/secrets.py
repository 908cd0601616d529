"""Secret scan: keyword automaton, anchored patterns near its hits, then checksums.

An Aho-Corasick automaton finds the keywords in the lower-cased bytes; only there an anchored
pattern is tried, so the patterns never search. Long hexadecimal runs have no keyword; they are
found by a vectorised scan: a run of 24 covers a whole aligned block of 12.

Base kinds (always reported): ``assign``, ``access``, ``hex``. Added kinds carry a checksum in
the token and are reported only if it holds: ``github`` and ``npm`` tokens (base-62 CRC-32 of the
body in the last six characters), payment ``card`` numbers (Luhn), ``jwt`` (its header must
decode to JSON with "alg").

Spans are in code points, end exclusive. Edge cases: null counts as empty, and a text without a
secret has counts 0 and an empty span list; repeated rows and null ids are scanned like others; other
columns have no part in a scan and pass through a redaction; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import blocks, freeing, raw

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "github", "npm", "card", "jwt")
GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
CARD = re.compile(rb"(?:card|visa|mastercard|amex)[^0-9\n]{0,20}((?:[0-9][ -]?){12,18}[0-9])(?![0-9])", re.I)
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access"} | {f"gh{c}_": "github" for c in "pousr"} | {"npm_": "npm", "eyj": "jwt", "card": "card", "visa": "card", "amex": "card"}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def base62_crc32(body: bytes) -> bytes:
    """The six-character checksum at the end of such tokens."""
    n, out = zlib.crc32(body), ""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out.rjust(6, "0").encode()


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _jwt(token: bytes) -> bool:
    head = token.split(b".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


def _anchored(text: bytes, hits: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """Spans (in bytes) from keyword hits in ascending order."""
    out, free = [], dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                free[kind] = m.end()
                if m.end(2) - m.start(2) >= LEAST[kind]:
                    out.append((at, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                free[kind] = m.end()
                if m.end() - at >= LEAST[kind]:
                    out.append((at, m.end(), kind))
        elif kind in ("github", "npm"):
            m = (GITHUB if kind == "github" else NPM).match(text, at)
            if m and base62_crc32(m[0][4:-6]) == m[0][-6:]:
                free[kind] = m.end()
                out.append((at, m.end(), kind))
        elif kind == "card":
            m = CARD.match(text, at)
            if m and luhn(re.sub(rb"[ -]", b"", m[1])):
                free[kind] = m.end()
                out.append((m.start(1), m.end(1), kind))
        elif (m := JWT.match(text, at)) and _jwt(m[0]):
            free[kind] = m.end()
            out.append((at, m.end(), kind))
    return out


def hex_runs(buf: np.ndarray, offs: np.ndarray, least: int = LEAST["hex"]) -> list[tuple[int, int, int]]:
    """(row, start, end) of maximal hexadecimal runs of ``least`` bytes, which are within rows."""
    step = least // 2
    on = _HEX[buf]
    n = len(buf) // step
    full = np.flatnonzero(on[: n * step].reshape(n, step).all(1))
    out, done = [], -1
    for b in full:
        at = int(b) * step
        if at < done:
            continue
        row = int(np.searchsorted(offs, at, side="right")) - 1
        last = int(np.searchsorted(offs, at + step - 1, side="right")) - 1
        for r in range(row, last + 1):  # the block may hold a row's end
            a = e = max(at, int(offs[r]))
            low, high = int(offs[r]), int(offs[r + 1])
            while a > low and on[a - 1]:
                a -= 1
            while e < high and on[e]:
                e += 1
            if e - a >= least and (not out or out[-1] != (r, a, e)):
                out.append((r, a, e))
            done = max(done, e)
    return out


def _found(texts: pa.Array, find: ahocorasick.Automaton):
    """For blocks of rows: (first row, their bytes, offsets, spans in bytes of each row with any)."""
    buf, offs = raw(texts)
    for i, j in blocks(offs):
        own, cuts = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        flat = own.tobytes()
        hits: dict[int, list[tuple[int, str]]] = {}
        for end, (name, n) in find.iter(flat.lower().decode("latin-1")):
            at = end - n + 1
            r = int(np.searchsorted(cuts, at, side="right")) - 1
            if end < cuts[r + 1]:
                hits.setdefault(r, []).append((at - int(cuts[r]), name))
        runs: dict[int, list[tuple[int, int, str]]] = {}
        for r, a, e in hex_runs(own, cuts):
            runs.setdefault(r, []).append((a - int(cuts[r]), e - int(cuts[r]), "hex"))
        spans = {}
        for r in {*hits, *runs}:
            found = _anchored(flat[cuts[r] : cuts[r + 1]], sorted(hits.get(r, ()))) + runs.get(r, [])
            if found:
                spans[r] = sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))
        yield i, flat, cuts, spans


def scan(docs: DataFrame) -> DataFrame:
    """All spans of every text: doc_id, spans array<struct<kind, start, end>> by start, then kind."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        find = automaton()
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for i, flat, cuts, found in _found(batch.column(1), find):
                spans = [[] for _ in cuts[1:]]
                for r, own in found.items():
                    lead = np.concatenate([[0], np.cumsum((np.frombuffer(flat[cuts[r] : cuts[r + 1]], np.uint8) & 0xC0) != 0x80)])
                    spans[r] = [{"kind": k, "start": int(lead[a]), "end": int(lead[e])} for a, e, k in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(spans)), pa.array(spans, kinds)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(freeing(run), f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret's characters replaced; all columns stay, and null texts stay null."""

    def run(batches):
        find = automaton()
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for i, flat, cuts, found in _found(batch.column(k), find):
                rows = batch.slice(i, len(cuts) - 1)
                if found:
                    texts = rows.column(k).to_pylist()
                    for r, spans in found.items():
                        texts[r] = _without(flat[cuts[r] : cuts[r + 1]], spans, mark).decode("utf-8", "surrogatepass")
                    rows = rows.set_column(k, "text", pa.array(texts, batch.schema.field(k).type))
                yield rows

    return docs.mapInArrow(freeing(run), docs.schema)


def _without(flat: bytes, spans: list[tuple[int, int, str]], mark: str) -> bytes:
    """A text with its spans, overlapping ones joined, replaced by ``mark``."""
    out, at = [], 0
    for a, e, _ in sorted(spans):
        if a >= at:
            out += [flat[at:a], mark.encode()]
        at = max(at, e)
    return b"".join([*out, flat[at:]])


def redact_text(text: str, find: ahocorasick.Automaton, mark: str) -> str:
    """One text without its secrets."""
    flat = text.encode("utf-8", "surrogatepass")
    for _, _, _, found in _found(pa.array([flat], pa.large_binary()), find):
        flat = _without(flat, found.get(0, []), mark)
    return flat.decode("utf-8", "surrogatepass")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the checksum of their spans, and all spans as a string."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*LEAST))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return scanned.select("doc_id", *(count(k).alias(f"n_{k}") for k in LEAST), F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"))
