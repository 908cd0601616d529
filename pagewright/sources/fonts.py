"""The characters that a TrueType font covers."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession


def cmap_coverage(data: bytes) -> set[int]:
    """Code points of a font's character map (formats 4 and 12)."""
    tables = {data[12 + 16 * k : 16 + 16 * k]: struct.unpack_from(">I", data, 20 + 16 * k)[0] for k in range(struct.unpack_from(">H", data, 4)[0])}
    base = tables.get(b"cmap")
    if base is None:
        return set()
    out: set[int] = set()
    for k in range(struct.unpack_from(">H", data, base + 2)[0]):
        at = base + struct.unpack_from(">I", data, base + 8 + 8 * k)[0]
        kind = struct.unpack_from(">H", data, at)[0]
        if kind == 12:
            for g in range(struct.unpack_from(">I", data, at + 12)[0]):
                first, last, glyph = struct.unpack_from(">3I", data, at + 16 + 12 * g)
                out.update(c for c in range(first, last + 1) if glyph + c - first)
        elif kind == 4:
            n = struct.unpack_from(">H", data, at + 6)[0] // 2
            word = lambda part, s: struct.unpack_from(">H", data, at + 14 + 2 * (n * part + s) + (2 if part else 0))[0]  # noqa: E731, B023
            for s in range(n):
                last, first, delta, offset = (word(p, s) for p in range(4))
                for c in range(first, last + 1):
                    if c == 0xFFFF:
                        continue
                    glyph = c
                    if offset:
                        place = at + 16 + 2 * (n * 3 + s) + offset + 2 * (c - first)
                        glyph = struct.unpack_from(">H", data, place)[0] if place + 2 <= len(data) else 0
                    if glyph and (glyph + delta) & 0xFFFF:
                        out.add(c)
    return out


def coverage(spark: SparkSession, data: bytes) -> DataFrame:
    """A row for each covered character: ch."""
    return spark.createDataFrame([(chr(c),) for c in sorted(cmap_coverage(data)) if not 0xD800 <= c < 0xE000], "ch string")
