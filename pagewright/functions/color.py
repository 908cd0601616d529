"""Colours as arrays of three doubles (0-255), and contrast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CONTRAST = 5.0


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def from_hex(c: Column) -> Column:
    return F.array(*(F.conv(F.substring(c, 2 + 2 * k, 2), 16, 10).cast("double") for k in range(3)))


def luminance(c: Column) -> Column:
    """WCAG relative luminance."""

    def channel(v: Column) -> Column:
        x = v / 255
        return F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(F.get(c, F.lit(0))) + 0.7152 * channel(F.get(c, F.lit(1))) + 0.0722 * channel(F.get(c, F.lit(2)))


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def is_chromatic(c: Column) -> Column:
    return F.array_max(c) - F.array_min(c) > 40


def same_color(a: Column, b: Column, tolerance: float = 8.0) -> Column:
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d < tolerance)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def ensure_contrast(c: Column, back: Column, least: float = MIN_CONTRAST) -> Column:
    """The first blend in steps of 5 % toward black or white that contrasts enough."""
    target = F.when(luminance(back) > 0.18, F.array(*[F.lit(0.0)] * 3)).otherwise(F.array(*[F.lit(255.0)] * 3))
    blends = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.zip_with(c, target, lambda v, t: round_half_up(v + (t - v) * (k * F.lit(0.05))).cast("double")))
    good = F.filter(blends, lambda m: contrast(m, back) >= least)
    return F.when(contrast(c, back) >= least, c).otherwise(F.coalesce(F.get(good, F.lit(0)), target))


def resolve_text_color(run: Column, back: Column, fore: Column, black_white: bool = False) -> Column:
    dark = F.forall(run, lambda v: v < 20)
    base = fore if black_white else F.when(run.isNull() | dark, fore).otherwise(F.transform(run, lambda v: round_half_up(v).cast("double")))
    seen = F.when(~is_chromatic(base) & (contrast(base, back) < MIN_CONTRAST), fore).otherwise(base)
    return ensure_contrast(seen, back)


def container_colors(fill: Column, stroke: Column, back: Column, fore: Column, black_white: bool = False) -> Column:
    if black_white:
        return F.struct(back.alias("fill"), fore.alias("stroke"))
    return F.struct(F.coalesce(fill, back).alias("fill"), F.coalesce(stroke, F.array(*[F.lit(153.0)] * 3)).alias("stroke"))
