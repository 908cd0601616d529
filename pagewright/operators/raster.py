"""Grey-scale raster kernels over numpy arrays (rows by columns, 0 black to 255 white)."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def grayscale(rgb: np.ndarray, most: int | None = None) -> np.ndarray:
    """Luma of an RGB raster, taken at every nth pixel so that no side exceeds ``most``."""
    step = max(1, -(-max(rgb.shape[:2]) // most)) if most else 1
    return rgb[::step, ::step].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)


def _lead(dark: np.ndarray, most: int) -> int:
    """How many values from the front are true, ``most`` at most."""
    head = dark[:most]
    return int(head.argmin()) if len(head) and not head.all() else len(head)


def shadow_crop(gray: np.ndarray, share: float = 0.08) -> tuple[int, int, int, int]:
    """(top, bottom, left, right) without edges darker than the scan's shadow threshold."""
    h, w = gray.shape
    sample = np.sort(gray.ravel()[::37])
    median = float(sample[len(sample) // 2]) or 200.0
    rows, columns = (gray.mean(axis) < min(0.4 * median, 90.0) for axis in (1, 0))
    dy, dx = int(h * share), int(w * share)
    return _lead(rows, dy), h - _lead(rows[::-1], dy), _lead(columns, dx), w - _lead(columns[::-1], dx)


def skew_angle(gray: np.ndarray, reach: float = 4.0, step: float = 0.5) -> float:
    """The angle in degrees whose row projection varies most."""
    h, w = gray.shape
    y, x = np.mgrid[0:h:2, 0:w:2]
    ink = (255.0 - gray[::2, ::2]).ravel()
    dy, dx = (y - h / 2).ravel(), (x - w / 2).ravel()
    spread = []
    angles = np.arange(-reach, reach + step / 2, step)
    for a in np.radians(angles):
        row = np.floor(dy * np.cos(a) - dx * np.sin(a) + h / 2 + 0.5).astype(int)
        ok = (row >= 0) & (row < h)
        count = np.bincount(row[ok], minlength=h)
        mean = np.bincount(row[ok], ink[ok], minlength=h)[count > 0] / count[count > 0]
        spread.append(mean.var())
    return float(angles[int(np.argmax(spread))])


def rotate(gray: np.ndarray, degrees: float) -> np.ndarray:
    """The raster turned about its centre, by nearest pixels, white outside."""
    h, w = gray.shape
    a = np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w]
    sx = np.floor((x - w / 2) * np.cos(a) - (y - h / 2) * np.sin(a) + w / 2 + 0.5).astype(int)
    sy = np.floor((x - w / 2) * np.sin(a) + (y - h / 2) * np.cos(a) + h / 2 + 0.5).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(gray, 255)
    out[inside] = gray[sy[inside], sx[inside]]
    return out


def turn(gray: np.ndarray, times: int) -> np.ndarray:
    return np.rot90(gray, -times)


def gutter(gray: np.ndarray) -> tuple[int, bool, np.ndarray]:
    """(column, whether it is clear, ink by column) of the fold between two half pages."""
    w = gray.shape[1]
    ink = np.maximum(0, 200 - gray[::2]).sum(0)
    lo, hi = int(w * 0.30), int(w * 0.70)
    at = lo + int(ink[lo:hi].argmin())
    outside = np.concatenate([ink[:lo], ink[hi:]])
    return at, bool(ink[at] < 0.35 * outside.mean()), ink


def gutter_cuts(at: int, ink: np.ndarray) -> tuple[int, int]:
    """(end of the left half, start of the right half): 6 % beyond the fold, then on to a blank column, 15 % at most."""
    w = len(ink)
    blank = ink <= 0.03 * (ink.max() or 1)
    near, far = round(w * 0.06), round(w * 0.15)
    right = np.arange(min(w - 1, at + near), min(w - 1, at + far) + 1)
    left = np.arange(max(0, at - near), max(0, at - far) - 1, -1)
    first = lambda path: int(path[blank[path].argmax()] if blank[path].any() else path[-1])
    return first(right), first(left)


def stretch(gray: np.ndarray) -> np.ndarray:
    """Contrast stretched between the 1st and 99th percentile by index."""
    flat = np.sort(gray.ravel())
    lo, hi = flat[int(len(flat) * 0.01)], flat[int(len(flat) * 0.99)]
    return np.clip((gray - lo) / max(1.0, float(hi - lo)) * 255, 0, 255)


def sauvola(gray: np.ndarray, window: int = 31, k: float = 0.34) -> np.ndarray:
    """True where ink: below the local threshold mean * (1 + k (deviation / 128 - 1)), from integral images."""
    h, w = gray.shape
    pad = lambda a: np.pad(a.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    one, two = pad(gray), pad(gray.astype(np.float64) ** 2)
    half = window // 2
    y0, y1 = np.clip(np.arange(h) - half, 0, h), np.clip(np.arange(h) + half + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - half, 0, w), np.clip(np.arange(w) + half + 1, 0, w)
    area = (y1 - y0)[:, None] * (x1 - x0)[None]
    box = lambda s: s[np.ix_(y1, x1)] - s[np.ix_(y0, x1)] - s[np.ix_(y1, x0)] + s[np.ix_(y0, x0)]
    mean = box(one) / area
    deviation = np.sqrt(np.maximum(0, box(two) / area - mean**2))
    return gray < mean * (1 + k * (deviation / 128 - 1))


def otsu(gray: np.ndarray) -> int:
    """The grey level that parts the histogram with the largest variance between its sides."""
    n = np.bincount(np.clip(np.floor(gray + 0.5), 0, 255).astype(int).ravel(), minlength=256).astype(float)
    a, s = n.cumsum(), (n * np.arange(256)).cumsum()
    b, t = a[-1] - a, s[-1] - s
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(a * b * (s / a - t / b) ** 2)
    return int(between.argmax())


def otsu_binarize(gray: np.ndarray) -> np.ndarray:
    return gray <= otsu(gray)


def connected_components(ink: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, pixels) of each 8-connected component, edges inclusive."""
    seen, out = np.zeros(ink.shape, bool), []
    h, w = ink.shape
    for y, x in zip(*np.nonzero(ink)):
        if seen[y, x]:
            continue
        seen[y, x] = True
        queue, xs, ys = deque([(int(y), int(x))]), [], []
        while queue:
            j, i = queue.popleft()
            ys.append(j)
            xs.append(i)
            for b in range(max(0, j - 1), min(h, j + 2)):
                for a in range(max(0, i - 1), min(w, i + 2)):
                    if ink[b, a] and not seen[b, a]:
                        seen[b, a] = True
                        queue.append((b, a))
        out.append((min(xs), min(ys), max(xs), max(ys), len(xs)))
    return out


def illustrations(ink: np.ndarray, times: float = 6.0) -> list[tuple[int, int, int, int]]:
    """Components over ``times`` the modal letter height in both directions."""
    found = connected_components(ink)
    heights = [y1 - y0 + 1 for _, y0, _, y1, n in found if n > 4]
    modal = np.bincount(heights).argmax() if heights else 0
    return [(x0, y0, x1, y1) for x0, y0, x1, y1, _ in found if modal and y1 - y0 + 1 > times * modal and x1 - x0 + 1 > times * modal]


def upscale(gray: np.ndarray, times: int = 2) -> np.ndarray:
    return gray.repeat(times, 0).repeat(times, 1)


def paint_white(gray: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    out = gray.copy()
    for x0, y0, x1, y1 in boxes:
        out[max(0, y0) : y1 + 1, max(0, x0) : x1 + 1] = 255
    return out


def is_mostly_blank(gray: np.ndarray, least: float = 0.10) -> bool:
    """Fewer than ``least`` of every fourth pixel are darker than 245."""
    return bool((gray.ravel()[::4] < 245).mean() < least)


def ink_contrast(region: np.ndarray) -> tuple[tuple, tuple]:
    """(background, ink) of an RGB region: the mode of 4-bit colours, and the mean of the 15 % farthest from it."""
    flat = region.reshape(-1, 3).astype(int)
    keys = (flat >> 4) @ np.array([256, 16, 1])
    back = flat[keys == np.bincount(keys).argmax()].mean(0)
    distance = ((flat - back) ** 2).sum(1)
    n = max(1, int(len(flat) * 0.15))
    return tuple(back), tuple(flat[np.argpartition(distance, -n)[-n:]].mean(0))


def prepare_half(gray: np.ndarray) -> np.ndarray:
    """A half page for recognition: twice the size, contrast stretched."""
    return stretch(upscale(gray, 2))


def page_halves(gray: np.ndarray, double: bool | None = None) -> list[np.ndarray]:
    """Crop shadows, straighten by more than half a degree, and part at a clear fold."""
    top, bottom, left, right = shadow_crop(gray)
    gray = gray[top:bottom, left:right]
    angle = skew_angle(gray)
    if abs(angle) > 0.5:
        gray = rotate(gray, -angle)
    at, clear, ink = gutter(gray)
    if double if double is not None else clear and gray.shape[1] > gray.shape[0]:
        end, start = gutter_cuts(at, ink)
        return [prepare_half(gray[:, :end]), prepare_half(gray[:, start:])]
    return [prepare_half(gray)]


def analyse(pages: DataFrame) -> DataFrame:
    """page_id, otsu, blank, angle, clear of grey rasters (page_id, height, width, pixels binary)."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                g = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width).astype(np.float32)
                out.append((r.page_id, otsu(g), is_mostly_blank(g), skew_angle(g), gutter(g)[1]))
            yield pd.DataFrame(out, columns=["page_id", "otsu", "blank", "angle", "clear"])

    return pages.mapInPandas(run, "page_id long, otsu int, blank boolean, angle double, clear boolean")
