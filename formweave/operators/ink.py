"""Pen strokes in crops of signatures: freed of form lines, specks and print, scored, and packed as PNG, in numpy."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.operators import images


@dataclass(frozen=True)
class Mode:
    """How long a run must be to be sought as a form line: least pixels, shares of the width and of the height."""

    least: int
    wide: float
    high: float


# The modes in the order in which equal scores are decided; hues (of 180), saturation and value of coloured pens; and the
# weights of a score: density, coherence, specks, lines, and the scores of crops without ink, without shapes, and with too little ink.
MODES = {"preserve": Mode(18, 0.55, 0.72), "balanced": Mode(20, 0.45, 0.65), "strict": Mode(16, 0.35, 0.55)}
BLUE, RED, PALE = (90, 135), (10, 170), 50
DENSITY, COHERENCE, SPECK, LINE = 6.0, 2.2, 0.03, 1.8
NO_INK, NO_SHAPE, TOO_LITTLE, LEAST_DENSITY, SPECK_AREA = -1e9, -1e8, -1e6, 0.004, 12
PAD = 5


def coloured(rgb: np.ndarray) -> np.ndarray:
    """Pixels of blue or red ink."""
    c = rgb.astype(float)
    top, low = c.max(axis=2), c.min(axis=2)
    spread = np.where(top > low, top - low, 1)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    hue = np.where(top == r, (g - b) / spread, np.where(top == g, 2 + (b - r) / spread, 4 + (r - g) / spread))
    hue = np.rint(np.where(top > low, hue * 30 % 180, 0))
    strong = (top >= PALE) & (255 * (top - low) / np.maximum(top, 1) >= PALE)
    return strong & ((hue >= BLUE[0]) & (hue <= BLUE[1]) | (hue <= RED[0]) | (hue >= RED[1]))


def runs(mask: np.ndarray, least: int) -> np.ndarray:
    """What is left of the ink in horizontal runs of `least` pixels or more: an opening by a line."""
    steps = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(steps == 1)
    end = np.nonzero(steps == -1)[1]
    long = end - begin >= least
    edges = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int32)
    np.add.at(edges, (row[long], begin[long]), 1)
    np.add.at(edges, (row[long], end[long]), -1)
    return np.cumsum(edges, axis=1)[:, :-1] > 0


def _shifts(mask: np.ndarray, outside: bool, offsets: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    p = np.pad(mask, 1, constant_values=outside)
    h, w = mask.shape
    return [p[1 + y : 1 + y + h, 1 + x : 1 + x + w] for y, x in offsets]


def _closed(mask: np.ndarray) -> np.ndarray:
    """Gaps of a pixel between neighbours above and beside are filled."""
    grown = np.logical_or.reduce(_shifts(mask, False, ((0, 0), (-1, 0), (0, -1))))
    return np.logical_and.reduce(_shifts(grown, True, ((0, 0), (1, 0), (0, 1))))


def _opened(mask: np.ndarray) -> np.ndarray:
    """Ink in squares of two pixels."""
    full = np.logical_and.reduce(_shifts(mask, True, ((0, 0), (0, 1), (1, 0), (1, 1))))
    return np.logical_or.reduce(_shifts(full, False, ((0, 0), (0, -1), (-1, 0), (-1, -1)))) & mask


def _without(mask: np.ndarray, found: images.Regions, drop: np.ndarray) -> np.ndarray:
    return mask & ~found.paint(mask.shape, drop)


def form_lines(mask: np.ndarray, mode: Mode) -> np.ndarray:
    """Rules that cross the crop, edges of boxes, and baselines at its lower border."""
    h, w = mask.shape
    cand = runs(mask, max(mode.least, int(w * mode.wide))) | runs(mask.T, max(mode.least, int(h * mode.high))).T
    found = images.regions(cand)
    wide, high = found.wide, found.high
    level = (wide >= 0.60 * w) & (high <= max(5, int(0.12 * h)))
    upright = (high >= 0.75 * h) & (wide <= max(5, int(0.12 * w)))
    baseline = (found.box[:, 3] >= h - 2) & (wide >= 0.45 * w) & (high <= max(8, int(0.18 * h)))
    return found.paint(mask.shape, level | upright | baseline)


def _without_fragments(mask: np.ndarray) -> np.ndarray:
    """Without specks at the borders and thin pieces at the bottom that are not the main body."""
    h, w = mask.shape
    found = images.regions(mask)
    if not len(found.area):
        return mask
    x0, y0, x1, y1 = found.box.T
    speck = ((x0 <= 1) | (y0 <= 1) | (x1 >= w - 1) | (y1 >= h - 1)) & (found.area <= 36)
    thin = (y0 >= int(0.78 * h)) & (found.high <= 3) & (found.wide >= int(0.10 * w)) & (np.arange(len(found.area)) != found.area.argmax())
    return _without(mask, found, speck | thin)


def _without_islands(mask: np.ndarray) -> np.ndarray:
    """Without dots that lie far from the main body."""
    h, w = mask.shape
    found = images.regions(mask)
    if not len(found.area):
        return mask
    main = int(found.area.argmax())
    x0, y0, x1, y1 = (int(v) for v in found.box[main])
    far_x, far_y = int(max(8, 0.35 * (x1 - x0))), int(max(8, 0.50 * (y1 - y0)))
    cx, cy = found.box[:, 0] + found.wide // 2, found.box[:, 1] + found.high // 2
    near = (cx >= max(0, x0 - far_x)) & (cx <= min(w - 1, x1 + far_x)) & (cy >= max(0, y0 - far_y)) & (cy <= min(h - 1, y1 + far_y))
    return _without(mask, found, ~near & (found.area <= 45) & (np.arange(len(near)) != main))


def clip_baseline(mask: np.ndarray) -> np.ndarray:
    """Without thin long lines that lie below the main body."""
    h, w = mask.shape
    body = images.regions(mask)
    if h < 20 or w < 40 or not len(body.area):
        return mask
    start = int(body.box[body.area.argmax(), 3] + 0.05 * h)
    found = images.regions(runs(mask, max(20, int(w * 0.50))))
    line = (found.box[:, 1] >= start) & (found.high <= max(3, int(0.10 * h))) & (found.wide >= int(0.50 * w)) & (found.area <= int(0.015 * h * w))
    return _without(mask, found, line)


def clip_lower_lines(mask: np.ndarray) -> np.ndarray:
    """Without thin long lines in the lower half."""
    h, w = mask.shape
    if h < 20 or w < 40:
        return mask
    found = images.regions(runs(mask, max(18, int(0.45 * w))))
    line = (found.box[:, 1] >= int(0.50 * h)) & (found.wide >= int(0.40 * w)) & (found.high <= max(4, int(0.12 * h))) & (found.area <= int(0.025 * h * w))
    return _without(mask, found, line)


def straight(mask: np.ndarray, least: int, gap: int, votes: int, slope: float) -> list[tuple[int, int, float, int]]:
    """Straight lines x0, x1, middle y, drop of at most the slope, the longest first; a line takes its ink with it.

    All slopes that differ by a pixel over the width are tried, so that no chance decides.
    """
    h, w = mask.shape
    left, out = mask.copy(), []
    steep = int(slope * w)
    drops = np.array(sorted(range(-steep, steep + 1), key=abs))
    falls = np.rint(drops[:, None] * np.arange(w) / max(1, w - 1)).astype(int)
    span = h + 2 * steep + 2
    while left.sum() >= votes:
        y, x = np.nonzero(left)
        order = np.argsort(x, kind="stable")
        y, x = y[order], x[order]
        # the row of each pixel at the left edge, for each slope: pixels of a line share it
        at = y - falls[:, x]
        cell = (at + steep + 1 + np.arange(len(drops))[:, None] * span).ravel()
        first, last = np.full(len(drops) * span, w), np.full(len(drops) * span, -1)
        xs = np.tile(x, len(drops))
        np.minimum.at(first, cell, xs)
        np.maximum.at(last, cell, xs)
        # what may be a line, in runs without a wide gap
        tried = (np.bincount(cell, minlength=len(drops) * span) >= votes) & (last - first >= least)
        held = np.nonzero(tried[cell])[0]
        if not len(held):
            break
        held = held[np.argsort(cell[held], kind="stable")]
        c, ink = cell[held], xs[held]
        cuts = np.nonzero((c[1:] != c[:-1]) | (ink[1:] - ink[:-1] > gap + 1))[0]
        begin, end = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ink) - 1]])
        length = np.where(end - begin + 1 >= votes, ink[end] - ink[begin], -1)
        i = int(length.argmax())
        if length[i] < least:
            break
        k, r = int(c[begin[i]] // span), int(c[begin[i]] % span) - steep - 1
        drop, part = int(drops[k]), ink[begin[i] : end[i] + 1]
        y = r + np.rint(drop * part / max(1, w - 1)).astype(int)
        for d in (-1, 0, 1):
            left[np.clip(y + d, 0, h - 1), part] = False
        out.append((int(part[0]), int(part[-1]), float(y[0] + y[-1]) / 2, int(y[-1] - y[0])))
    return out


def _erase(mask: np.ndarray, lines: list[tuple[int, int, float, int]], above: float) -> np.ndarray:
    out, (h, w) = mask.copy(), mask.shape
    for x0, x1, mid, drop in lines:
        if mid >= above * h:
            x = np.arange(x0, x1 + 1)
            y = np.rint(mid - drop / 2 + drop * (x - x0) / max(1, x1 - x0)).astype(int)
            for d in (-1, 0, 1):
                out[np.clip(y + d, 0, h - 1), x] = False
    return out


def strokes(rgb: np.ndarray) -> np.ndarray:
    """Coloured and dark pixels of a crop (height, width, 3) in strokes, form lines included."""
    h, w = rgb.shape[:2]
    gray = np.rint(rgb.astype(float) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    smooth = images._blur(gray) if min(h, w) > 1 else gray
    flat = smooth.min() == smooth.max()
    dark = np.zeros((h, w), bool) if flat else (smooth <= images.otsu(smooth)) | (smooth <= images._local_mean(smooth, 25) - 6)
    return _opened(coloured(rgb) | dark)


def _cleaned(base: np.ndarray, lines: np.ndarray) -> np.ndarray:
    w = base.shape[1]
    ink = _without_islands(_without_fragments(base & ~lines))
    if base.any() and ink.sum() < max(30, int(base.sum() * 0.18)):
        ink = base & ~lines
    ink = _closed(clip_baseline(ink))
    ink = _erase(ink, straight(ink, max(20, int(0.45 * w)), 8, 30, 0.10), 0.45)
    return clip_baseline(clip_lower_lines(ink))


def clean(rgb: np.ndarray, mode: str = "balanced") -> np.ndarray:
    """The ink of a signature in a crop (height, width, 3), as a mask.

    Coloured and dark strokes without form lines, fragments and islands; if next to nothing is left, the form lines alone go.
    """
    base = strokes(rgb)
    return _cleaned(base, form_lines(base, MODES[mode]))


def score(ink: np.ndarray) -> float:
    """How much a mask looks like a signature: enough ink, one body, few specks, no lines below."""
    h, w = ink.shape
    n = int(ink.sum())
    if not n:
        return NO_INK
    density = n / (h * w)
    if density < LEAST_DENSITY:
        return TOO_LITTLE * (LEAST_DENSITY - density)
    area = images.regions(ink).area
    if not len(area):
        return NO_SHAPE
    below = [np.hypot(x1 - x0, drop) / w for x0, x1, mid, drop in straight(ink, max(18, int(0.35 * w)), 6, 24, 0.12) if mid >= 0.50 * h]
    return float(DENSITY * density + COHERENCE * area.max() / n - SPECK * (area < SPECK_AREA).sum() - LINE * sum(below))


def best_clean(rgb: np.ndarray) -> tuple[str, np.ndarray]:
    """The mode with the best score and its mask, the first of equal ones. Modes that find the same form lines are one."""
    base = strokes(rgb)
    lines = {m: form_lines(base, mode) for m, mode in MODES.items()}
    made = {held: _cleaned(base, lines[m]) for held, m in {lines[m].tobytes(): m for m in MODES}.items()}
    known = {held: score(ink) for held, ink in made.items()}
    name = max(MODES, key=lambda m: known[lines[m].tobytes()])
    return name, made[lines[name].tobytes()]


def png(gray: np.ndarray) -> bytes:
    """A grey image as a PNG file."""
    h, w = gray.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), gray], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def inflated(raw: bytes, size: int) -> bytes | None:
    """The bytes in a zlib stream of `size` bytes; null for anything else, of which no more than that is read."""
    reader = zlib.decompressobj()
    try:
        out = reader.decompress(raw, size + 1)
    except zlib.error:
        return None
    return out if reader.eof and not reader.unused_data and len(out) == size else None


def signature_images(pages: DataFrame, boxes: DataFrame, page: list[str], mode: str = "auto", deflated: bool = False) -> DataFrame:
    """page, box_id, mode, n_ink, png: the cleaned crop of each box (x0, y0, x1, y1 in pixels), five pixels wider on all sides.

    `pages` hold width, height and rgb (three bytes a pixel; `deflated`: these as a zlib stream, so that batches of pages
    stay small on their way and one raster at a time is whole). A page's raster meets its boxes once. Boxes off the page,
    and pages with an unreadable raster, have no row.
    """
    packed = boxes.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("box_id", *(F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1"))))).alias("_b"))
    # cleaning takes long for its few bytes, so that its tasks are not to be merged by size
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = pages.select(*page, "width", "height", "rgb").join(packed, page).repartition(tasks, *page)
    types = dict(held.dtypes)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *at, w, h, raw, found in batch.itertuples(index=False):
                if raw is None or not (w > 0 and h > 0):
                    continue
                if deflated:
                    raw = inflated(raw, int(3 * w * h))
                if raw is None or len(raw) != 3 * w * h:
                    continue
                image = np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3)
                for b in found:
                    crop = image[max(0, b["y0"] - PAD) : max(0, b["y1"] + PAD), max(0, b["x0"] - PAD) : max(0, b["x1"] + PAD)]
                    if crop.size:
                        name, ink = best_clean(crop) if mode == "auto" else (mode, clean(crop, mode))
                        out.append((*at, b["box_id"], name, int(ink.sum()), png(np.where(ink, 0, 255).astype(np.uint8))))
            yield pd.DataFrame(out, columns=[*page, "box_id", "mode", "n_ink", "png"])

    keys = ", ".join(f"{c} {types[c]}" for c in page)
    return held.mapInPandas(rows, f"{keys}, box_id {dict(boxes.dtypes)['box_id']}, mode string, n_ink int, png binary")
