"""Raster operators on grey page images, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """A box of a fixed template: what it answers for its keyword, and where it is in shares of the page."""

    page_no: int
    keyword: str
    kind: str
    ord: int
    answer: str
    cx: float
    cy: float
    size: float


def otsu(gray: np.ndarray) -> int:
    """The threshold with the greatest variance between the two classes of grey values."""
    hist = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(hist), hist.sum()
    mean = np.cumsum(hist * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        var = (mean[-1] * below - mean * total) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(var), var, -1)))


def ticked(gray: np.ndarray, cx: float, cy: float, size: float, margin: float = 0.22, ink: float = 0.08) -> bool:
    """The inside of a box at relative coordinates holds enough ink."""
    h, w = gray.shape
    half = size * w / 2 * (1 - 2 * margin)
    x, y = cx * w, cy * h
    part = gray[max(0, int(y - half)) : int(y + half) + 1, max(0, int(x - half)) : int(x + half) + 1]
    return bool(part.size and (part <= otsu(gray)).mean() >= ink)


#: Sixteenths to whole grey values, halves to even ones.
_SIXTEENTHS = np.rint(np.arange(16 * 255 + 1) / 16).astype(np.uint8)


def _blur(gray: np.ndarray) -> np.ndarray:
    """Weights 1, 2, 1 along both axes, mirrored at the edges."""
    p = np.pad(gray.astype(np.uint16), 1, mode="reflect")
    p = p[:-2] + 2 * p[1:-1] + p[2:]
    return _SIXTEENTHS[p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]]


@dataclass(frozen=True)
class Regions:
    """Connected areas: their runs (row, begin, end exclusive, area), boxes x0, y0, x1, y1 (ends exclusive) and pixels."""

    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    of: np.ndarray
    box: np.ndarray
    area: np.ndarray

    @property
    def wide(self) -> np.ndarray:
        return self.box[:, 2] - self.box[:, 0]

    @property
    def high(self) -> np.ndarray:
        return self.box[:, 3] - self.box[:, 1]

    def paint(self, shape: tuple[int, int], chosen: np.ndarray) -> np.ndarray:
        """The mask of the chosen areas."""
        on = chosen[self.of]
        edges = np.zeros((shape[0], shape[1] + 1), np.int32)
        np.add.at(edges, (self.row[on], self.begin[on]), 1)
        np.add.at(edges, (self.row[on], self.end[on]), -1)
        return np.cumsum(edges, axis=1)[:, :-1] > 0


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the rows that the pairs tie to each of `n` rows."""
    root = np.arange(n)
    while len(a):
        one, two = root[a], root[b]
        apart = one != two
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def regions(mask: np.ndarray, diagonal: bool = True) -> Regions:
    """The connected areas of a mask, in order of their first run. Runs of neighbouring rows are united."""
    h, w = mask.shape
    framed = np.zeros((h, w + 2), bool)
    framed[:, 1:-1] = mask
    edge = np.flatnonzero(framed[:, 1:] != framed[:, :-1])
    row, begin = np.divmod(edge[::2], w + 1)
    end = edge[1::2] % (w + 1)
    # a run meets a stretch of the runs in the row above
    line = w + 3
    first = np.searchsorted(row * line + end, (row - 1) * line + begin - diagonal, "right")
    n = np.maximum(np.searchsorted(row * line + begin, (row - 1) * line + end + diagonal, "left") - first, 0)
    below = np.repeat(np.arange(len(row)), n)
    above = np.arange(len(below)) + np.repeat(first - np.cumsum(n) + n, n)
    roots, of = np.unique(_roots(len(row), above, below), return_inverse=True)
    box = np.zeros((len(roots), 4), int)
    box[:, :2] = max(mask.shape)
    for k, values, fold in ((0, begin, np.minimum), (1, row, np.minimum), (2, end, np.maximum), (3, row + 1, np.maximum)):
        fold.at(box[:, k], of, values)
    return Regions(row, begin, end, of, box, np.bincount(of, end - begin, len(roots)).astype(int))


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """x0, y0, x1, y1 (ends exclusive) of each connected area."""
    return regions(mask, diagonal).box


def box_centers(gray: np.ndarray, least: int = 8, most: int = 70, ratio: tuple[float, float] = (0.75, 1.35), fill: tuple[float, float] = (0.18, 0.78), apart: float = 0.01) -> list[tuple[float, float]]:
    """Relative centres of ticked boxes: outlines of dark areas and of the holes in them, by size, shape and ink.

    From top to bottom; of centres nearer than `apart` on both axes the first one stays.
    """
    if not gray.size or gray.min() == gray.max():
        return []
    smooth = _blur(gray)
    ink = smooth <= otsu(smooth)
    h, w = ink.shape
    holes = components(~ink, False)
    inner = (holes[:, 0] > 0) & (holes[:, 1] > 0) & (holes[:, 2] < w) & (holes[:, 3] < h)
    found: list[tuple[float, float]] = []
    outlines = np.concatenate([components(ink), holes[inner] + np.array([-1, -1, 1, 1])])
    for x0, y0, x1, y1 in outlines[np.lexsort((outlines[:, 0], outlines[:, 1]))].tolist():
        wide, high = x1 - x0, y1 - y0
        if least <= wide <= most and least <= high <= most and ratio[0] <= wide / high <= ratio[1] and fill[0] <= ink[y0:y1, x0:x1].mean() <= fill[1]:
            x, y = (x0 + wide / 2) / w, (y0 + high / 2) / h
            if not any(abs(x - a) < apart and abs(y - b) < apart for a, b in found):
                found.append((x, y))
    return found


def _local_mean(gray: np.ndarray, block: int) -> np.ndarray:
    """Mean with normal weights over `block` pixels along both axes, edges repeated."""
    half = block // 2
    sigma = 0.3 * (half - 1) + 0.8
    weights = np.exp(-((np.arange(block) - half) ** 2) / (2 * sigma * sigma))
    weights /= weights.sum()
    out = gray.astype(np.float32)
    for axis in (0, 1):
        padded = np.pad(out, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = out.shape[axis]
        out = sum(np.float32(v) * (padded[i : i + n] if axis == 0 else padded[:, i : i + n]) for i, v in enumerate(weights))
    return np.rint(out)


def combs(boxes: np.ndarray, least: int = 3) -> set[int]:
    """Positions of boxes (cx, cy, side), by rows, that stand in a run of `least` or more closer than 1.8 sides.

    A band is what lies within half a side of the first box that is in no band yet.
    """
    out: set[int] = set()
    free = np.ones(len(boxes), bool)
    for seed in range(len(boxes)):
        if not free[seed]:
            continue
        band = np.nonzero(free & (np.abs(boxes[:, 1] - boxes[seed, 1]) <= boxes[seed, 2] / 2))[0]
        free[band] = False
        band = band[np.argsort(boxes[band, 0], kind="stable")]
        cuts = np.nonzero(np.diff(boxes[band, 0]) > 1.8 * boxes[band[1:], 2])[0] + 1
        for run in np.split(band, cuts):
            if len(run) >= least:
                out.update(run.tolist())
    return out


# Shares of the shorter side of a page and of the height of its text that bound a box's side, of a side that are its edge and
# its margin, the least ink of an edge, and the ink of a tick.
PAGE_SIDE, TEXT_SIDE, LEAST_SIDE, EDGE, MARGIN, SOLID, TICK = (0.008, 0.040), (0.95, 3.0), 8.0, 0.15, 0.28, 0.85, (0.10, 0.60)


def page_boxes(gray: np.ndarray, text_height: float = 0.0) -> list[tuple[float, float, float, bool]]:
    """Centre, side and tick of the boxes on a page, by rows: outlines darker than their surroundings with four solid edges.

    Outlines may be pale, so they are sought in the local contrast; a tick is dark, so it is sought below the page's
    threshold. Of boxes within half a side the first one stays; runs of boxes hold characters and go.
    """
    if not gray.size or gray.min() == gray.max():
        return []
    page = min(gray.shape)
    least, most = max(LEAST_SIDE, page * PAGE_SIDE[0]), page * PAGE_SIDE[1]
    if text_height > 0:
        least, most = max(least, text_height * TEXT_SIDE[0]), min(most, text_height * TEXT_SIDE[1])
    if least >= most:
        return []
    smooth = _blur(gray)
    dark = smooth <= otsu(smooth)
    line = smooth <= _local_mean(smooth, max(3, int(page * 0.02) | 1)) - 8
    holes = components(~line, False)
    h, w = line.shape
    closed = (holes[:, 0] > 0) & (holes[:, 1] > 0) & (holes[:, 2] < w) & (holes[:, 3] < h)
    areas = np.concatenate([components(line), holes[closed] + np.array([-1, -1, 1, 1])])
    wide, high = areas[:, 2] - areas[:, 0], areas[:, 3] - areas[:, 1]
    square = (wide >= least) & (wide <= most) & (high >= least) & (high <= most) & (wide / high >= 0.75) & (wide / high <= 1.35)
    kept: list[tuple[float, float, float, float]] = []
    areas = areas[square]
    for x0, y0, x1, y1 in areas[np.lexsort((areas[:, 0] + areas[:, 2], areas[:, 1] + areas[:, 3]))].tolist():
        short, part = min(x1 - x0, y1 - y0), line[y0:y1, x0:x1]
        band, margin = max(1, round(short * EDGE)), max(1, round(short * MARGIN))
        rows, cols = part.mean(axis=1), part.mean(axis=0)
        if min(rows[:band].max(), rows[-band:].max(), cols[:band].max(), cols[-band:].max()) < SOLID:
            continue
        inner = dark[y0 + margin : y1 - margin, x0 + margin : x1 - margin]
        x, y, side = (x0 + x1) / 2, (y0 + y1) / 2, float(max(x1 - x0, y1 - y0))
        if inner.size and not any(abs(x - a) < s / 2 and abs(y - b) < s / 2 for a, b, s, _ in kept):
            kept.append((x, y, side, float(inner.mean())))
    gone = combs(np.array([k[:3] for k in kept]).reshape(-1, 3))
    return [(x, y, side, TICK[0] <= ink <= TICK[1]) for i, (x, y, side, ink) in enumerate(kept) if i not in gone]


def boxes_of_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page_no, box_no, cx, cy, side, ticked of pages (key, page_no, width, height, gray, text_height); unreadable rasters have none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, page_no, w, h, gray, height in batch.itertuples(index=False):
                if gray is not None and w * h and len(gray) == w * h:
                    found = page_boxes(np.frombuffer(gray, np.uint8).reshape(int(h), int(w)), 0.0 if pd.isna(height) else float(height))
                    out += [(k, page_no, i, *box) for i, box in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "page_no", "box_no", "cx", "cy", "side", "ticked"])

    held = pages.select(key, "page_no", "width", "height", "gray", "text_height")
    return held.mapInPandas(rows, f"{key} {dict(pages.dtypes)[key]}, page_no int, box_no int, cx double, cy double, side double, ticked boolean")


def template_values(pages: DataFrame, boxes: list[Box], key: str = "doc_id") -> DataFrame:
    """key, keyword, value of the ticked template boxes on pages (key, page_no, width, height, gray).

    Of options the first ticked one counts, YES and NO together are BOTH, and of pages the last with a tick. Pages
    without a template or with an unreadable raster answer nothing. The template is configuration and rides along.
    """
    by_page: dict[int, list[Box]] = {}
    for b in boxes:
        by_page.setdefault(b.page_no, []).append(b)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, page_no, w, h, gray in batch.itertuples(index=False):
                if gray is None or not w * h or len(gray) != w * h:
                    continue
                page = np.frombuffer(gray, np.uint8).reshape(int(h), int(w))
                out += [(k, page_no, b.keyword, b.kind, b.ord, b.answer) for b in by_page.get(page_no, ()) if ticked(page, b.cx, b.cy, b.size)]
            yield pd.DataFrame(out, columns=[key, "page_no", "keyword", "kind", "ord", "answer"])

    kind_of_key = dict(pages.dtypes)[key]
    marks = pages.select(key, "page_no", "width", "height", "gray").mapInPandas(rows, f"{key} {kind_of_key}, page_no int, keyword string, kind string, ord int, answer string")
    one = marks.groupBy(key, "page_no", "keyword", "kind").agg(F.count_distinct("ord").alias("n"), F.min_by("answer", "ord").alias("first"))
    value = F.when((F.col("kind") == "yesno") & (F.col("n") > 1), "BOTH").otherwise(F.col("first"))
    return one.groupBy(key, "keyword").agg(F.max_by(value, "page_no").alias("value"))
