"""Scanned pages of waveforms: from pixels to the twelve leads, by array operations on one page at a time."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from millrace.operators import signals as S

# Widths of filters in pixels, thresholds of light and colour, and shares of a lead's block.
WINDOW, DARKER = 41, 8  # ink is darker than the mean of its surroundings
REDDISH, BLUISH = ((0, 40), (320, 360)), ((170, 280),)  # hues of printed grids, in degrees
LEAST_SATURATION, LEAST_RED, LEAST_BLUE = 10, 70, 60  # of 255
SMALL, SMALL_GRID = 20, 50  # pixels of the least part that is kept
CLOSED = 5  # gaps within a row that are closed
EDGE, LEAST_INK = 0.02, 0.003  # of a block: what is cut above and below, and what must be drawn


def _around(a: np.ndarray, high: int, wide: int, pick: Callable) -> np.ndarray:
    """The largest or smallest value within a rectangle around each pixel; beyond the page there is none."""
    out = a
    for axis, size in ((0, high), (1, wide)):
        if size > 1:
            pad = [(size // 2, size // 2) if k == axis else (0, 0) for k in range(2)]
            fill = 0 if pick is np.max else 255
            out = pick(np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, constant_values=fill), size, axis=axis), axis=-1)
    return out


def ink(grey: np.ndarray, window: int = WINDOW, darker: int = DARKER) -> np.ndarray:
    """255 where a pixel is darker than the mean of the square around it by more than ``darker``, else 0; the page's rim is repeated."""
    half = window // 2
    sums = np.pad(np.pad(grey.astype(np.int64), half, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = grey.shape
    mean = (sums[window : window + h, window : window + w] - sums[:h, window : window + w] - sums[window : window + h, :w] + sums[:h, :w]) / window**2
    return np.where(grey < mean - darker, 255, 0).astype(np.uint8)


def coloured_grid(page: np.ndarray) -> np.ndarray:
    """255 where a page (rows, columns, RGB) has a grid's red or blue, without specks and a pixel wider."""
    rgb = page.astype(np.float64)
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    spread = np.maximum(top - low, 1e-9)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    hue = np.where(top == r, (g - b) / spread % 6, np.where(top == g, (b - r) / spread + 2, (r - g) / spread + 4)) * 60
    coloured = np.where(top > 0, (top - low) / np.maximum(top, 1e-9), 0) * 255 >= LEAST_SATURATION

    def hues(ranges: tuple) -> np.ndarray:
        return np.any([(hue >= a) & (hue <= e) for a, e in ranges], axis=0)

    found = coloured & ((hues(REDDISH) & (top >= LEAST_RED)) | (hues(BLUISH) & (top >= LEAST_BLUE)))
    opened = _around(_around(np.where(found, 255, 0).astype(np.uint8), 3, 3, np.min), 3, 3, np.max)
    return _around(opened, 3, 3, np.max)


def masks(page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signal, grid) of a page: rows by columns, or with three colours. Without a coloured grid, long straight lines are the grid."""
    drawn = ink(page[..., 1] if page.ndim == 3 else page)
    grid = coloured_grid(page) if page.ndim == 3 else np.zeros_like(drawn)
    if not grid.any():
        grid = S.without_small(S.line_grid(drawn), SMALL_GRID)
    signal = S.without_small(np.where(grid > 0, 0, drawn).astype(np.uint8), SMALL)
    return _around(_around(signal, 1, CLOSED, np.max), 1, CLOSED, np.min), grid


def spacings(grid: np.ndarray, share: float = 0.45, low: int = 4, high: int = 80) -> list[float]:
    """The median distance of a grid's lines down and across; none where there aren't two lines within bounds."""
    out = []
    for axis in (0, 1):
        p = (grid > 0).sum(axis=axis).astype(float)
        if len(p) < 3:
            continue
        peak = np.flatnonzero((p[1:-1] >= p[:-2]) & (p[1:-1] >= p[2:]) & (p[1:-1] >= max(1.0, p.max() * share))) + 1
        gaps = np.diff(peak)
        gaps = gaps[(gaps >= low) & (gaps <= high)]
        out += [float(np.median(gaps))] if len(gaps) else []
    return out


def leads(page: np.ndarray, samples: int = S.SAMPLES) -> dict[str, np.ndarray]:
    """The waveform of each lead of a page: masked, cropped, scaled by its grid, cut into leads, freed from letters and traced.

    A lead of which hardly anything is left is traced on all ink of its block. An empty page gives zeros.
    """
    if page.size == 0 or min(page.shape[:2]) < 2:
        return {name: np.zeros(samples, np.float32) for row in S.LAYOUT for name in row}
    signal, grid = masks(page)
    left, top, right, bottom = S.crop_box(signal, grid)
    signal, grid, page = signal[top:bottom, left:right], grid[top:bottom, left:right], page[top:bottom, left:right]
    ppm = S.pixels_per_mm(signal.shape[1], spacings(grid), float((grid > 0).mean()) if grid.size else 0.0)
    every = ink(page[..., 1] if page.ndim == 3 else page)
    out = {}
    for (name, block), whole in zip(S.split_leads(signal).items(), S.split_leads_like(signal, every), strict=True):
        cut = round(block.shape[0] * EDGE)
        rows = slice(cut, max(cut + 1, block.shape[0] - cut))
        clean = S.without_vertical(S.without_text(block[rows]))
        if (clean > 0).sum() < max(4, round(clean.size * LEAST_INK)):
            clean = S.without_small(whole[rows], SMALL)
        out[name] = S.waveform(clean, ppm, samples)
    return out


def bitmap(content: bytes) -> np.ndarray:
    """The pixels of a binary PGM (P5) or PPM (P6) file with up to 255 shades: rows by columns, RGB for PPM. Others raise ValueError."""
    fields: list[bytes] = []
    at = 0
    while len(fields) < 4:
        while at < len(content) and (content[at : at + 1].isspace() or content[at : at + 1] == b"#"):
            at = content.find(b"\n", at) + 1 or len(content) if content[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        if end == at:
            break
        fields.append(content[at:end])
        at = end
    if len(fields) < 4 or fields[0] not in (b"P5", b"P6") or not all(f.isdigit() for f in fields[1:]) or not 0 < int(fields[3]) < 256:
        raise ValueError("no binary PGM or PPM file")
    w, h, colours = int(fields[1]), int(fields[2]), 3 if fields[0] == b"P6" else 1
    pixels = np.frombuffer(content, np.uint8, w * h * colours, at + 1)
    shades = int(fields[3])
    pixels = pixels if shades == 255 else (pixels.astype(np.int64) * 255 // shades).astype(np.uint8)
    return pixels.reshape((h, w) if colours == 1 else (h, w, 3))


def digitised(files: DataFrame, make: Callable[[], Callable[[bytes], np.ndarray]] | None = None, samples: int = S.SAMPLES) -> DataFrame:
    """(record, lead, samples) of scanned pages (record, content), every lead of each page once, of pages read one at a time.

    make gives a decoder of a file's bytes to pixels; without it, binary PGM and PPM files are read and others raise. Null
    contents have no rows. The contrast is evened out by the mean of a pixel's surroundings only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = make() if make else bitmap
        for b in batches:
            for record, content in zip(b["record"], b["content"], strict=True):
                if content is not None:
                    found = leads(decode(bytes(content)), samples)
                    yield pd.DataFrame({"record": record, "lead": list(found), "samples": [w.tolist() for w in found.values()]})

    return files.select("record", "content").mapInPandas(run, "record string, lead string, samples array<float>")
