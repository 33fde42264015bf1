"""Raster operators that look at neighbouring pixels.

Pixels are grouped into square tiles; a pixel near a tile edge is also sent to the neighbours
whose halo holds it. A group never exceeds one tile and its halo, whatever the image size, and
an operator costs one shuffle of slightly more than the image. Absent pixels count as 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.operators.raster import image_size

TILE = 256


def tile_apply(pixels: DataFrame, halo: int, fn: Callable, schema: str, size: DataFrame | None = None,
               tile: int = TILE) -> DataFrame:
    """Run ``fn`` on every tile.

    ``fn(block, y0, x0, h, w)`` gets the values from ``y0`` and ``x0`` (tile corner less halo) on
    and the image size, and returns columns ``y, x`` (absolute) plus values, for its own tile only.
    """
    tile = max(tile, halo + 1)
    size = image_size(pixels) if size is None else size
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    sized = pixels.join(size, "img")
    spread = sized.withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x")))
    inside = (F.col("ty") >= 0) & (F.col("tx") >= 0) & (F.col("ty") * tile < F.col("h")) & (F.col("tx") * tile < F.col("w"))
    side = tile + 2 * halo

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        y0, x0 = int(head["ty"]) * tile - halo, int(head["tx"]) * tile - halo
        block = np.zeros((side, side), dtype=np.int64)
        block[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = pdf["v"].to_numpy()
        out = fn(block, y0, x0, int(head["h"]), int(head["w"]))
        out.insert(0, "img", head["img"])
        out.insert(1, "ch", head["ch"])
        return out

    keys = ["img", "ch", "ty", "tx"]
    return spread.filter(inside).select(*keys, "y", "x", "v", "h", "w").groupBy(*keys).applyInPandas(
        run, f"img {pixels.schema['img'].dataType.simpleString()}, ch {pixels.schema['ch'].dataType.simpleString()}, {schema}")


def _own(values: np.ndarray, y0: int, x0: int) -> pd.DataFrame:
    """Rows of a block of results whose first value belongs to (y0, x0)."""
    yy, xx = np.indices(values.shape)
    return pd.DataFrame({"y": (yy + y0).ravel(), "x": (xx + x0).ravel(), "v": values.ravel().astype(np.int64)})


def _own_part(block, y0, x0, h, w, halo):
    """Slices of the tile itself that lie in the image."""
    rows = slice(halo, min(block.shape[0] - halo, h - y0))
    cols = slice(halo, min(block.shape[1] - halo, w - x0))
    return rows, cols


def gaussian_weights(ksize: int) -> np.ndarray:
    """Normalised kernel whose sigma follows from its size."""
    sigma = 0.3 * ((ksize - 1) * 0.5 - 1) + 0.8
    d = np.arange(ksize) - (ksize - 1) / 2
    w = np.exp(-(d**2) / (2 * sigma**2))
    return w / w.sum()


def blur(pixels: DataFrame, ksize: int = 11, size: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Gaussian blur in double precision, borders mirrored without the edge pixel, rounded half to even."""
    halo, fn = blurred(ksize)
    return tile_apply(pixels, halo, fn, "y int, x int, v long", size, tile)


def blurred(ksize: int) -> tuple[int, Callable]:
    """Halo and block function of :func:`blur`."""
    halo, weights = ksize // 2, gaussian_weights(ksize)

    def mirror(first, count, limit):
        i = np.arange(first, first + count)
        if limit == 1:
            return np.zeros(count, dtype=int)
        i = np.abs(i) % (2 * limit - 2)
        return np.where(i >= limit, 2 * limit - 2 - i, i)

    def fn(block, y0, x0, h, w):
        rows, cols = _own_part(block, y0, x0, h, w, halo)
        nr, nc = rows.stop - rows.start, cols.stop - cols.start
        full = block[mirror(y0, nr + 2 * halo, h) - y0][:, mirror(x0, nc + 2 * halo, w) - x0].astype(float)
        down = sum(weights[k] * full[k:k + nr] for k in range(ksize))
        both = sum(weights[k] * down[:, k:k + nc] for k in range(ksize))
        return _own(np.rint(both), y0 + halo, x0 + halo)

    return halo, fn


def _slide(block: np.ndarray, ksize: int, pick) -> np.ndarray:
    """Extremum over a square window; the result is ``ksize - 1`` smaller per side."""
    view = np.lib.stride_tricks.sliding_window_view
    return pick(view(pick(view(block, ksize, axis=0), axis=-1), ksize, axis=1), axis=-1)


def dilate(pixels: DataFrame, ksize: int, size: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Highest value under a square of ones, centred at ``ksize // 2``; outside the image counts as nothing."""
    halo, fn = dilated(ksize)
    return tile_apply(pixels, halo, fn, "y int, x int, v long", size, tile)


def dilated(ksize: int) -> tuple[int, Callable]:
    """Halo and block function of :func:`dilate`."""
    before, after = ksize // 2, ksize - 1 - ksize // 2

    def fn(block, y0, x0, h, w):
        rows, cols = _own_part(block, y0, x0, h, w, before)
        part = block[rows.start - before:rows.stop + after, cols.start - before:cols.stop + after]
        return _own(_slide(part, ksize, np.max), y0 + before, x0 + before)

    return before, fn


def close(pixels: DataFrame, ksize: int, size: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Dilation and then erosion under a square of ones, both within one tile visit."""
    halo, fn = closed(ksize)
    return tile_apply(pixels, halo, fn, "y int, x int, v long", size, tile)


def closed(ksize: int) -> tuple[int, Callable]:
    """Halo and block function of :func:`close`."""
    before, after = ksize // 2, ksize - 1 - ksize // 2
    halo = 2 * before

    def fn(block, y0, x0, h, w):
        rows, cols = _own_part(block, y0, x0, h, w, halo)
        part = block[rows.start - halo:rows.stop + 2 * after, cols.start - halo:cols.stop + 2 * after]
        grown = _slide(part, ksize, np.max)
        # pixels outside the image must not pull the erosion down
        gy = np.arange(grown.shape[0]) + y0 + before
        gx = np.arange(grown.shape[1]) + x0 + before
        outside = ((gy < 0) | (gy >= h))[:, None] | ((gx < 0) | (gx >= w))[None, :]
        shrunk = _slide(np.where(outside, np.iinfo(np.int64).max, grown), ksize, np.min)
        return _own(shrunk, y0 + halo, x0 + halo)

    return halo, fn


def border_codes(mask: DataFrame, size: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Set pixels with an unset 8-neighbour, with a bit per set neighbour (east first, then anticlockwise)."""

    def fn(block, y0, x0, h, w):
        rows, cols = _own_part(block, y0, x0, h, w, 1)
        on = block > 0
        code = np.zeros(block.shape, dtype=np.int64)
        for bit, (dy, dx) in enumerate(STEPS):
            code |= np.roll(on, (-dy, -dx), axis=(0, 1)).astype(np.int64) << bit
        own = _own(np.where(on, code, -1)[rows, cols], y0 + 1, x0 + 1)
        return own[(own["v"] >= 0) & (own["v"] < 255)].reset_index(drop=True)

    return tile_apply(mask, 1, fn, "y int, x int, v long", size, tile).withColumnRenamed("v", "code")


# Neighbour offsets (row, column) from east, anticlockwise on screen.
STEPS = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]
