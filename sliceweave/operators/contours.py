"""Outer contours of mask islands as polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.operators.components import ROW
from sliceweave.operators.neighbourhood import STEPS, TILE, border_codes
from sliceweave.operators.spatial_join import points_within


@F.pandas_udf(G.RING)
def trace(borders: pd.Series) -> pd.Series:
    """Closed ring of the turning points of each island's outer border, from its border pixels (flat y, x, code runs)."""
    return pd.Series([_walk(np.asarray(b).reshape(-1, 3)) for b in borders])


def _walk(border: np.ndarray) -> list:
    code = {(y, x): c for y, x, c in border.tolist()}
    start = min(code)
    ring = []
    if code[start]:
        # the last step of the walk comes from the first set neighbour clockwise of west
        back = next(d % 8 for d in range(11, 3, -1) if code[start] >> (d % 8) & 1)
        pixel, came, first = start, back, None
        incoming = (back + 4) % 8
        while True:
            out = next(d % 8 for d in range(came + 1, came + 9) if code[pixel] >> (d % 8) & 1)
            if (pixel, out) == first:
                break
            first = first or (pixel, out)
            if out != incoming:
                ring.append({"x": float(pixel[1]), "y": float(pixel[0]), "z": None})
            pixel = (pixel[0] + STEPS[out][0], pixel[1] + STEPS[out][1])
            came, incoming = (out + 4) % 8, out
    return [*ring, ring[0]] if ring else ring


def outer_contours(islands: DataFrame, size: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """One polygon per island through its outer border pixels: ``img, ch, label, geometry``.

    ``islands`` holds ``img, ch, y, x, v, label``. Only border pixels are gathered per island, and
    they become that island's one geometry value. Islands in a hole of another are left out, and
    so are islands whose border encloses no area.
    """
    border = border_codes(islands.select("img", "ch", "y", "x", "v"), size, tile)
    labelled = border.join(islands.select("img", "ch", "y", "x", "label"), ["img", "ch", "y", "x"])
    # one row per island before its border is walked: that row is as large as its polygon
    rows = labelled.groupBy("img", "ch", "label").agg(
        F.flatten(F.collect_list(F.array(F.col("y").cast("long"), F.col("x").cast("long"), "code"))).alias("_b"))
    traced = rows.select("img", "ch", "label", trace("_b").alias("_ring")).filter(F.size("_ring") >= 4)
    shapes = traced.select("img", "ch", "label", G.polygon(F.col("_ring")).alias("geometry"))
    starts = shapes.select("img", "ch", F.col("label").alias("inner"), (F.col("label") % ROW).cast("double").alias("px"),
                           F.floor(F.col("label") / ROW).cast("double").alias("py"))
    nested = points_within(starts, shapes.select("img", "ch", "geometry"), "px", "py", ["img", "ch"])
    nested = nested.select("img", "ch", F.col("inner").alias("label"))
    return shapes.join(nested, ["img", "ch", "label"], "left_anti")
