"""Connected components: of any edge table, and of the set pixels of a raster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.operators.neighbourhood import TILE
from sliceweave.session import materialize

# A pixel's own label is y * 2^31 + x, so the lowest label of an island is its first pixel in raster order.
ROW = 1 << 31


def connected_components(edges: DataFrame, on: list[str], u: str = "u", v: str = "v") -> DataFrame:
    """Lowest node of each component: ``on, node, root`` for every node that has an edge to another.

    Alternates the large-star and small-star steps, which re-hang the higher (then the lower)
    neighbours of every node onto its lowest neighbour; the edges become stars in a number of
    rounds that grows with the logarithm of the graph. Each round reduces per node map-side.
    """
    hi, lo = F.greatest(u, v).alias("u"), F.least(u, v).alias("v")
    e = materialize(edges.filter(F.col(u) != F.col(v)).select(*on, hi, lo).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(*on, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(*on, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter(F.col("v") > F.col("u")).join(lowest, [*on, "u"])
        large = large.select(*on, F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large)
        low = large.groupBy(*on, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*on, "u"]).filter("v <> m").select(*on, F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select(*on, "u", F.col("m").alias("v"))).distinct())
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v", *on).cast("decimal(20,0)"))).first()
        if seen == state:
            break
        state = seen
    return e.select(*on, F.col("u").alias("node"), F.col("v").alias("root"))


def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Lowest pixel label of each 8-connected patch of one tile."""
    y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
    order = np.argsort(y * ROW + x)
    y, x = y[order], x[order]
    grid = np.full((y.max() - y.min() + 3, x.max() - x.min() + 3), -1, dtype=np.int64)
    gy, gx = y - y.min() + 1, x - x.min() + 1
    grid[gy, gx] = np.arange(len(y))
    a, b = [], []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = grid[gy + dy, gx + dx]
        a.append(np.flatnonzero(other >= 0))
        b.append(other[other >= 0])
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(y))
    while True:
        # hang the higher root below the lower one, then flatten
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return pd.DataFrame({"img": pdf["img"].iloc[0], "ch": pdf["ch"].iloc[0], "y": y, "x": x,
                         "label": y[label] * ROW + x[label]})


def label_islands(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """8-connected islands of set pixels: ``img, ch, y, x, label``.

    Tiles are labelled on their own; labels that touch across a seam form a small graph (only
    seam pixels enter it) whose components join them.
    """
    kinds = {c: mask.schema[c].dataType.simpleString() for c in ("img", "ch")}
    tiled = mask.filter(F.col("v") > 0).select(
        "img", "ch", "y", "x", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx"))
    local = materialize(tiled.groupBy("img", "ch", "ty", "tx").applyInPandas(
        _label_tile, f"img {kinds['img']}, ch {kinds['ch']}, y int, x int, label long"))
    edge = lambda c: (F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1)
    seam = local.filter(edge("y") | edge("x"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    looking = seam.withColumn("_s", F.explode(steps)).select(
        "img", "ch", F.col("label").alias("u"), F.col("y").alias("y1"), F.col("x").alias("x1"),
        (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"))
    cell = lambda c: F.floor(F.col(c) / tile)
    looking = looking.filter((cell("y") != cell("y1")) | (cell("x") != cell("x1"))).drop("y1", "x1")
    touching = looking.join(seam.withColumnRenamed("label", "v"), ["img", "ch", "y", "x"]).select("img", "ch", "u", "v")
    roots = connected_components(touching, ["img", "ch"]).withColumnRenamed("node", "label")
    out = local.join(roots, ["img", "ch", "label"], "left")
    return out.select("img", "ch", "y", "x", F.coalesce("root", "label").alias("label"))


def island_areas(labels: DataFrame) -> DataFrame:
    """Pixels, centroid and box per island; combined map-side, so a huge island stays cheap."""
    return labels.groupBy("img", "ch", "label").agg(
        F.count(F.lit(1)).alias("area"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def large_islands(labels: DataFrame, min_area: float = 1000) -> DataFrame:
    """Pixels of the islands with at least ``min_area`` pixels, as a 255 mask with labels."""
    big = labels.groupBy("img", "ch", "label").count().filter(F.col("count") >= min_area).drop("count")
    return labels.join(big, ["img", "ch", "label"], "left_semi").withColumn("v", F.lit(255).cast("long"))
