"""Raster tables on disk: pixels packed into tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACK = 256


def to_tiles(pixels: DataFrame, tile: int = PACK) -> DataFrame:
    """One row per tile: ``img, ch, ty, tx, px`` with the set pixels as (offset, value) in offset order.

    A tile holds at most ``tile`` squared pixels, which bounds every group.
    """
    at = (F.col("y") % tile) * tile + F.col("x") % tile
    return pixels.groupBy("img", "ch", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")).agg(
        F.array_sort(F.collect_list(F.struct(at.cast("int").alias("at"), F.col("v").alias("v")))).alias("px"))


def from_tiles(tiles: DataFrame, tile: int = PACK) -> DataFrame:
    spread = tiles.select("img", "ch", "ty", "tx", F.explode("px").alias("p"))
    y = F.col("ty") * tile + F.floor(F.col("p.at") / tile)
    x = F.col("tx") * tile + F.col("p.at") % tile
    return spread.select("img", "ch", y.cast("int").alias("y"), x.cast("int").alias("x"), F.col("p.v").alias("v"))
