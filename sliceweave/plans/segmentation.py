"""Segmentation: channel clean-up, island mask, marker-ratio filter, neuron/non-neuron polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sliceweave.operators import raster as RA
from sliceweave.operators.components import label_islands, large_islands
from sliceweave.operators.contours import outer_contours
from sliceweave.operators.neighbourhood import TILE, blur, close, dilate
from sliceweave.session import materialize


def island_mask(pixels: DataFrame, kernel: int = 11, grow: int = 5, min_area: float = 1000, ksize: int = 11,
                tile: int = TILE, eight_bit: bool = False):
    """Mask of the bright islands of one channel and the outer contours of the grown mask.

    8-bit scaling, Gaussian blur, Otsu threshold, closing, islands of at least ``min_area``
    pixels, growth by dilation. Returns ``(mask, contours)``.
    """
    size = materialize(RA.image_size(pixels))
    scaled = pixels if eight_bit else RA.to_8bit(pixels)
    smooth = materialize(blur(scaled, ksize, size, tile))
    binary = RA.binarise(smooth, RA.otsu(smooth))
    islands = large_islands(label_islands(close(binary, kernel, size, tile), tile), min_area)
    grown = dilate(islands.select("img", "ch", "y", "x", "v"), grow, size, tile)
    mask = materialize(grown.filter("v > 0"))
    labelled = label_islands(mask, tile).join(mask, ["img", "ch", "y", "x"])
    return mask, outer_contours(materialize(labelled), size, tile)
