"""Polygons from vertex tables, segmentation feature loading and barcodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.functions.scalar import json_scalars
from sliceweave.operators.merge import require_unique
from sliceweave.operators.position import with_position


def polygons_from_vertices(vertices: DataFrame, cell_id: str = "cell_id", ordinal: str = "ordinal",
                           x: str = "vertex_x", y: str = "vertex_y") -> DataFrame:
    """One closed polygon per id with at least three vertices, in ordinal order.

    ``first_ordinal`` records where the id first occurs, so that the source order of polygons
    can be restored. The list collected per id is the ring itself.
    """
    placed = F.struct(F.col(ordinal).alias("o"), G.vertex(F.col(x), F.col(y)).alias("v"))
    grouped = vertices.groupBy(cell_id).agg(F.array_sort(F.collect_list(placed)).alias("_l"))
    grouped = grouped.filter(F.size("_l") >= 3)
    ring = G.close_ring(F.transform("_l", lambda s: s["v"]))
    return grouped.select(cell_id, F.col("_l")[0]["o"].alias("first_ordinal"), G.polygon(ring).alias("geometry"))


def build_barcodes(features: DataFrame, position: str, id_column: str | None) -> DataFrame:
    """Add ``barcode``: the id column, or ``polygon_`` plus the six-digit position where it is missing or empty."""
    fallback = F.format_string("polygon_%06d", F.col(position))
    if id_column is None or id_column not in features.columns:
        return features.withColumn("barcode", fallback)
    text = F.col(id_column).cast("string")
    return features.withColumn("barcode", F.coalesce(F.when(text != "", text), fallback))


def with_measures(polygons: DataFrame) -> DataFrame:
    """Add area and centroid from one pass over the outline."""
    m = polygons.withColumn("_m", G.moments(F.col("geometry")))
    area = F.col("_m.area")
    return m.withColumns({"polygon_area": area, "centroid_x": F.col("_m.mx") / area, "centroid_y": F.col("_m.my") / area}).drop("_m")


def load_features(features: DataFrame, order: list[str], id_column: str | None = None, check: bool = True) -> DataFrame:
    """Segmentation polygons ready for assignment.

    Drops missing and empty geometries, numbers the rest in the stated order, turns nested
    properties into sorted JSON, and adds barcode, area and centroid. Fails when nothing is left
    or barcodes repeat.
    """
    kept = features.filter(~G.is_empty(F.col("geometry")))
    if check and kept.isEmpty():
        raise ValueError("no valid polygon features were found")
    numbered = with_position(json_scalars(kept), order, "polygon_pos")
    out = build_barcodes(numbered, "polygon_pos", id_column)
    out = with_measures(out)
    return require_unique(out, "barcode") if check else out
