"""Side labels, warped shapes and the stacked 3D table.

Sides and sections are columns, so that one job covers all of them. The non-rigid warp itself
comes from an outside registration: as a displacement field, or as shapes that are warped already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.functions.scalar import MICRON_PER_PIXEL, PIXEL_PER_MICRON
from sliceweave.operators.matrix import Matrix, attach_metadata, subset_labels
from sliceweave.operators.merge import merge, point_columns, section_z
from sliceweave.operators.spatial_join import label_points
from sliceweave.operators.warp import warp_by_field


def label_sides(cells: DataFrame, masks: DataFrame) -> DataFrame:
    """Cells (``sampleid, cell_id, x, y`` in micron) with ``tglabel`` from the side masks of their section."""
    return label_points(cells, masks, "cell_id", "x", "y", ["sampleid"], "tglabel", micron_per_pixel=MICRON_PER_PIXEL)


def shapes_of_sides(shapes: DataFrame, labelled: DataFrame, field: DataFrame | None = None, spacing: float = 1.0) -> DataFrame:
    """Shapes of the labelled cells in micron, warped per section: ``sampleid, cell_id, tglabel, final_annot, geometry``."""
    pixel = shapes.withColumn("geometry", G.scale(F.col("geometry"), PIXEL_PER_MICRON))
    chosen = labelled.filter(F.col("tglabel") != "Unassigned").select("sampleid", "cell_id", "tglabel", "final_annot")
    side = pixel.join(chosen, ["sampleid", "cell_id"])
    if field is not None:
        side = warp_by_field(side, field, ["cell_id"], spacing, ["sampleid"])
    return side.withColumn("geometry", G.scale(F.col("geometry"), MICRON_PER_PIXEL))


def stack_sections(shapes: DataFrame, sections: DataFrame, start: float = 0.0, step: float = 12.0,
                   neighborhood: DataFrame | None = None) -> DataFrame:
    """3D table of one or more sides: depth per section in sheet order, optional neighbourhood label.

    ``sections`` holds ``tglabel, sampleid, pos``; depth counts only the sections that have shapes.
    """
    present = sections.join(shapes.select("tglabel", "sampleid").distinct(), ["tglabel", "sampleid"], "left_semi")
    depth = section_z(present, "pos", start, step, ["tglabel"])
    out = shapes.join(depth.select("tglabel", "sampleid", "warp_z"), ["tglabel", "sampleid"])
    out = out.withColumn("geometry", G.set_z(F.col("geometry"), F.col("warp_z"))).drop("warp_z")
    out = out.withColumnRenamed("sampleid", "slicename")
    if neighborhood is None:
        return out
    return merge(out, neighborhood, ["slicename", "cell_id"], ["sampleid", "cell_id"], "left", ["neighborhood"],
                 fill="all", na="Unassigned").drop("sampleid")


def coordinates_table(points: DataFrame) -> DataFrame:
    """Point geometries as ``warp_x, warp_y, warp_z`` columns."""
    return point_columns(points, "warp_")


def attach_coordinates(m: Matrix, coordinates: DataFrame) -> Matrix:
    """Matrix rows that have warped coordinates, with them."""
    order = [F.col("warp_z"), F.col("warp_x"), F.col("warp_y")]
    return attach_metadata(m, coordinates, ["sampleid", "cell_id"], ["slicename", "cell_id"], "inner",
                           ["warp_x", "warp_y", "warp_z"], order)


def neurons_only(m: Matrix, neuron_types: list[str], label: str = "final_annot") -> Matrix:
    return subset_labels(m, label, neuron_types)
