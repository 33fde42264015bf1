"""Bins to cells: vertex table -> polygons -> unique assignment -> group sum -> count filter -> labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.operators.matrix import Matrix, attach_metadata, filter_by_counts, group_sum
from sliceweave.operators.rings import load_features, polygons_from_vertices, with_measures
from sliceweave.operators.spatial_join import unique_assignment
from sliceweave.session import materialize


def cell_polygons(vertices: DataFrame, factor: float, order: list[str] | None = None) -> DataFrame:
    """Cell polygons in pixels with barcode, area and centroid."""
    polygons = polygons_from_vertices(vertices)
    scaled = polygons.withColumn("geometry", G.scale(F.col("geometry"), factor))
    if order is None:
        # ids are known to be there, so no position is needed for a fallback name
        return with_measures(scaled.withColumn("barcode", F.col("cell_id").cast("string")))
    return load_features(scaled, order, "cell_id")


def aggregate_bins(bins: DataFrame, x: DataFrame, var: DataFrame, polygons: DataFrame, bin_key: str, var_key: str,
                   value: str, on: list[str] = ()) -> Matrix:
    """Cell-by-gene matrix: counts of the bins strictly within exactly one polygon.

    Every polygon stays in obs, with the number of bins assigned to it.
    """
    # the assignment feeds both the bin counts and the group sum, and the sums feed every later
    # filter: each is stored once rather than derived again per use
    assigned = materialize(unique_assignment(bins, polygons, bin_key, "barcode", on=list(on)))
    per_cell = assigned.groupBy("barcode").agg(F.count(F.lit(1)).alias("num_assigned_bins"))
    obs = polygons.drop("geometry").join(per_cell, "barcode", "left")
    obs = obs.withColumn("num_assigned_bins", F.coalesce("num_assigned_bins", F.lit(0)).cast("long"))
    summed = materialize(group_sum(x, assigned, bin_key, "barcode", var_key, value))
    return Matrix(obs, var, summed, "barcode", var_key, value)


def bins_to_cells(vertices: DataFrame, bins: DataFrame, x: DataFrame, var: DataFrame, metadata: DataFrame | None,
                  metadata_key: str, bin_key: str, var_key: str, value: str, factor: float, min_count: float = 1,
                  keep: bool = True) -> Matrix:
    """The whole chain; without metadata the last merge is left out."""
    polygons = materialize(cell_polygons(vertices, factor))
    m = aggregate_bins(bins, x, var, polygons, bin_key, var_key, value)
    m = filter_by_counts(m, min_count, keep)
    if metadata is None:
        return m
    return attach_metadata(m, metadata, ["_index_"], [metadata_key])
