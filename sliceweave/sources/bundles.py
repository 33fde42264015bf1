"""Instrument output folders as element tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.functions.scalar import decode_bytes
from sliceweave.operators.matrix import Matrix
from sliceweave.operators.overlay import valid_only
from sliceweave.operators.rings import polygons_from_vertices
from sliceweave.sources.coordinate_text import is_there, read_counts


def with_vertex_order(vertices: DataFrame) -> DataFrame:
    """Make the file order of a vertex table explicit as ``ordinal``.

    Uses the place of a row in its file, which is fixed by the file, not by the run.
    """
    return vertices.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r")).withColumn(
        "ordinal", F.struct("_f", "_r")).drop("_f", "_r")


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of a boundary table; invalid and empty ones are left out."""
    vertices = decode_bytes(with_vertex_order(spark.read.parquet(path)), "cell_id")
    shapes = polygons_from_vertices(vertices).withColumn("pid", F.col("cell_id").cast("string"))
    return valid_only(shapes).drop("pid", "first_ordinal")


def read_xenium(spark: SparkSession, folder: str, cells_boundaries: bool = True, nucleus_boundaries: bool = True,
                transcripts: bool = True, cells_as_circles: bool = False, cells_table: bool = True, counts: bool | None = None) -> dict[str, DataFrame]:
    """Elements of a Xenium output folder; each flag leaves one out.

    The count matrix, if there is one or ``counts`` asks for it, is ``counts/table/obs``, ``.../var`` and ``.../x``, from the folder ``cell_feature_matrix``; obs has the
    columns of the cell table.
    """
    out = {}
    if cells_boundaries:
        out["shapes/cell_boundaries"] = boundaries(spark, f"{folder}/cell_boundaries.parquet")
    if nucleus_boundaries:
        out["shapes/nucleus_boundaries"] = boundaries(spark, f"{folder}/nucleus_boundaries.parquet")
    if transcripts:
        out["points/transcripts"] = decode_bytes(
            spark.read.parquet(f"{folder}/transcripts.parquet"), "feature_name", "cell_id")
    if cells_as_circles or cells_table:
        cells = decode_bytes(spark.read.parquet(f"{folder}/cells.parquet"), "cell_id")
        if cells_table:
            out["tables/table"] = cells
            out |= counted(spark, f"{folder}/cell_feature_matrix", "table", cells, "cell_id", counts)
        if cells_as_circles:
            radius = F.sqrt(F.col("cell_area") / F.lit(3.141592653589793))
            out["shapes/cell_circles"] = cells.select("cell_id", F.col("x_centroid").alias("x"),
                                                      F.col("y_centroid").alias("y"), radius.alias("radius"))
    return out


def read_visium_hd(spark: SparkSession, folder: str, bin_size: str = "square_002um", bins_as_squares: bool = True,
                   spacing: float | None = None, counts: bool | None = None, raw_counts: bool = False) -> dict[str, DataFrame]:
    """Bin positions of a Visium HD output folder, as squares or as circles, and its counts.

    ``spacing`` is the bin width in full-resolution pixels; without it the smallest distance of
    neighbouring columns is used. Counts, if there or asked for, are ``counts/<bin size>/obs``, ``.../var`` and ``.../x``, from the filtered matrix
    or with ``raw_counts`` the raw one; obs has the bin positions.
    """
    place = spark.read.parquet(f"{folder}/binned_outputs/{bin_size}/spatial/tissue_positions.parquet")
    bins = place.select("barcode", "in_tissue", "array_row", "array_col", F.col("pxl_col_in_fullres").alias("x"),
                        F.col("pxl_row_in_fullres").alias("y"))
    if spacing is None:
        # distance along one array row divided by the columns between its ends
        ends = bins.groupBy("array_row").agg(F.min_by("x", "array_col").alias("a"), F.max_by("x", "array_col").alias("b"),
                                             (F.max("array_col") - F.min("array_col")).alias("n"))
        spacing = ends.filter("n > 0").agg(F.avg(F.abs(F.col("b") - F.col("a")) / F.col("n"))).first()[0] or 1.0
    half = F.lit(spacing / 2)
    square = G.rectangle(F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half)
    shape = bins.select("barcode", square.alias("geometry")) if bins_as_squares else bins.select(
        "barcode", "x", "y", half.alias("radius"))
    out = {f"shapes/{bin_size}": shape, f"tables/{bin_size}": bins}
    kind = "raw" if raw_counts else "filtered"
    return out | counted(spark, f"{folder}/binned_outputs/{bin_size}/{kind}_feature_bc_matrix", bin_size, bins, "barcode", counts)


def counted(spark: SparkSession, folder: str, name: str, rows: DataFrame, key: str, wanted: bool | None) -> dict[str, DataFrame]:
    """A count matrix as elements; barcodes that ``rows`` doesn't have keep null columns. None wants it if it is there."""
    if not wanted and (wanted is False or not is_there(spark, folder)):
        return {}
    m = read_counts(spark, folder)
    obs = m.obs.join(rows.withColumnRenamed(key, "barcode"), "barcode", "left")
    return {f"counts/{name}/obs": obs, f"counts/{name}/var": m.var, f"counts/{name}/x": m.x}


def counts_of(elements: dict[str, DataFrame], name: str) -> Matrix:
    """The count matrix among the elements, e.g. ``table`` or ``square_002um``."""
    return Matrix(*(elements[f"counts/{name}/{t}"] for t in ("obs", "var", "x")))


def name_rows(df: DataFrame, path_column: str = "path") -> DataFrame:
    """Section name of each row: the stem of the file it came from."""
    return df.withColumn("slicename", F.regexp_extract(path_column, r"([^/]+?)(\.[^./]+)?$", 1))
