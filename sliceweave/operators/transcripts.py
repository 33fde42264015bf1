"""Marker transcript points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions.scalar import MICRON_PER_PIXEL


def marker_genes(markers: DataFrame) -> DataFrame:
    """One row per gene of each named marker set (a comma list)."""
    return markers.select("name", F.explode(F.split("marker", ",")).alias("feature_name"))


def marker_points(transcripts: DataFrame, symbols: list[str], level: int = 0, carry: list[str] = ()) -> DataFrame:
    """Pixel positions of the chosen genes at one image pyramid level, y before x."""
    if not 0 <= level <= 7:
        raise ValueError("level must be 0 to 7")
    factor = F.lit(1.0 / (MICRON_PER_PIXEL * 2**level))
    kept = transcripts.filter(F.col("feature_name").isin(*symbols))
    return kept.select(
        *carry, (F.col("y_location") * factor).alias("axis-1"), (F.col("x_location") * factor).alias("axis-0")
    )


def marker_points_by_set(transcripts: DataFrame, markers: DataFrame, level: int = 0) -> DataFrame:
    """Points of every marker set at once, with the set's name; the sheet is a short table."""
    points = transcripts.join(marker_genes(markers), "feature_name")
    factor = F.lit(1.0 / (MICRON_PER_PIXEL * 2**level))
    return points.select(
        "name", (F.col("y_location") * factor).alias("axis-1"), (F.col("x_location") * factor).alias("axis-0")
    )


def xy_of_points(points: DataFrame) -> DataFrame:
    """x and y by their names, else from the second and the first column."""
    if {"x_location", "y_location"} <= set(points.columns):
        return points.select(F.col("x_location").alias("x"), F.col("y_location").alias("y"))
    return points.select(F.col(f"`{points.columns[1]}`").alias("x"), F.col(f"`{points.columns[0]}`").alias("y"))
