"""Joins that must not be broadcast, because what the planner estimates grows much larger in memory."""

from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.operators import grid
from sliceweave.operators import spatial_join as SJ


def _squares(spark, n):
    x = (F.col("id") % 10 * 10).cast("double")
    y = F.floor(F.col("id") / 10).cast("double") * 10
    return spark.range(n).select(F.col("id").alias("cell_id"), G.rectangle(x, y, x + 8, y + 8).alias("geometry"))


def _points(spark, n):
    return spark.range(n).select(F.col("id").alias("bin_id"), (F.col("id") % 10 * 10 + 4).cast("double").alias("x"),
                                 (F.floor(F.col("id") / 10).cast("double") * 10 + 4).alias("y"))


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_outlines_are_not_broadcast_to_points(spark):
    hits = SJ.unique_assignment(_points(spark, 50), _squares(spark, 50), "bin_id", "cell_id")
    assert _broadcasts(hits) == 0
    assert hits.filter("bin_id = cell_id").count() == hits.count() == 50


def test_outlines_are_not_broadcast_to_their_counts(spark):
    out = SJ.counts_per_polygon(_points(spark, 20), _squares(spark, 50), "cell_id", {"n": F.count(F.lit(1))})
    assert _broadcasts(out) == 0
    assert out.filter("n = 1").count() == 20 and out.count() == 50


def test_filed_boxes_are_not_broadcast(spark):
    boxes = spark.range(30).select("id", *[(F.col("id") + d).cast("double").alias(c) for c, d in (("x0", 0), ("y0", 0), ("x1", 1), ("y1", 1))])
    pairs = grid.overlapping_boxes(boxes, "id", [], ["x0", "y0", "x1", "y1"], [], [0])
    assert _broadcasts(pairs) == 0
    assert pairs.count() == 29
