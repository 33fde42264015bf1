"""Point-in-polygon joins and what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.operators import grid
from sliceweave.operators.clipping import points_within_clipped

_BOX = ["_xmin", "_ymin", "_xmax", "_ymax"]


def filed_polygons(polygons: DataFrame, geom: str = "geometry") -> DataFrame:
    """Polygons with their banded edges and box, one row per grid cell of their own level."""
    shaped = polygons.filter(~G.is_empty(F.col(geom))).withColumn("_box", G.bounds(F.col(geom)))
    shaped = shaped.withColumns({c: F.col(f"_box.{c[1:]}") for c in _BOX})
    shaped = shaped.withColumn("_edges", G.banded_edges(F.col(geom))).drop("_box", geom)
    return grid.file_boxes(shaped, _BOX)


def polygon_levels(polygons: DataFrame, geom: str = "geometry") -> list[int]:
    box = G.bounds(F.col(geom))
    extent = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    return grid.occurring_levels(polygons.filter(~G.is_empty(F.col(geom))).select(grid.level_of(extent).alias("l")), "l")


def candidate_pairs(points: DataFrame, polygons: DataFrame, x: str, y: str, on: list[str], geom: str,
                    levels: list[int] | None = None) -> DataFrame:
    """Points joined to the polygons whose box holds them, with the polygon's edges at the point's height."""
    levels = polygon_levels(polygons, geom) if levels is None else levels
    if not levels:
        levels = [0]
    probes = grid.probe_points(points, F.col(x), F.col(y), levels)
    # edges are many times what the planner takes them for, so they must not be broadcast on its estimate
    joined = probes.join(filed_polygons(polygons, geom).hint("merge"), [*on, "_level", "_gx", "_gy"])
    boxed = joined.filter(
        (F.col(x) >= F.col("_xmin")) & (F.col(x) <= F.col("_xmax"))
        & (F.col(y) >= F.col("_ymin")) & (F.col(y) <= F.col("_ymax"))
    )
    band = G.band_at(F.col("_edges"), F.col(y))
    return boxed.withColumn("_edges", band).drop("_level", "_gx", "_gy", *_BOX)


def points_within(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", on: list[str] = (),
                  geom: str = "geometry", levels: list[int] | None = None) -> DataFrame:
    """Inner join of points with the polygons that strictly hold them.

    ``on`` names columns both tables share (such as a section); other names must differ. A point
    has one cell per level and a polygon one level, so no pair arises twice.
    """
    pairs = candidate_pairs(points, polygons, x, y, list(on), geom, levels)
    return pairs.filter(G.location("_edges", x, y) == 1).drop("_edges")


def distinct_shapes(polygons: DataFrame, on: list[str], polygon_id: str, geom: str) -> DataFrame:
    """One row per geometry with its lowest id and the number of copies.

    Copies would multiply the candidates of every point on them; a join needs each geometry once.
    """
    return polygons.filter(~G.is_empty(F.col(geom))).groupBy(*on, geom).agg(
        F.min(polygon_id).alias(polygon_id), F.count(F.lit(1)).alias("_copies"))


def unique_assignment(points: DataFrame, polygons: DataFrame, point_id: str, polygon_id: str, **join) -> DataFrame:
    """(point, polygon) for the points strictly within exactly one polygon."""
    on, geom = list(join.get("on", ())), join.get("geom", "geometry")
    x, y = join.get("x", "x"), join.get("y", "y")
    shapes = distinct_shapes(polygons, on, polygon_id, geom)
    hits = points_within(points.select(*on, point_id, x, y), shapes, **join)
    counted = hits.groupBy(*on, point_id).agg(F.sum("_copies").alias("_n"), F.min(polygon_id).alias(polygon_id))
    return counted.filter("_n = 1").drop("_n")


def assignment_report(points: DataFrame, assigned: DataFrame, hits: DataFrame, point_id: str) -> DataFrame:
    """One row: points in all, assigned, in several polygons, and in none."""
    multi = hits.groupBy(point_id).count().agg(F.sum((F.col("count") > 1).cast("long")).alias("ambiguous"))
    total = points.agg(F.count(F.lit(1)).alias("points"))
    done = assigned.agg(F.count(F.lit(1)).alias("assigned"))
    # three one-row tables side by side
    one = [t.withColumn("_k", F.lit(1)) for t in (total, done, multi)]
    joined = one[0].join(one[1], "_k").join(one[2], "_k").drop("_k")
    joined = joined.withColumn("ambiguous", F.coalesce("ambiguous", F.lit(0)).cast("long"))
    return joined.withColumn("outside", F.col("points") - F.col("assigned") - F.col("ambiguous"))


def label_points(points: DataFrame, masks: DataFrame, point_id: str, x: str, y: str, on: list[str],
                 label: str = "tglabel", order: str = "mask_order", unassigned: str = "Unassigned",
                 micron_per_pixel: float = 0.2125) -> DataFrame:
    """Label each point by the last mask of its section that holds it.

    Mask rows carry ``on`` columns, the label, their order and a pixel geometry; point
    coordinates are in micron. Points in no mask, and those of sections without masks, stay
    ``unassigned``.
    """
    factor = F.lit(1.0 / micron_per_pixel)
    scaled = points.select(*on, point_id, (F.col(x) * factor).alias("_px"), (F.col(y) * factor).alias("_py"))
    # of masks with one outline only the last can win
    latest = masks.groupBy(*on, "geometry").agg(F.max_by(label, order).alias(label), F.max(order).alias(order))
    # a mask may hold most points of its section, so it is met cell by cell
    hits = points_within_clipped(scaled, latest, "_px", "_py", on)
    last = hits.groupBy(*on, point_id).agg(F.max_by(label, F.col(order)).alias(label))
    out = points.join(last, [*on, point_id], "left")
    return out.withColumn(label, F.coalesce(F.col(label), F.lit(unassigned)))


def counts_per_polygon(points: DataFrame, polygons: DataFrame, polygon_id: str, counts: dict, **join) -> DataFrame:
    """Polygons with aggregates over the points strictly inside, null where there are none.

    ``counts`` maps a column name to an aggregate over point columns. Points are combined
    map-side per geometry; copies of a geometry take the same values afterwards.
    """
    on, geom = list(join.get("on", ())), join.get("geom", "geometry")
    shapes = distinct_shapes(polygons.select(*on, geom, F.col(polygon_id).alias("_shape")), on, "_shape", geom)
    hits = points_within(points, shapes.drop("_copies"), **join)
    per_shape = hits.groupBy(*on, "_shape").agg(*[agg.alias(name) for name, agg in counts.items()])
    # outlines are too large to be broadcast on the planner's estimate
    found = shapes.hint("merge").join(per_shape, [*on, "_shape"]).select(*on, geom, *counts)
    return polygons.join(found.hint("merge"), [*on, geom], "left").select(*polygons.columns, *counts)


def transcript_ratio(polygons: DataFrame, nonneuron: DataFrame, neuron: DataFrame, polygon_id: str,
                     ratio: float = 0.1, strict: bool = False, keep_all: bool = False, **join) -> DataFrame:
    """Keep polygons whose share of non-neuron marker points is at least ``ratio``.

    By default an empty count stands as one, because the counts come from left joins that keep
    one row for a polygon without hits. ``strict`` counts zero as zero and gives a polygon
    without any point the ratio 10, so that it leaves no hole. ``keep_all`` returns every
    polygon with the two counts and the ratio.
    """
    on = list(join.get("on", ()))
    # one spatial join serves both point sets
    marked = nonneuron.withColumn("_m", F.lit(0)).unionByName(neuron.withColumn("_m", F.lit(1)))
    x, y = join.get("x", "x"), join.get("y", "y")
    counts = {"nonneuron_count": F.sum((F.col("_m") == 0).cast("long")), "neuron_count": F.sum((F.col("_m") == 1).cast("long"))}
    counted = counts_per_polygon(marked.select(*on, x, y, "_m"), polygons, polygon_id, counts, **join)
    floor = 0 if strict else 1
    out = counted.withColumns(
        {c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(floor)).cast("long") for c in counts})
    total = F.col("nonneuron_count") + F.col("neuron_count")
    out = out.withColumn("ratio", F.when(total > 0, F.col("nonneuron_count") / total).otherwise(F.lit(10.0)))
    if keep_all:
        return out
    return out.filter(F.col("ratio") >= F.lit(float(ratio))).drop("nonneuron_count", "neuron_count", "ratio")
