"""Polygons clipped to grid cells, for joins with points where one polygon is as large as the plane.

A cell that no edge meets lies inside or outside as a whole; a cell on the border holds the edges that meet it and whether
its lower left corner lies inside. So the points in a huge polygon are dealt by cell, most of them need no test, and the
others are tested against the few edges of their cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceweave.functions import geometry as G
from sliceweave.session import materialize

#: Points a cell has on average.
CELL_POINTS = 4096
#: Cells begin at an odd share of their size, so that no corner of ordinary coordinates lies on a cell's border.
OFFSET = 0.3819660112501051


def cell_size(points: DataFrame, x: str, y: str, on: list[str], per_cell: int = CELL_POINTS) -> float:
    """Side of square cells that hold ``per_cell`` points on average in the densest plane, a power of two."""
    boxes = points.groupBy(*on) if on else points.groupBy()
    seen = boxes.agg(F.count(F.lit(1)).alias("n"), ((F.max(x) - F.min(x)) * (F.max(y) - F.min(y))).alias("area")).filter("area > 0")
    density = seen.agg(F.max(F.col("n") / F.col("area"))).first()[0]
    return float(2.0 ** np.ceil(np.log2(np.sqrt(per_cell / density)))) if density else 1.0


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / size + OFFSET).cast("long")


def _edge_cells(edges: DataFrame, size: float) -> DataFrame:
    """Edges with every cell they meet: column by column, the rows between the edge's heights at the column's sides. A little
    slack may add a cell that an edge only comes near, which does no harm."""
    slack = size * 1e-7
    x1, y1, x2, y2 = (F.col(f"e.{c}") for c in ("x1", "y1", "x2", "y2"))
    columns = F.sequence(cell_of(F.least(x1, x2) - slack, size), cell_of(F.greatest(x1, x2) + slack, size))
    spread = edges.withColumn("_gx", F.explode(columns))
    side = lambda k: (F.col("_gx") + k - OFFSET) * size
    at = lambda x: y1 + (x - x1) * (y2 - y1) / F.when(x1 != x2, x2 - x1).otherwise(1.0)
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    within = lambda v: F.least(F.greatest(v, low), high)
    a, b = F.when(x1 == x2, low).otherwise(within(at(side(0)))), F.when(x1 == x2, high).otherwise(within(at(side(1))))
    steep = F.abs(y2 - y1) / F.greatest(F.abs(x2 - x1), F.lit(1e-300))
    room = slack * (1 + F.least(steep, F.lit(1e6)))
    rows = F.sequence(cell_of(F.greatest(F.least(a, b) - room, low - slack), size), cell_of(F.least(F.greatest(a, b) + room, high + slack), size))
    return spread.withColumn("_gy", F.explode(rows))


def clipped(polygons: DataFrame, size: float, on: list[str], geom: str = "geometry") -> DataFrame:
    """A row per polygon and cell it meets: the columns of ``polygons`` but its geometry, and ``_gx, _gy, _odd, _edges``.

    ``_edges`` is null for a cell that lies inside as a whole; else ``_odd`` tells whether the cell's corner lies inside.
    """
    keyed = materialize(polygons.filter(~G.is_empty(F.col(geom))).withColumn("_shape", F.monotonically_increasing_id()))
    edges = keyed.select(*on, "_shape", F.explode(G.edges(F.col(geom))).alias("e")).filter("e.x1 != e.x2 or e.y1 != e.y2")
    border = materialize(_edge_cells(edges, size).groupBy(*on, "_shape", "_gx", "_gy").agg(F.collect_list("e").alias("_edges")))
    # edges that cross the line through the corners of a row of cells; half open, so each corner of the outline counts once
    low, high = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    first, stop = F.ceil(low / size + OFFSET).cast("long") - 1, F.ceil(high / size + OFFSET).cast("long") + 1
    line = lambda g: (g.cast("double") - OFFSET) * size
    over = edges.withColumn("_gy", F.explode(F.sequence(first, stop))).filter((line(F.col("_gy")) >= low) & (line(F.col("_gy")) < high))
    crossed = over.groupBy(*on, "_shape", "_gy").agg(F.collect_list("e").alias("crossed"))
    rows = border.groupBy(*on, "_shape", "_gy").agg(F.array_sort(F.collect_list("_gx")).alias("cells")).join(crossed, [*on, "_shape", "_gy"], "left")
    fields = [polygons.schema[c] for c in on]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("_shape", "_gy", "_gx", "upto")], T.StructField("_odd", T.BooleanType())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cells = batch.column("cells")[i].values.to_numpy(zero_copy_only=False)
                gy = batch.column("_gy")[i].as_py()
                met = batch.column("crossed")[i].values if batch.column("crossed")[i].is_valid else None
                corner = lambda g: (np.asarray(g, dtype=float) - OFFSET) * size
                starts = np.concatenate([cells, cells[:-1] + 1])
                odd = np.zeros(len(starts), dtype=np.int64)
                if met is not None:
                    x1, y1, x2, y2 = (met.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2"))
                    for a in range(0, len(x1), 256):
                        part = slice(a, a + 256)
                        odd += left_of(corner(starts)[:, None], corner(gy), x1[part], y1[part], x2[part], y2[part]).sum(axis=1)
                odd = odd % 2 == 1
                # border cells, then gaps between them that lie inside
                gap = (cells[1:] > cells[:-1] + 1) & odd[len(cells):]
                gx = np.concatenate([cells, cells[:-1][gap] + 1])
                upto = np.concatenate([cells, cells[1:][gap] - 1])
                flag = pa.array(np.concatenate([odd[:len(cells)], np.ones(int(gap.sum()), dtype=bool)]), mask=np.concatenate([np.zeros(len(cells), dtype=bool), np.ones(int(gap.sum()), dtype=bool)]))
                same = pa.array(np.full(len(gx), i))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(same) for c in (*on, "_shape", "_gy")], pa.array(gx.astype(np.int64)), pa.array(upto.astype(np.int64)), flag],
                                                 names=[f.name for f in schema.fields])

    runs = materialize(rows.select(*on, "_shape", "_gy", "cells", "crossed").mapInArrow(run, schema))
    key = [*on, "_shape", "_gx", "_gy"]
    inside = runs.filter("_odd is null").withColumn("_gx", F.explode(F.sequence("_gx", "upto"))).select(*key, "_odd", F.lit(None).cast(border.schema["_edges"].dataType).alias("_edges"))
    edge = runs.filter("_odd is not null").select(*key, "_odd").join(border, key).select(*key, "_odd", "_edges")
    return inside.unionByName(edge).join(keyed.drop(geom), [*on, "_shape"]).drop("_shape")


def left_of(x, y, x1, y1, x2, y2):
    """Whether the edge lies left of the place at its height: the sign of the turn, seen from the edge's lower end."""
    turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    return np.where(y2 > y1, turn, -turn) < 0


def points_within_clipped(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", on: list[str] = (), geom: str = "geometry",
                          size: float | None = None) -> DataFrame:
    """``spatial_join.points_within`` for polygons that may hold most of the points.

    Inner join of points with the polygons that strictly hold them; ``on`` names columns that both share. A point has one
    cell, so what meets in a join key is one cell's points and the polygons there. Points without coordinates are in none.
    """
    on = list(on)
    size = cell_size(points, x, y, on) if size is None else size
    cells = clipped(polygons, size, on, geom)
    placed = points.withColumns({"_gx": cell_of(F.col(x), size), "_gy": cell_of(F.col(y), size)})
    met = placed.join(cells, [*on, "_gx", "_gy"])
    extra = [c for c in cells.columns if c not in (*on, "_gx", "_gy", "_odd", "_edges")]
    kept = [*points.columns, *extra]
    sure = met.filter("_edges is null").select(*kept)

    @F.pandas_udf("boolean")
    def holds(px, py, gx, gy, odd, edges):
        return in_cells(px, py, gx, gy, odd, edges, size)

    tested = met.filter("_edges is not null").filter(holds(F.col(x).cast("double"), F.col(y).cast("double"), "_gx", "_gy", "_odd", F.transform("_edges", lambda e: F.array(e["x1"], e["y1"], e["x2"], e["y2"]))))
    return sure.unionByName(tested.select(*kept))


def in_cells(px, py, gx, gy, odd, edges, size: float):
    """Whether points lie strictly inside, by the edges their way from the cell's corner crosses: up, then right."""
    many = edges.map(len).to_numpy()
    owner = np.repeat(np.arange(len(many)), many)
    flat = np.stack([e for row in edges for e in row]) if len(owner) else np.zeros((0, 4))
    x1, y1, x2, y2 = flat.T
    x, y = px.to_numpy()[owner], py.to_numpy()[owner]
    cx, cy = ((g.to_numpy()[owner] - OFFSET) * size for g in (gx, gy))
    turn = lambda a, b: (x2 - x1) * (b - y1) - (y2 - y1) * (a - x1)
    at, bend, corner = turn(x, y), turn(cx, y), turn(cx, cy)
    # a place on an edge's line counts as one a little above it, as the half-open heights have it
    under = lambda t: (t < 0) | ((t == 0) & (x2 < x1))
    across = (np.minimum(y1, y2) <= y) & (y < np.maximum(y1, y2)) & (under(at) != under(bend))
    along = (np.minimum(x1, x2) <= cx) & (cx < np.maximum(x1, x2)) & (under(bend) != under(corner))
    crossings = np.bincount(owner, weights=across.astype(float) + along, minlength=len(many)).astype(np.int64)
    on_edge = (at == 0) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))
    outline = np.bincount(owner, weights=on_edge, minlength=len(many)) > 0
    return pd.Series(((crossings % 2 == 1) != odd.to_numpy().astype(bool)) & ~outline)
