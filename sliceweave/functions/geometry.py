"""Column expressions over planar geometry.

A polygonal geometry is ``STRUCT<kind STRING, parts ARRAY<ARRAY<ARRAY<STRUCT<x,y,z>>>>>``:
part -> ring -> vertex, where ring 0 of a part is the shell and the others are holes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERTEX = T.StructType(
    [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType())]
)
RING = T.ArrayType(VERTEX)
PARTS = T.ArrayType(T.ArrayType(RING))
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", PARTS)])


def vertex(x: Column, y: Column, z: Column | None = None) -> Column:
    return F.struct(
        x.cast("double").alias("x"),
        y.cast("double").alias("y"),
        (F.lit(None) if z is None else z).cast("double").alias("z"),
    )


def polygon(ring: Column) -> Column:
    """Geometry of one hole-free polygon from a closed ring."""
    return F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(ring)).alias("parts"))


def geometry(parts: Column) -> Column:
    kind = F.when(F.size(parts) > 1, F.lit("MultiPolygon")).otherwise(F.lit("Polygon"))
    return F.struct(kind.alias("kind"), parts.alias("parts"))


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return polygon(F.array(*[vertex(x, y) for x, y in corners]))


def close_ring(ring: Column) -> Column:
    """Repeat the first vertex at the end unless it is there already."""
    first, last = F.get(ring, F.lit(0)), F.try_element_at(ring, F.lit(-1))
    same = (first["x"] == last["x"]) & (first["y"] == last["y"])
    return F.when(same, ring).otherwise(F.concat(ring, F.array(first)))


def map_vertices(geom: Column, fn) -> Column:
    parts = F.transform(geom["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, fn)))
    return F.struct(geom["kind"].alias("kind"), parts.alias("parts"))


def scale(geom: Column, sx: float, sy: float | None = None) -> Column:
    """Scale about the origin."""
    sy = sx if sy is None else sy
    return map_vertices(geom, lambda v: vertex(v["x"] * F.lit(float(sx)), v["y"] * F.lit(float(sy)), v["z"]))


def set_z(geom: Column, z: Column) -> Column:
    return map_vertices(geom, lambda v: vertex(v["x"], v["y"], z))


def rings(geom: Column) -> Column:
    return F.flatten(geom["parts"])


def ring_edges(ring: Column) -> Column:
    """Edges of a closed ring, in vertex order."""
    return F.zip_with(
        F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))),
        F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def edges(geom: Column) -> Column:
    return F.flatten(F.transform(rings(geom), ring_edges))


def ring_moments(ring: Column) -> Column:
    """Twice the signed area and the two first moments (times six), by the shoelace sum.

    Coordinates are taken relative to the first vertex so that far-away rings keep precision.
    """
    first = F.get(ring, F.lit(0))
    ox, oy = first["x"], first["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc, e):
        x1, y1, x2, y2 = e["x1"] - ox, e["y1"] - oy, e["x2"] - ox, e["y2"] - oy
        cross = x1 * y2 - x2 * y1
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (x1 + x2) * cross).alias("mx"),
            (acc["my"] + (y1 + y2) * cross).alias("my"),
        )

    return F.aggregate(
        ring_edges(ring),
        zero,
        step,
        lambda s: F.struct(
            (s["a"] / 2).alias("area"),
            (s["mx"] / 6 + ox * (s["a"] / 2)).alias("mx"),
            (s["my"] / 6 + oy * (s["a"] / 2)).alias("my"),
        ),
    )


def moments(geom: Column) -> Column:
    """Area and first moments of the whole geometry; holes subtract whatever their direction."""
    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add_part(acc, part):
        signed = F.transform(
            part,
            lambda ring, i: F.struct(
                ring_moments(ring).alias("m"), F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("s")
            ),
        )
        return F.aggregate(
            signed,
            acc,
            lambda a, r: F.struct(
                (a["area"] + F.abs(r["m"]["area"]) * r["s"]).alias("area"),
                (a["mx"] + r["m"]["mx"] * F.signum(r["m"]["area"]) * r["s"]).alias("mx"),
                (a["my"] + r["m"]["my"] * F.signum(r["m"]["area"]) * r["s"]).alias("my"),
            ),
        )

    return F.aggregate(geom["parts"], zero, add_part)


def area(geom: Column) -> Column:
    return moments(geom)["area"]


def centroid(geom: Column) -> Column:
    m = moments(geom)
    return F.struct((m["mx"] / m["area"]).alias("x"), (m["my"] / m["area"]).alias("y"))


def bounds(geom: Column) -> Column:
    xs = F.transform(F.flatten(rings(geom)), lambda v: v["x"])
    ys = F.transform(F.flatten(rings(geom)), lambda v: v["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def is_empty(geom: Column) -> Column:
    return geom.isNull() | (F.size(rings(geom)) <= 0) | (F.size(F.flatten(rings(geom))) <= 0)


def banded_edges(geom: Column) -> Column:
    """Edges cut up for point tests: ``struct<y0, h, bands array<array<double>>>``.

    The box is sliced into about 2 sqrt(n) horizontal bands; each holds the edges that reach it
    as flat x1, y1, x2, y2 runs. A test then looks at one band instead of the whole outline.
    """
    all_edges = edges(geom)

    def build(es):
        lows = F.transform(es, lambda e: F.least(e["y1"], e["y2"]))
        highs = F.transform(es, lambda e: F.greatest(e["y1"], e["y2"]))
        return F.struct(es.alias("es"), F.array_min(lows).alias("y0"), F.array_max(highs).alias("y1"),
                        F.ceil(F.sqrt(F.size(es)) * 2).cast("int").alias("n"))

    def fill(b):
        h = (b["y1"] - b["y0"]) / b["n"]
        # one band of slack each side absorbs the rounding of the band index
        reach = lambda i: F.filter(b["es"], lambda e: (F.least(e["y1"], e["y2"]) <= b["y0"] + h * (i + 1.001))
                                   & (F.greatest(e["y1"], e["y2"]) >= b["y0"] + h * (i - 0.001)))
        flat = lambda i: F.flatten(F.transform(reach(i), lambda e: F.array(e["x1"], e["y1"], e["x2"], e["y2"])))
        return F.struct(b["y0"].alias("y0"), h.alias("h"),
                        F.transform(F.sequence(F.lit(0), b["n"] - 1), flat).alias("bands"))

    # one-element arrays bind the intermediate result once
    return F.transform(F.array(build(all_edges)), fill)[0]


def band_at(banded: Column, py: Column) -> Column:
    """The band a height falls in; heights must lie within the box."""
    last = F.size(banded["bands"]) - 1
    i = F.when(banded["h"] > 0, F.floor((py - banded["y0"]) / banded["h"])).otherwise(F.lit(0))
    return banded["bands"][F.greatest(F.least(i.cast("int"), last), F.lit(0))]


@F.arrow_udf(T.ByteType())
def location(band: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
    """1 strictly inside, 0 on the boundary, -1 outside, by even-odd ray casting.

    Tests a whole Arrow batch at once: the edges of all rows form one flat array, and each row
    sums its own stretch.
    """
    offsets = np.asarray(band.offsets)
    e = np.asarray(band.values)[offsets[0]:offsets[-1]].reshape(-1, 4)
    n = np.diff(offsets) // 4
    x = np.repeat(px.to_numpy(zero_copy_only=False), n)
    y = np.repeat(py.to_numpy(zero_copy_only=False), n)
    x1, y1, x2, y2 = e.T
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    up, down = (y1 <= y) & (y2 > y) & (cross > 0), (y1 > y) & (y2 <= y) & (cross < 0)
    on = ((cross == 0) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2))
          & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2)))
    row = np.repeat(np.arange(len(n)), n)
    odd = np.bincount(row[up | down], minlength=len(n)) % 2 == 1
    touching = np.bincount(row[on], minlength=len(n)) > 0
    return pa.array(np.where(touching, 0, np.where(odd, 1, -1)).astype(np.int8))


def proper_crossing(p1, p2, q1, q2, eps: float = 1e-9) -> Column:
    """Segments cross at an interior point of both; touching and collinear do not count.

    Each argument is an ``(x, y)`` pair of columns.
    """

    def turn(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def opposite(s, t):
        return ((s > eps) & (t < -eps)) | ((s < -eps) & (t > eps))

    return opposite(turn(q1, q2, p1), turn(q1, q2, p2)) & opposite(turn(p1, p2, q1), turn(p1, p2, q2))
