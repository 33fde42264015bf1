"""Moving geometries by a given displacement field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G


def affine(df: DataFrame, a: float, b: float, c: float, d: float, e: float, f: float) -> DataFrame:
    """x' = a x + b y + c, y' = d x + e y + f, on the geometry column."""
    return df.withColumn("geometry", G.map_vertices(F.col("geometry"), lambda v: G.vertex(
        v["x"] * a + v["y"] * b + c, v["x"] * d + v["y"] * e + f, v["z"])))


def warp_by_field(features: DataFrame, field: DataFrame, key: list[str], spacing: float, on: list[str] = ()) -> DataFrame:
    """Shift every vertex by a displacement field, interpolated between its grid nodes.

    ``field`` holds ``on, gx, gy, dx, dy`` with one node every ``spacing``; ``key`` names the
    columns that identify a feature. The field comes from an outside registration. Vertices meet
    their four nodes through equi-joins; a vertex beyond the field keeps its place, and so does a
    feature without a geometry.
    """
    on = list(on)
    ids = list(dict.fromkeys([*on, *key]))
    parts = features.select(*ids, F.posexplode("geometry.parts").alias("p", "part"))
    rings = parts.select(*ids, "p", F.posexplode("part").alias("r", "ring"))
    flat = rings.select(*ids, "p", "r", F.posexplode("ring").alias("i", "v"))
    fx, fy = F.col("v.x") / spacing, F.col("v.y") / spacing
    placed = flat.withColumns({"gx": F.floor(fx), "gy": F.floor(fy)})
    placed = placed.withColumns({"tx": fx - F.col("gx"), "ty": fy - F.col("gy")})
    # each node offers itself to the four grid squares it is a corner of
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    nodes = field.withColumn("c", corner).select(
        *on, (F.col("gx") - F.col("c.i")).alias("gx"), (F.col("gy") - F.col("c.j")).alias("gy"),
        F.struct((F.col("c.i") * 2 + F.col("c.j")).alias("k"), "dx", "dy").alias("n"))
    square = nodes.groupBy(*on, "gx", "gy").agg(F.array_sort(F.collect_list("n")).alias("n")).filter(F.size("n") == 4)
    joined = placed.join(square, [*on, "gx", "gy"], "left")
    tx, ty = F.col("tx"), F.col("ty")
    weights = ((1 - tx) * (1 - ty), (1 - tx) * ty, tx * (1 - ty), tx * ty)
    shift = lambda d: F.coalesce(sum(w * F.col("n")[k][d] for k, w in enumerate(weights)), F.lit(0.0))
    moved = joined.withColumn("v", G.vertex(F.col("v.x") + shift("dx"), F.col("v.y") + shift("dy"), F.col("v.z")))
    seq = lambda k, v: F.transform(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), F.col(v).alias("v")))), lambda s: s["v"])
    ringed = moved.groupBy(*ids, "p", "r").agg(seq("i", "v").alias("ring"))
    parted = ringed.groupBy(*ids, "p").agg(seq("r", "ring").alias("part"))
    whole = parted.groupBy(*ids).agg(seq("p", "part").alias("_parts"))
    out = features.join(whole, ids, "left")
    moved = F.struct(F.col("geometry.kind").alias("kind"), F.col("_parts").alias("parts"))
    return out.withColumn("geometry", F.when(F.col("_parts").isNotNull(), moved).otherwise(F.col("geometry"))).drop("_parts")
