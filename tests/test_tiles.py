"""Dense tiles against plain numpy: packing, pixel algebra, masks by raster and by scan lines, halos."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceweave.functions import geometry as G
from sliceweave.operators import neighbourhood as NB
from sliceweave.operators import raster as RA
from sliceweave.operators import tiles as TI


def image(spark, h, w, channels=2, share=1.0, seed=1, img="a"):
    rng = random.Random(seed)
    rows = [(img, c, y, x, rng.randrange(1000)) for c in range(channels) for y in range(h) for x in range(w) if rng.random() < share or (y, x) == (h - 1, w - 1)]
    return spark.createDataFrame(rows, "img string, ch int, y int, x int, v long").repartition(5)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("tile,share", [(7, 1.0), (16, 0.4), (64, 0.02)])
def test_tiles_hold_the_pixels(spark, tile, share):
    px = image(spark, 33, 20, share=share).unionByName(image(spark, 5, 9, 1, share, 2, "b"))
    tiles = TI.to_tiles(px, tile=tile)
    assert rows(TI.from_tiles(tiles, tile)) == rows(px)
    for r in tiles.collect():
        assert len(r["v"]) == min(tile, r["h"] - r["ty"] * tile) * min(tile, r["w"] - r["tx"] * tile)
    doubled = TI.map_values(tiles, lambda v, ch: v * 2 + ch)
    assert rows(TI.from_tiles(doubled, tile)) == sorted((i, c, y, x, 2 * v + c) for i, c, y, x, v in rows(px))
    assert TI.from_tiles(TI.to_tiles(px.filter("false"), tile=tile), tile).count() == 0


def test_masks_by_raster(spark):
    px, mask = image(spark, 30, 25), image(spark, 30, 25, 2, 0.5, 9)
    for limit, inverted in ((500, False), (127, True), (-1, False)):
        got = TI.mask_by_raster(TI.to_tiles(px, tile=8), TI.to_tiles(mask, tile=8), limit, inverted)
        assert rows(TI.from_tiles(got, 8)) == rows(RA.mask_by_raster(px, mask, limit, inverted))
    nothing = TI.mask_by_raster(TI.to_tiles(px, tile=8), TI.to_tiles(mask.filter("false"), tile=8))
    assert {r["v"] for r in TI.from_tiles(nothing, 8).collect()} == {0}


def polygons(spark, shapes, img="a"):
    made = [(img, ("Polygon", [[[(float(x), float(y), None) for x, y in (*ring, ring[0])] for ring in part] for part in parts])) for parts in shapes]
    return spark.createDataFrame(made, T.StructType([T.StructField("img", T.StringType()), T.StructField("geometry", G.GEOMETRY)]))


def random_shapes(seed, size):
    """Stars, boxes on pixel centres, needles, holes, parts, one larger than the image."""
    rng = random.Random(seed)
    out = []
    for i in range(25):
        cx, cy, n = rng.uniform(0, size), rng.uniform(0, size), rng.randrange(3, 12)
        ring = []
        for k in range(n):
            r, a = rng.uniform(1, size / 4), 2 * np.pi * (k + rng.random() * 0.7) / n
            ring.append((cx + r * np.cos(a), cy + r * np.sin(a)))
        if i % 3 == 0:
            ring = [(round(2 * x) / 2, round(2 * y) / 2) for x, y in ring]
        out.append([[ring]])
    out.append([[[(3.5, 3.5), (15.5, 3.5), (15.5, 12.5), (9.5, 6.5), (3.5, 12.5)], [(5.5, 4.5), (7.5, 4.5), (7.5, 5.5)]], [[(20, 20), (20.5, 30.5), (29.5, 20.5)]]])
    out.append([[[(2.0, 31.5), (30.0, 31.5), (30.0, 31.9), (2.0, 31.9)]]])
    return out


@pytest.mark.parametrize("tile", [8, 64])
def test_scan_lines_match_the_point_test(spark, tile):
    px = image(spark, 40, 37, 1)
    for i, shape in enumerate([*random_shapes(4, 40)[::3], *random_shapes(5, 40)[-2:]]):
        shapes = polygons(spark, [shape])
        want = {(r["y"], r["x"]) for r in RA.mask_by_polygon(px.withColumn("v", F.lit(1)), shapes).filter("v = 1").collect()}
        got = {(r["y"], x) for r in TI.polygon_runs(shapes, tile=tile).collect() for x in range(r["x0"], r["x1"]) if 0 <= r["y"] < 40 and 0 <= x < 37}
        assert got == want, i


def test_masks_by_polygons(spark):
    px = image(spark, 40, 37, 2, 0.9)
    shapes = polygons(spark, [*random_shapes(6, 40)[-8:], [[[(-50, -50), (200, -60), (30, 18)]]]]).unionByName(polygons(spark, random_shapes(7, 40)[:3], "other"))
    for inverted, white in ((False, False), (True, False), (False, True)):
        got = TI.mask_by_polygon(TI.to_tiles(px, tile=9), shapes, inverted, white, tile=9)
        assert rows(TI.from_tiles(got, 9)) == rows(RA.mask_by_polygon(px, shapes, inverted, white))
    assert {r["v"] for r in TI.from_tiles(TI.mask_by_polygon(TI.to_tiles(px, tile=9), shapes.filter("false"), tile=9), 9).collect()} == {0}


def test_a_huge_outline_is_spread(spark):
    """Ten thousand edges over 4,000 lines: bands hold a share of the edges each, and runs have the outline's area."""
    n, r = 10_000, 2000.0
    ring = [(2000 + r * np.cos(2 * np.pi * k / n), 2000 + r * np.sin(2 * np.pi * k / n)) for k in range(n)]
    runs = TI.polygon_runs(polygons(spark, [[[ring]]])).groupBy(F.floor(F.col("y") / 256).alias("band")).agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).collect()
    assert len(runs) == 16 and abs(sum(r["n"] for r in runs) / (np.pi * r * r) - 1) < 1e-3


def test_neighbourhoods(spark):
    px = image(spark, 29, 31, 2, 0.8).unionByName(image(spark, 4, 3, 1, 1.0, 3, "b"))
    binary = px.withColumn("v", F.when(F.col("v") > 900, 255).otherwise(0).cast("long"))
    for tile in (8, 40):
        t, b = TI.to_tiles(px, tile=tile), TI.to_tiles(binary, tile=tile)
        assert rows(TI.from_tiles(TI.blur(t, 5, tile), tile)) == rows(NB.blur(px, 5))
        assert rows(TI.from_tiles(TI.dilate(b, 5, tile), tile)) == rows(NB.dilate(binary, 5))
        assert rows(TI.from_tiles(TI.close(b, 4, tile), tile)) == rows(NB.close(binary, 4))
    with pytest.raises(ValueError):
        TI.blur(t, 101, 8)


def test_blend_and_scale(spark):
    px = image(spark, 20, 22, 4, 0.7)
    tiles = TI.to_tiles(px, tile=8)
    for inverted in (False, True):
        assert rows(TI.rgb_pixels(TI.blend_rgb(tiles, inverted), 8)) == rows(RA.blend_rgb(px, inverted))
    assert rows(TI.from_tiles(TI.to_8bit(tiles), 8)) == rows(RA.to_8bit(px))


def test_no_pixels_are_shuffled(spark):
    """After packing, tiles and runs are dealt by tile, never pixels by place."""
    from sliceweave.session import materialize

    tiles = materialize(TI.to_tiles(image(spark, 40, 40, 2), tile=16))
    shapes = polygons(spark, random_shapes(8, 40)[:2])
    for df in (TI.mask_by_raster(tiles, tiles), TI.blend_rgb(tiles), TI.mask_by_polygon(tiles, shapes, tile=16), TI.blur(TI.to_8bit(tiles), 5, 16)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys = [set(re.findall(r"\b([a-z_]\w*)#", args)) for args in re.findall(r"Exchange hashpartitioning\((.*?)\), ", plan)]
        assert keys and not any({"x", "y"} & k and "x0" not in k for k in keys) and "posexplode" not in plan
