"""Point joins, ratio filter, overlay and warp."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceweave.functions import geometry as G
from sliceweave.operators import clipping as CL
from sliceweave.operators import overlay as OV
from sliceweave.operators import spatial_join as SJ
from sliceweave.operators.warp import affine, warp_by_field


def shapes(spark, items):
    """Items: (pid, [part, ...]) with part = [ring, ...] and ring = [(x, y), ...] not closed."""
    data = [(p, ("Polygon" if len(parts) == 1 else "MultiPolygon",
                 [[[(float(x), float(y), None) for x, y in [*r, r[0]]] for r in part] for part in parts])) for p, parts in items]
    schema = T.StructType([T.StructField("pid", T.StringType()), T.StructField("geometry", G.GEOMETRY)])
    return spark.createDataFrame(data, schema)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def pts(spark, items):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(items)], "id int, x double, y double")


def inside(spark, points, polys):
    return sorted((r["id"], r["pid"]) for r in SJ.points_within(pts(spark, points), polys).collect())


def test_boundary_is_outside(spark):
    assert inside(spark, [(0.5, 0.5), (0, 0.5), (1, 1), (2, 2)], shapes(spark, [("u", [[box(0, 0, 1, 1)]])])) == [(0, "u")]


def test_hole(spark):
    assert inside(spark, [(2, 2), (0.5, 2)], shapes(spark, [("h", [[box(0, 0, 4, 4), box(1, 1, 3, 3)]])])) == [(1, "h")]


def even_odd(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def star(rng, cx, cy, r, n):
    angles = sorted(rng.uniform(0, 2 * np.pi) for _ in range(n))
    return [(cx + r * rng.uniform(0.3, 1) * np.cos(a), cy + r * rng.uniform(0.3, 1) * np.sin(a)) for a in angles]


def test_points_within_matches_brute_force(spark):
    rng = random.Random(1)
    # sizes from tiny to one that covers everything, negative coordinates included
    polys = [(f"p{i}", star(rng, rng.uniform(-50, 50), rng.uniform(-50, 50), r, rng.choice([3, 5, 40])))
             for i, r in enumerate([0.01, 0.5, 1, 3, 3, 7, 20, 100] * 4)]
    points = [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(400)]
    want = sorted((i, p) for i, (x, y) in enumerate(points) for p, ring in polys if even_odd(ring, x, y))
    assert inside(spark, points, shapes(spark, [(p, [[ring]]) for p, ring in polys])) == want


def test_two_masks(spark):
    two = shapes(spark, [("a", [[box(0, 0, 2, 2)]]), ("b", [[box(1, 1, 3, 3)]])])
    got = SJ.unique_assignment(pts(spark, [(0.5, 0.5), (1.5, 1.5), (9, 9)]), two, "id", "pid").collect()
    assert [(r["id"], r["pid"]) for r in got] == [(0, "a")]
    masks = two.withColumns({"tglabel": F.upper("pid"), "mask_order": F.ascii("pid"), "s": F.lit("x")}).drop("pid")
    cells = pts(spark, [(1.5, 1.5), (0.5, 0.5), (9, 9)]).withColumn("s", F.lit("x")).union(
        pts(spark, [(0.5, 0.5)]).select(F.lit(7).alias("id"), "x", "y", F.lit("other").alias("s")))
    out = SJ.label_points(cells, masks, "id", "x", "y", ["s"], micron_per_pixel=1.0).collect()
    assert {r["id"]: r["tglabel"] for r in out} == {0: "B", 1: "A", 2: "Unassigned", 7: "Unassigned"}


@pytest.mark.parametrize("n,m,ratio,kept", [(0, 0, 0.5, True), (0, 9, 0.1, True), (0, 10, 1 / 11, False), (3, 1, 0.75, True)])
def test_transcript_ratio(spark, n, m, ratio, kept):
    poly = shapes(spark, [("u", [[box(0, 0, 1, 1)]])])
    a, b = pts(spark, [(0.5, 0.5)] * n + [(5, 5)]).select("x", "y"), pts(spark, [(0.25, 0.5)] * m + [(5, 5)]).select("x", "y")
    full = SJ.transcript_ratio(poly, a, b, "pid", keep_all=True).first()
    assert full["ratio"] == pytest.approx(ratio)
    assert (SJ.transcript_ratio(poly, a, b, "pid").count() == 1) == kept
    if n == m == 0:
        assert SJ.transcript_ratio(poly, a, b, "pid", strict=True, keep_all=True).first()["ratio"] == 10.0


def parts_area(df):
    out = {}
    for r in df.select("pid", G.area(F.col("geometry")).alias("a")).collect():
        out.setdefault(r["pid"], []).append(round(r["a"], 6))
    return {k: sorted(v) for k, v in out.items()}


def test_harmonise_cases(spark):
    a = shapes(spark, [("within", [[box(1, 1, 2, 2)]]), ("holds", [[box(10, 0, 14, 4)]]), ("part", [[box(20, 0, 24, 4)]]),
                       ("split", [[box(30, 0, 36, 2)]]), ("alone", [[box(50, 0, 52, 2)]]), ("same", [[box(60, 0, 62, 2)]]),
                       ("edge", [[box(70, 0, 72, 2)]]), ("two", [[box(80, 0, 90, 2)]])])
    b = shapes(spark, [("1", [[box(0, 0, 4, 4)]]), ("2", [[box(11, 1, 12, 2)]]), ("3", [[box(23, 0, 26, 4)]]),
                       ("4", [[box(32, -1, 34, 3)]]), ("5", [[box(60, 0, 62, 2)]]), ("6", [[box(72, 0, 74, 2)]]),
                       ("7", [[box(79, -1, 83, 1)]]), ("8", [[box(82, -1, 85, 1)]]), ("9", [[box(85, -1, 87, 1)]])])
    got = parts_area(OV.harmonise(a, b))
    assert got == {"holds": [16.0], "part": [12.0], "split": [4.0, 4.0], "alone": [4.0], "edge": [4.0], "two": [13.0]}


def test_difference_makes_holes_and_corners(spark):
    a = shapes(spark, [("hole", [[box(0, 0, 10, 10)]]), ("corner", [[box(20, 0, 24, 4)]]), ("multi", [[box(40, 0, 44, 4)], [box(46, 0, 50, 4)]])])
    b = shapes(spark, [("1", [[box(2, 2, 4, 4)]]), ("2", [[box(4, 4, 6, 6)]]), ("3", [[box(20, 0, 22, 2)]]), ("4", [[box(22, 2, 24, 4)]]),
                       ("5", [[box(43, 1, 47, 3)]])])
    out = OV.difference_exploded(a, b)
    got = parts_area(out)
    assert got == {"hole": [92.0], "corner": [4.0, 4.0], "multi": [14.0, 14.0]}
    holed = out.filter("pid = 'hole'").select(F.size(F.col("geometry.parts")[0]).alias("n")).first()["n"]
    assert holed == 3
    assert OV.invalid_polygons(out.withColumn("pid", F.concat("pid", "part"))).count() == 0


def test_difference_area_matches_sampling(spark):
    rng = random.Random(4)
    a = [(f"a{i}", star(rng, rng.uniform(0, 20), rng.uniform(0, 20), 6, 7)) for i in range(6)]
    b = [(f"b{i}", star(rng, rng.uniform(0, 20), rng.uniform(0, 20), 5, 7)) for i in range(10)]
    got = {k: sum(v) for k, v in parts_area(OV.difference_exploded(shapes(spark, [(p, [[r]]) for p, r in a]), shapes(spark, [(p, [[r]]) for p, r in b]))).items()}
    g = (np.arange(400) + 0.5) * 0.08 - 6
    xx, yy = np.meshgrid(g, g)

    def mask(ring):
        odd = np.zeros(xx.shape, bool)
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            hit = (y1 > yy) != (y2 > yy)
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= hit & (xx < (x2 - x1) * (yy - y1) / (y2 - y1) + x1)
        return odd

    union = np.any([mask(r) for _, r in b], axis=0)
    for p, ring in a:
        assert got.get(p, 0.0) == pytest.approx((mask(ring) & ~union).sum() * 0.08**2, abs=0.6)


def test_invalid_polygons(spark):
    items = [("ok", [[box(0, 0, 2, 2)]]), ("bow", [[[(0, 0), (2, 2), (2, 0), (0, 2)]]]), ("flat", [[[(0, 0), (1, 1), (2, 2)]]]),
             ("spike", [[[(0, 0), (4, 0), (4, 4), (4, 6), (4, 4), (0, 4)]]]), ("touch", [[[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)]]]),
             ("holed", [[box(0, 0, 4, 4), box(1, 1, 2, 2)]]), ("crossed", [[box(0, 0, 4, 4), box(3, 3, 5, 5)]])]
    bad = {r["pid"] for r in OV.invalid_polygons(shapes(spark, items)).collect()}
    assert bad == {"bow", "flat", "spike", "touch", "crossed"}


def test_warp(spark):
    poly = shapes(spark, [("u", [[box(0, 0, 4, 4), box(1, 1, 2, 2)], [box(5, 5, 6, 6)]])])
    assert affine(poly, 1, 0, 0, 0, 1, 0).collect() == poly.collect()
    nodes = spark.createDataFrame([(i, j, 0.5 * i, 1.0) for i in range(5) for j in range(5)], "gx int, gy int, dx double, dy double")
    out = warp_by_field(poly, nodes, ["pid"], 2.0)
    v = [(p["x"], p["y"]) for part in out.first()["geometry"]["parts"] for ring in part for p in ring]
    w = [(p["x"], p["y"]) for part in poly.first()["geometry"]["parts"] for ring in part for p in ring]
    assert v == [(x + 0.25 * x, y + 1) for x, y in w]


def test_copies_of_a_shape(spark):
    many = shapes(spark, [(f"c{i}", [[box(0, 0, 2, 2)]]) for i in range(50)] + [("d", [[box(4, 0, 6, 2)]])])
    cells = pts(spark, [(1, 1), (5, 1)])
    assert [(r["id"], r["pid"]) for r in SJ.unique_assignment(cells, many, "id", "pid").collect()] == [(1, "d")]
    counts = SJ.counts_per_polygon(cells, many, "pid", {"n": F.count(F.lit(1))}).collect()
    assert len(counts) == 51 and {r["n"] for r in counts} == {1}
    neuron = shapes(spark, [("n", [[box(1, 0, 3, 2)]]), ("i", [[box(0.5, 0.5, 1, 1)]])])
    assert parts_area(OV.harmonise(neuron, many)) == {"n": [2.0]}
    assert OV.polygons_within(neuron, many).count() == 50


def test_nesting_of_rings(spark):
    """Faults of rings that don't cross, in both orders of the rings' corners, and valid neighbours of each."""
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    shell = box(0, 0, 10, 10)
    diamond = [(10, 5), (5, 8), (0, 5), (5, 2)]
    kinds = {
        "one": ([[shell]], True), "hole": ([[shell, box(1, 1, 2, 2), box(3, 3, 4, 4)]], True), "hole outside": ([[shell, box(11, 1, 12, 2)]], False),
        "hole around": ([[box(2, 2, 3, 3), shell]], False), "hole in hole": ([[shell, box(1, 1, 9, 9), box(2, 2, 3, 3)]], False),
        "hole touches once": ([[shell, [(0, 5), (2, 4), (2, 6)]]], True), "hole touches twice": ([[shell, diamond]], False),
        "holes touch once": ([[shell, box(1, 1, 3, 3), box(3, 3, 5, 5)]], True), "hole outside touches": ([[shell, [(10, 5), (12, 4), (12, 6)]]], False),
        "ring of holes": ([[shell, [(2, 5), (5, 2), (3, 5)], [(5, 2), (8, 5), (5, 3)], [(8, 5), (5, 8), (7, 5)], [(5, 8), (2, 5), (5, 7)]]], False),
        "chain of holes": ([[shell, [(2, 5), (5, 2), (3, 5)], [(5, 2), (8, 5), (5, 3)], [(8, 5), (5, 8), (7, 5)]]], True),
        "chain to the shell": ([[shell, [(0, 5), (3, 4), (3, 6)], [(3, 4), (6, 1), (6, 3)], [(6, 3), (10, 5), (7, 6)]]], False),
        "part in part": ([[shell], [box(1, 1, 2, 2)]], False), "part around part": ([[box(1, 1, 2, 2)], [shell]], False),
        "part in hole": ([[shell, box(1, 1, 9, 9)], [box(2, 2, 3, 3)]], True), "part fills hole": ([[shell, box(1, 1, 9, 9)], [box(1, 1, 9, 9)]], False),
        "part touches hole": ([[shell, box(1, 1, 9, 9)], [[(1, 5), (3, 4), (3, 6)]]], True), "part in part touches": ([[shell], [[(0, 5), (2, 4), (2, 6)]]], False),
        "parts touch": ([[shell], [box(10, 10, 12, 12)]], True), "parts touch twice": ([[shell], [[(10, 2), (14, 5), (10, 8), (12, 5)]]], True),
        "parts overlap at corners": ([[[(0, 0), (4, 0), (4, 4), (0, 4)]], [[(4, 0), (4, 4), (0, 0)]]], False), "parts cross in corners": ([[diamond], [[(5, 8), (5, 2), (20, 5)]]], False),
        "parts share an edge": ([[shell], [box(10, 2, 12, 8)]], False), "same part twice": ([[shell], [shell]], False), "hole is the shell": ([[shell, shell]], False),
    }
    rows = []
    for name, (parts, _) in kinds.items():
        for turned in (False, True):
            closed = [[[*ring, ring[0]] for ring in part] for part in parts]
            closed = [[ring[::-1] if turned else ring for ring in part] for part in closed]
            rows.append((f"{name}/{turned}", ("MultiPolygon", [[[(float(x), float(y), None) for x, y in ring] for ring in part] for part in closed])))
    polygons = spark.createDataFrame(rows, T.StructType([T.StructField("pid", T.StringType()), T.StructField("geometry", G.GEOMETRY)])).repartition(3)
    got = {r["pid"] for r in OV.valid_only(polygons).select("pid").collect()}
    assert got == {f"{name}/{turned}" for name, (_, fine) in kinds.items() if fine for turned in (False, True)}


def spiky(rng, cx, cy, reach, n):
    at = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = rng.uniform(0.2, 1, n) * reach
    return [(float(cx + r * np.cos(t)), float(cy + r * np.sin(t))) for r, t in zip(far, at)]


@pytest.mark.parametrize("size", [0.5, 4.0, 64.0, None])
def test_clipped_polygons_hold_the_same_points(spark, size):
    """Stars, holes, parts, needles and outlines along grid lines, with points on corners, edges and cell borders."""
    rng = np.random.default_rng(11)
    shapes = [[[spiky(rng, *rng.uniform(0, 40, 2), rng.uniform(1, 30), int(rng.integers(3, 40)))]] for _ in range(12)]
    shapes += [[[[(0, 0), (40, 0), (40, 40), (0, 40)], [(10, 10), (20, 10), (20, 30), (10, 30)]], [[(12, 12), (18, 12), (15, 20)]]], [[[(1, 1), (39, 1.001), (39, 1.002)]]],
               [[[(5, 5), (5, 35), (6, 35), (6, 5)]]], [[[(-500, -500), (600, -480), (20, 900)]]], [[[(100, 100), (101, 100), (101, 101)]]]]
    rows = [(f"p{i}", "s", ("Polygon", [[[(float(x), float(y), None) for x, y in (*ring, ring[0])] for ring in part] for part in parts])) for i, parts in enumerate(shapes)]
    polygons = spark.createDataFrame(rows, T.StructType([T.StructField("name", T.StringType()), T.StructField("sec", T.StringType()), T.StructField("geometry", G.GEOMETRY)]))
    places = [(float(x), float(y)) for x, y in rng.uniform(-5, 45, (400, 2))] + [(x / 2, y / 2) for x in range(0, 82, 3) for y in range(0, 82, 3)]
    places += [c for parts in shapes for part in parts for ring in part for c in ring]
    if size:
        places += [((k - 0.3819660112501051) * size, y) for k in range(3) for y in (1.0, 12.0, 20.0)]
    points = spark.createDataFrame([(i, "s" if i % 9 else "other", *map(float, p)) for i, p in enumerate(places)] + [(-1, "s", None, 1.0)], "id long, sec string, px double, py double").repartition(3)
    got = CL.points_within_clipped(points, polygons, "px", "py", ["sec"], size=size)
    want = SJ.points_within(points, polygons, "px", "py", ["sec"])
    key = lambda df: sorted((r["id"], r["name"]) for r in df.select("id", "name").collect())
    assert key(got) == key(want) and len(key(want)) > 500
    assert CL.points_within_clipped(points.filter("false"), polygons, "px", "py", ["sec"]).count() == 0
    assert CL.points_within_clipped(points, polygons.filter("false"), "px", "py", ["sec"], size=size).count() == 0


def test_a_mask_as_large_as_its_section_is_spread(spark):
    """One outline round all points: its cells are many keys, of which few hold edges, and few edges each."""
    rng = np.random.default_rng(12)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1000, (40_000, 2)))], "id long, x double, y double")
    ring = [(500 + 495 * np.cos(2 * np.pi * k / 5000), 500 + 495 * np.sin(2 * np.pi * k / 5000)) for k in range(5000)]
    mask = spark.createDataFrame([("m", ("Polygon", [[[(float(x), float(y), None) for x, y in (*ring, ring[0])]]]))], T.StructType([T.StructField("name", T.StringType()), T.StructField("geometry", G.GEOMETRY)]))
    size = CL.cell_size(points, "x", "y", [], 64)
    cells = CL.clipped(mask, size, []).select("_gx", "_gy", F.coalesce(F.size("_edges"), F.lit(0)).alias("n")).collect()
    assert len(cells) > 150 and len({(r["_gx"], r["_gy"]) for r in cells}) == len(cells)
    assert sum(r["n"] == 0 for r in cells) > 0.6 * len(cells) and max(r["n"] for r in cells) < 250
    hits = CL.points_within_clipped(points, mask, size=size)
    per_cell = hits.groupBy(CL.cell_of(F.col("x"), size), CL.cell_of(F.col("y"), size)).count().agg(F.max("count")).first()[0]
    assert per_cell < 400 and hits.count() == SJ.points_within(points, mask).count()
