"""Raster operators against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.operators import components as CO
from sliceweave.operators import neighbourhood as NB
from sliceweave.operators import raster as RA
from sliceweave.operators.contours import outer_contours
from sliceweave.plans.segmentation import island_mask
from sliceweave.sources.rasters import from_tiles, to_tiles


def table(spark, image, img="i"):
    image = np.asarray(image)
    image = image[None] if image.ndim == 2 else image
    rows = [(img, c, y, x, int(v)) for c, plane in enumerate(image) for y, line in enumerate(plane) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "img string, ch int, y int, x int, v long")


def array(df, shape, ch=0):
    out = np.zeros(shape, dtype=np.int64)
    for r in df.filter(F.col("ch") == ch).collect():
        out[r["y"], r["x"]] = r["v"]
    return out


def test_threshold_edges(spark):
    px = table(spark, [[200, 199]])
    assert array(RA.threshold(px, [200]), (1, 2)).tolist() == [[200, 0]]
    assert array(RA.threshold(px, [199], invert=True), (1, 2)).tolist() == [[65535, 199]]
    mask = table(spark, [[127, 128]]).drop("ch")
    assert array(RA.mask_by_raster(px, mask), (1, 2)).tolist() == [[0, 199]]
    assert array(RA.mask_by_raster(px, mask, inverted=True), (1, 2)).tolist() == [[200, 0]]


def test_stack_checks_shape(spark):
    a, b = table(spark, [[1, 2]]).drop("ch"), table(spark, [[1, 2], [3, 4]]).drop("ch")
    assert RA.stack_channels([a, a]).count() == 4
    with pytest.raises(ValueError, match="differ in shape"):
        RA.stack_channels([a, b])


def test_flip_and_rotate(spark):
    image = np.arange(6).reshape(2, 3)
    px = table(spark, image)
    assert (array(RA.flip(px, "horizon"), (2, 3)) == np.fliplr(image)).all()
    assert (array(RA.flip(px, "vertical"), (2, 3)) == np.flipud(image)).all()
    for k in (1, 2, 3):
        want = np.rot90(image, k)
        assert (array(RA.rotate90(px, k), want.shape) == want).all()


@pytest.mark.parametrize("kw", [{}, {"min_intensity": 3}, {"log": True}, {"scale": True}])
def test_histogram_matches_numpy(spark, kw):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 1000, (20, 20))
    v = image.ravel()
    if kw.get("min_intensity"):
        v = v[v > 3]
    if kw.get("scale"):
        v = (v * 1.0 / v.max() * 255).astype(np.uint8)
    if kw.get("log"):
        v = np.log10(v + 1e-6)
    want = np.histogram(v, bins=37)[0]
    got = np.zeros(37, dtype=int)
    for r in RA.intensity_histogram(table(spark, image), breaks=37, **kw).collect():
        got[r["bin"]] = r["n"]
    assert got.tolist() == want.tolist()
    flat = RA.intensity_histogram(table(spark, [[5, 5]]), breaks=10).first()
    assert (flat["bin"], flat["n"]) == (5, 2)


def test_histogram_last_bin(spark):
    rows = {r["bin"]: r["n"] for r in RA.intensity_histogram(table(spark, [list(range(11))]), breaks=10).collect()}
    assert rows[9] == 2 and sum(rows.values()) == 11


def test_blend(spark):
    px = table(spark, [[[0, 60000]], [[60000, 0]]])
    get = lambda inv: [(r["r"], r["g"], r["b"]) for r in RA.blend_rgb(px, inv).orderBy("x").collect()]
    assert get(False) == [(255, 255, 0), (0, 255, 255)]
    assert get(True) == [(0, 0, 255), (255, 0, 0)]
    rng = np.random.default_rng(3)
    image = rng.integers(0, 60000, (4, 6, 7))
    total = np.zeros((6, 7, 3), dtype=np.float32)
    for c, plane in enumerate(image):
        p = plane.astype(np.float32)
        total += ((p - p.min()) / (p.max() - p.min() + 1e-8))[..., None] * RA.CHANNEL_COLOURS[c]
    want = (np.clip(total, 0, 1) * 255).round().astype(int)
    got = np.zeros_like(want)
    for r in RA.blend_rgb(table(spark, image)).collect():
        got[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    assert (got == want).all()


def padded(image, k, fill):
    b, a = k // 2, k - 1 - k // 2
    return np.pad(image.astype(float), ((b, a), (b, a)), constant_values=fill)


def slide(image, k, pick, fill):
    view = np.lib.stride_tricks.sliding_window_view(padded(image, k, fill), (k, k))
    return pick(view, axis=(2, 3)).astype(np.int64)


@pytest.mark.parametrize("k,tile", [(3, 4), (5, 8), (4, 5), (11, 64)])
def test_morphology_matches_numpy(spark, k, tile):
    rng = np.random.default_rng(k)
    image = np.where(rng.random((17, 23)) < 0.08, 255, 0)
    px = table(spark, image).filter("v > 0 or (y = 16 and x = 22)")
    size = RA.image_size(px)
    grown = slide(image, k, np.max, -np.inf)
    assert (array(NB.dilate(px, k, size, tile), image.shape) == grown).all()
    assert (array(NB.close(px, k, size, tile), image.shape) == slide(grown, k, np.min, np.inf)).all()


@pytest.mark.parametrize("tile", [6, 9, 64])
def test_blur_matches_numpy(spark, tile):
    rng = np.random.default_rng(8)
    image = rng.integers(0, 256, (19, 14))
    w = NB.gaussian_weights(11)
    assert w.sum() == pytest.approx(1) and w[5] / w[3] == pytest.approx(np.exp(0.5))
    p = np.pad(image.astype(float), 5, mode="reflect")
    want = sum(w[i] * w[j] * p[i:i + 19, j:j + 14] for i in range(11) for j in range(11))
    assert np.abs(array(NB.blur(table(spark, image), 11, tile=tile), image.shape) - want).max() <= 0.5 + 1e-9


def test_otsu_matches_exhaustive_search(spark):
    rng = np.random.default_rng(6)
    image = np.concatenate([rng.integers(0, 90, 200), rng.integers(140, 256, 100)]).reshape(15, 20)
    best, arg = -1, 0
    for t in range(256):
        lo, hi = image[image <= t], image[image > t]
        if len(lo) and len(hi):
            s = len(lo) * len(hi) * (lo.mean() - hi.mean()) ** 2
            if s > best * (1 + 1e-12):
                best, arg = s, t
    px = table(spark, image)
    t = RA.otsu(px)
    assert t.first()["t"] == arg
    assert (array(RA.binarise(px, t), image.shape) == np.where(image > arg, 255, 0)).all()


def flood(mask):
    label, seen = np.full(mask.shape, -1, dtype=np.int64), np.zeros(mask.shape, bool)
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            stack, first = [(y, x)], y * CO.ROW + x
            seen[y, x] = True
            while stack:
                cy, cx = stack.pop()
                label[cy, cx] = first
                for ny in range(max(cy - 1, 0), min(cy + 2, mask.shape[0])):
                    for nx in range(max(cx - 1, 0), min(cx + 2, mask.shape[1])):
                        if mask[ny, nx] and not seen[ny, nx]:
                            seen[ny, nx] = True
                            stack.append((ny, nx))
    return label


@pytest.mark.parametrize("tile,density", [(3, 0.4), (7, 0.3), (64, 0.45)])
def test_components_match_flood_fill(spark, tile, density):
    image = np.where(np.random.default_rng(tile).random((30, 25)) < density, 255, 0)
    labels = CO.label_islands(table(spark, image), tile)
    got = np.full(image.shape, -1, dtype=np.int64)
    for r in labels.collect():
        got[r["y"], r["x"]] = r["label"]
    want = flood(image > 0)
    assert (got == want).all()
    sizes = {k: int((want == k).sum()) for k in np.unique(want) if k >= 0}
    kept = CO.large_islands(labels, 5)
    assert kept.count() == sum(n for n in sizes.values() if n >= 5)
    assert {r["label"]: r["area"] for r in CO.island_areas(labels).collect()} == sizes


def test_component_chain(spark):
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(200)] + [("h", 5, 9), ("h", 9, 7)], "k string, u long, v long")
    got = {(r["k"], r["node"]): r["root"] for r in CO.connected_components(edges, ["k"]).collect()}
    assert got == {**{("g", i): 0 for i in range(1, 201)}, ("h", 9): 5, ("h", 7): 5}


def contours_of(spark, image, tile=64):
    px = table(spark, image)
    islands = CO.label_islands(px, tile).join(px, ["img", "ch", "y", "x"])
    out = outer_contours(islands, RA.image_size(px), tile).collect()
    return {r["label"]: [(v["x"], v["y"]) for v in r["geometry"]["parts"][0][0]] for r in out}


def test_contours(spark):
    image = np.zeros((12, 14), dtype=int)
    image[1:5, 2:7] = 255  # a block
    image[7:12, 0:6] = 255
    image[8:11, 1:5] = 0  # with a hole
    image[9, 2:4] = 255  # and a line in the hole
    image[0, 10] = 255  # one pixel encloses nothing
    got = contours_of(spark, image, tile=5)
    assert set(got) == {1 * CO.ROW + 2, 7 * CO.ROW}
    assert sorted(set(got[CO.ROW + 2])) == [(2.0, 1.0), (2.0, 4.0), (6.0, 1.0), (6.0, 4.0)]
    assert sorted(set(got[7 * CO.ROW])) == [(0.0, 7.0), (0.0, 11.0), (5.0, 7.0), (5.0, 11.0)]
    nested = np.zeros((9, 9), dtype=int)
    nested[[0, 8], :] = nested[:, [0, 8]] = 255
    nested[3:6, 3:6] = 255
    assert set(contours_of(spark, nested)) == {0}


def test_contour_of_a_concave_island(spark):
    image = np.zeros((6, 7), dtype=int)
    image[1:5, 1:6] = 255
    image[1:3, 3] = 0
    ring = contours_of(spark, image)[CO.ROW + 1]
    assert ring[0] == ring[-1]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2
    # outline through pixel centres: the 4 x 3 block less the notch
    assert area == 12 - 3


def test_island_mask_finds_the_blobs(spark):
    yy, xx = np.mgrid[0:80, 0:100]
    image = np.full((80, 100), 100)
    for cy, cx, r in ((20, 25, 12), (55, 70, 15)):
        image[(yy - cy) ** 2 + (xx - cx) ** 2 <= r * r] = 4000
    image[3:6, 90:93] = 4000  # too small
    mask, contours = island_mask(table(spark, image), kernel=5, grow=3, min_area=300, tile=32)
    rows = contours.select(G.area(F.col("geometry")).alias("a")).collect()
    assert len(rows) == 2
    got = array(mask, image.shape)
    assert got[20, 25] == got[55, 70] == 255 and got[4, 91] == 0


def test_mask_by_polygon(spark):
    px = table(spark, np.full((4, 4), 9))
    poly = spark.range(1).select(F.lit("i").alias("img"), G.rectangle(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(3.2)).alias("geometry"))
    want = np.zeros((4, 4), dtype=int)
    want[0:3, 0:2] = 9
    assert (array(RA.mask_by_polygon(px, poly), (4, 4)) == want).all()
    assert (array(RA.mask_by_polygon(px, poly, inverted=True, white=True), (4, 4)) == np.where(want == 9, 255, 9)).all()


def test_tiles_round_trip(spark):
    px = table(spark, np.arange(70).reshape(7, 10))
    assert sorted(map(tuple, from_tiles(to_tiles(px, 4), 4).collect())) == sorted(map(tuple, px.collect()))
