"""Cases in which rows, features or pixels used to go missing."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.operators import merge, overlay, raster, warp
from sliceweave.session import STEPS, clear_steps, materialize
from sliceweave.sources import features


def squares(spark, items):
    rows = spark.createDataFrame([(p, float(a), float(b), float(c), float(d), "tag " + p) for p, a, b, c, d in items], "pid string, a double, b double, c double, d double, label string")
    return rows.select("pid", "label", G.rectangle(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geometry"))


def areas(df):
    return {(r["pid"], r["label"]): r["a"] for r in df.groupBy("pid", "label").agg(F.round(F.sum(G.area(F.col("geometry"))), 6).alias("a")).collect()}


def test_equal_neurons_stay(spark):
    got = overlay.harmonise(squares(spark, [("n1", 0, 0, 4, 4), ("n2", 0, 0, 4, 4)]), squares(spark, [("b", 3, 1, 5, 3)]))
    assert areas(got) == {("n1", "tag n1"): 14.0, ("n2", "tag n2"): 14.0}


def test_neurons_that_share_an_edge_stay(spark):
    neurons = squares(spark, [("n1", 0, 0, 4, 4), ("n2", 0, 0, 6, 4), ("n3", 4, 0, 8, 4)])
    others = squares(spark, [("b1", 1, -1, 2, 1), ("b2", 2.5, -1, 3.5, 1)])
    assert areas(overlay.harmonise(neurons, others)) == {("n1", "tag n1"): 14.0, ("n2", "tag n2"): 22.0, ("n3", "tag n3"): 16.0}


def test_overlapping_non_neurons_are_cut_once(spark):
    got = overlay.harmonise(squares(spark, [("n1", 0, 0, 4, 4), ("n2", 0, 0, 4, 4)]), squares(spark, [("b1", 3, 1, 5, 3), ("b2", 3, 2, 5, 5)]))
    assert set(areas(got).values()) == {13.0}


def test_open_boundary_is_an_error():
    import numpy as np

    with pytest.raises(ValueError, match="without closing"):
        overlay._parts(np.array([[0, 0, 1, 0], [1, 0, 1, 1]], dtype=float))


def test_mask_of_two_channels(spark):
    pixels = spark.createDataFrame([(0, c, 0, x, 9) for c in (0, 1) for x in (0, 1)], "img int, ch int, y int, x int, v long")
    got = raster.mask_by_raster(pixels, pixels.withColumn("v", F.lit(255) * (F.col("x") == 0).cast("int")), 127).collect()
    assert sorted((r["ch"], r["x"], r["v"]) for r in got) == [(0, 0, 9), (0, 1, 0), (1, 0, 9), (1, 1, 0)]


def test_threshold_needs_a_limit_for_each_channel(spark):
    pixels = spark.createDataFrame([(0, c, 0, 0, 9) for c in (0, 1, 2)], "img int, ch int, y int, x int, v long")
    with pytest.raises(ValueError, match="2 limits for 3 channels"):
        raster.threshold(pixels, [1, 2])
    assert [r["v"] for r in raster.threshold(pixels, [10]).collect()] == [0, 0, 0]


def test_conditions_compare_text(spark):
    rows = spark.createDataFrame([(8, "08"), (9, "8")], "n int, t string")
    assert merge.filter_equals(rows, "n=abc").count() == 0
    assert [r["n"] for r in merge.filter_equals(rows, "t=08").collect()] == [8]
    assert merge.filter_equals(rows, "n=08").count() == 0 and merge.filter_equals(rows, "n=8").count() == 1


def test_warp_keeps_features_without_geometry(spark):
    given = squares(spark, [("a", 0, 0, 1, 1)])
    given = given.unionByName(given.withColumns({"pid": F.lit("b"), "geometry": F.lit(None).cast(given.schema["geometry"].dataType)}))
    field = spark.createDataFrame([(x, y, 1.0, 2.0) for x in range(-1, 3) for y in range(-1, 3)], "gx long, gy long, dx double, dy double")
    got = {r["pid"]: r["geometry"] for r in warp.warp_by_field(given, field, ["pid"], 1.0).collect()}
    assert got["b"] is None and got["a"]["parts"][0][0][0]["x"] == 1.0


FEATURE = '{"type": "Feature", "properties": {"pid": "%s"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}'


def test_geojson_in_one_line(spark, tmp_path):
    (tmp_path / "one.geojson").write_text('{"type": "FeatureCollection", "features": [%s, %s]}' % (FEATURE % "a", FEATURE % "b"))
    assert {r["pid"] for r in features.read_geojson(spark, str(tmp_path / "one.geojson"), "pid string").collect()} == {"a", "b"}


def test_torn_geojson_is_an_error(spark, tmp_path):
    path = tmp_path / "torn.geojson"
    path.write_text('{"type": "FeatureCollection",\n "features": [\n  {\n   "type": "Feature",\n   "properties": {"pid": "a"},\n   "geometry": null\n  }\n ]\n}\n')
    with pytest.raises(Exception, match="one document"):
        features.read_geojson(spark, str(path), "pid string").collect()
    assert features.read_geojson(spark, str(path), "pid string", one_document=True).count() == 1


def test_step_tables_go(spark):
    materialize(spark.range(3)).count()
    paths = [Path(p.removeprefix("file:")) for p in STEPS]
    assert any(p.exists() for p in paths)
    clear_steps(spark)
    assert not STEPS and not any(p.exists() for p in paths)


def test_functions_run_from_another_folder(tmp_path):
    code = (f"import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})\n"
            "from sliceweave.session import build_session\nfrom sliceweave.operators.overlay import stitch\n"
            "spark = build_session('away', 'local[2]')\n"
            "print(spark.range(1).selectExpr('array(0D, 0D, 1D, 0D, 1D, 0D, 1D, 1D, 1D, 1D, 0D, 0D) AS p').select(stitch('p')).count())\n"
            "print('rows', len(spark.range(1).selectExpr('array(0D, 0D, 1D, 0D, 1D, 0D, 1D, 1D, 1D, 1D, 0D, 0D) AS p').select(stitch('p')).collect()))")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1" in out.stdout, out.stderr[-2000:]
