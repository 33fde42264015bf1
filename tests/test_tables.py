"""Merge, subset, matrix and ring rules on hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.functions.scalar import decode_bytes, sorted_json, string_key
from sliceweave.operators import matrix as MX
from sliceweave.operators import merge as M
from sliceweave.operators import rings as R
from sliceweave.operators.position import with_position


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


def test_duplicate_right_keys(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "rk string, v string, o int")
    assert rows(M.merge(left, right, ["k"], ["rk"], "left"), "k", "v") == [("a", "1"), ("a", "2"), ("b", None)]
    assert rows(M.merge(left, right, ["k"], ["rk"], "left", dedup_order=[F.col("o")]), "k", "v") == [("a", "1"), ("b", None)]


def test_fill_modes(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a", "t", 1.5)], "rk string, t string, n double")
    got = lambda fill: rows(M.merge(left, right, ["k"], ["rk"], "left", fill=fill, na="Unassigned").filter("k = 'b'"), "t", "n")
    assert got("all") == [("Unassigned", "Unassigned")]
    assert got("text") == [("Unassigned", None)]
    assert got("none") == [(None, None)]


def test_missing_keys_meet_as_text(spark):
    left = spark.createDataFrame([("nan", 1), (None, 2), ("None", 3)], "k string, i int")
    right = spark.createDataFrame([(None, "x")], "rk string, v string")
    assert rows(M.merge(left, right, ["k"], ["rk"], "inner"), "i") == [(1,), (2,)]
    assert M.merge(left, right, ["k"], ["rk"], "inner", missing_keys="never").count() == 0


def test_name_clash_and_outer(spark):
    left = spark.createDataFrame([("a", 1)], "k string, v int")
    right = spark.createDataFrame([("a", 2), ("z", 3)], "k string, v int")
    out = M.merge(left, right, ["k"], ["k"], "outer")
    assert out.columns == ["k", "v_x", "v_y"]
    assert rows(out) == [("a", 1, 2), ("z", None, 3)]
    with pytest.raises(ValueError):
        M.merge(left, right, ["k"], [], "left")
    with pytest.raises(KeyError):
        M.merge(left, right, ["nope"], ["k"], "left")


def test_first_candidate_property(spark):
    feats = spark.createDataFrame([("a", "z")], "index string, cell_id string")
    meta = spark.createDataFrame([("z", "ok")], "id string, lab string")
    assert rows(M.add_property(feats, meta, ["cell_id", "index"], "id"), "lab") == [("ok",)]
    with pytest.raises(ValueError):
        M.add_property(feats, meta, ["nothing"], "id")


def test_inverted_labels_keep_missing(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "l string")
    assert rows(M.keep_labels(df, "l", ["A"], invert=True)) == [("B",), (None,)]
    assert rows(M.keep_labels(df, "l", ["A"])) == [("A",)]


def test_filter_splits_at_first_equals(spark):
    df = spark.createDataFrame([("a=b",), ("a",)], "c string")
    assert rows(M.filter_equals(df, "c=a=b")) == [("a=b",)]


def test_section_depth_has_no_gap(spark):
    df = spark.createDataFrame([(1, "s1"), (3, "s3")], "pos int, s string")
    assert rows(M.section_z(df, "pos"), "s", "warp_z") == [("s1", 0.0), ("s3", 12.0)]


def test_point_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, None), (2, 4.0, 5.0, 6.0)], "i int, x double, y double, z double")
    pts = df.select("i", F.struct(F.lit("Point").alias("kind"), F.array(F.array(F.array(G.vertex(F.col("x"), F.col("y"), F.col("z"))))).alias("parts")).alias("geometry"))
    assert M.point_columns(pts).columns == ["i", "warp_x", "warp_y", "warp_z"]
    assert M.point_columns(pts.filter("i = 1")).columns == ["i", "warp_x", "warp_y"]


def test_positions_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = with_position(df.repartition(7), ["k"]).collect()
    assert sorted((r["k"], r["pos"]) for r in got) == [(i, i) for i in range(1000)]


def test_count_filter_modes(spark):
    x = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (1, 1, 2.0)], "obs_pos int, var_pos int, value double")
    m = MX.Matrix(spark.range(2).select(F.col("id").cast("int").alias("obs_pos")), spark.range(2).select(F.col("id").cast("int").alias("var_pos")), x)
    joint, keep = MX.filter_by_counts(m, 2), MX.filter_by_counts(m, 2, keep=True)
    assert rows(joint.obs, "obs_pos") == [(1,)] and rows(joint.var, "var_pos") == [(0,), (1,)]
    assert rows(keep.obs, "obs_pos") == [(1,)] and rows(keep.var, "var_pos") == [(1,)]
    assert rows(keep.x) == [(1, 1, 2.0)]


def test_matrix_metadata(spark):
    m = MX.Matrix(spark.createDataFrame([("b1", 1.0), ("b2", 2.0)], "bar string, n double"), spark.range(1),
                  spark.createDataFrame([("b1", 0, 1.0), ("b2", 0, 1.0)], "bar string, g int, value double"), "bar", "g")
    meta = spark.createDataFrame([("b1", "x"), ("b1", "y")], "id string, lab string")
    left = MX.attach_metadata(m, meta, ["_index_"])
    assert rows(left.obs, "bar", "lab") == [("b1", "x"), ("b2", "Unassigned")]
    inner = MX.attach_metadata(m, meta, ["bar"], how="inner")
    assert rows(inner.x, "bar") == [("b1",)]
    with pytest.raises(ValueError):
        MX.attach_metadata(m, meta, ["bar"], how="outer")


def test_rings(spark):
    v = [("t", 0, 0., 0.), ("t", 1, 1., 0.), ("t", 2, 0., 1.), ("s", 3, 0., 0.), ("s", 4, 1., 1.),
         ("q", 5, 0., 0.), ("q", 6, 2., 0.), ("q", 7, 2., 2.), ("q", 8, 0., 2.), ("q", 9, 0., 0.)]
    polys = R.polygons_from_vertices(spark.createDataFrame(v, "cell_id string, ordinal int, vertex_x double, vertex_y double"))
    out = polys.select("cell_id", F.size(G.rings(F.col("geometry"))[0]).alias("n"), G.area(F.col("geometry")).alias("a"),
                       G.centroid(F.col("geometry")).alias("c"))
    got = {r["cell_id"]: (r["n"], r["a"], tuple(r["c"])) for r in out.collect()}
    assert set(got) == {"t", "q"} and got["t"][0] == 4
    assert got["q"] == (5, 4.0, (1.0, 1.0))


def test_area_with_hole_and_far_offset(spark):
    sq = lambda a, b: G.rectangle(F.lit(a), F.lit(a), F.lit(b), F.lit(b))["parts"][0][0]
    for o in (0.0, 1e8):
        g = G.geometry(F.array(F.array(sq(o, o + 4.0), sq(o + 1.0, o + 3.0))))
        r = spark.range(1).select(G.area(g).alias("a"), G.centroid(g).alias("c")).first()
        assert r["a"] == 12.0 and r["c"]["x"] == pytest.approx(o + 2)


def test_barcodes(spark):
    sq = G.rectangle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    df = spark.createDataFrame([(0, "", {"b": 1, "a": 2}), (1, "x", None)], "o int, id string, p map<string,int>").withColumn("geometry", sq)
    out = R.load_features(df, ["o"], "id")
    assert rows(out, "barcode", "p") == [("polygon_000000", '{"a":2,"b":1}'), ("x", None)]
    twice = spark.createDataFrame([(0, "x"), (1, "x")], "o int, id string").withColumn("geometry", sq)
    with pytest.raises(ValueError, match="not unique"):
        R.load_features(twice, ["o"], "id")
    with pytest.raises(ValueError, match="no valid"):
        R.load_features(twice.filter("o > 5"), ["o"], "id")


def test_json_bytes_keys(spark):
    df = spark.createDataFrame([(bytearray(b"ab"), ([{"z": 1}],))], "k binary, n struct<l: array<map<string,int>>>")
    assert decode_bytes(df, "k").first()["k"] == "ab"
    assert df.select(sorted_json(df, "n")).first()[0] == '{"l":[{"z":1}]}'
    assert df.select(string_key(F.lit(None).cast("int"))).first()[0] == "nan"
