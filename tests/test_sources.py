"""Reading and writing."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.operators.matrix import Matrix
from sliceweave.operators.transcripts import marker_genes, marker_points, marker_points_by_set, xy_of_points
from sliceweave.plans import label_and_stack as LS
from sliceweave.sources import bundles, features, matrices, tables
from tests.test_spatial import box, shapes


def test_typed_table(spark, tmp_path):
    p = tmp_path / "t.txt.gz"
    with gzip.open(p, "wt") as f:
        f.write("id\tn\tf\tb\ts\n007\t1\t1.5\tTrue\tx\n008\t2\tNA\tFalse\tNone\n009\t3\t2\tTrue\t\n")
    df = tables.read_table(spark, str(p))
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "double", "boolean", "string"]
    assert [r["s"] for r in df.orderBy("id").collect()] == ["x", None, None]
    text = tables.read_table(spark, str(p), all_text=True)
    assert text.first()["id"] == "007" and {t for _, t in text.dtypes} == {"string"}
    fixed = tables.read_table(spark, str(p), schema="id string, f double")
    assert fixed.columns == ["id", "f"] and fixed.orderBy("id").first()["id"] == "007"


def test_write_table_and_groups(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1, 2]), ("b", None, [3]), (None, 3, [])], "g string, n int, l array<int>")
    tables.write_table(df.coalesce(1), str(tmp_path / "o"), na="NA")
    back = tables.read_table(spark, str(tmp_path / "o"))
    assert sorted((r["g"] or "", r["n"] or 0) for r in back.collect()) == [("", 3), ("a", 1), ("b", 0)]
    raw = "".join(gzip.open(f, "rt").read() for f in (tmp_path / "o").glob("*.gz"))
    assert "b\tNA\t3" in raw and 'a\t1\t1,2' in raw
    tables.write_table(df, str(tmp_path / "o"), mode="ignore")  # resume: nothing happens
    tables.write_groups(df.drop("l"), "g", str(tmp_path / "groups"), "n")
    assert {p.name for p in (tmp_path / "groups/metadata").glob("_group=*")} == {"_group=a", "_group=b"}
    assert {p.name for p in (tmp_path / "groups/ids").glob("_group=*")} == {"_group=a", "_group=b"}


def test_lists_and_sheets(spark, tmp_path):
    (tmp_path / "ids").write_text("007\n008\n007\n")
    assert sorted(r["id"] for r in tables.read_id_list(spark, str(tmp_path / "ids")).collect()) == ["007", "008"]
    (tmp_path / "types").write_text("Th\n\n Sst \n")
    assert [r[0] for r in tables.read_lines(spark, str(tmp_path / "types")).collect()] == ["Th", "Sst"]
    (tmp_path / "sides").write_text("# note\nside\tsampleid\tpolygon\timage\nL\ts1\tp1\tmask\nR\ts1\tp2\twhole\nL\ts2\n#x\nL\ts3\tp3\tmask\n")
    sheet = tables.read_sheet(spark, str(tmp_path / "sides"), ["side", "sampleid", "polygon", "image"])
    assert [r["sampleid"] for r in tables.side_sections(sheet, "L").orderBy("pos").collect()] == ["s1", "s3"]
    (tmp_path / "markers").write_text("name\tmarker\nn3\tA,B\n")
    sets = tables.read_sheet(spark, str(tmp_path / "markers"), ["name", "marker"])
    assert [r["feature_name"] for r in marker_genes(sets).collect()] == ["A", "B"]
    tr = spark.createDataFrame([("A", 0.2125, 0.425), ("C", 1.0, 1.0)], "feature_name string, x_location double, y_location double")
    pts = marker_points(tr, ["A", "B"])
    assert pts.columns == ["axis-1", "axis-0"]
    assert tuple(xy_of_points(pts).first()) == pytest.approx((1.0, 2.0))
    assert tuple(xy_of_points(tr).first()) == (0.2125, 0.425)
    assert marker_points_by_set(tr, sets).count() == 1
    with pytest.raises(ValueError):
        marker_points(tr, ["A"], level=8)


def test_edges_and_chains(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, 0.5, "t")], "a long, b long, dist double, ct string")
    tables.write_edges(e, str(tmp_path / "e"))
    assert tables.read_edges(spark, str(tmp_path / "e")).collect() == e.collect()
    c = spark.createDataFrame([(1, [1, 5])], "chain long, members array<long>")
    tables.write_chains(c, str(tmp_path / "c"))
    assert tables.read_chains(spark, str(tmp_path / "c")).collect() == c.collect()
    (tmp_path / "plain").write_text("9,2\n\n")
    assert tables.read_chains(spark, str(tmp_path / "plain")).first()["members"] == [2, 9]


ITEMS = [("b", [[box(0, 0, 4, 4), box(1, 1, 2, 2)]]), ("a", [[box(0, 0, 1, 1)], [box(5, 5, 6, 6)]])]


def test_geojson_round_trip(spark, tmp_path):
    df = shapes(spark, ITEMS).withColumns({"n": F.lit(3), "q": F.lit('say "hi"')})
    path = str(tmp_path / "f.geojson")
    features.write_geojson(df, path, ["pid"], "pid")
    text = "".join(p.read_text() for p in sorted((tmp_path / "f.geojson").glob("part-*")))
    doc = json.loads(text)
    assert set(doc) == {"type", "features"} and [f["id"] for f in doc["features"]] == ["a", "b"]
    assert doc["features"][0]["geometry"]["type"] == "MultiPolygon" and doc["features"][1]["properties"] == {"n": 3, "q": 'say "hi"'}
    back = features.read_features(spark, path)
    want = {r["pid"]: r["geometry"] for r in df.collect()}
    assert {r["id"]: r["geometry"] for r in back.collect()} == want
    assert dict(back.dtypes)["n"] == "bigint"
    typed = features.read_geojson(spark, path, "n int")
    assert typed.columns == ["id", "n", "geometry"]
    (tmp_path / "one.json").write_text(text.replace("\n", ""))
    assert {r["id"]: r["geometry"] for r in features.read_features(spark, str(tmp_path / "one.json"), one_document=True).collect()} == want
    features.write_geojson(df, str(tmp_path / "lines.geojson"), ["pid"], "pid", collection=False)
    assert features.read_features(spark, str(tmp_path / "lines.geojson")).count() == 2
    with pytest.raises(ValueError):
        features.read_features(spark, "x.shp")
    assert features.promote_feature_id(df.withColumn("index", F.lit(1)))[1] == "index"


def test_geoparquet_round_trip(spark, tmp_path):
    point = spark.range(1).select(F.lit("p").alias("pid"), F.struct(F.lit("Point").alias("kind"), F.array(F.array(F.array(
        G.vertex(F.lit(1.0), F.lit(2.0), F.lit(3.0))))).alias("parts")).alias("geometry"))
    df = shapes(spark, ITEMS).unionByName(point)
    features.write_geoparquet(df, str(tmp_path / "g.parquet"))
    assert dict(spark.read.parquet(str(tmp_path / "g.parquet")).dtypes)["geometry"] == "binary"
    back = features.read_features(spark, str(tmp_path / "g.parquet"))
    assert {r["pid"]: r["geometry"] for r in back.collect()} == {r["pid"]: r["geometry"] for r in df.collect()}


def test_find_shapes(spark, tmp_path):
    for store, kind in (("s1.zarr", "shapes"), ("s2.zarr", "RNA")):
        spark.createDataFrame([(store,)], "v string").coalesce(1).write.parquet(str(tmp_path / "tmp" / store))
        target = tmp_path / "seg" / store / kind / "cellpose_boundaries"
        target.mkdir(parents=True)
        source = next((tmp_path / "tmp" / store).glob("*.parquet"))
        (target / "shapes.parquet").write_bytes(source.read_bytes())
    assert [(r["name"], r["v"]) for r in tables.find_shapes(spark, str(tmp_path / "seg")).collect()] == [("s1", "s1.zarr")]


def test_matrix_and_elements(spark, tmp_path):
    m = Matrix(spark.createDataFrame([("c1", 1)], "barcode string, n int"), spark.createDataFrame([(0, "g")], "gene int, name string"),
               spark.createDataFrame([("c1", 0, 2.0)], "barcode string, gene int, value double"), "barcode", "gene")
    matrices.write_matrix(m, str(tmp_path / "m"))
    back = matrices.read_matrix(spark, str(tmp_path / "m"), "barcode", "gene")
    assert back.x.collect() == m.x.collect()
    assert tables.read_table(spark, str(tmp_path / "m/obs_table")).columns == ["obs_index", "barcode", "n"]
    matrices.write_matrix(m, str(tmp_path / "m2"), names="last")
    assert tables.read_table(spark, str(tmp_path / "m2/obs_table")).columns == ["n", "barcode"]
    matrices.write_elements({"shapes/a": m.obs, "tables/b": m.var}, str(tmp_path / "z"))
    assert matrices.read_elements(spark, str(tmp_path / "z"), ["shapes/a"])["shapes/a"].count() == 1


def test_bundles(spark, tmp_path):
    v = [(b"c1", 0.0, 0.0), (b"c1", 2.0, 0.0), (b"c1", 2.0, 2.0), (b"bow", 0., 0.), (b"bow", 2., 2.), (b"bow", 2., 0.), (b"bow", 0., 1.5)]
    edge = spark.createDataFrame([(bytearray(a), b, c) for a, b, c in v], "cell_id binary, vertex_x double, vertex_y double").coalesce(1)
    for n in ("cell", "nucleus"):
        edge.write.parquet(str(tmp_path / "x" / f"{n}_boundaries.parquet"))
    spark.createDataFrame([(bytearray(b"A"), 1.0, 2.0)], "feature_name binary, x_location double, y_location double").write.parquet(str(tmp_path / "x/transcripts.parquet"))
    spark.createDataFrame([("c1", 1.0, 1.0, 3.141592653589793)], "cell_id string, x_centroid double, y_centroid double, cell_area double").write.parquet(str(tmp_path / "x/cells.parquet"))
    got = bundles.read_xenium(spark, str(tmp_path / "x"), cells_as_circles=True)
    assert [r["cell_id"] for r in got["shapes/cell_boundaries"].collect()] == ["c1"]
    assert got["points/transcripts"].first()["feature_name"] == "A" and got["shapes/cell_circles"].first()["radius"] == 1.0
    pos = spark.createDataFrame([(f"b{r}{c}", 1, r, c, 10.0 * r, 10.0 * c) for r in range(2) for c in range(3)],
                                "barcode string, in_tissue int, array_row int, array_col int, pxl_row_in_fullres double, pxl_col_in_fullres double")
    pos.write.parquet(str(tmp_path / "v/binned_outputs/square_002um/spatial/tissue_positions.parquet"))
    squares = bundles.read_visium_hd(spark, str(tmp_path / "v"))["shapes/square_002um"]
    assert {r["a"] for r in squares.select(G.area(F.col("geometry")).alias("a")).collect()} == {100.0}
    assert bundles.name_rows(spark.createDataFrame([("/a/s1.geojson",)], "path string")).first()["slicename"] == "s1"


def test_label_and_stack(spark):
    cells = spark.createDataFrame([("s1", "c1", 0.2125, 0.2125, "Th"), ("s1", "c2", 21.25, 0.2125, "Sst"), ("s3", "c1", 0.2125, 0.2125, "Th")],
                                  "sampleid string, cell_id string, x double, y double, final_annot string")
    rect = lambda a, b: G.rectangle(F.lit(a), F.lit(0.0), F.lit(b), F.lit(10.0))
    masks = spark.createDataFrame([("s1", "leftTG", 0), ("s3", "leftTG", 0)], "sampleid string, tglabel string, mask_order int").withColumn("geometry", rect(0.0, 10.0)).unionByName(
        spark.createDataFrame([("s1", "rightTG", 1)], "sampleid string, tglabel string, mask_order int").withColumn("geometry", rect(90.0, 110.0)))
    labelled = LS.label_sides(cells, masks)
    assert sorted((r["sampleid"], r["cell_id"], r["tglabel"]) for r in labelled.collect()) == [
        ("s1", "c1", "leftTG"), ("s1", "c2", "rightTG"), ("s3", "c1", "leftTG")]
    dots = cells.select("sampleid", "cell_id", F.struct(F.lit("Point").alias("kind"), F.array(F.array(F.array(G.vertex(F.col("x"), F.col("y"))))).alias("parts")).alias("geometry"))
    side = LS.shapes_of_sides(dots, labelled)
    order = spark.createDataFrame([("leftTG", s, i) for i, s in enumerate(["s1", "s2", "s3"])] + [("rightTG", "s1", 3)], "tglabel string, sampleid string, pos int")
    niche = spark.createDataFrame([("s1", "c1", "core")], "sampleid string, cell_id string, neighborhood string")
    out = LS.coordinates_table(LS.stack_sections(side, order, neighborhood=niche))
    got = {(r["slicename"], r["cell_id"]): (r["warp_z"], r["neighborhood"]) for r in out.collect()}
    assert got == {("s1", "c1"): (0.0, "core"), ("s3", "c1"): (12.0, "Unassigned"), ("s1", "c2"): (0.0, "Unassigned")}
    m = Matrix(cells.select(F.concat("sampleid", "cell_id").alias("o"), "sampleid", "cell_id", "final_annot"), spark.range(1),
               cells.select(F.concat("sampleid", "cell_id").alias("o"), F.lit(0).alias("g"), F.lit(1.0).alias("value")), "o", "g")
    attached = LS.attach_coordinates(m, out.filter("cell_id = 'c1'"))
    assert attached.x.count() == 2 and "warp_x" in attached.obs.columns
    assert LS.neurons_only(m, ["Th"]).x.count() == 2


def test_rasters_start_from_tables():
    from sliceweave.sources import rasters

    assert not hasattr(rasters, "read_tiff")
