"""GeoParquet footers and single GeoJSON documents, as other programs read them."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sliceweave.functions import geometry as G
from sliceweave.sources import features


def shapes(spark, n=50):
    box = G.rectangle(F.col("id").cast("double"), F.lit(1.0), F.col("id") + 0.5, F.lit(2.5))
    two = G.geometry(F.array(*[box["parts"][0]] * 2))
    flat = F.struct(F.lit("Point").alias("kind"), F.array(F.array(F.array(G.vertex(F.col("id"), F.lit(7.0))))).alias("parts"))
    shape = F.when(F.col("id") % 5 == 0, two).when(F.col("id") % 5 == 1, flat).when(F.col("id") % 5 < 4, box)
    return spark.range(n).select(F.concat(F.lit("p"), F.lpad("id", 3, "0")).alias("pid"), (F.col("id") * 1.5).alias("n"), shape.alias("geometry")).repartition(4)


def test_footer_of_every_file(spark, tmp_path):
    df, path = shapes(spark), str(tmp_path / "g.parquet")
    features.write_geoparquet(df, path)
    seen, boxes = set(), []
    files = sorted((tmp_path / "g.parquet").glob("*.parquet"))
    assert len(files) == 4 and not list((tmp_path / "g.parquet").glob("_temporary*"))
    for file in files:
        meta = pq.read_metadata(file).metadata
        geo = json.loads(meta[b"geo"])
        column = geo["columns"][geo["primary_column"]]
        assert geo["version"] == "1.0.0" and column["encoding"] == "WKB" and column["crs"] is None
        assert pq.read_schema(file).names == ["pid", "n", "geometry"] and pq.read_schema(file).field("geometry").type == "binary"
        seen |= set(column["geometry_types"])
        boxes.append(column["bbox"])
    assert seen == {"Polygon", "MultiPolygon", "Point"}
    assert [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)] == [0.0, 1.0, 48.5, 7.0]
    got = features.read_features(spark, path)
    key = lambda d: sorted(map(str, d.select("pid", "n", "geometry").collect()))
    assert key(got) == key(df)
    with pytest.raises(FileExistsError):
        features.write_geoparquet(df, path)
    features.write_geoparquet(df.limit(1), path, mode="ignore")
    assert features.read_features(spark, path).count() == 50
    features.write_geoparquet(df, path, mode="append")
    assert features.read_features(spark, path).count() == 100
    features.write_geoparquet(df.filter("n < 3"), path, mode="overwrite")
    assert features.read_features(spark, path).count() == 2


def test_deep_points_and_no_rows(spark, tmp_path):
    deep = spark.range(3).select("id", F.struct(F.lit("Point").alias("kind"), F.array(F.array(F.array(G.vertex(F.col("id"), F.lit(1), F.lit(12.0))))).alias("parts")).alias("geometry"))
    features.write_geoparquet(deep.coalesce(1), str(tmp_path / "d.parquet"))
    (file,) = (tmp_path / "d.parquet").glob("*.parquet")
    assert json.loads(pq.read_metadata(file).metadata[b"geo"])["columns"]["geometry"]["geometry_types"] == ["Point Z"]
    assert features.read_geoparquet(spark, str(tmp_path / "d.parquet")).first()["geometry"]["parts"][0][0][0]["z"] == 12.0


def test_a_failed_write_leaves_no_files(spark, tmp_path):
    path = tmp_path / "f.parquet"
    bad = shapes(spark).withColumn("n", F.when(F.col("pid") == "p030", F.raise_error(F.lit("torn")).cast("double")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="torn"):
        features.write_geoparquet(bad, str(path))
    assert not list(path.glob("*.parquet")) and not (path / "_SUCCESS").exists()


def test_one_geojson_document(spark, tmp_path):
    df, path = shapes(spark, 300), tmp_path / "all.geojson"
    features.write_geojson(df, str(path), ["pid"], "pid", one_file=True)
    doc = json.loads(path.read_text())
    assert path.is_file() and doc["type"] == "FeatureCollection" and [f["id"] for f in doc["features"]] == sorted(f"p{i:03}" for i in range(300))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["all.geojson"]
    again = features.read_features(spark, str(path))
    assert again.count() == 300 and {r["n"] for r in again.select("n").collect()} == {i * 1.5 for i in range(300)}
    with pytest.raises(FileExistsError):
        features.write_geojson(df, str(path), ["pid"], "pid", one_file=True)
    features.write_geojson(df.filter("false"), str(path), ["pid"], "pid", mode="overwrite", one_file=True)
    assert json.loads(path.read_text()) == {"type": "FeatureCollection", "features": []}
    features.write_geojson(df, str(tmp_path / "lines.geojson"), ["pid"], collection=False, one_file=True)
    assert sum(1 for line in (tmp_path / "lines.geojson").open() if json.loads(line)) == 300
