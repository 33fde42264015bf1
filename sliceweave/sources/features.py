"""GeoJSON and GeoParquet feature tables."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceweave.functions import geometry as G
from sliceweave.operators.position import with_position
from sliceweave.sources.geo_files import ready_to_write, geo_columns, join_parts, write_with_footer
from sliceweave.sources.tables import infer_types


def _from_coordinates(kind: Column, text: Column) -> Column:
    """Geometry from GeoJSON coordinates text; kinds other than point and polygon give null."""
    v = lambda p: G.vertex(p[0], p[1], F.try_element_at(p, F.lit(3)))
    part = lambda rings: F.transform(rings, lambda ring: F.transform(ring, v))
    point = F.from_json(text, "array<double>")
    poly = F.from_json(text, "array<array<array<double>>>")
    multi = F.from_json(text, "array<array<array<array<double>>>>")
    parts = (F.when(kind == "Point", F.array(F.array(F.array(v(point)))))
             .when(kind == "Polygon", F.array(part(poly)))
             .when(kind == "MultiPolygon", F.transform(multi, part)))
    return F.when(parts.isNotNull(), F.struct(kind.alias("kind"), parts.alias("parts")))


def read_geojson(spark: SparkSession, path: str, properties: str | None = None, one_document: bool = False) -> DataFrame:
    """Feature collection as property columns and ``geometry``; a feature-level id becomes ``id``.

    Files with one feature per line (as writers commonly lay them out, and as
    :func:`write_geojson` does) are read in parallel; a line may also hold a whole collection.
    A feature that spreads over several lines is an error; ``one_document`` reads such files, one
    file per row. ``properties`` is the DDL of the properties; without it names and types are taken
    from the data.
    """
    shape = "type: string, id: string, properties: string, geometry: struct<type: string, coordinates: string>"
    if one_document:
        whole = spark.read.text(path, wholetext=True)
        items = whole.select(F.explode(F.from_json("value", f"features array<struct<{shape}>>")["features"]).alias("f"))
    else:
        line = F.regexp_replace(F.regexp_replace(F.trim("value"), r"^,", ""), r",$", "")
        lines = spark.read.text(path).select(line.alias("line"), F.from_json(line, f"struct<{shape}>").alias("f"),
                                             F.from_json(line, f"struct<features: array<struct<{shape}>>>")["features"].alias("all"))
        torn = F.raise_error(F.concat(F.lit("a feature goes on in the next line, read it as one document: "), F.substring("line", 1, 80)))
        feature = F.when(F.col("f.type") == "Feature", F.array("f")).when(F.col("all").isNotNull(), F.col("all"))
        # headers and brackets of a collection name no feature
        split = F.col("line").rlike(r'"type"\s*:\s*"Feature"')
        items = lines.select(F.explode(F.coalesce(feature, F.when(split, torn.cast(f"array<struct<{shape}>>")))).alias("f"))
    feature = items.filter(F.col("f.type") == "Feature").select(
        F.col("f.id").alias("_fid"), F.col("f.properties").alias("_props"),
        _from_coordinates(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("geometry"))
    if properties is not None:
        out = feature.withColumn("_p", F.from_json("_props", properties)).select("_fid", "_p.*", "geometry")
        return _promote_id(out)
    as_map = feature.withColumn("_p", F.from_json("_props", "map<string,string>"))
    # the distinct property names are the columns of the result
    names = [r[0] for r in as_map.select(F.explode(F.map_keys("_p")).alias("k")).distinct().orderBy("k").collect()]
    out = as_map.select("_fid", *[F.col("_p")[n].alias(n) for n in names], "geometry")
    return infer_types(_promote_id(out))


def _promote_id(df: DataFrame) -> DataFrame:
    return df.drop("_fid") if "id" in df.columns else df.withColumnRenamed("_fid", "id")


def feature_json(df: DataFrame, id_column: str | None = None) -> Column:
    """One GeoJSON feature as text; the id column moves to feature level."""
    position = lambda v: F.when(v["z"].isNull(), F.array(v["x"], v["y"])).otherwise(F.array(v["x"], v["y"], v["z"]))
    nested = lambda parts: F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, position)))
    g = F.col("geometry")
    coords = (F.when(g["kind"] == "Point", F.to_json(position(g["parts"][0][0][0])))
              .when(g["kind"] == "MultiPolygon", F.to_json(nested(g["parts"])))
              .otherwise(F.to_json(nested(g["parts"])[0])))
    shape = F.when(G.is_empty(g), F.lit("null")).otherwise(
        F.concat(F.lit('{"type":"'), g["kind"], F.lit('","coordinates":'), coords, F.lit("}")))
    props = [c for c in df.columns if c not in ("geometry", id_column)]
    body = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in props]), {"ignoreNullFields": "false"}) if props else F.lit("{}")
    head = F.lit('{"type":"Feature"')
    if id_column:
        quoted = F.to_json(F.struct(F.col(id_column).cast("string").alias("i")))
        head = F.concat(F.lit('{"type":"Feature","id":'), F.regexp_replace(quoted, r'^\{"i":|\}$', ""))
    return F.concat(head, F.lit(',"properties":'), body, F.lit(',"geometry":'), shape, F.lit("}"))


def promote_feature_id(df: DataFrame) -> tuple[DataFrame, str | None]:
    """The column to use as feature id: ``index`` if present, else ``id``."""
    for name in ("index", "id"):
        if name in df.columns:
            return df, name
    return df, None


def write_geojson(df: DataFrame, path: str, order: list[str], id_column: str | None = None, collection: bool = True,
                  mode: str = "error", one_file: bool = False) -> None:
    """Write features as text, one per line, in order.

    With ``collection`` the part files, joined in name order, form one FeatureCollection without
    ``name`` or ``crs`` keys; otherwise each line is a feature of its own. ``one_file`` joins them: the
    parts are written in parallel beside ``path``, and a task copies them into one file there.
    """
    if one_file:
        spark = df.sparkSession
        if ready_to_write(spark, path, mode):
            if mode == "append":
                raise ValueError("a document cannot be appended to")
            parts = f"{path}.parts-{uuid.uuid4().hex}"
            write_geojson(df, parts, order, id_column, collection)
            join_parts(spark, parts, path)
        return
    if not collection:
        df.select(feature_json(df, id_column).alias("value")).write.mode(mode).text(path)
        return
    numbered = with_position(df.select(*order, feature_json(df, id_column).alias("_json")), order, "_pos")
    lines = numbered.select("_pos", F.when(F.col("_pos") == 0, F.col("_json")).otherwise(
        F.concat(F.lit(","), F.col("_json"))).alias("value"))
    spark = df.sparkSession
    ends = spark.createDataFrame([(-1, '{"type":"FeatureCollection","features":['), (1 << 62, "]}")], "_pos long, value string")
    lines.unionByName(ends).repartitionByRange("_pos").sortWithinPartitions("_pos").select("value").write.mode(mode).text(path)


@F.pandas_udf(G.GEOMETRY)
def from_wkb(blobs: pd.Series) -> pd.DataFrame:
    """Points, polygons and multipolygons from well-known binary."""

    def body(b, at):
        order = "<" if b[at] == 1 else ">"
        code = struct.unpack_from(order + "I", b, at + 1)[0]
        wide = 3 if code & 0x80000000 or 1000 < code % 10000 < 2000 else 2
        return order, (code & 0xFFFF) % 1000, wide, at + 5

    def places(b, order, wide, n, at):
        flat = struct.unpack_from(f"{order}{n * wide}d", b, at)
        rows = [flat[i:i + wide] for i in range(0, n * wide, wide)]
        return [{"x": r[0], "y": r[1], "z": r[2] if wide == 3 else None} for r in rows], at + 8 * n * wide

    def rings(b, order, wide, at):
        out, (n,) = [], struct.unpack_from(order + "I", b, at)
        at += 4
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", b, at)
            ring, at = places(b, order, wide, m, at + 4)
            out.append(ring)
        return out, at

    def one(b):
        if b is None:
            return None, None
        order, code, wide, at = body(b, 0)
        if code == 1:
            return "Point", [[places(b, order, wide, 1, at)[0]]]
        if code == 3:
            return "Polygon", [rings(b, order, wide, at)[0]]
        if code == 6:
            (n,), at, parts = struct.unpack_from(order + "I", b, at), at + 4, []
            for _ in range(n):
                order, _, wide, at = body(b, at)
                part, at = rings(b, order, wide, at)
                parts.append(part)
            return "MultiPolygon", parts
        return None, None

    return pd.DataFrame([one(bytes(b) if b is not None else None) for b in blobs], columns=["kind", "parts"])


@F.pandas_udf(T.BinaryType())
def to_wkb(geoms: pd.DataFrame) -> pd.Series:
    """Well-known binary, little-endian, three-dimensional when every vertex has z."""

    def one(kind, parts):
        if kind is None or parts is None:
            return None
        vertices = [v for part in parts for ring in part for v in ring]
        wide = bool(vertices) and all(v["z"] is not None and v["z"] == v["z"] for v in vertices)
        up = 1000 if wide else 0
        place = lambda v: struct.pack("<3d", v["x"], v["y"], v["z"]) if wide else struct.pack("<2d", v["x"], v["y"])
        rings = lambda part: struct.pack("<I", len(part)) + b"".join(
            struct.pack("<I", len(r)) + b"".join(place(v) for v in r) for r in part)
        if kind == "Point":
            return struct.pack("<BI", 1, 1 + up) + place(vertices[0])
        if kind == "Polygon":
            return struct.pack("<BI", 1, 3 + up) + rings(parts[0])
        return struct.pack("<BII", 1, 6 + up, len(parts)) + b"".join(struct.pack("<BI", 1, 3 + up) + rings(p) for p in parts)

    return pd.Series([one(k, p) for k, p in zip(geoms["kind"], geoms["parts"])])


def read_geoparquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with a binary (WKB) or already structured ``geometry`` column."""
    df = spark.read.parquet(path)
    if "geometry" not in df.columns:
        raise ValueError(f"{path} has no geometry column")
    if df.schema["geometry"].dataType.typeName() == "binary":
        return df.withColumn("geometry", F.when(F.col("geometry").isNotNull(), from_wkb("geometry")))
    return df


def write_geoparquet(df: DataFrame, path: str, wkb: bool = True, mode: str = "error") -> None:
    """GeoParquet with well-known binary and the ``geo`` footer key; without ``wkb`` plain Parquet of the structured column."""
    if wkb:
        write_with_footer(df, geo_columns(df, to_wkb), path, mode)
    else:
        df.write.mode(mode).parquet(path)


def read_features(spark: SparkSession, path: str, **options) -> DataFrame:
    """Features by file ending: ``.parquet``, ``.geojson`` or ``.json``."""
    trimmed = path.rstrip("/")
    if trimmed.endswith(".parquet"):
        return read_geoparquet(spark, path)
    if trimmed.endswith((".geojson", ".json")):
        return read_geojson(spark, path, **options)
    raise ValueError(f"unsupported feature file ending: {path}")
