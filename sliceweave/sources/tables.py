"""Delimited tables, lists and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceweave.functions.scalar import missing_to_null


def _raw(spark: SparkSession, path: str, sep: str, header: bool, comment: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header).option("inferSchema", False)
    reader = reader.option("mode", "PERMISSIVE").option("nullValue", "").option("emptyValue", "")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns that hold only whole numbers, numbers or truth values; one aggregation pass."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not text:
        return df
    kinds = ("bigint", "double", "boolean")
    aggs = []
    for i, c in enumerate(text):
        col = F.col(f"`{c}`")
        aggs.append(F.count(col).alias(f"n{i}"))
        aggs += [F.count(col.try_cast(k)).alias(f"{k}{i}") for k in kinds]
        aggs.append(F.count(F.when(F.lower(col).isin("true", "false"), 1)).alias(f"word{i}"))
    seen = df.agg(*aggs).first()
    casts = {}
    for i, c in enumerate(text):
        n = seen[f"n{i}"]
        if n == 0:
            continue
        if seen[f"bigint{i}"] == n and seen[f"double{i}"] == n:
            casts[c] = "bigint"
        elif seen[f"double{i}"] == n:
            casts[c] = "double"
        elif seen[f"word{i}"] == n:
            casts[c] = "boolean"
    return df.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in casts.items()})


def read_table(spark: SparkSession, path: str, sep: str = "\t", schema: str | None = None, all_text: bool = False) -> DataFrame:
    """Headed table, plain or gzipped; the usual texts for a missing value become null.

    With ``schema`` the columns are cast as told; ``all_text`` keeps text; otherwise types are
    inferred in one pass. A gzipped file cannot be split, so large tables should come as
    several files or as Parquet.
    """
    raw = _raw(spark, path, sep, True)
    clean = raw.select(*[missing_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is not None:
        from pyspark.sql.types import StructType

        want = StructType.fromDDL(schema)
        return clean.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want.fields])
    return clean if all_text else infer_types(clean)


def write_table(df: DataFrame, path: str, sep: str = "\t", na: str = "", gzip: bool = True, header: bool = True,
                mode: str = "error") -> None:
    """Headed table as part files; list columns are joined with commas. ``mode='ignore'`` resumes."""
    flat = {f.name: F.array_join(F.transform(f"`{f.name}`", lambda v: v.cast("string")), ",")
            for f in df.schema.fields if f.dataType.typeName() == "array"}
    out = df.withColumns(flat) if flat else df
    out.write.mode(mode).csv(path, sep=sep, header=header, nullValue=na, emptyValue="",
                             compression="gzip" if gzip else "none")


def write_groups(df: DataFrame, column: str, path: str, id_column: str | None = None, mode: str = "error") -> None:
    """One folder per group under ``metadata`` and, with an id column, one unheaded list per group under ``ids``.

    Rows are not shuffled by group, so a group with most of the rows is written by many tasks.
    """
    kept = df.filter(F.col(column).isNotNull())
    kept.withColumn("_group", F.col(column)).write.mode(mode).partitionBy("_group").csv(
        f"{path}/metadata", sep="\t", header=True, compression="gzip", emptyValue="")
    if id_column:
        kept.select(F.col(column).alias("_group"), id_column).write.mode(mode).partitionBy("_group").csv(
            f"{path}/ids", sep="\t", header=False, compression="gzip", emptyValue="")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Unheaded list as distinct text ids; leading zeros stay."""
    raw = _raw(spark, path, "\t", False)
    return raw.select(F.col(raw.columns[0]).cast("string").alias("id")).filter(F.col("id").isNotNull()).distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-empty lines, as a one-column table ``value``."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter(F.col("value") != "")


def read_sheet(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Sample, marker or side sheet: ``#`` lines, the header, and rows with too few fields are dropped.

    ``pos`` numbers the rows in file order; a sheet is a short file.
    """
    lines = F.filter(F.split("value", "\r?\n"), lambda l: ~l.startswith("#"))
    body = spark.read.text(path, wholetext=True).select(F.posexplode(F.slice(lines, 2, F.size(lines))).alias("pos", "line"))
    rows = body.select("pos", F.split("line", "\t").alias("f")).filter(F.size("f") >= len(fields))
    return rows.select("pos", *[F.col("f")[n].alias(name) for n, name in enumerate(fields)])


def side_sections(sheet: DataFrame, side: str) -> DataFrame:
    """Sections of one side in sheet order."""
    return sheet.filter(F.col("side") == side).select("pos", "sampleid", "polygon", "image")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schema="a bigint, b bigint, dist double, ct string")


def write_edges(edges: DataFrame, path: str, mode: str = "error") -> None:
    write_table(edges.select("a", "b", "dist", "ct"), path, mode=mode)


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """Comma lists of positions, each sorted: ``chain, members``."""
    lines = read_lines(spark, path)
    members = F.array_sort(F.transform(F.split("value", ","), lambda v: F.trim(v).cast("bigint")))
    return lines.select(members.alias("members")).select(F.col("members")[0].alias("chain"), "members")


def write_chains(chains: DataFrame, path: str, gzip: bool = True, mode: str = "error") -> None:
    line = F.array_join(F.transform("members", lambda v: v.cast("string")), ",")
    chains.select(line.alias("value")).write.mode(mode).text(path, compression="gzip" if gzip else "none")


def find_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """All ``shapes.parquet`` under ``cellpose_boundaries`` folders outside ``RNA``, named by their store.

    Reads every store in one scan; ``name`` is the ``.zarr`` folder's name without the ending.
    """
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "shapes.parquet").parquet(folder)
    path = F.col("_metadata.file_path")
    kept = df.select("*", path.alias("_path")).filter(F.col("_path").contains("/cellpose_boundaries/") & ~F.col("_path").contains("/RNA/"))
    return kept.withColumn("name", F.regexp_extract("_path", r"([^/]+)\.zarr/[^/]+/[^/]+/[^/]+$", 1)).drop("_path")
