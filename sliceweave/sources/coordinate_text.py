"""Sparse matrices as coordinate text with row and column name files, as instruments write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceweave.operators.matrix import Matrix
from sliceweave.operators.position import with_position
from sliceweave.session import materialize

# The first line of a coordinate file, the kinds of numbers it may announce, and the files of a folder.
BANNER = "%%MatrixMarket matrix coordinate {field} general"
FIELDS = ("integer", "real", "pattern")
MATRIX, COLUMNS, ROWS = "matrix.mtx", "barcodes.tsv", "features.tsv"


def lines_in_place(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or of a folder of parts that follow each other by name, with their ``place``.

    A place is the part, the split within it and a number that grows within the split, so splits are read in parallel and
    places still compare in file order. The table is stored, because the numbers belong to this reading.
    """
    lines = spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n")).alias("place"))
    return materialize(lines)


def named_ordinals(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """``pos`` (0, 1, 2 ... in file order) and the tab-parted ``fields`` of every line; fields a line lacks are null."""
    lines = with_position(lines_in_place(spark, path).filter(F.col("value") != ""), ["place"])
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    return lines.select("pos", *[F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(fields)])


def _number(parts: Column, i: int, kind: str) -> Column:
    return F.get(parts, F.lit(i)).try_cast(kind)


def read_entries(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """Entries (row, col, value) of a coordinate file, counted from 0, and the numbers of rows and columns.

    The text is read once, in parallel. Banner and size line are the first line and the first one without ``%``, by place. A
    matrix that isn't general or real, a torn line, an entry outside the announced shape and a wrong number of entries are
    errors. Entries of a ``pattern`` are 1.
    """
    lines = lines_in_place(spark, path)
    parts = F.split(F.trim("value"), r"\s+")
    is_note = F.col("value").startswith("%")
    # notes are few; of the rest only the first line is wanted here
    ends = lines.agg(F.min(F.struct("place", "value")).alias("banner"), F.min(F.when(~is_note & (F.trim("value") != ""), F.struct("place", "value"))).alias("size")).first()
    field = next((f for f in FIELDS if ends["banner"] and ends["banner"]["value"].strip().lower() == BANNER.format(field=f).lower()), None)
    if field is None:
        raise ValueError(f"{path} is not a general coordinate matrix of numbers: {ends['banner'] and ends['banner']['value'][:100]!r}")
    shape = [int(x) for x in ends["size"]["value"].split()] if ends["size"] and all(x.isdigit() for x in ends["size"]["value"].split()) else []
    if len(shape) != 3:
        raise ValueError(f"{path} has no size line")
    head = ends["size"]["place"]
    place = F.struct(F.lit(head["part"]).alias("part"), F.lit(head["split"]).cast("long").alias("split"), F.lit(head["n"]).cast("long").alias("n"))
    body = lines.filter(~is_note & (F.trim("value") != "") & (F.col("place") > place))
    wanted = 2 if field == "pattern" else 3
    entries = body.select((_number(parts, 0, "bigint") - 1).alias("row"), (_number(parts, 1, "bigint") - 1).alias("col"),
                          (F.lit(1.0) if field == "pattern" else _number(parts, 2, "double")).alias("value"), F.size(parts).alias("n"), F.col("value").alias("line"))
    fine = (F.col("n") == wanted) & F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1) & F.col("value").isNotNull()
    stored = materialize(entries.withColumn("fine", F.coalesce(fine, F.lit(False))).select("row", "col", "value", "fine", F.when(~F.col("fine"), F.col("line")).alias("line")))
    seen = stored.agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("bad")).first()
    if seen["bad"] is not None:
        raise ValueError(f"{path} has an entry that is torn or outside {shape[0]} x {shape[1]}: {seen['bad'][:100]!r}")
    if seen["n"] != shape[2]:
        raise ValueError(f"{path} announces {shape[2]} entries and has {seen['n']}")
    return stored.select("row", "col", "value"), shape[0], shape[1]


def is_there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _first_there(spark: SparkSession, folder: str, name: str) -> str:
    """The file, or the same gzipped. A gzipped one is read by one task."""
    for path in (f"{folder}/{name}", f"{folder}/{name}.gz"):
        if is_there(spark, path):
            return path
    raise FileNotFoundError(f"{folder} has no {name}")


def read_counts(spark: SparkSession, folder: str) -> Matrix:
    """Barcodes by features from a folder of a coordinate matrix and its two name files, plain or gzipped.

    obs is (obs_pos, barcode), var (var_pos, feature_id, symbol, feature_type). Rows of the file are features. Entries at one
    place stay apart, sums add them up. More or fewer names than the matrix announces are an error.
    """
    entries, rows, cols = read_entries(spark, _first_there(spark, folder, MATRIX))
    obs = named_ordinals(spark, _first_there(spark, folder, COLUMNS), ["barcode"]).withColumnRenamed("pos", "obs_pos")
    var = named_ordinals(spark, _first_there(spark, folder, ROWS), ["feature_id", "symbol", "feature_type"]).withColumnRenamed("pos", "var_pos")
    for names, announced, what in ((obs, cols, "barcodes"), (var, rows, "features")):
        if (found := names.count()) != announced:
            raise ValueError(f"{folder} has {found} {what} for {announced} in the matrix")
    return Matrix(obs, var, entries.select(F.col("col").alias("obs_pos"), F.col("row").alias("var_pos"), "value"), "obs_pos", "var_pos", "value")


def write_counts(m: Matrix, folder: str, barcode: str, feature: list[str], compression: str = "none") -> None:
    """``m`` as such a folder: every file is a folder of parts, in the order of their names, so tasks write in parallel.

    Rows are numbered in the order of the obs and var keys. ``feature`` names the columns of var that are written: id, symbol,
    type. Whole values are written as integers.
    """
    spark = m.x.sparkSession
    obs = materialize(with_position(m.obs.select(F.col(m.obs_key), F.col(barcode).cast("string").alias("_name")), [m.obs_key], "_obs"))
    var = materialize(with_position(m.var.select(F.col(m.var_key), F.concat_ws("\t", *[F.col(c).cast("string") for c in feature]).alias("_name")), [m.var_key], "_var"))
    put = lambda df, name: df.write.option("compression", compression).text(f"{folder}/{name}")
    put(obs.orderBy("_obs").select("_name"), COLUMNS)
    put(var.orderBy("_var").select("_name"), ROWS)
    placed = m.x.join(obs.select(m.obs_key, "_obs"), m.obs_key).join(var.select(m.var_key, "_var"), m.var_key)
    placed = materialize(placed.select("_obs", "_var", F.col(m.value).cast("double").alias("_value")))
    seen = placed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("_value") == F.floor("_value")), F.lit(True)).alias("whole")).first()
    number = F.col("_value").cast("bigint") if seen["whole"] else F.col("_value")
    body = placed.select(F.concat_ws(" ", (F.col("_var") + 1).cast("string"), (F.col("_obs") + 1).cast("string"), number.cast("string")).alias("value"))
    head = [(BANNER.format(field="integer" if seen["whole"] else "real"),), (f"{var.count()} {obs.count()} {seen['n']}",)]
    # the first part of a union is the first task's
    put(spark.createDataFrame(head, "value string").coalesce(1).unionByName(body), MATRIX)
