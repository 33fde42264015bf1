"""Files that other programs read: GeoParquet with its footer key, and one GeoJSON document from parallel parts.

Tasks write to the target's file system through Arrow, so the path must be one that every executor reaches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sliceweave.functions import geometry as G

# Fixed values of the GeoParquet format.
GEO_KEY, GEO_VERSION, ENCODING = "geo", "1.0.0", "WKB"
#: Columns that tell the writer of a row's geometry and are not written.
KIND, BOX = "_geo_kind", "_geo_box"
#: Bytes copied at once.
CHUNK = 1 << 22


def file_system(path: str):
    """The Arrow file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def geo_metadata(column: str, kinds: set[str], box: list[float] | None) -> str:
    about = {"encoding": ENCODING, "geometry_types": sorted(kinds), "crs": None} | ({"bbox": box} if box else {})
    return json.dumps({"version": GEO_VERSION, "primary_column": column, "columns": {column: about}})


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str


class GeoParquetFiles(DataSource):
    """Sink ``geoparquet``: a file per task with the ``geo`` key in its footer, moved to its name when all tasks are done."""

    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def writer(self, schema, overwrite):
        return GeoParquetWriter(self.options["path"], self.options.get("geometry", "geometry"), uuid.uuid4().hex)


class GeoParquetWriter(DataSourceArrowWriter):
    def __init__(self, path: str, column: str, run: str):
        self.path, self.column, self.run = path, column, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        context = TaskContext.get()
        files, top = file_system(self.path)
        name = f"{top}/_temporary-{self.run}/{context.partitionId()}-{context.taskAttemptId()}.parquet"
        files.create_dir(name.rsplit("/", 1)[0], recursive=True)
        writer, kinds, box = None, set(), None
        try:
            for batch in iterator:
                kinds |= {k for k in batch.column(KIND).unique().to_pylist() if k}
                for b in batch.column(BOX).drop_null().to_pylist():
                    box = b if box is None else [*map(min, box[:2], b[:2]), *map(max, box[2:], b[2:])]
                plain = batch.drop_columns([KIND, BOX])
                if writer is None:
                    writer = pq.ParquetWriter(name, plain.schema, filesystem=files)
                writer.write_batch(plain)
            if writer is not None:
                writer.add_key_value_metadata({GEO_KEY: geo_metadata(self.column, kinds, box)})
        finally:
            if writer is not None:
                writer.close()
        return Written(context.partitionId(), name if writer is not None else "")

    def commit(self, messages: list[Written | None]) -> None:
        files, top = file_system(self.path)
        for m in messages:
            if m is not None and m.file:
                files.move(m.file, f"{top}/part-{m.part:05d}-{self.run}.parquet")
        self._clear(files, top)
        with files.open_output_stream(f"{top}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, files, top: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{top}/_temporary-{self.run}").type != fs.FileType.NotFound:
            files.delete_dir(f"{top}/_temporary-{self.run}")


def ready_to_write(spark: SparkSession, path: str, mode: str) -> bool:
    """Whether to write, after what ``mode`` asks for when the path is there."""
    if mode not in ("error", "overwrite", "append", "ignore"):
        raise ValueError(f"unknown mode {mode}")
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(p):
        if mode == "error":
            raise FileExistsError(path)
        if mode == "overwrite":
            files.delete(p, True)
        return mode != "ignore"
    return True


def write_with_footer(df: DataFrame, wkb: DataFrame, path: str, mode: str) -> None:
    """``wkb`` is ``df`` with its geometry as well-known binary beside the kind and box of each."""
    spark = df.sparkSession
    if not ready_to_write(spark, path, mode):
        return
    if df.isEmpty():
        # a table without rows still has its columns
        wkb = wkb.coalesce(1)
    spark.dataSource.register(GeoParquetFiles)
    wkb.write.format("geoparquet").option("path", path).mode("append").save()


def geo_columns(df: DataFrame, to_wkb) -> DataFrame:
    g = F.col("geometry")
    b = G.bounds(g)
    deep = F.exists(F.flatten(G.rings(g)), lambda v: v["z"].isNotNull() & ~F.isnan(v["z"]))
    kind = F.when(~G.is_empty(g), F.concat(g["kind"], F.when(deep, " Z").otherwise("")))
    box = F.when(~G.is_empty(g), F.array(b["xmin"], b["ymin"], b["xmax"], b["ymax"]))
    return df.withColumns({KIND: kind, BOX: box}).withColumn("geometry", to_wkb("geometry"))


def join_parts(spark: SparkSession, parts: str, path: str) -> None:
    """One file at ``path`` from the parts of a folder in the order of their names, copied by a task and moved when whole."""
    from pyspark.sql.types import LongType, StructField, StructType

    beside = f"{path}.{uuid.uuid4().hex}"

    def copy(frames):
        from pyarrow import fs

        for frame in frames:
            if len(frame):
                source, top = file_system(parts)
                target, out = file_system(beside)
                names = sorted(f.path for f in source.get_file_info(fs.FileSelector(top)) if f.is_file and f.base_name.startswith("part-"))
                size = 0
                with target.open_output_stream(out) as sink:
                    for name in names:
                        with source.open_input_stream(name) as stream:
                            while data := stream.read(CHUNK):
                                sink.write(data)
                                size += len(data)
                yield frame.__class__({"size": [size]})

    spark.range(1).coalesce(1).mapInPandas(copy, StructType([StructField("size", LongType())])).collect()
    jvm = spark._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    files = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(old, new):
        raise OSError(f"{beside} could not be moved to {path}")
    files.delete(jvm.org.apache.hadoop.fs.Path(parts), True)
