"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins from measured shuffle sizes (so a side is broadcast only when it was
# seen to be small), splits skewed join partitions and merges small ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Step tables of this driver that stand in the shared folder.
STEPS: list[str] = []


def clear_steps(spark: SparkSession) -> None:
    """Delete all step tables of this driver; call it when the results that read them have been written."""
    while STEPS:
        path = spark._jvm.org.apache.hadoop.fs.Path(STEPS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def build_session(app_name: str = "sliceweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, so that its Python functions run wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_sliceweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sliceweave-package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._sliceweave_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without it gets its own folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="sliceweave-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def step_path(spark: SparkSession) -> str:
    """A new place in the shared folder, which :func:`clear_steps` will delete."""
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    STEPS.append(path)
    return path


def materialize(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return a scan of it.

    The lineage ends there, so a lost executor costs only its own tasks. As a columnar table it
    is read with column pruning, and its file sizes tell the planner what may be broadcast.
    ``rows_per_file`` keeps files of very wide rows small, since readers take many rows at once.
    """
    path = step_path(df.sparkSession)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
