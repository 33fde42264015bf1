"""Labelled matrices and named element stores as folders of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceweave.operators.matrix import Matrix
from sliceweave.sources.tables import write_table


def write_matrix(m: Matrix, path: str, names: str = "first", mode: str = "error") -> None:
    """``obs``, ``var`` and ``x`` as Parquet, and the obs and var tables as delimited text.

    The text tables carry the row name as ``obs_index``/``var_index`` in front or, with
    ``names='last'``, as ``barcode``/``symbol`` at the end.
    """
    m.obs.write.mode(mode).parquet(f"{path}/obs")
    m.var.write.mode(mode).parquet(f"{path}/var")
    m.x.write.mode(mode).parquet(f"{path}/x")
    for df, key, front, back in ((m.obs, m.obs_key, "obs_index", "barcode"), (m.var, m.var_key, "var_index", "symbol")):
        others = [c for c in df.columns if c != (front if names == "first" else back)]
        label = F.col(key).cast("string")
        out = df.select(label.alias(front), *others) if names == "first" else df.select(*others, label.alias(back))
        write_table(out, f"{path}/{'obs' if df is m.obs else 'var'}_table", mode=mode)


def read_matrix(spark: SparkSession, path: str, obs_key: str = "obs_pos", var_key: str = "var_pos", value: str = "value") -> Matrix:
    tables = (spark.read.parquet(f"{path}/{t}") for t in ("obs", "var", "x"))
    return Matrix(*tables, obs_key, var_key, value)


def write_elements(elements: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Store named tables under ``kind/name``, e.g. ``shapes/cell_boundaries``."""
    for name, df in elements.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def read_elements(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The named elements; nothing else in the store is opened."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
