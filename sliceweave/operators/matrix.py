"""Labelled sparse matrices as three tables: obs, var and x(obs key, var key, value)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Matrix:
    """``x`` holds the non-zero entries; ``obs_key`` and ``var_key`` name the key columns."""

    obs: DataFrame
    var: DataFrame
    x: DataFrame
    obs_key: str = "obs_pos"
    var_key: str = "var_pos"
    value: str = "value"

    def with_obs(self, obs: DataFrame, restrict: bool = True) -> "Matrix":
        """New obs table; ``restrict`` drops the entries of rows that are gone."""
        x = self.x.join(obs.select(self.obs_key), self.obs_key, "left_semi") if restrict else self.x
        return replace(self, obs=obs, x=x)


def group_sum(x: DataFrame, assignment: DataFrame, obs_key: str, group_key: str, var_key: str, value: str) -> DataFrame:
    """Sum entries over groups of rows.

    The first aggregation runs map-side, so a hot group arrives at the reducers already summed
    per task.
    """
    joined = x.select(obs_key, var_key, value).join(assignment.select(obs_key, group_key), obs_key)
    return joined.groupBy(group_key, var_key).agg(F.sum(value).alias(value))


def filter_by_counts(m: Matrix, min_count: float, keep: bool = False) -> Matrix:
    """Drop cells and genes whose value sum is below ``min_count``.

    ``keep`` filters cells first and then genes on the cells left, and records ``n_counts``;
    otherwise both sums come from the matrix as given.
    """
    cells = m.x.groupBy(m.obs_key).agg(F.sum(m.value).alias("n_counts"))
    obs = m.obs.join(cells, m.obs_key, "left").withColumn("n_counts", F.coalesce("n_counts", F.lit(0)))
    obs = obs.filter(F.col("n_counts") >= min_count)
    x_cells = m.x.join(obs.select(m.obs_key), m.obs_key, "left_semi")
    genes = (x_cells if keep else m.x).groupBy(m.var_key).agg(F.sum(m.value).alias("n_counts"))
    var = m.var.join(genes, m.var_key, "left").withColumn("n_counts", F.coalesce("n_counts", F.lit(0)))
    var = var.filter(F.col("n_counts") >= min_count)
    x = x_cells.join(var.select(m.var_key), m.var_key, "left_semi")
    if not keep:
        obs, var = obs.drop("n_counts"), var.drop("n_counts")
    return replace(m, obs=obs, var=var, x=x)


def subset_labels(m: Matrix, label: str, values: list[str], invert: bool = False) -> Matrix:
    """Rows of the matrix by label; integer labels compare as text."""
    from sliceweave.operators.merge import keep_labels

    return m.with_obs(keep_labels(m.obs, label, values, invert))


def attach_metadata(m: Matrix, metadata: DataFrame, left_on: list[str], right_on: list[str] | None = None,
                    how: str = "left", values: list[str] | None = None, order: list | None = None,
                    na: str = "Unassigned") -> Matrix:
    """Merge a table onto obs: first metadata row per key, text columns filled with ``na``.

    ``_index_`` among the left keys means the obs key itself; the default right key is the first
    metadata column. Only left and inner merges leave every obs row with its matrix row.
    """
    from sliceweave.operators.merge import merge

    if how not in ("left", "inner"):
        raise ValueError("a matrix merge must be left or inner: other kinds make obs rows without matrix rows")
    right_on = right_on or [metadata.columns[0]]
    order = order or [F.col(c) for c in metadata.columns]
    obs = m.obs.withColumns({"_index_": F.col(m.obs_key).cast("string"), "_row_": F.col(m.obs_key)})
    merged = merge(obs, metadata, left_on, right_on, how, values, order, "text", na)
    merged = merged.drop("_index_", m.obs_key, f"{m.obs_key}_x").withColumnRenamed("_row_", m.obs_key)
    return m.with_obs(merged, restrict=how == "inner")
