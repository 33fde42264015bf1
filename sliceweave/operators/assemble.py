"""Merged cells from chains, and every other cell as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions.scalar import column_or_default
from sliceweave.operators.matrix import Matrix
from sliceweave.operators.position import with_position
from sliceweave.session import materialize


def _fold(values, fn):
    return F.aggregate(F.transform("m", values), F.lit(0.0), lambda a, v: a + v, fn)


def assemble(cells: DataFrame, chain_table: DataFrame, neuron_types: list[str]) -> DataFrame:
    """Obs rows of the merged object.

    One row per chain (summed counts and areas, mean coordinates, most frequent branch label, the
    section of the member with most counts) and one per cell in no chain. Optional inputs:
    ``branchlabel, spot_class, total_counts, cell_area, raw_x, raw_y``. A chain's rows are few, so
    they are folded as one sorted list, which also fixes the order of floating-point sums.
    """
    raw = {"raw_x", "raw_y"} <= set(cells.columns)
    src = cells.select(
        F.col("pos").cast("long").alias("pos"), F.col("sampleid").cast("string").alias("sampleid"),
        F.col("cell_id").cast("string").alias("cell_id"), F.col("final_annot").cast("string").alias("final_annot"),
        column_or_default(cells, "branchlabel", "NA", "string").alias("branchlabel"),
        column_or_default(cells, "spot_class", "NA", "string").alias("spot_class"),
        column_or_default(cells, "total_counts", 0.0, "double").alias("total_counts"),
        column_or_default(cells, "cell_area", 0.0, "double").alias("cell_area"),
        *[F.col(c).cast("double").alias(c) for c in ("warp_x", "warp_y", "warp_z")],
        *([F.col(c).cast("double").alias(c) for c in ("raw_x", "raw_y")] if raw else []),
    )
    members = chain_table.select("chain", F.explode("members").alias("pos"))
    m = F.array_sort(F.collect_list(F.struct(*src.columns))).alias("m")
    grouped = src.join(members, "pos").groupBy("chain").agg(
        m, F.expr("mode(branchlabel, true)").alias("branchlabel"), F.countDistinct("sampleid").alias("n_sections"))

    n = F.size("m")
    total = lambda c: _fold(lambda v: v[c], lambda s: s)
    mean = lambda c: _fold(lambda v: v[c], lambda s: s / n)
    most = F.array_max(F.transform("m", lambda v: v["total_counts"]))
    any_count = F.exists("m", lambda v: v["total_counts"] != 0)
    rep = F.when(any_count, F.filter("m", lambda v: v["total_counts"] == most)[0]).otherwise(F.col("m")[0])
    joined = lambda c: F.array_join(F.transform("m", lambda v: v[c].cast("string")), ",")
    coords = ["warp_x", "warp_y", "warp_z"] + (["raw_x", "raw_y"] if raw else [])
    merged = grouped.select(
        F.col("chain").alias("source_pos"), F.lit("neuron").alias("cell_class"), F.lit(True).alias("is_merged"),
        n.cast("long").alias("chain_length"), F.col("n_sections").cast("long").alias("n_sections"),
        F.col("m")[0]["final_annot"].alias("final_annot"), "branchlabel", F.lit("merged_neuron").alias("spot_class"),
        *[mean(c).alias(c) for c in coords], total("cell_area").alias("total_cell_area"),
        mean("cell_area").alias("mean_cell_area"), total("total_counts").alias("total_counts"),
        rep["sampleid"].alias("sampleid"), joined("sampleid").alias("sampleid_list"),
        joined("cell_id").alias("cell_id_list"), joined("pos").alias("block_pos_list"))
    one = F.lit(1).cast("long")
    is_neuron = F.coalesce(F.col("final_annot").isin(*neuron_types), F.lit(False))
    single = src.join(members.select("pos"), "pos", "left_anti").select(
        F.col("pos").alias("source_pos"), F.when(is_neuron, "neuron").otherwise("non-neuron").alias("cell_class"),
        F.lit(False).alias("is_merged"), one.alias("chain_length"), one.alias("n_sections"), "final_annot",
        "branchlabel", "spot_class", *coords, F.col("cell_area").alias("total_cell_area"),
        F.col("cell_area").alias("mean_cell_area"), "total_counts", "sampleid",
        F.col("sampleid").alias("sampleid_list"), F.col("cell_id").alias("cell_id_list"),
        F.col("pos").cast("string").alias("block_pos_list"))
    return merged.unionByName(single)


def name_rows(obs: DataFrame) -> DataFrame:
    """Add ``obs_name``: ``merged_i`` for chains and ``cell_j`` for the rest, both in position order."""
    merged = with_position(obs.filter("is_merged"), ["source_pos"], "rank")
    single = with_position(obs.filter("not is_merged"), ["source_pos"], "rank")
    named = [merged.withColumn("obs_name", F.format_string("merged_%d", "rank")),
             single.withColumn("obs_name", F.format_string("cell_%d", "rank"))]
    return named[0].unionByName(named[1]).drop("rank")


def assemble_matrix(m: Matrix, cells: DataFrame, chain_table: DataFrame, neuron_types: list[str]) -> Matrix:
    """The merged object as a matrix keyed by ``source_pos``: chain rows summed, others as they are.

    Only entries of chain members are regrouped; the others pass through under their own
    position, which needs no shuffle of theirs.
    """
    obs = materialize(assemble(cells, chain_table, neuron_types))
    members = chain_table.select("chain", F.explode("members").alias("_pos"))
    x = m.x.withColumnRenamed(m.obs_key, "_pos")
    tagged = x.join(members, "_pos", "left")
    inside = tagged.filter("chain is not null").groupBy(F.col("chain").alias("source_pos"), m.var_key).agg(
        F.sum(m.value).alias(m.value))
    outside = tagged.filter("chain is null").select(F.col("_pos").alias("source_pos"), m.var_key, m.value)
    return Matrix(obs, m.var, inside.unionByName(outside), "source_pos", m.var_key, m.value)
