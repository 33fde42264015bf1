"""Explicit row positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sliceweave.session import materialize


def with_position(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Number rows 0, 1, 2, ... in the given order without a single-task sort.

    Rows are range-partitioned and sorted per partition, stored once, and each partition's
    numbers are shifted by the rows before it. The stored table makes the numbers final: later
    plans read them rather than derive them again. A non-unique order leaves ties to the sort.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(parts.withColumn("_id", F.monotonically_increasing_id()))
    # the id is (partition << 33) + row number in the partition
    split = stored.withColumns({"_p": F.shiftright("_id", 33), "_i": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = split.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition, so this window is as small as the partition count
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = split.join(F.broadcast(offsets), "_p")
    return numbered.withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_id", "_n", "_before")
