"""Vectors in blocks: cleaning, packing, and merging of what pairs of blocks find."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceweave.session import materialize

#: Rows of a block of candidates, and queries that are compared with it together.
BLOCK, PACK = 2048, 256
PACKED = "block long, ids binary, rows binary, n int, low array<double>, high array<double>, mat binary"


def clean(df: DataFrame, id_col: str, vec_col: str, also: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows (id, vec) whose vector is whole: not null, without null or non-finite components. ``also`` may ask for more."""
    vec = F.col("vec")
    fine = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.coalesce(fine, F.lit(False)))
    return rows.filter(also(vec)) if also else rows


def width_of(rows: DataFrame) -> int:
    """The longest vector; shorter ones are read as if zeros followed."""
    return rows.agg(F.max(F.size("vec"))).first()[0] or 0


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def moments(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of outer products over all rows, ``width`` x ``width``; tasks add up their own first."""
    def part(frames):
        total = np.zeros((width, width))
        for frame in frames:
            m = matrix(frame["vec"].to_numpy(), width)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(width * width), "v": total.ravel()})

    sums = rows.select("vec").mapInPandas(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(width * width)
    for r in sums.collect():
        out[r["i"]] = r["v"]
    return out.reshape(width, width)


def packed(rows: DataFrame, order: list[str], size: int, width: int, bounds: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows (row, id, vec), range-partitioned by ``order``, put in blocks of at most ``size`` neighbours within a task.

    ``bounds`` gives columns of a block's matrix of which the least and greatest values are kept. Blocks are stored with
    consecutive numbers 0, 1, ... in order.
    """
    def pack(frames):
        held = []

        def block():
            ids, numbers, m = (np.concatenate([h[i] for h in held]) for i in range(3))
            b = bounds(m)
            return pd.DataFrame({"block": [0], "ids": [ids.astype("<i8").tobytes()], "rows": [numbers.astype("<i8").tobytes()], "n": [len(ids)],
                                 "low": [b.min(axis=0)], "high": [b.max(axis=0)], "mat": [m.astype("<f8").tobytes()]})

        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at:at + size]
                while len(part):
                    room = size - sum(len(h[0]) for h in held)
                    take, part = part.iloc[:room], part.iloc[room:]
                    held.append((take["id"].fillna(-1).to_numpy(np.int64), take["row"].to_numpy(np.int64), matrix(take["vec"].to_numpy(), width)))
                    if len(take) == room:
                        yield block()
                        held = []
        if held:
            yield block()

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "id", "vec")
    stored = materialize(ranged.mapInPandas(pack, PACKED).withColumn("_order", F.monotonically_increasing_id()), rows_per_file=64)
    # one row per block of thousands of vectors
    numbers = stored.select("_order").withColumn("block", (F.row_number().over(Window.orderBy("_order")) - 1).cast("long"))
    return stored.drop("block").join(numbers, "_order").drop("_order")


def open_block(ids: bytes, rows: bytes, mat: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, dtype="<i8")
    return ids, np.frombuffer(rows, dtype="<i8"), np.frombuffer(mat, dtype="<f8").reshape(len(ids), width)


FOUND = "qrow long, query_id long, vec_id long, row long, score double"


def merged(found: DataFrame, k: int, best: list[Column]) -> DataFrame:
    """The ``k`` best rows of each query row, ranked from 1; a block gave at most ``k`` for a query."""
    rank = F.row_number().over(Window.partitionBy("qrow").orderBy(*best))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
