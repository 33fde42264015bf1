"""Grid cells for spatial equi-joins.

A box is filed at the level whose cell is at least as large as the box (cells grow by a factor
of four per level), so it touches at most 2 x 2 cells there whatever its size. Probes visit the
levels that occur. Small and huge shapes thus mix without either exploding into many cells, and
dense places with small shapes get small cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels outside this range are clamped: cells from 4^-24 to 4^24, so at most 49 levels occur.
LOWEST, HIGHEST = -24, 24


def level_of(extent: Column) -> Column:
    raw = F.ceil(F.log2(F.greatest(extent, F.lit(4.0**LOWEST))) / 2)
    return F.least(F.greatest(raw, F.lit(LOWEST)), F.lit(HIGHEST)).cast("int")


def cell_size(level: Column) -> Column:
    return F.pow(F.lit(4.0), level.cast("double"))


def cell(value: Column, size: Column) -> Column:
    return F.floor(value / size).cast("long")


def occurring_levels(df: DataFrame, column: str) -> list[int]:
    """Distinct levels; the clamp bounds this to 49 numbers."""
    return sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)


def covered_cells(xmin: Column, ymin: Column, xmax: Column, ymax: Column, size: Column) -> Column:
    """Array of the cells a box touches, to be exploded."""
    return F.flatten(
        F.transform(
            F.sequence(cell(xmin, size), cell(xmax, size)),
            lambda gx: F.transform(
                F.sequence(cell(ymin, size), cell(ymax, size)),
                lambda gy: F.struct(gx.alias("gx"), gy.alias("gy")),
            ),
        )
    )


def file_boxes(df: DataFrame, box: list[str], prefix: str = "_") -> DataFrame:
    """Add a level and one row per touched cell: columns ``_level``, ``_gx``, ``_gy``."""
    xmin, ymin, xmax, ymax = (F.col(c) for c in box)
    leveled = df.withColumn(prefix + "level", level_of(F.greatest(xmax - xmin, ymax - ymin)))
    cells = covered_cells(xmin, ymin, xmax, ymax, cell_size(F.col(prefix + "level")))
    spread = leveled.withColumn(prefix + "c", F.explode(cells))
    return spread.withColumns(
        {prefix + "gx": F.col(prefix + "c.gx"), prefix + "gy": F.col(prefix + "c.gy")}
    ).drop(prefix + "c")


def probe_points(df: DataFrame, x: Column, y: Column, levels: list[int], prefix: str = "_") -> DataFrame:
    """Add the cell of a point at every given level."""
    options = [
        F.struct(
            F.lit(level).alias("level"),
            cell(x, F.lit(math.pow(4.0, level))).alias("gx"),
            cell(y, F.lit(math.pow(4.0, level))).alias("gy"),
        )
        for level in levels
    ]
    if len(options) == 1:
        # no generator needed: plain columns keep the scan, projection and shuffle write in one stage
        names = ("level", "gx", "gy")
        level = levels[0]
        size = F.lit(math.pow(4.0, level))
        return df.withColumns({prefix + n: v for n, v in zip(names, (F.lit(level), cell(x, size), cell(y, size)))})
    spread = df.withColumn(prefix + "c", F.explode(F.array(*options)))
    return spread.withColumns({prefix + n: F.col(f"{prefix}c.{n}") for n in ("level", "gx", "gy")}).drop(prefix + "c")


def overlapping_boxes(df: DataFrame, key: str, on: list[str], box: list[str], carry: list[str], levels: list[int],
                      keep=None) -> DataFrame:
    """Pairs of rows of one table whose boxes overlap, each unordered pair once.

    Carried columns come back with ``_1`` and ``_2`` endings. The smaller box probes the level
    of the larger one; at equal level the smaller key comes first. A pair met in several cells
    is kept only in the cell that holds the lower corner of the overlap. ``keep(a, b)`` may
    restrict pairs by carried columns before the corner test.
    """
    filed = file_boxes(df.select(*dict.fromkeys([key, *on, *box, *carry])), box)
    right = filed.select(*on, F.col("_level").alias("_lv"), "_gx", "_gy",
                         *[F.col(c).alias(f"{c}_2") for c in dict.fromkeys([key, *box, *carry])])
    own = df.select(*dict.fromkeys([key, *on, *box, *carry]))
    own = own.withColumn("_level", level_of(F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1]))))
    own = own.withColumn("_lv", F.explode(F.filter(F.array(*[F.lit(l) for l in levels]), lambda l: l >= F.col("_level"))))
    size = cell_size(F.col("_lv"))
    own = own.withColumn("_c", F.explode(covered_cells(*[F.col(c) for c in box], size)))
    left = own.select(*on, "_lv", F.col("_c.gx").alias("_gx"), F.col("_c.gy").alias("_gy"),
                      F.col("_level").alias("_level_1"),
                      *[F.col(c).alias(f"{c}_1") for c in dict.fromkeys([key, *box, *carry])])
    # rows spread over cells are many times what the planner takes them for, so they must not be broadcast on its estimate
    joined = left.join(right.hint("merge"), [*on, "_lv", "_gx", "_gy"])
    x0, y0, x1, y1 = box
    low_x, low_y = F.greatest(f"{x0}_1", f"{x0}_2"), F.greatest(f"{y0}_1", f"{y0}_2")
    once = (cell(low_x, cell_size(F.col("_lv"))) == F.col("_gx")) & (cell(low_y, cell_size(F.col("_lv"))) == F.col("_gy"))
    ordered = (F.col("_level_1") < F.col("_lv")) | (F.col(f"{key}_1") < F.col(f"{key}_2"))
    overlap = (low_x <= F.least(f"{x1}_1", f"{x1}_2")) & (low_y <= F.least(f"{y1}_1", f"{y1}_2"))
    rule = ordered & overlap & once
    if keep is not None:
        rule = keep(F.col) & rule
    return joined.filter(rule).drop("_lv", "_gx", "_gy", "_level_1")
