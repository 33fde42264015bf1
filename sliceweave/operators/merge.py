"""Keyed merges, subsets, splits and unions of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceweave.functions.scalar import first_present, string_key

HOW = ("left", "right", "outer", "inner")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the stated order.

    ``min_by`` over the whole row keeps the map-side combine that a ranking window lacks, so a
    key with a third of the rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def fill_missing(df: DataFrame, mode: str, text: str | None, columns: list[str] | None = None) -> DataFrame:
    """Fill nulls: ``all`` columns (as text), only ``text`` columns, or ``none``."""
    if mode == "none" or text is None:
        return df
    if mode not in ("all", "text"):
        raise ValueError(f"unknown fill mode {mode!r}")
    names = set(df.columns if columns is None else columns)
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
        if field.name in names and not nested and (mode == "all" or isinstance(field.dataType, T.StringType)):
            col = F.coalesce(col.cast("string"), F.lit(text)).alias(field.name)
        out.append(col)
    return df.select(*out)


def merge(
    left: DataFrame,
    right: DataFrame,
    left_on: list[str],
    right_on: list[str],
    how: str = "left",
    values: list[str] | None = None,
    dedup_order: list[Column] | None = None,
    fill: str = "none",
    na: str | None = None,
    missing_keys: str = "match",
) -> DataFrame:
    """Merge two tables on text keys.

    Columns both sides share get ``_x``/``_y`` endings, except keys of the same name, which stay
    one column. Give ``dedup_order`` to keep only the first right row of each key; without it
    repeated right keys multiply rows.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    if not left_on or len(left_on) != len(right_on):
        raise ValueError("left and right keys must be given in equal number")
    absent = [k for k in left_on if k not in left.columns] + [k for k in right_on if k not in right.columns]
    if absent:
        raise KeyError(f"key columns not found: {absent}")
    if values is not None:
        right = right.select(*dict.fromkeys([*right_on, *values]))
    right = right.withColumns({k: string_key(F.col(k), missing_keys) for k in right_on})
    if dedup_order is not None:
        right = first_per_key(right, right_on, dedup_order)
    left = left.withColumns({k: string_key(F.col(k), missing_keys) for k in left_on})

    shared_keys = {l for l, r in zip(left_on, right_on) if l == r}
    clash = (set(left.columns) & set(right.columns)) - shared_keys
    l_name = {c: f"{c}_x" if c in clash else c for c in left.columns}
    r_name = {c: f"{c}_y" if c in clash else c for c in right.columns}
    lt = left.select(*[F.col(c).alias(f"l.{c}") for c in left.columns])
    rt = right.select(*[F.col(c).alias(f"r.{c}") for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(f"`l.{a}`") == F.col(f"`r.{b}`") for a, b in zip(left_on, right_on)])
    joined = lt.join(rt, on, how)
    out = [
        (F.coalesce(F.col(f"`l.{c}`"), F.col(f"`r.{c}`")) if c in shared_keys else F.col(f"`l.{c}`")).alias(l_name[c])
        for c in left.columns
    ]
    out += [F.col(f"`r.{c}`").alias(r_name[c]) for c in right.columns if c not in shared_keys]
    return fill_missing(joined.select(*out), fill, na)


def add_property(features: DataFrame, metadata: DataFrame, candidates: list[str], key: str,
                 values: list[str] | None = None) -> DataFrame:
    """Left merge of metadata onto features by the first candidate property the features carry."""
    return merge(features, metadata, [first_present(features, candidates)], [key], "left", values)


def subset_by_ids(df: DataFrame, ids: DataFrame, candidates: list[str] = ("cell_id", "index")) -> DataFrame:
    """Rows whose id occurs in a one-column id list."""
    column = first_present(df, list(candidates))
    wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("_wanted"))
    return df.join(wanted, F.col(column).cast("string") == F.col("_wanted"), "left_semi")


def keep_labels(df: DataFrame, label: str, values: list[str], invert: bool = False) -> DataFrame:
    """Rows whose label is (or with ``invert`` is not) in a list; a missing label counts as not in it."""
    listed = F.coalesce(F.col(label).cast("string").isin(*values), F.lit(False))
    return df.filter(~listed if invert else listed)


def filter_equals(df: DataFrame, condition: str) -> DataFrame:
    """Filter by ``column=value``, compared as text; only the first ``=`` separates."""
    column, sep, value = condition.partition("=")
    if not sep:
        raise ValueError(f"expected column=value, got {condition!r}")
    return df.filter(F.col(column).cast("string") == F.lit(value))


def split_groups(df: DataFrame, column: str, condition: str | None = None) -> DataFrame:
    """Rows that a per-group write would produce: filtered, and without a missing group."""
    kept = df if condition is None else filter_equals(df, condition)
    return kept.filter(F.col(column).isNotNull())


def stack_tables(tables: list[DataFrame], join: str = "outer") -> DataFrame:
    """Union in input order; ``outer`` keeps every column, ``inner`` only the common ones."""
    if join == "outer":
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    if join != "inner":
        raise ValueError(f"join must be outer or inner, got {join!r}")
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return reduce(lambda a, b: a.unionByName(b), [t.select(*common) for t in tables])


def section_z(sections: DataFrame, order: str, start: float = 0.0, step: float = 12.0, by: list[str] = ()) -> DataFrame:
    """Depth per section from its place among the sections present (a missing one leaves no gap).

    ``sections`` holds one row per section, so the ranking window is small even without ``by``.
    """
    window = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    rank = F.row_number().over(window) - 1
    return sections.withColumn("warp_z", F.lit(float(start)) + rank * F.lit(float(step)))


def point_columns(df: DataFrame, prefix: str = "warp_", with_z: bool | None = None) -> DataFrame:
    """Turn a point geometry column into coordinate columns.

    The z column appears when any row has a z; pass ``with_z`` to skip looking.
    """
    v = F.col("geometry")["parts"][0][0][0]
    if with_z is None:
        with_z = not df.filter(v["z"].isNotNull()).isEmpty()
    axes = ("x", "y", "z") if with_z else ("x", "y")
    return df.withColumns({prefix + a: v[a] for a in axes}).drop("geometry")


def require_unique(df: DataFrame, column: str) -> DataFrame:
    """Raise when a key repeats, naming up to ten of them; one aggregation, ten rows to the driver."""
    repeated = df.groupBy(column).count().filter("count > 1").limit(10).collect()
    if repeated:
        raise ValueError(f"{column} values are not unique, e.g. {', '.join(str(r[0]) for r in repeated)}")
    return df
