"""Key, missing-value and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts a delimited-table reader treats as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Micron per pixel of the full-resolution image, and its reciprocal.
MICRON_PER_PIXEL = 0.2125
PIXEL_PER_MICRON = 4.70588235294117647058


def missing_to_null(value: Column) -> Column:
    return F.when(value.isin(*MISSING_TEXTS), F.lit(None)).otherwise(value)


def string_key(value: Column, missing: str = "match") -> Column:
    """Join key as text.

    ``match`` gives missing keys the text ``nan``, so that they meet each other as they do after
    a cast to string; ``never`` leaves them null, which meets nothing.
    """
    if missing not in ("match", "never"):
        raise ValueError(f"unknown missing-key mode {missing!r}")
    text = value.cast("string")
    return F.coalesce(text, F.lit("nan")) if missing == "match" else text


def decode_bytes(df: DataFrame, *columns: str) -> DataFrame:
    """Decode the named columns from UTF-8 where the schema says they are binary."""
    binary = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.BinaryType)]
    return df.withColumns({c: F.decode(F.col(c), "UTF-8") for c in binary}) if binary else df


def first_present(df: DataFrame, candidates: list[str]) -> str:
    """First of the candidate columns that the table has, in the order given."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {candidates} is a column; the table has {df.columns}")


def column_or_default(df: DataFrame, name: str, default, dtype: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(default)).cast(dtype)


def sorted_json(df: DataFrame, name: str) -> Column:
    """JSON text of a nested column with keys in sorted order at every level."""

    def sort_keys(value: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StructType):
            fields = sorted(dtype.fields, key=lambda f: f.name)
            built = F.struct(*[sort_keys(value[f.name], f.dataType).alias(f.name) for f in fields])
            return F.when(value.isNotNull(), built)
        if isinstance(dtype, T.ArrayType):
            return F.transform(value, lambda v: sort_keys(v, dtype.elementType))
        if isinstance(dtype, T.MapType):
            entries = F.array_sort(F.map_entries(F.transform_values(value, lambda _, v: sort_keys(v, dtype.valueType))))
            return F.map_from_entries(entries)
        return value

    return F.to_json(sort_keys(F.col(name), df.schema[name].dataType), {"ignoreNullFields": "false"})


def json_scalars(df: DataFrame, skip: tuple[str, ...] = ("geometry",)) -> DataFrame:
    """Replace nested property columns by their sorted JSON text."""
    nested = [
        f.name for f in df.schema.fields
        if f.name not in skip and isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
    ]
    return df.withColumns({c: sorted_json(df, c) for c in nested}) if nested else df
