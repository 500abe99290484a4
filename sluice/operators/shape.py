"""Renaming, safe casts and column listings: one projection, fused into the scan by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.functions.names import column
from sluice.functions.casts import safe_cast
from sluice.functions.types import spark_type, type_class, type_name


def shape(df: DataFrame, column_mapping: dict[str, str] | None = None, type_overrides: dict[str, str] | None = None) -> DataFrame:
    """Rename (old -> new) and cast; the override of the new name wins over that of the old name.

    Unlisted columns stay, the order stays, unknown names are ignored.
    """
    mapping, overrides = column_mapping or {}, type_overrides or {}
    for name in overrides.values():
        spark_type(name)  # reject bad type names before any job
    columns = []
    for field in df.schema.fields:
        value, new = column(field.name), mapping.get(field.name, field.name)
        target = overrides.get(new, overrides.get(field.name))
        columns.append((safe_cast(value, field.dataType, target) if target else value).alias(new))
    return df.select(columns)


def rename(df: DataFrame, column_mapping: dict[str, str]) -> DataFrame:
    return shape(df, column_mapping=column_mapping)


def cast(df: DataFrame, type_overrides: dict[str, str]) -> DataFrame:
    return shape(df, type_overrides=type_overrides)


def describe_columns(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, class. No data is read."""
    rows = [(i, f.name, type_name(f.dataType), type_class(f.dataType)) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, class string")
