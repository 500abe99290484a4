"""Data-quality warnings about a table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.functions.names import column
from sluice.functions.formats import NULL_PERCENT, NUMERIC_SHARE, looks_numeric
from sluice.functions.types import type_class
from sluice.operators.profile import column_stats, first_values

# The values looked at, those that decide, the positions reported, the message.
VALUES_READ = 100
VALUES_DECIDING = 20
POSITIONS_REPORTED = 10
INCONSISTENT = "Column looks numeric but contains non-numeric values"


def null_warnings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``high_null_percentage``: more than half of the column is NULL."""
    stats = column_stats(df, columns, formats=False)
    percent = F.col("null_count") / F.nullif(F.col("row_count"), F.lit(0)) * 100
    return stats.where(percent > NULL_PERCENT).select(
        F.col("name").alias("column_name"),
        F.lit("high_null_percentage").alias("issue"),
        # format_number rounds half to even on the exact value, like the message it stands for.
        F.concat(F.lit("Column has "), F.format_number(percent, 1), F.lit("% null values")).alias("message"),
    )


def type_warnings(df: DataFrame, order_by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """``type_inconsistency``: most of the first 20 non-null texts are numbers, some of the first 100 not.

    One row per warned column; ``affected_rows`` holds the first 10 offending 1-based positions,
    counted among the non-null values in the order of ``order_by``.
    """
    # All that is read of a value is whether it looks like a number.
    first = first_values(df, _text_columns(df, columns), order_by, VALUES_READ, lambda value, _: looks_numeric(value), 2 * VALUES_READ)
    deciding = F.slice("sample_values", 1, VALUES_DECIDING)
    share = F.size(F.filter(deciding, lambda numeric: numeric)) / F.nullif(F.size(deciding), F.lit(0))
    marked = F.transform("sample_values", lambda numeric, i: F.when(~numeric, (i + 1).cast("bigint")))
    return (
        first.select("name", share.alias("share"), F.filter(marked, lambda at: at.isNotNull()).alias("at"))
        .where((F.col("share") > NUMERIC_SHARE) & (F.size("at") > 0))
        .select(
            F.col("name").alias("column_name"),
            F.lit("type_inconsistency").alias("issue"),
            F.lit(INCONSISTENT).alias("message"),
            F.slice("at", 1, POSITIONS_REPORTED).alias("affected_rows"),
        )
    )


def numeric_text_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Whole-table counterpart: share of number-like texts and count of the others, one pass."""
    chosen = _text_columns(df, columns)
    measures = []
    for i, name in enumerate(chosen):
        numeric = looks_numeric(column(name))
        measures += [F.avg(numeric.cast("int")).alias(f"share{i}"), F.count_if(~numeric).alias(f"other{i}")]
    records = [
        F.struct(F.lit(n).alias("column_name"), F.col(f"share{i}").alias("numeric_share"), F.col(f"other{i}").alias("other_count"))
        for i, n in enumerate(chosen)
    ]
    return df.agg(*measures).select(F.inline(F.array(*records)))


def warnings(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """All warnings: column_name, issue, message, affected_rows."""
    nulls = null_warnings(df).withColumn("affected_rows", F.lit(None).cast("array<bigint>"))
    return nulls.unionByName(type_warnings(df, order_by)) if _text_columns(df, None, required=False) else nulls


def _text_columns(df: DataFrame, columns: list[str] | None, required: bool = True) -> list[str]:
    chosen = [f.name for f in df.schema.fields if type_class(f.dataType) == "text" and (columns is None or f.name in columns)]
    if required and not chosen:
        raise ValueError("no text column")
    return chosen
