"""Column profiles.

Counts, null counts, ranges and format shares of all columns come from one pass without a shuffle
of rows; exact distinct counts take one shuffle of (column, value) pairs, combined map-side, per
type family, so that every column is read once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sluice.functions.casts import safe_cast
from sluice.functions.formats import STRING_FORMATS, format_choice, format_test
from sluice.functions.names import column, literal, quoted
from sluice.functions.types import type_class, type_name

# Default and largest sample, values shown per column, rows of the head sample.
SAMPLE_ROWS = 1000
MAX_SAMPLE_ROWS = 10_000
SAMPLE_VALUES = 5
HEAD_ROWS = 100

# Sparse columns that get a read of their own for their first values.
OWN_READS = 4

# Columns per aggregate, to keep the generated code compilable on wide tables.
COLUMNS_PER_PASS = 100


def sample(df: DataFrame, sample_size: int = SAMPLE_ROWS, order_by: list[str] | None = None) -> DataFrame:
    """The first rows; with ``order_by`` the first in that order. More than 10,000 are refused."""
    if not 0 < sample_size <= MAX_SAMPLE_ROWS:
        raise ValueError(f"sample_size must lie between 1 and {MAX_SAMPLE_ROWS}")
    return (df.orderBy(*map(column, order_by)) if order_by else df).limit(sample_size)


def uniform_sample(df: DataFrame, sample_size: int = SAMPLE_ROWS, keys: list[str] | None = None) -> DataFrame:
    """Rows drawn evenly from all of them: those with the smallest hashes of their ``keys``, by default of all columns.

    Each task keeps its smallest ``sample_size`` only, and the tasks' rows merge into the smallest of all, so the sample
    is the same whatever the partitions and whenever it is taken. Rows alike in their keys are alike in their hash.
    """
    if not 0 < sample_size <= MAX_SAMPLE_ROWS:
        raise ValueError(f"sample_size must lie between 1 and {MAX_SAMPLE_ROWS}")
    cells = [F.coalesce(column(c).cast("string"), F.lit("\u0000")) for c in keys or df.columns]
    return df.withColumn("_hash", F.md5(F.concat_ws("\u0001", *cells))).orderBy("_hash").limit(sample_size).drop("_hash")


def held_sample(df: DataFrame, sample_size: int = SAMPLE_ROWS, order_by: list[str] | None = None) -> DataFrame:
    """The sample, read once for many uses.

    It passes the driver, as 10,000 rows are its fixed bound: without an order only as many files
    are opened as needed, where a limit inside a plan would read from all of them.
    """
    return df.sparkSession.createDataFrame(sample(df, sample_size, order_by).collect(), df.schema)


def head(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """The first 100 rows."""
    return sample(df, HEAD_ROWS, order_by)


def totals(df: DataFrame) -> DataFrame:
    """One row: total_rows, total_columns."""
    return df.agg(F.count("*").alias("total_rows"), F.lit(len(df.columns)).alias("total_columns"))


def column_stats(df: DataFrame, columns: list[str] | None = None, formats: bool = True) -> DataFrame:
    """One row per column from one pass: position, name, type, row and null counts, range, format.

    ``min_value``/``max_value`` hold numeric ranges as doubles, ``min_text``/``max_text`` temporal
    ones as text. ``detected_format`` looks at all non-null values of text columns.
    """
    places = {c: i for i, c in enumerate(df.columns, 1)}
    chosen = columns if columns is not None else df.columns
    parts = [
        _stats_pass(df, [(places[c], df.schema[c]) for c in chosen[at : at + COLUMNS_PER_PASS]], formats)
        for at in range(0, len(chosen), COLUMNS_PER_PASS)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _stats_pass(df: DataFrame, fields: list[tuple[int, T.StructField]], formats: bool) -> DataFrame:
    # SQL text, because tables may have thousands of columns and text reaches the planner in one call.
    cells, measures, records = [], ["count(*) AS n"], []
    for at, field in fields:
        kind = type_class(field.dataType)
        low = high = low_text = high_text = found = "NULL"
        cells.append(f"{quoted(field.name)} AS c{at}")
        measures.append(f"count(c{at}) AS filled{at}")
        if kind in ("numeric", "temporal"):
            measures += [f"min(c{at}) AS min{at}", f"max(c{at}) AS max{at}"]
        if kind == "numeric":
            low, high = f"min{at}", f"max{at}"
        elif kind == "temporal":
            low_text, high_text = f"min{at}", f"max{at}"
        elif kind == "text" and formats:
            # Columns of their own, because an aggregate repeats its argument in its code.
            cells += [f"{format_test(quoted(field.name), f)} AS {f}{at}" for f in STRING_FORMATS]
            measures += [f"count_if({f}{at}) AS {f}_n{at}" for f in STRING_FORMATS]
            found = format_choice({f: f"{f}_n{at} / nullif(filled{at}, 0)" for f in STRING_FORMATS})
        records.append(
            f"named_struct('position', {at}, 'name', {literal(field.name)}, 'inferred_type', {literal(type_name(field.dataType))}, 'class', '{kind}',"
            f" 'row_count', n, 'null_count', n - filled{at}, 'nullable', n > filled{at},"
            f" 'min_value', CAST({low} AS DOUBLE), 'max_value', CAST({high} AS DOUBLE),"
            f" 'min_text', CAST({low_text} AS STRING), 'max_text', CAST({high_text} AS STRING), 'detected_format', CAST({found} AS STRING))"
        )
    stats = df.selectExpr(cells).agg(*map(F.expr, measures))
    return stats.selectExpr(f"inline(array({', '.join(records)}))")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: name, null_count, nullable."""
    return column_stats(df, columns, formats=False).select("name", "null_count", "nullable")


def numeric_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column: name, min_value, max_value."""
    chosen = _of_class(df, columns, "numeric")
    return column_stats(df, chosen).select("name", "min_value", "max_value")


def temporal_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per temporal column: name, min_value, max_value, as text."""
    chosen = _of_class(df, columns, "temporal")
    return column_stats(df, chosen).select("name", F.col("min_text").alias("min_value"), F.col("max_text").alias("max_value"))


def detected_formats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per text column: name, detected_format (email, url, phone, uuid or NULL)."""
    chosen = _of_class(df, columns, "text")
    return column_stats(df, chosen).select("name", "detected_format")


def _of_class(df: DataFrame, columns: list[str] | None, wanted: str) -> list[str]:
    chosen = [f.name for f in df.schema.fields if type_class(f.dataType) == wanted and (columns is None or f.name in columns)]
    if not chosen:
        raise ValueError(f"no {wanted} column")
    return chosen


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column: position, name, unique_count. NULL is no value.

    Exact counts turn each family of columns into (position, value) rows; equal values combine in
    every task before the shuffle, so a frequent value costs one row per task.
    """
    places = {c: i for i, c in enumerate(df.columns, 1)}
    chosen = columns if columns is not None else df.columns
    if approximate:
        counts = df.agg(*[F.approx_count_distinct(column(c)).alias(f"c{places[c]}") for c in chosen])
        records = [f"named_struct('position', {places[c]}, 'name', {literal(c)}, 'unique_count', c{places[c]})" for c in chosen]
        return counts.selectExpr(f"inline(array({', '.join(records)}))")
    families: dict[str, list[str]] = {}
    for name in chosen:
        value, family = _groupable(quoted(name), df.schema[name].dataType)
        families.setdefault(family, []).append(f"named_struct('position', {places[name]}, 'value', {value})")
    counted = None
    for cells in families.values():
        pairs = df.selectExpr(f"inline(array({', '.join(cells)}))").where("value IS NOT NULL")
        part = pairs.distinct().groupBy("position").agg(F.count("*").alias("unique_count"))
        counted = part if counted is None else counted.unionAll(part)
    # A column without any value has no pair; the list of columns brings it back.
    names = df.sparkSession.createDataFrame([(places[c], c) for c in chosen], "position int, name string")
    return names.join(F.broadcast(counted), "position", "left").select("position", "name", F.coalesce("unique_count", F.lit(0)).alias("unique_count"))


def _groupable(value: str, dtype: T.DataType) -> tuple[str, str]:
    """The value (SQL) under a common type of its family."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"CAST({value} AS BIGINT)", "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"CAST({value} AS DOUBLE)", "double"
    if isinstance(dtype, T.MapType):
        return f"to_json(sort_array(map_entries({value})))", "string"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return f"CAST({value} AS STRING)", "string"
    return value, dtype.simpleString()


def sample_values(df: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None, n: int = SAMPLE_VALUES) -> DataFrame:
    """The first ``n`` non-null values of each column as text rows: name, position, sample_value."""
    values = first_values(df, columns if columns is not None else df.columns, order_by, n)
    rows = values.select("name", F.posexplode("sample_values").alias("at", "sample_value"))
    return rows.select("name", (F.col("at") + 1).alias("position"), "sample_value")


def first_values(
    df: DataFrame,
    columns: list[str],
    order_by: list[str] | None,
    n: int,
    read: Callable[[Column, T.DataType], Column] | None = None,
    head_rows: int | None = None,
) -> DataFrame:
    """One row per column: name and, as ``sample_values``, what ``read`` makes of its first non-null values.

    By default they are read as text. The first few rows usually hold enough values of every
    column: one top-k read. Columns that are still short get a top-k read of their own, in one job; if they
    are many, one pass ranks the values of all of them, cut to the first in each task.
    """
    read = read or (lambda value, dtype: safe_cast(value, dtype, "VARCHAR"))
    spark, keys, size = df.sparkSession, [column(k) for k in order_by or []], head_rows or 4 * n
    reads = {c: F.when(column(c).isNotNull(), read(column(c), df.schema[c].dataType)).alias(c) for c in columns}
    kind = df.select(reads[columns[0]]).schema[0].dataType
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("sample_values", T.ArrayType(kind))])

    def top(condition: Column, values: list[Column], rows: int) -> DataFrame:
        chosen = df.where(condition)
        return (chosen.orderBy(*keys) if keys else chosen).select(values).limit(rows)

    first = top(F.lit(True), list(reads.values()), size).collect()
    held = {name: [row[i] for row in first if row[i] is not None][:n] for i, name in enumerate(columns)}
    short = [name for name in columns if len(held[name]) < n and len(first) == size]
    if len(short) > OWN_READS:
        cells = [F.struct(F.lit(i).alias("at"), reads[c].alias("value")) for i, c in enumerate(short)]
        order = [k.alias(f"key{i}") for i, k in enumerate(keys or [F.monotonically_increasing_id()])]
        rows = df.select(*order, F.inline(F.array(*cells))).where("value IS NOT NULL")
        rank = F.row_number().over(Window.partitionBy("at").orderBy(*[f"key{i}" for i in range(len(order))]))
        parts = [rows.select("at", "value", rank.alias("rank")).where(F.col("rank") <= n).orderBy("at", "rank")]
    else:
        parts = [top(column(c).isNotNull(), [F.lit(i).alias("at"), reads[c].alias("value")], n) for i, c in enumerate(short)]
    if keys and len(parts) > 1:
        # Every part scans the table anyway: one job for all of them.
        parts = [functools.reduce(DataFrame.unionAll, parts)]
    found = [row for part in parts for row in part.collect()]
    held.update({name: [row.value for row in found if row["at"] == i] for i, name in enumerate(short)})
    return spark.createDataFrame([(name, held[name]) for name in columns], schema)


def profile(
    df: DataFrame,
    sample_size: int | None = None,
    order_by: list[str] | None = None,
    approximate: bool = False,
    values: int = SAMPLE_VALUES,
    formats_of_samples: bool | None = None,
) -> DataFrame:
    """The full profile, one row per column.

    Works on the whole table, or on the first ``sample_size`` rows. With ``values`` > 0 the first
    non-null values are added as ``sample_values``; for samples (or with ``formats_of_samples``)
    they alone decide the format, elsewhere all values do.
    """
    rows = df if sample_size is None else held_sample(df, sample_size, order_by)
    stats = column_stats(rows)
    unique = distinct_counts(rows, approximate=approximate).select("position", "unique_count")
    out = stats.join(F.broadcast(unique), "position")
    if values:
        out = out.join(F.broadcast(first_values(rows, df.columns, order_by, values)), "name", "left")
        if formats_of_samples if formats_of_samples is not None else sample_size is not None:
            shares = {f: f"size(filter(sample_values, v -> {format_test('v', f)})) / nullif(size(sample_values), 0)" for f in STRING_FORMATS}
            out = out.withColumn("detected_format", F.expr(f"if(class = 'text', {format_choice(shares)}, NULL)"))
    return out.orderBy("position")

