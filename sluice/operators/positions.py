"""Removing rows by position.

No row ever gets a global number. Rows behind the last wanted position are set apart at once and
pass through untouched: files further back, or rows with greater keys. In the rest the positions
are translated into (file, row in file) pairs with the row counts of the files, one row each, and
those few pairs are filtered out.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.functions.names import column
from sluice.operators.joins import asof_join
from sluice.session import scratch_dir

# Up to so many matches are broadcast; more are joined by (file, row) with a shuffle.
BROADCAST_POSITIONS = 100_000
# Positions below this are found by a top-k read of the keys instead of a sort of the table.
TOP_POSITIONS = 10_000


def skip_rows(df: DataFrame, positions: list[int] | DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """``df`` without the rows at the 0-based ``positions``, a list or a table with one column; those past the end are ignored.

    The order is that of the files ``df`` reads, or that of ``order_by``, which sources without
    files (databases) need.
    """
    return split_rows(df, positions, order_by)[0]


def skipped_rows(df: DataFrame, positions: list[int] | DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row: how many rows ``skip_rows`` removes."""
    return split_rows(df, positions, order_by)[1].agg(F.count("*").alias("rows_removed"))


def split_rows(df: DataFrame, positions: list[int] | DataFrame, order_by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The kept rows, and one row (file, row) per removed row."""
    spark = df.sparkSession
    if isinstance(positions, DataFrame):
        wanted = positions.select(F.col(positions.columns[0]).cast("long").alias("_position")).where("_position >= 0").distinct()
    else:
        wanted = spark.createDataFrame([(p,) for p in sorted({int(p) for p in positions if p >= 0})], "_position long")
    count, last = wanted.agg(F.count("*"), F.max("_position")).first()
    if not count:
        return df, spark.createDataFrame([], "_sluice_file string, _sluice_row long")
    if order_by is None:
        fields = _file_fields(df)
        front, back = _front_files(df, last)
        source = front if "row_index" in fields else _staged(front, None)
    else:
        front, back = _front_keys(df, last, order_by)
        source = _staged(front, order_by)
    rows = source.select("*", F.col("_metadata.file_path").alias("_sluice_file"), F.col("_metadata.row_index").alias("_sluice_row"))
    splits = [c for c in source.columns if c not in df.columns]
    # Part files are numbered; past 99,999 the numbers get longer.
    runs = [F.col(c) for c in splits] or ([F.col("_sluice_file")] if source is front else [F.length("_sluice_file"), F.col("_sluice_file")])
    targets = _targets(rows, runs, wanted)
    few = F.broadcast(targets) if count <= BROADCAST_POSITIONS else targets
    kept = rows.join(few, ["_sluice_file", "_sluice_row"], "left_anti").drop("_sluice_file", "_sluice_row", *splits)
    return (kept if back is None else kept.unionAll(back)), targets


def _front_files(df: DataFrame, last: int) -> tuple[DataFrame, DataFrame | None]:
    """The first files, in path order, that hold the positions up to ``last``; and the others."""
    paths = sorted(re.sub("^file:///", "file:/", p) for p in df.inputFiles())
    path, taken = F.col("_metadata.file_path"), 1
    while taken < len(paths):
        # A condition on the path keeps the other files out of the scan.
        front = df.where(path <= paths[taken - 1])
        if front.count() > last:
            return front, df.where(path > paths[taken - 1])
        taken *= 8
    return df, None


def _front_keys(df: DataFrame, last: int, order_by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows with keys up to that of position ``last``, and the others."""
    if last >= TOP_POSITIONS:
        return df, None
    key = F.struct(*[column(c).alias(f"k{i}") for i, c in enumerate(order_by)])
    edge = df.select(*map(column, order_by)).orderBy(*map(column, order_by)).limit(last + 1).agg(F.max(key).alias("edge"))
    found = edge.collect()
    if found[0].edge is None:
        return df, None
    bound = df.sparkSession.createDataFrame(found, edge.schema).scalar()
    return df.where(key <= bound), df.where(key > bound)


def _file_fields(df: DataFrame) -> list[str]:
    try:
        return df.select("_metadata").schema["_metadata"].dataType.fieldNames()
    except AnalysisException:
        raise ValueError("rows of this source have no order; give order_by") from None


def _staged(df: DataFrame, order_by: list[str] | None) -> DataFrame:
    """A Parquet copy in which every part file holds rows in the wanted order.

    Sorted output: part files in name order. Scan output: each input split (file, first byte) is
    one run of rows inside one part file, so its place can be read back.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "positions")
    if order_by is not None:
        # The last key splits rows with equal keys over several tasks.
        tied = df.withColumn("_sluice_tie", F.monotonically_increasing_id())
        tied.orderBy(*map(column, order_by), "_sluice_tie").drop("_sluice_tie").write.parquet(path)
    else:
        split = [F.col("_metadata.file_path").alias("_sluice_split"), F.col("_metadata.file_block_start").alias("_sluice_byte")]
        df.select("*", *split).write.parquet(path)
    return spark.read.parquet(path)


def _targets(rows: DataFrame, blocks: list[Column], wanted: DataFrame) -> DataFrame:
    """(file, row) of the wanted positions; ``blocks`` order the runs of rows.

    One row per file or input split reaches the single-task window: about one per 128 MB of input. A position belongs
    to the last run that begins at or before it, found by ``asof_join``: linear in positions and runs.
    """
    names = [f"_block{i}" for i in range(len(blocks))]
    runs = (
        rows.select(*[b.alias(n) for n, b in zip(names, blocks)], "_sluice_file", "_sluice_row")
        .groupBy(*names, "_sluice_file")
        .agg(F.count("*").alias("_count"), F.min("_sluice_row").alias("_first"), F.max("_sluice_row").alias("_last"))
    )
    # A filtered scan has gaps in its file positions.
    whole = F.col("_last") - F.col("_first") + 1 == F.col("_count")
    runs = runs.withColumn("_count", F.when(whole, F.col("_count")).otherwise(F.raise_error("skip rows of a plain scan, or give order_by")))
    before = Window.orderBy(*names, "_sluice_file", "_first").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_offset", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    placed = placed.where("_count > 0").select(F.lit(0).alias("_all"), F.col("_offset").alias("_position"), "_offset", "_count", "_first", "_sluice_file")
    found = asof_join(wanted.withColumn("_all", F.lit(0)), placed, "_position", ["_all"], ["_offset", "_count", "_first", "_sluice_file"])
    inside = F.col("_position") < F.col("_offset") + F.col("_count")
    return found.where(inside).select("_sluice_file", (F.col("_first") + F.col("_position") - F.col("_offset")).alias("_sluice_row"))
