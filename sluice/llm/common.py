"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sluice.functions.names import column
from sluice.session import scratch_dir

WORD_BREAK = r"[\x20\x09-\x0D]"
SLICE_ROWS = 256  # rows of an Arrow batch that Python looks at together


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, empty if it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def extended(schema: StructType, more: str) -> StructType:
    """A schema with further columns, given as in SQL."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def settled(df: DataFrame) -> DataFrame:
    """The same rows; the optimizer moves no filter on computed columns below the place where they are computed.

    Moved down, a filter would repeat long expressions on arrays for each of their elements.
    """
    row = F.struct(*[column(c) for c in df.columns])
    return df.select(F.inline(F.array(row)))


def hold(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read again: computed once, and kept if executors go."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_state(name: str, build: Callable[[], object]) -> object:
    """An object that a Python worker keeps between its tasks: automata, caches of pure functions.

    Helpers travel by value, so their own module globals are new in each task; a module made at
    run time is not.
    """
    module = sys.modules.setdefault("_sluice_worker_state", types.ModuleType("_sluice_worker_state"))
    if name not in module.__dict__:
        module.__dict__[name] = build()
    return module.__dict__[name]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, which bounds the Python copies of long texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def without(rows: DataFrame, gone: DataFrame, key: str, limit: int = 2_000_000) -> DataFrame:
    """``rows`` whose ``key``, a number, is not in ``gone``, a written table of keys.

    Up to ``limit`` keys, which are counted, travel to the rows; beyond it both sides are dealt by key.
    """
    few = gone.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(gone) if few else gone, key, "left_anti")


def among(rows: DataFrame, wanted: DataFrame, key: str, limit: int = 2_000_000, how: str = "inner") -> DataFrame:
    """``rows`` joined to a written table with few rows per key, in the same two ways as ``without``."""
    few = wanted.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(wanted) if few else wanted, key, how)


def with_small(df: DataFrame, small: DataFrame, key: str, limit: int = 10_000, salts: int = 32) -> DataFrame:
    """``df`` left joined to a table of one row per key.

    Up to ``limit`` rows, which are counted, the table is broadcast. Beyond it, each of its rows is
    copied once per salt, so that a frequent key is dealt to many tasks. NULL keys match each other.
    """
    names = {c: f"__small_{i}" for i, c in enumerate(small.columns) if c != key}
    right = small.select(column(key).alias("__small_key"), *[column(c).alias(n) for c, n in names.items()])
    on = column(key).eqNullSafe(F.col("__small_key"))
    if small.limit(limit + 1).count() <= limit:
        joined = df.join(F.broadcast(right), on, "left")
    else:
        df = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        right = right.withColumn("__small_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = df.join(right, on & (F.col("__salt") == F.col("__small_salt")), "left").drop("__salt")
    own = [column(c) for c in df.columns if c != "__salt"]
    return joined.select(*own, *[F.col(n).alias(c) for c, n in names.items()])
