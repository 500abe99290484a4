"""Parquet output, checked by reading it back."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from sluice.functions.types import type_name

# Rows per row group, compression names, codec of each.
ROW_GROUP_ROWS = 122_880
CODECS = {"zstd": "zstd", "snappy": "snappy", "none": "uncompressed"}


@dataclass(frozen=True)
class Written:
    """What a write produced."""

    path: str
    rows: int
    columns: int
    size_bytes: int
    seconds: float
    fields: list[tuple[str, str]] = field(default_factory=list)


def write_parquet(
    df: DataFrame, path: str, compression: str = "zstd", row_group_size: int = ROW_GROUP_ROWS, mode: str = "errorifexists"
) -> None:
    """Write a Parquet folder with row groups of at most ``row_group_size`` rows."""
    if compression not in CODECS:
        raise ValueError(f"no compression named {compression!r}, choose from {', '.join(CODECS)}")
    if row_group_size < 1:
        raise ValueError("row_group_size must be positive")
    df.write.mode(mode).option("compression", CODECS[compression]).option("parquet.block.row.count.limit", row_group_size).parquet(path)


def write_checked(df: DataFrame, path: str, compression: str = "zstd", row_group_size: int = ROW_GROUP_ROWS, mode: str = "errorifexists") -> Written:
    """Write, then compare the rows that left the plan with the rows in the files.

    Rows are counted while they are written; the read-back count comes from the Parquet footers.
    """
    started = time.monotonic()
    seen = Observation()
    write_parquet(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, compression, row_group_size, mode)
    spark = df.sparkSession
    back = spark.read.parquet(path)
    rows = back.count()
    if rows != seen.get["rows"]:
        raise RuntimeError(f"{path}: wrote {seen.get['rows']} rows, read back {rows}")
    names = [(f.name, type_name(f.dataType)) for f in back.schema.fields]
    return Written(path, rows, len(names), folder_size(spark, path), round(time.monotonic() - started, 2), names)


def folder_size(spark: SparkSession, path: str) -> int:
    """Bytes of the Parquet files below ``path``; only the file listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def output_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: row_count and column_count of written Parquet."""
    back = spark.read.parquet(path)
    return back.agg(F.count("*").alias("row_count"), F.lit(len(back.columns)).alias("column_count"))


def source_path(root: str, organization_id: str, source_id: str) -> str:
    """Folder with the uploaded files of a source."""
    return f"{_bucket(root, organization_id)}/uploads/{_part(source_id)}"


def raw_path(root: str, organization_id: str, source_id: str, version: int, extension: str) -> str:
    """Archived original of a version."""
    return f"{_bucket(root, organization_id)}/raw/{_part(source_id)}/v{int(version)}/data.{_part(extension)}"


def version_path(root: str, organization_id: str, source_id: str, version: int) -> str:
    """Folder of a version: its data, its quarantine and its claims."""
    return f"{_bucket(root, organization_id)}/processed/{_part(source_id)}/v{int(version)}"


def output_path(root: str, organization_id: str, source_id: str, version: int) -> str:
    """Parquet folder of a version."""
    return f"{version_path(root, organization_id, source_id, version)}/data.parquet"


def quarantine_path(root: str, organization_id: str, source_id: str, version: int) -> str:
    """Parquet folder with the rows that a version's conversion cut or left out."""
    return f"{version_path(root, organization_id, source_id, version)}/quarantine.parquet"


def profile_path(root: str, organization_id: str, source_id: str, version: int) -> str:
    """Folder with the kept profile of a version's files."""
    return f"{version_path(root, organization_id, source_id, version)}/profile"


def _bucket(root: str, organization_id: str) -> str:
    return f"{root.rstrip('/')}/org-{_part(organization_id)}"


def _part(name: str) -> str:
    text = str(name)
    if not text or "/" in text or text in (".", ".."):
        raise ValueError(f"not a path part: {name!r}")
    return text
