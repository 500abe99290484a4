"""SQLite files as a partitioned data source: read-only, disjoint row-id ranges side by side."""

from __future__ import annotations

import glob
import hashlib
import os
import re
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from sluice.session import mounted_path

PARTITION_BYTES = 64 << 20
BATCH_ROWS = 10_000


def scan_sqlite(spark: SparkSession, path: str, table: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """A table of one SQLite file, or of every file in a folder or glob that executors can open."""
    _register(spark)
    reader = spark.read.format("sluice_sqlite").option("database", mounted_path(path)).option("dbtable", table)
    return reader.option("partitionBytes", partition_bytes).load()


def sqlite_tables(spark: SparkSession, path: str) -> DataFrame:
    """The tables of a SQLite file: table_name."""
    with _open(_files(mounted_path(path))[0]) as db:
        rows = db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall()
    return spark.createDataFrame(rows, "table_name string")


def register_database(spark: SparkSession, path: str, prefix: str = "sqlite") -> None:
    """Every table of the file as ``prefix.table`` in SQL.

    SQL-created tables do not hand their options to a Python source, so each gets a bound source.
    Names that Spark does not allow for tables (blanks, signs) stay out; ``scan_sqlite`` reads those.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{prefix}`")
    for row in sqlite_tables(spark, path).collect():  # the catalog: one row per table
        table = row.table_name
        if not re.fullmatch(r"[A-Za-z0-9_]+", table):
            continue
        source = f"sluice_sqlite_{hashlib.md5(f'{path}|{table}'.encode()).hexdigest()}"
        fixed = {"database": mounted_path(path), "dbtable": table}
        bound = type("BoundSqliteSource", (SqliteSource,), {"fixed": fixed, "name": classmethod(lambda cls, n=source: n)})
        spark.dataSource.register(bound)
        spark.sql(f"DROP TABLE IF EXISTS `{prefix}`.`{table}`")
        spark.sql(f"CREATE TABLE `{prefix}`.`{table}` USING {source}")


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        names = [os.path.join(path, n) for n in sorted(os.listdir(path)) if not n.startswith((".", "_"))]
    else:
        names = sorted(glob.glob(path)) if glob.has_magic(path) else [path]
    names = [n for n in names if os.path.isfile(n)]
    if not names:
        raise ValueError(f"no SQLite file at {path}")
    return names


class _open:
    """A read-only connection that is closed at the end of the block."""

    def __init__(self, path: str) -> None:
        self._db = sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)

    def __enter__(self) -> sqlite3.Connection:
        return self._db

    def __exit__(self, *_) -> None:
        self._db.close()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _declared(text: str) -> T.DataType:
    """Spark type of a declared column type."""
    name = text.lower()
    if "bool" in name:
        return T.BooleanType()
    if "int" in name:
        return T.LongType()
    if any(k in name for k in ("char", "clob", "text")):
        return T.StringType()
    if "blob" in name:
        return T.BinaryType()
    if any(k in name for k in ("real", "floa", "doub", "dec", "num")):
        return T.DoubleType()
    if "time" in name:
        return T.TimestampNTZType()
    if "date" in name:
        return T.DateType()
    return T.StringType()


class RowRange(InputPartition):
    """Rows of one file; without bounds the whole file (a table without row ids)."""

    def __init__(self, path: str, low: int | None, high: int | None) -> None:
        self.path, self.low, self.high = path, low, high


class SqliteSource(DataSource):
    fixed: dict[str, str] = {}  # options of a source that is bound to one table

    @classmethod
    def name(cls) -> str:
        return "sluice_sqlite"

    def schema(self) -> T.StructType:
        options = {**self.options, **self.fixed}
        table = options["dbtable"]
        with _open(_files(options["database"])[0]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
        if not columns:
            raise ValueError(f"no table {table}")
        return T.StructType([T.StructField(c[1], _declared(c[2])) for c in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        options = {**self.options, **self.fixed}
        return SqliteReader(options["database"], options["dbtable"], int(options.get("partitionbytes", PARTITION_BYTES)), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, database: str, table: str, size: int, schema: T.StructType) -> None:
        self.database, self.table, self.size, self.schema = database, table, size, schema

    def partitions(self) -> list[RowRange]:
        out = []
        for path in _files(self.database):
            with _open(path) as db:
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:  # WITHOUT ROWID
                    out.append(RowRange(path, None, None))
                    continue
            if low is not None:
                # As many ranges as the file has pieces of the wanted size; counting rows would read it all.
                step = -(-(high - low + 1) // -(-os.path.getsize(path) // self.size))
                out += [RowRange(path, at, min(at + step - 1, high)) for at in range(low, high + 1, step)]
        return out or [RowRange(_files(self.database)[0], 1, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(self.schema)
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
        bounded = partition.low is not None
        query = f"SELECT {columns} FROM {_quoted(self.table)}" + (" WHERE rowid BETWEEN ? AND ?" if bounded else "")
        with _open(partition.path) as db:
            cursor = db.execute(query, (partition.low, partition.high) if bounded else ())
            while rows := cursor.fetchmany(BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([_column(v, f.type) for v, f in zip(zip(*rows), types)], schema=types)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Values as stored (dates and moments are text, booleans numbers) in their declared type."""
    if pa.types.is_temporal(kind):
        return pa.array([None if v is None else str(v).replace("T", " ") for v in values], pa.string()).cast(kind)
    if pa.types.is_boolean(kind):
        return pa.array([None if v is None else v not in (0, "0", "false", "FALSE", "f") for v in values], kind)
    if pa.types.is_string(kind):
        return pa.array([v if v is None or isinstance(v, str) else str(v) for v in values], kind)
    return pa.array(values, kind)
