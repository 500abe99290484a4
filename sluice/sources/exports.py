"""Tables in foreign formats, written by the tasks that hold the rows, to be scanned again.

Spark writes CSV, JSON and Parquet itself. SQLite files and workbooks are made here: one task turns
its partition into files of bounded size, under a hidden name until complete, so that a repeated
task replaces its own files. The folder must be mounted on all executors.
"""

from __future__ import annotations

import itertools
import os
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.session import mounted_path, scratch_dir

WORKBOOK_ROWS = 50_000
DERBY_DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
DERBY_TEXT = "VARCHAR(32672)"


def _write_parts(df: DataFrame, folder: str, extension: str, write: Callable[[str, Iterator[pd.DataFrame]], Iterator[str]]) -> None:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number in itertools.count():
            first = next(batches, None)
            if first is None:
                return
            task = TaskContext.get()
            name = f"part-{task.partitionId():06d}-{number:04d}.{extension}"
            hidden = os.path.join(folder, f".{task.taskAttemptId()}-{name}")
            write(hidden, itertools.chain([first], batches))
            os.replace(hidden, os.path.join(folder, name))
            yield pd.DataFrame({"name": [name]})

    os.makedirs(folder, exist_ok=True)
    df.mapInPandas(run, "name string").agg(F.count("*")).collect()


def export_sqlite(df: DataFrame, folder: str, table: str) -> str:
    """One SQLite file per partition, each with ``table``."""
    kinds = {"string": "TEXT", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    columns = ", ".join(f'"{n}" {kinds.get(k, "INTEGER")}' for n, k in df.dtypes)
    text = df.select([F.col(n).cast("string").alias(n) if k in ("date", "timestamp_ntz") else F.col(n) for n, k in df.dtypes])
    marks = ", ".join("?" * len(df.columns))

    def write(path: str, batches: Iterator[pd.DataFrame]) -> None:
        db = sqlite3.connect(path)
        db.execute(f'CREATE TABLE "{table}" ({columns})')
        for batch in batches:
            rows = batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None)
            db.executemany(f'INSERT INTO "{table}" VALUES ({marks})', rows)
        db.commit()
        db.close()

    _write_parts(text, mounted_path(folder), "db", write)
    return folder


def export_workbooks(df: DataFrame, folder: str, sheets: tuple[str, ...] = ("Data",), rows: int = WORKBOOK_ROWS) -> str:
    """Workbooks of at most ``rows`` rows; the table is on the last sheet, the others are empty."""
    numeric = [k in ("tinyint", "smallint", "int", "bigint", "float", "double") for _, k in df.dtypes]
    names = df.columns

    def one(path: str, batches: Iterator[pd.DataFrame]) -> None:
        taken = 0
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
            write_workbook_frame(book, sheets)
            with book.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w") as sheet:
                sheet.write(SHEET_START)
                sheet.write(sheet_row([(False, n) for n in names]))
                for batch in batches:
                    for row in batch.itertuples(index=False, name=None):
                        sheet.write(sheet_row(list(zip(numeric, row))))
                    taken += len(batch)
                    if taken >= rows:
                        break
                sheet.write(SHEET_END)

    _write_parts(df, mounted_path(folder), "xlsx", one)
    return folder


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
SHEET_START = f'<worksheet xmlns="{MAIN}"><sheetData>'.encode()
SHEET_END = b"</sheetData></worksheet>"


def write_workbook_frame(book: zipfile.ZipFile, sheets: tuple[str, ...]) -> None:
    """Everything of a workbook but its last sheet."""
    numbers = range(1, len(sheets) + 1)
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    book.writestr(
        "[Content_Types].xml",
        f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
        + "</Types>",
    )
    book.writestr(
        "_rels/.rels",
        f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    )
    tags = "".join(f'<sheet name="{escape(s)}" sheetId="{i}" r:id="r{i}"/>' for i, s in zip(numbers, sheets))
    book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{tags}</sheets></workbook>')
    links = "".join(f'<Relationship Id="r{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
    book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')
    for i in numbers[:-1]:
        book.writestr(f"xl/worksheets/sheet{i}.xml", SHEET_START + SHEET_END)


def sheet_row(cells: list[tuple]) -> bytes:
    """One row of (is a number, value) cells; a missing value leaves its cell empty."""
    out = []
    for number, value in cells:
        if value is None or value != value:
            out.append("<c/>")
        elif number:
            out.append(f"<c><v>{value!r}</v></c>")
        else:
            out.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
    return f"<row>{''.join(out)}</row>".encode()


def export_database(df: DataFrame, table: str) -> dict[str, str]:
    """``df`` as a table of a JDBC database; returns the connection options.

    The database is the one in ``spark.sluice.jdbc.url`` (with ``.driver``, ``.user``, ``.password``).
    Without it a local session uses embedded Derby, which only its own process can see.
    """
    spark = df.sparkSession
    options = database_options(spark)
    writer = df.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", 10_000)
    if options["url"].startswith("jdbc:derby:"):
        texts = [f"`{n}` {DERBY_TEXT}" for n, k in df.dtypes if k == "string"]
        if texts:
            writer = writer.option("createTableColumnTypes", ", ".join(texts))
    writer.mode("overwrite").save()
    return options


def database_options(spark: SparkSession) -> dict[str, str]:
    found = {k: spark.conf.get(f"spark.sluice.jdbc.{k}", None) for k in ("url", "driver", "user", "password")}
    if found["url"]:
        return {k: v for k, v in found.items() if v}
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("embedded Derby is visible to one process only: set spark.sluice.jdbc.url on a cluster")
    folder = mounted_path(scratch_dir(spark, "derby"))
    os.makedirs(os.path.dirname(folder), exist_ok=True)
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{folder}.log")
    return {"url": f"jdbc:derby:{folder};create=true", "driver": DERBY_DRIVER}
