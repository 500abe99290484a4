"""Folders of Excel workbooks, one workbook per task row.

``binaryFile`` spreads the workbooks over the cluster; a small helper turns each workbook's sheet
into rows of (kind, text) cells, batch by batch. Column types come from the kinds in one aggregate.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.functions.names import unique_names
from sluice.sources.sniff import TextType, read_text_as

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show a date or a time.
DATE_FORMATS = {14, 15, 16, 17, 22} | set(range(27, 37)) | set(range(50, 59))
TIME_FORMATS = {18, 19, 20, 21, 45, 46, 47}
BATCH_ROWS = 4096

# Bits of the kinds a column holds: number, boolean, date, moment, time, text.
KIND_BITS = {"n": 1, "b": 2, "d": 4, "m": 8, "t": 16, "s": 32}
KIND_TYPES = {1: "DOUBLE", 2: "BOOLEAN", 4: "DATE", 8: "TIMESTAMP", 12: "TIMESTAMP", 16: "TIME"}


# Columns that hold the place of a row on request.
PLACE = ("_sluice_book", "_sluice_line")


def scan_excel(spark: SparkSession, path: str, sheet_name: str | None = None, sheet_index: int = 0, place: bool = False) -> DataFrame:
    """The chosen sheet of every workbook below ``path``, stacked by column name.

    With ``place`` each row also carries its workbook and line, the only order such rows have.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").option("recursiveFileLookup", "true").load(path)
    return workbook_rows(files, sheet_name, sheet_index, place)


def workbook_rows(files: DataFrame, sheet_name: str | None = None, sheet_index: int = 0, place: bool = False) -> DataFrame:
    """Rows of workbooks given as (path, content); the first sheet row holds the column names."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield _sheet_columns(path, content, sheet_name, sheet_index)

    books = files.select("path", "content")
    # One row per workbook and column, then one per column, in the order of first appearance.
    columns = (
        books.mapInPandas(describe, "path string, at int, name string, bits int")
        .groupBy("name")
        .agg(F.min(F.struct("path", "at")).alias("place"), F.bit_or("bits").alias("bits"))
        .orderBy("place")
        .collect()
    )
    if not columns:
        raise ValueError("no workbook with a header row found")
    names = [row.name for row in columns]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield from _sheet_batches(path, content, sheet_name, sheet_index, names)

    cells = books.mapInPandas(read, "path string, line long, texts array<string>")
    places = [F.col(c).alias(name) for c, name in zip(("path", "line"), PLACE)] if place else []
    text = cells.select([F.col("texts")[i].alias(name) for i, name in enumerate(names)] + places)
    return read_text_as(text, {row.name: TextType(KIND_TYPES.get(row.bits, "VARCHAR")) for row in columns})


def _table(content: bytes, sheet_name: str | None, sheet_index: int) -> tuple[list[str], Iterator[list]]:
    """Column names and the rows below them, up to the first empty row."""
    rows = _sheet_rows(content, sheet_name, sheet_index)
    header = next(rows, [])
    names = unique_names([text for _, text in header])
    return names, itertools.takewhile(lambda row: any(text is not None for _, text in row), rows)


def _sheet_columns(path: str, content: bytes, sheet_name: str | None, sheet_index: int) -> pd.DataFrame:
    names, rows = _table(content, sheet_name, sheet_index)
    bits = [0] * len(names)
    for row in rows:
        for at, (kind, _) in enumerate(row[: len(names)]):
            bits[at] |= KIND_BITS.get(kind, 0)
    return pd.DataFrame({"path": path, "at": range(len(names)), "name": names, "bits": bits})


def _sheet_batches(path: str, content: bytes, sheet_name: str | None, sheet_index: int, wanted: list[str]) -> Iterator[pd.DataFrame]:
    names, rows = _table(content, sheet_name, sheet_index)
    at = [names.index(name) if name in names else -1 for name in wanted]
    first = 0
    while batch := list(itertools.islice(rows, BATCH_ROWS)):
        texts = [[row[i][1] if 0 <= i < len(row) else None for i in at] for row in batch]
        yield pd.DataFrame({"path": path, "line": range(first, first + len(batch)), "texts": texts})
        first += len(batch)


def _sheet_rows(content: bytes, sheet_name: str | None, sheet_index: int) -> Iterator[list]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        target = _sheet_member(book, sheet_name, sheet_index)
        strings = _shared_strings(book)
        styles = _date_styles(book)
        with book.open(target) as member:
            expected = 1
            table = None
            for event, node in ElementTree.iterparse(member, events=("start", "end")):
                if event == "start" or node.tag != MAIN + "row":
                    table = node if node.tag == MAIN + "sheetData" else table
                    continue
                number = int(node.get("r", expected))
                for _ in range(expected, number):
                    yield []
                expected = number + 1
                row: list = []
                for cell in node.iter(MAIN + "c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(row)
                    row.extend([(None, None)] * (at - len(row)))
                    row.append(_cell(cell, strings, styles))
                yield row
                table.clear()  # keeps one row in memory


def _sheet_member(book: zipfile.ZipFile, sheet_name: str | None, sheet_index: int) -> str:
    sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    if sheet_name:
        chosen = [s for s in sheets if s.get("name") == sheet_name]
    else:
        chosen = sheets[sheet_index : sheet_index + 1] if sheet_index >= 0 else []
    if not chosen:
        raise ValueError(f"no sheet {sheet_name or sheet_index}; sheets: {[s.get('name') for s in sheets]}")
    target = links[chosen[0].get(RELATION)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as member:
        for _, node in ElementTree.iterparse(member):
            if node.tag == MAIN + "si":
                out.append(_plain_text(node))
                node.clear()
    return out


def _plain_text(node) -> str:
    """Text of a string item without its phonetic runs."""
    parts = [t.text or "" for t in node.findall(MAIN + "t")]
    parts += [t.text or "" for run in node.findall(MAIN + "r") for t in run.findall(MAIN + "t")]
    return "".join(parts)


def _date_styles(book: zipfile.ZipFile) -> dict[int, str]:
    """Cell style number -> kind, for styles that show dates, moments or times."""
    if "xl/styles.xml" not in book.namelist():
        return {}
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter(MAIN + "numFmt")}
    kinds = {}
    for index, style in enumerate(root.iterfind(f"{MAIN}cellXfs/{MAIN}xf")):
        number = int(style.get("numFmtId", 0))
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", custom.get(number, "")).lower()
        day, hour = bool(re.search("[dy]", code)), bool(re.search("[hs]", code))
        if number in DATE_FORMATS or (day and not hour):
            kinds[index] = "m" if number == 22 else "d"
        elif number in TIME_FORMATS or (hour and not day):
            kinds[index] = "t"
        elif day and hour:
            kinds[index] = "m"
    return kinds


def _column_number(reference: str) -> int:
    number = 0
    for letter in reference.rstrip("0123456789"):
        number = number * 26 + ord(letter) - 64
    return number - 1


def _cell(cell, strings: list[str], styles: dict[int, str]) -> tuple:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        node = cell.find(MAIN + "is")
        return ("s", _plain_text(node)) if node is not None else (None, None)
    value = cell.findtext(MAIN + "v")
    if value is None or value == "":
        return (None, None)
    if kind == "s":
        return ("s", strings[int(value)])
    if kind == "b":
        return ("b", "true" if value == "1" else "false")
    if kind == "d":
        return ("m" if "T" in value else "d", value)
    if kind != "n":
        return (None, None) if kind == "e" else ("s", value)
    style = styles.get(int(cell.get("s", 0)))
    if style is None:
        return ("n", value)
    # Day 60 of the calendar is a day that never was; serials before it are one day off.
    serial = float(value)
    moment = datetime(1899, 12, 30) + timedelta(seconds=round(serial * 86400), days=1 if 1 <= serial < 60 else 0)
    if style == "d":
        return ("d", moment.strftime("%Y-%m-%d"))
    return (style, moment.strftime("%Y-%m-%d %H:%M:%S" if style == "m" else "%H:%M:%S"))
