"""Type detection for text columns: one aggregate over the data, one bit mask per column.

Every cell yields the set of types it could have, as bits; ``bit_and`` keeps the types that hold
for all cells. The aggregate combines map-side into one row per task, whatever the data size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice.functions.names import column, quoted
from sluice.functions.casts import safe_cast
from sluice.functions.types import canonical, spark_type

# What a cell must look like for each type.
BOOLEAN_WORDS = ("true", "false", "t", "f", "yes", "no", "y", "n")
NUMBER_WORDS = ("nan", "-nan", "inf", "-inf")
INTEGER_TEXT = r"^\s*(?:-\d+|0|[1-9]\d*)\s*$"
DOUBLE_TEXT = r"^\s*-?(?:(?:0|[1-9]\d*)(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*$"
YEAR_FIRST = r"^\s*(\d{4})([-/.])(\d{1,2})\2(\d{1,2})\s*$"
YEAR_LAST = r"^\s*(\d{1,2})([-/.])(\d{1,2})\2(\d{4})\s*$"
MOMENT = r"^\s*\d{4}([-/])\d{1,2}\1\d{1,2}[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|UTC|[+-]\d{1,2}(?::?\d{2})?)?\s*$"
CLOCK = r"^\s*\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*$"
MAX_SNIFF_ROWS = 200_000  # they pass the driver

BITS = {
    "BOOLEAN": 1,
    "TIME": 2,
    "DATE": 4,
    "DATE day first": 8,
    "DATE month first": 16,
    "TIMESTAMP": 32,
    "TIMESTAMP WITH TIME ZONE": 64,
    "BIGINT": 128,
    "HUGEINT": 256,
    "DOUBLE": 512,
}
TEMPORAL = tuple(name for name in BITS if name.startswith(("DATE", "TIMESTAMP")))


@dataclass(frozen=True)
class TextType:
    """A detected or given type; ``layout`` says how dates are written."""

    name: str
    layout: str = "year first"

    def read(self, col: Column) -> Column:
        """The cell in this type, NULL if it does not fit."""
        if self.name == "DATE":
            iso = _iso_date(col, self.layout).try_cast("date")
            return F.coalesce(safe_cast(col, T.StringType(), "DATE"), iso) if self.layout == "year first" else iso
        return safe_cast(col, T.StringType(), self.name)

    def read_sniffed(self, col: Column) -> Column:
        """The same for cells that are known to fit, without the checks."""
        if self.name in ("BOOLEAN", "BIGINT", "HUGEINT", "DOUBLE"):
            return col.try_cast(spark_type(self.name))
        if self.name.startswith("TIMESTAMP"):
            return _moment(col).try_cast(spark_type(self.name))
        if self.name == "DATE":
            return _iso_date(col, self.layout).try_cast("date")
        return self.read(col)


def _moment(col: Column) -> Column:
    return F.when(F.contains(col, F.lit("/")), F.replace(F.trim(col), F.lit("/"), F.lit("-"))).otherwise(col)


def _iso_date(col: Column, layout: str) -> Column:
    pattern, order = {
        "year first": (YEAR_FIRST, "$1-$3-$4"),
        "day first": (YEAR_LAST, "$4-$3-$1"),
        "month first": (YEAR_LAST, "$4-$1-$3"),
    }[layout]
    return F.when(col.rlike(pattern), F.regexp_replace(col, pattern, order))


def _any(*names: str) -> int:
    return sum(BITS[n] for n in names)


def _date(pattern: str, order: str) -> str:
    return f"try_cast(regexp_replace(cell, r'{pattern}', '{order}') AS DATE) IS NOT NULL"


# The types a cell could have; NULL for a NULL cell, which then decides nothing.
CELL_BITS = rf"""
CASE
  WHEN cell IS NULL THEN NULL
  WHEN ltrim(cell) >= '-' AND ltrim(cell) < ':' THEN CASE -- starts with a digit, a minus sign or a point
    WHEN contains(cell, ':') THEN CASE -- only moments and times of day hold a colon, and all of them do
      WHEN cell RLIKE r'{MOMENT}' THEN CASE
        WHEN try_cast(replace(trim(cell), '/', '-') AS TIMESTAMP_NTZ) IS NULL THEN 0
        WHEN substring(ltrim(cell), 12) RLIKE r'[-+ZU]' THEN {_any("TIMESTAMP WITH TIME ZONE")}
        ELSE {_any("TIMESTAMP")} END
      WHEN cell RLIKE r'{CLOCK}' THEN if(try_cast(concat('1970-01-01 ', trim(cell)) AS TIMESTAMP_NTZ) IS NOT NULL, {_any("TIME")}, 0)
      ELSE 0 END
    WHEN cell RLIKE r'{INTEGER_TEXT}' THEN CASE
      WHEN length(cell) <= 18 OR try_cast(cell AS BIGINT) IS NOT NULL THEN {_any("BIGINT", "HUGEINT", "DOUBLE")}
      WHEN try_cast(cell AS DECIMAL(38, 0)) IS NOT NULL THEN {_any("HUGEINT", "DOUBLE")}
      ELSE 0 END
    WHEN cell RLIKE r'{DOUBLE_TEXT}' THEN {_any("DOUBLE")}
    WHEN cell RLIKE r'{YEAR_FIRST}' THEN if({_date(YEAR_FIRST, "$1-$3-$4")}, {_any("DATE")}, 0)
    WHEN cell RLIKE r'{YEAR_LAST}'
      THEN if({_date(YEAR_LAST, "$4-$3-$1")}, {_any("DATE day first")}, 0) + if({_date(YEAR_LAST, "$4-$1-$3")}, {_any("DATE month first")}, 0)
    ELSE 0 END
  WHEN lower(trim(cell)) IN {BOOLEAN_WORDS} THEN {_any("BOOLEAN")}
  WHEN lower(trim(cell)) IN {NUMBER_WORDS} THEN {_any("DOUBLE")}
  ELSE 0 END
"""


def sniff_types(df: DataFrame, columns: list[str] | None = None, sniff_rows: int | None = None, allowed: tuple[str, ...] | None = None) -> dict[str, TextType]:
    """The type of each text column, decided by all rows or by the first ``sniff_rows``."""
    columns = columns if columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not columns:
        return {}
    if sniff_rows is not None:
        if not 0 < sniff_rows <= MAX_SNIFF_ROWS:
            raise ValueError(f"sniff_rows must lie between 1 and {MAX_SNIFF_ROWS}")
        # take() opens only as many files as it needs; a limit inside a plan would read from all.
        cells = df.select(*map(column, columns))
        df = df.sparkSession.createDataFrame(cells.take(sniff_rows), cells.schema)
    # One (column, cell) row per cell: the checks are compiled once, however wide the table.
    cells = ", ".join(f"{at}, {quoted(c)}" for at, c in enumerate(columns))
    # The bits are a column of their own, because an aggregate repeats its argument in its code.
    bits = df.selectExpr(f"stack({len(columns)}, {cells}) AS (at, cell)").select("at", F.expr(CELL_BITS).alias("bits"))
    masks = dict(bits.groupBy("at").agg(F.bit_and("bits")).collect())
    found = {}
    for at, title in enumerate(columns):
        mask = masks.get(at) or 0
        choice = next((n for n, bit in BITS.items() if mask & bit and (allowed is None or n in allowed)), "VARCHAR")
        name, _, layout = choice.partition(" ") if choice.startswith("DATE ") else (choice, "", "")
        found[title] = TextType(name, layout or "year first")
    return found


def sniff_report(df: DataFrame, sniff_rows: int | None = None) -> DataFrame:
    """Detected types as rows ``(name, inferred_type)``."""
    found = sniff_types(df, sniff_rows=sniff_rows)
    return df.sparkSession.createDataFrame([(c, t.name) for c, t in found.items()], "name string, inferred_type string")


def given_types(types: dict[str, str]) -> dict[str, TextType]:
    """User-given types, checked."""
    for name in types.values():
        spark_type(name)
    return {column: TextType(canonical(name)) for column, name in types.items()}


TEXTS = ("VARCHAR", "TEXT", "STRING")


def unreadable(name: str, kind: TextType) -> Column:
    """Whether a text column's cell is there but not of the type."""
    return column(name).isNotNull() & kind.read(column(name)).isNull()


def read_text_as(df: DataFrame, types: dict[str, TextType], reject: bool = False, sniffed: bool = False) -> DataFrame:
    """Text columns read as ``types``; with ``reject`` a row with an unreadable cell is dropped whole.

    ``sniffed`` says that the types were detected on these very rows: every cell fits.
    """
    typed = {c: t for c, t in types.items() if t.name not in TEXTS}
    if reject and typed and not sniffed:
        keep = F.lit(True)
        for c, t in typed.items():
            keep = keep & ~unreadable(c, t)
        df = df.where(keep)

    def cell(c: str) -> Column:
        col = column(c)
        return (typed[c].read_sniffed(col) if sniffed else typed[c].read(col)).alias(c) if c in typed else col

    return df.select([cell(c) for c in df.columns])
