"""How each delimited file is written: delimiter, quote and header, from all of its lines.

Every candidate pair of delimiter and quote gives each line a width. The widths of a file form histograms that tasks
merge; the pair under which most lines have one width wins. A first record is a header if its cells do not have the
types of the cells below them, or if all cells are text and none of the first is empty. Both decisions are aggregates
by file: one row for each file reaches the driver, which lists the files anyway.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sluice.sources.sniff import CELL_BITS

DELIMITERS = (",", ";", "\t", "|")
QUOTES = ('"', "'")
FEW_FILES = 100_000  # whose first lines are fetched by a set of row numbers


@dataclass(frozen=True)
class FileShape:
    """What the survey tells of one file."""

    path: str
    key: int  # the hash by which records name the file
    delimiter: str
    quote: str
    header: str | None  # its first line that is not blank
    opens: bool  # whether a quoted cell may go on beyond its line
    width: int  # most cells of a line


def bare(text: Column, delimiter: str, quote: str) -> Column:
    """The text without its quoted cells; what quotes are left stand for themselves or open a cell."""
    mark, q = rf"\Q{delimiter}\E", rf"\Q{quote}\E"
    cut = F.regexp_replace(F.replace(text, F.lit(quote * 2), F.lit("")), rf"(^|{mark}){q}[^{q}]*+{q}(?={mark}|\r?$)", "$1")
    return F.when(F.contains(text, F.lit(quote)), cut).otherwise(text)


def width(text: Column, delimiter: str, quote: str = '"') -> Column:
    """Cells of a record."""
    cells = bare(text, delimiter, quote)
    marks = F.octet_length(cells) - F.octet_length(F.replace(cells, F.lit(delimiter), F.lit("")))
    return (marks / len(delimiter.encode()) + 1).cast("int")


def _quoted_cells(text: Column, delimiter: str, quote: str) -> Column:
    mark, q = rf"\Q{delimiter}\E", rf"\Q{quote}\E"
    return F.regexp_count(text, F.lit(rf"(?:^|{mark}){q}[^{q}]*+{q}(?={mark}|\r?$)"))


def survey(raw: DataFrame, delimiter: str | None, quote: str = '"') -> list[FileShape]:
    """The shape of each file of ``raw`` (Spark's text source, lines apart by ``\\n``), in order of their paths."""
    line = F.rtrim("value", F.lit("\r"))
    line = F.when(F.startswith(line, F.lit("\ufeff")), F.substr(line, F.lit(2))).otherwise(line)
    # Numbers of rows, unlike lines, are kept by hash aggregates, which sort nothing; the first lines are fetched by them later.
    place = F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    told = raw.select(line.alias("line"), F.col("_metadata.file_path").alias("file"), *place)
    filled = told.where(F.trim("line") != "")
    pairs = [(delimiter, quote)] if delimiter else [(d, q) for q in QUOTES for d in DELIMITERS]
    measured = [
        F.struct(
            F.lit(at).alias("pair"),
            width(F.col("line"), d, q).alias("width"),
            F.contains(bare(F.col("line"), d, q), F.lit(q)).alias("opens"),
            _quoted_cells(F.col("line"), d, q).alias("quoted") if delimiter is None else F.lit(0).alias("quoted"),
        )
        for at, (d, q) in enumerate(pairs)
    ]
    # One row for each pair and width of a split: the histogram, with what else its lines add to it.
    lines = filled.select("file", "block", "row", *([measured[0].alias("m")] if delimiter else [F.explode(F.array(*measured)).alias("m")]))
    flat = lines.select("file", "block", "row", "m.pair", "m.width", "m.opens", "m.quoted")
    counted = flat.groupBy("file", "pair", "width", "block").agg(F.count("*").alias("n"), F.max("opens").alias("opens"), F.sum("quoted").alias("quoted"), F.min("row").alias("row"))
    first = F.min(F.struct("block", "row")).alias("first")
    counted = counted.groupBy("file", "pair", "width").agg(F.sum("n").alias("n"), F.max("opens").alias("opens"), F.sum("quoted").alias("quoted"), first)
    # The most frequent width; of a tie the larger one.
    modal = F.max(F.struct("n", "width")).alias("modal")
    by_pair = counted.groupBy("file", "pair").agg(
        modal, F.sum("n").alias("lines"), F.max("opens").alias("opens"), F.sum("quoted").alias("quoted"), F.max("width").alias("widest"), F.min("first").alias("first")
    )
    # A pair that never parts a line tells nothing; fewer quoted cells, and later candidates, yield.
    share = F.when(F.col("modal.width") > 1, F.col("modal.n") / F.col("lines")).otherwise(F.lit(0.0))
    likely = F.struct(share.alias("share"), F.col("quoted"), F.col("modal.width").alias("cells"), (-F.col("pair")).alias("rank"))
    told_by = F.struct("pair", "opens", "widest", "first")
    best = by_pair.select("file", told_by.alias("b")) if len(pairs) == 1 else by_pair.groupBy("file").agg(F.max_by(told_by, likely).alias("b"))
    rows = sorted(best.select("file", F.xxhash64("file").alias("key"), "b.pair", "b.opens", "b.widest", "b.first.row").collect())
    numbers = [r.row for r in rows]
    if len(rows) <= FEW_FILES:
        heads = told.where(F.col("row").isin(numbers))
    else:
        heads = told.join(raw.sparkSession.createDataFrame([(n,) for n in numbers], "row long"), "row", "left_semi")
    text = {r.file: r.line for r in heads.select("file", "line").collect()} if rows else {}
    if set(text) != {r.file for r in rows}:
        raise RuntimeError("splits of files changed between two passes")
    return [FileShape(r.file, r.key, *pairs[r.pair], text[r.file], r.opens, r.widest) for r in rows]


def headed(cells: DataFrame, columns: int) -> set[int]:
    """Keys of the files whose first record is a header; ``cells`` has ``__file, first, c0, c1, ...``."""
    stacked = cells.selectExpr("__file", "first", f"stack({columns}, {', '.join(f'{i}, c{i}' for i in range(columns))}) AS (at, cell)")
    bits = stacked.select("__file", "first", "at", F.expr(CELL_BITS).alias("bits"))
    masks = bits.groupBy("__file", "at").agg(
        F.bit_and(F.when(~F.col("first"), F.col("bits"))).alias("rest"),
        F.bit_and(F.when(F.col("first"), F.col("bits"))).alias("head"),
    )
    # Of the types that hold for all cells below, the lowest bit is the one chosen; a file of one record is its own rest.
    alone = F.max(F.col("rest").isNotNull()).over(_file_window())
    below = F.when(alone, F.coalesce("rest", F.lit(0))).otherwise(F.coalesce("head", F.lit(0)))
    chosen = below.bitwiseAND(-below)
    known = masks.select("__file", "head", chosen.alias("chosen"), F.col("rest").isNotNull().alias("filled"))
    fits = (F.col("chosen") == 0) | F.col("head").isNull() | (F.col("head").bitwiseAND(F.col("chosen")) != 0)
    # Columns that no record of the file reaches say nothing.
    seen = known.where("filled OR head IS NOT NULL")
    judged = seen.groupBy("__file").agg(F.min(fits).alias("fits"), F.max(F.col("chosen") != 0).alias("typed"), F.max(F.col("head").isNull()).alias("hole"))
    return {r[0] for r in judged.where("NOT fits OR (NOT typed AND NOT hole)").select("__file").collect()}


def _file_window():
    from pyspark.sql import Window

    return Window.partitionBy("__file")
