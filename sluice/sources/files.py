"""File scans. Every function takes a file, a folder or a glob and returns a lazy DataFrame."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sluice.functions.names import column, quoted, unique_names
from sluice.session import scratch_dir
from sluice.sources.dialect import DELIMITERS, FileShape, headed, survey, width as dialect_width
from sluice.sources.excel import scan_excel
from sluice.sources.json_values import as_lines, flat_lines, layouts
from sluice.sources.records import lines_of, pin_splits, records, split_states
from sluice.sources.sniff import CELL_BITS, TEMPORAL, TextType, TEXTS, given_types, read_text_as, sniff_types, unreadable

FEW_FILES = 100_000  # whose layouts are told by broadcast


def scan_csv(
    spark: SparkSession,
    path: str,
    delimiter: str | None = ",",
    header: bool | None = True,
    encoding: str | None = None,
    multi_line: bool = True,
    types: dict[str, str] | None = None,
    sniff: bool = True,
    sniff_rows: int | None = None,
    ignore_errors: bool = True,
) -> DataFrame:
    """Delimited text: short rows are padded with NULL, types are given or detected.

    Types come from ``types`` first, then from the data (all rows, or the first ``sniff_rows``).
    A row with a cell that cannot be read as its column's type is dropped (``ignore_errors``) or
    keeps a NULL there. ``delimiter=None`` finds each file's delimiter and quote, ``header=None`` whether its first
    record is a header.
    """
    text = csv_text(spark, path, delimiter, header, encoding, multi_line)
    return type_columns(text, types, sniff, sniff_rows, ignore_errors)


def scan_tsv(spark: SparkSession, path: str, delimiter: str | None = "\t", **options) -> DataFrame:
    """Tab-separated text."""
    return scan_csv(spark, path, delimiter=delimiter or "\t", **options)


# Encodings whose line breaks are not the byte 10; Spark's reader takes them, one task per file.
WIDE = ("utf-16", "utf-16le", "utf-16be", "utf-32", "utf-32le", "utf-32be")


def csv_text(
    spark: SparkSession,
    path: str,
    delimiter: str | None = ",",
    header: bool | None = True,
    encoding: str | None = None,
    multi_line: bool = True,
    raw: str | None = None,
) -> DataFrame:
    """Delimited text with every column as a string; empty cells are NULL.

    Files with other headers, or their columns in another order, are united by name, whatever their encoding and line
    breaks; columns that a file lacks are NULL there; columns named by folders keep their types. Files without a header
    have ``column0, column1, ...``, as many as their widest record has cells. Quoted cells may hold line breaks: files
    that may have such cells are cut into records by their quotes (``records``), still in many tasks;
    ``multi_line=False`` says that no cell does. ``raw`` names a further column with the whole text of rows that have
    more cells than their file's header; elsewhere it is NULL.
    """
    return _csv_text(spark, path, delimiter, header, encoding, multi_line, raw)[0]


PLACE = ("__place_file", "__place_start", "__place_row")  # of a record among all files, where Spark cannot tell it


def _csv_text(spark: SparkSession, path: str, delimiter, header, encoding, multi_line, raw, placed=False) -> tuple[DataFrame, bool]:
    """The text, and whether it may have rows longer than their header.

    With ``placed`` rows of files that Spark's reader cannot cut into records carry their place among all files.
    """
    if encoding and encoding.lower().replace("_", "-") in WIDE:
        reader = _csv_reader(spark, delimiter or ",", '"').option("header", header is not False).option("multiLine", True).option("encoding", encoding)
        cells = _no_empty_cells(reader.csv(path))
        return (cells if raw is None else cells.withColumn(raw, F.lit(None).cast("string"))), False
    pin_splits(spark)
    lines = spark.read.option("lineSep", "\n").text(path)
    folders = lines.schema.fields[1:]
    shapes = survey(lines, delimiter)
    parts: dict[tuple, list[FileShape]] = {}
    doubtful = _doubtful(spark, shapes) if header is None else set()
    bare = _without_header(spark, [f for f in shapes if f.key in doubtful and not (encoding or f.opens and multi_line)]) if doubtful else set()
    # Where cells go on beyond their line, the widths of lines tell little.
    longer = header is not False and any((f.opens and multi_line) or f.key not in bare and f.width > len(_names(f, True, 0)) for f in shapes)
    for shape in shapes:
        records_needed = encoding is not None or (shape.opens and multi_line)
        if raw and placed and header is not False:  # Spark's reader tells the text of long rows, but no place
            records_needed |= shape.key not in bare and shape.width > len(_names(shape, True, 0))
        parts.setdefault((records_needed, shape.delimiter, shape.quote, header is not False and shape.key not in bare), []).append(shape)
    if placed and len(parts) > 1 or any(key[0] for key in parts):
        parts = {(True, *key[1:]): [f for k, own in parts.items() if k[1:] == key[1:] for f in own] for key in parts} if placed else parts
    base = path if folders else None
    found: list[DataFrame] = []
    for (cut, mark, quote, headers), files in parts.items():
        if cut:
            known = None if any(f.key in doubtful for f in files) else headers
            found.append(_by_records(spark, files, mark, quote, known, encoding or "utf-8", base, raw, len(files) == len(shapes) and path, multi_line, {f.key: i for i, f in enumerate(shapes)} if placed else None))
        else:
            found += _by_reader(spark, files, mark, quote, headers, base, raw, len(files) == len(shapes) and path)
    if not found:
        return spark.createDataFrame([], T.StructType([*([T.StructField(raw, T.StringType())] if raw else []), *folders])), False
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    last = [f.name for f in folders if f.name in df.columns] + ([raw] if raw else [])
    return df.select([column(c) for c in [c for c in df.columns if c not in last] + last]), longer


def _no_empty_cells(raw: DataFrame) -> DataFrame:
    """A quoted empty cell is read as an empty string; it becomes NULL."""
    return raw.select([F.nullif(column(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else column(f.name) for f in raw.schema.fields])


def _doubtful(spark: SparkSession, shapes: list[FileShape]) -> set[int]:
    """Files whose first line does not tell by itself that it is a header.

    Cells that are all filled and all plain text are one: either the cells below have types, or all cells are text.
    """
    cells = [(f.key, cell or None) for f in shapes if f.header for cell in (_cells(f.header, f.delimiter, f.quote) or [None])]
    if not cells:
        return set()
    bits = spark.createDataFrame(cells, "key long, cell string").select("key", F.expr(CELL_BITS).alias("bits"))
    return {r[0] for r in bits.where("bits IS NULL OR bits <> 0").select("key").distinct().collect()}


def _without_header(spark: SparkSession, shapes: list[FileShape]) -> set[int]:
    """Of files whose records are lines, those that have no header."""
    out = set()
    for mark, quote in sorted({(f.delimiter, f.quote) for f in shapes}):
        own = [f for f in shapes if (f.delimiter, f.quote) == (mark, quote)]
        known = spark.createDataFrame([(f.key, f.header) for f in own], "__file long, __header string")
        raw = spark.read.option("lineSep", "\n").text([_plain_path(f.path) for f in own])
        line = F.regexp_replace(F.rtrim("value", F.lit("\r")), "^\ufeff", "").alias("line")
        lines = raw.select(F.xxhash64("_metadata.file_path").alias("__file"), line).where(F.trim("line") != "")
        lines = lines.join(F.broadcast(known) if len(own) <= FEW_FILES else known, "__file")
        width = max(f.width for f in own)
        cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)), {"sep": mark, "quote": quote, "escape": quote}).alias("cells")
        # A later line that reads as the first one is no evidence either way.
        parsed = lines.select("__file", (F.col("line") == F.col("__header")).alias("first"), cells)
        named = headed(parsed.select("__file", "first", *[F.nullif(F.col(f"cells.c{i}"), F.lit("")).alias(f"c{i}") for i in range(width)]), width)
        out |= {f.key for f in own if f.key not in named}
    return out


def _names(shape: FileShape, header: bool, width: int) -> list[str]:
    return unique_names(_cells(shape.header, shape.delimiter, shape.quote)) if header else [f"column{i}" for i in range(width)]


MISFIT = "__misfit"  # the text of a row with more or fewer cells than its header


def _by_reader(spark, shapes: list[FileShape], mark: str, quote: str, header: bool, base, raw, whole) -> list[DataFrame]:
    """Files whose records are lines, by Spark's reader: one read for each header."""
    groups: dict[str | None, list[FileShape]] = {}
    for shape in shapes:
        groups.setdefault(shape.header if header else None, []).append(shape)
    out = []
    for files in groups.values():
        names = _names(files[0], header, max(f.width for f in files))
        widest = max(f.width for f in files)
        long = raw is not None and header and widest > len(names)
        reader = _csv_reader(spark, mark, quote).option("header", header).option("maxColumns", max(20480, widest))
        reader = reader.schema(_text_schema(names + [MISFIT] if long else names))
        reader = reader.option("columnNameOfCorruptRecord", MISFIT) if long else reader
        reader = reader.option("basePath", base) if base else reader
        cells = _no_empty_cells(reader.csv(whole if whole and len(groups) == 1 else [_plain_path(f.path) for f in files]))
        if raw is not None:
            # Spark tells rows of another width only if it reads all columns, so these go with the text, cut to nothing.
            told = F.concat(column(MISFIT), F.left(F.concat_ws("", *[column(c) for c in names]), F.lit(0))) if long else None
            text = F.when(dialect_width(column(MISFIT), mark, quote) > len(names), told) if long else F.lit(None).cast("string")
            cells = cells.withColumn(raw, text).drop(MISFIT)
        out.append(cells)
    return out


def _by_records(spark, shapes: list[FileShape], mark: str, quote: str, header: bool | None, encoding: str, base, raw, whole, multi_line: bool, ranks: dict[int, int] | None) -> DataFrame:
    """Files whose records are found by their quotes, or whose header is in doubt: read once, cells named by file."""
    paths = whole or [_plain_path(f.path) for f in shapes]
    lines = lines_of(spark, paths, base)
    folders = [c for c in lines.columns if not c.startswith("__")]
    if any(f.opens for f in shapes) and multi_line:
        states = _held(split_states(lines, mark, quote), "csv-states")
    else:
        states = lines.groupBy("__file", "__start").agg(F.max("__length").alias("__length"), F.lit(False).alias("inside"))
    rows = records(lines, states, mark, quote, encoding)
    rows = rows.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    widest = rows.agg(F.max(dialect_width(F.col("value"), mark, quote))).first()[0] or 1
    told = ", ".join(f"c{i} string" for i in range(widest))
    options = {"sep": mark, "quote": quote, "escape": quote, "multiLine": "true", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, widest))}
    parsed = rows.select("value", "__file", "first", F.from_csv("value", told, options).alias("cells"), "__start", "__at", *[F.col(quoted(c)) for c in folders])
    if header is None:
        named = headed(parsed.select("__file", "first", *[F.nullif(F.col(f"cells.c{i}"), F.lit("")).alias(f"c{i}") for i in range(widest)]), widest)
    else:
        named = {f.key for f in shapes} if header else set()
    firsts = {f.key: f.header for f in shapes if f.key in named}
    if any(f.opens and f.key in named for f in shapes):  # a header may go on beyond its line
        firsts |= {r[0]: r[1] for r in rows.where("first").select("__file", "value").collect() if r[0] in named}
    titles = {key: unique_names(_cells(text, mark, quote)) for key, text in firsts.items()}
    layouts: dict[tuple[str, ...], list[int]] = {}
    for shape in shapes:
        layouts.setdefault(tuple(titles.get(shape.key, [f"column{i}" for i in range(widest)])), []).append(shape.key)
    names = list(dict.fromkeys(name for layout in layouts for name in layout))
    places = [(i, key, key in named, (ranks or {}).get(key, 0)) for i, (_, keys) in enumerate(layouts.items()) for key in keys]
    if ranks or len({(i, headed_file) for i, _, headed_file, _ in places}) > 1:
        known = spark.createDataFrame(places, "__layout int, __file long, __headed boolean, __rank int")
        parsed = parsed.join(F.broadcast(known) if len(places) <= FEW_FILES else known, "__file")
    else:
        parsed = parsed.withColumn("__layout", F.lit(0)).withColumn("__headed", F.lit(bool(places and places[0][2])))
    data = parsed.where(~(F.col("first") & F.col("__headed")))

    def cell(name: str) -> Column:
        options = [F.when(F.col("__layout") == i, F.col(f"cells.c{layout.index(name)}")) for i, layout in enumerate(layouts) if name in layout and layout.index(name) < widest]
        return F.nullif(F.coalesce(*options), F.lit("")).alias(name) if options else F.lit(None).cast("string").alias(name)

    columns = [cell(name) for name in names] + [F.col(quoted(c)) for c in folders]
    if raw is not None:
        own = reduce(lambda other, i: F.when(F.col("__layout") == i[0], F.lit(len(i[1]))).otherwise(other), enumerate(layouts), F.lit(0))
        columns.append(F.when(dialect_width(F.col("value"), mark, quote) > own, F.col("value")).alias(raw))
    if ranks:
        columns += [F.col(c).alias(name) for c, name in zip(("__rank", "__start", "__at"), PLACE)]
    return data.select(*columns)


def _held(df: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _plain_path(file: str) -> str:
    """The path of a file from its metadata; characters of globs in it stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file))


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def _csv_reader(spark, delimiter, quote):
    return spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("mode", "PERMISSIVE")


def type_columns(text: DataFrame, types=None, sniff=True, sniff_rows=None, ignore_errors=True) -> DataFrame:
    """String columns as their given or detected types."""
    known, found = _types_of(text, types, sniff, sniff_rows)
    return read_text_as(read_text_as(text, known, reject=ignore_errors), found, sniffed=True)


def _types_of(text: DataFrame, types=None, sniff=True, sniff_rows=None) -> tuple[dict[str, TextType], dict[str, TextType]]:
    """The types that cells may miss, and those that were detected on all rows."""
    texts = [f.name for f in text.schema.fields if isinstance(f.dataType, T.StringType)]
    known = given_types({c: t for c, t in (types or {}).items() if c in text.columns})
    found = sniff_types(text, [c for c in texts if c not in known], sniff_rows) if sniff else {}
    return ({**found, **known}, {}) if sniff_rows is not None else (known, found)


ROW, REASON = "__row", "__reason"


@dataclass(frozen=True)
class Checked:
    """A scan that forgets no row: ``data`` has the typed rows; ``marked`` all rows, with what is wrong in ``__reason``."""

    data: DataFrame
    marked: DataFrame
    cut: Column
    rejected: Column
    sound: bool  # no row can be cut or left out, as far as the survey and the types tell

    def quarantine(self) -> DataFrame:
        """``(row, reason, dropped)`` of each row that was cut to the header's width or left out."""
        cells = [column(c).cast("string") for c in self.marked.columns if c not in (ROW, REASON, *PLACE)]
        told = F.coalesce(column(ROW), F.to_csv(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]), {"quote": '"', "escape": '"'}))
        reason = F.concat_ws("; ", F.when(self.cut, F.lit("more cells than the header")), column(REASON))
        return self.marked.where(self.cut | self.rejected).select(told.alias("row"), reason.alias("reason"), self.rejected.alias("dropped"))


def scan_csv_checked(spark: SparkSession, path: str, delimiter=",", header=None, encoding=None, multi_line=True, types=None, sniff=True, sniff_rows=None, ignore_errors=True, placed=False) -> Checked:
    """As ``scan_csv``, with every row that is cut or left out told by ``quarantine``."""
    text, longer = _csv_text(spark, path, delimiter, header, encoding, multi_line, ROW, placed)
    known, found = _types_of(text.drop(ROW), types, sniff, sniff_rows)
    misfits = [F.when(unreadable(c, t), F.lit(f"{c}: not {t.name}")) for c, t in known.items() if t.name not in TEXTS] if ignore_errors else []
    marked = text.withColumn(REASON, F.nullif(F.concat_ws("; ", *misfits), F.lit("")) if misfits else F.lit(None).cast("string"))
    rejected = column(REASON).isNotNull()
    data = read_text_as(marked.where(~rejected).drop(ROW, REASON), known, reject=False)
    return Checked(read_text_as(data, found, sniffed=True), marked, column(ROW).isNotNull(), rejected, not misfits and not longer)


def long_rows(spark: SparkSession, path: str, delimiter: str = ",", width: int | None = None) -> DataFrame:
    """Rows with more cells than ``width``, by default that of the header; a scan cuts them to it."""
    if width is None:
        return csv_text(spark, path, delimiter, raw="row").where("row IS NOT NULL").select("row")
    return spark.read.text(path).where(dialect_width(F.col("value"), delimiter) > width).select(F.col("value").alias("row"))


def _cells(text: str, delimiter: str, quote: str = '"') -> list[str]:
    """The cells of one record."""
    if len(delimiter) > 1:  # the csv module knows single characters only
        text, delimiter = text.replace(delimiter, "\x1f"), "\x1f"
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=quote), [])


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of most files."""
    marks = [f.delimiter for f in survey(spark.read.option("lineSep", "\n").text(path), None)]
    return max(DELIMITERS, key=lambda d: (marks.count(d), -DELIMITERS.index(d)))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with its own schema."""
    return spark.read.parquet(path)


def scan_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
    sniff: bool = True,
) -> DataFrame:
    """JSON objects in any layout; date and timestamp texts become typed columns.

    Files with one object per line are read as they are. Objects in an array, indented, or several on a line are
    found first, in many tasks (``json_values``), by nesting depth unless no object of the file holds another, and written
    as lines to the shared folder; files of both kinds are read with one schema. ``multi_line=True`` looks for them in all
    files, ``False`` in none.
    """
    pin_splits(spark)
    reader, keys = spark.read.option("mode", "FAILFAST"), []
    folders = spark.read.text(path).columns[1:]
    base = path if folders else None
    plain, flat, laid = ([], [], []) if multi_line is False else _json_layouts(spark, path, bool(multi_line))
    some = bool(flat or laid)
    parts: list[tuple[str | list[str], str | None]] = [(plain if some else path, base if some else None)] if plain or multi_line is False or not some else []
    if some:
        parts.append(([*([flat_lines(spark, flat, base)] if flat else []), *([as_lines(spark, laid, base)] if laid else [])], None))
    if plain and schema is None:
        first = spark.read.text(plain[0]).where(F.trim("value") != "").limit(1)
        keys = (first.select(F.json_object_keys(F.regexp_replace("value", "^\ufeff", ""))).first() or [None])[0] or []
    readers = [(reader.option("basePath", root) if root else spark.read.option("mode", "FAILFAST"), files) for files, root in parts]
    if schema is not None:
        return reduce(DataFrame.unionByName, [r.schema(schema).json(f) for r, f in readers])
    if len(readers) > 1:
        schema_of = lambda drop: [r.option("dropFieldIfAllNull", drop).json(f).schema for r, f in readers]
        told = reduce(_either_type, schema_of(True))
        told = reduce(_with_missing, schema_of(False), told)
        whole = T.StructType([f for f in told.fields if f.name not in folders])
        df = reduce(DataFrame.unionByName, [r.schema(whole).json(f) for r, f in readers])
    else:
        df = readers[0][0].json(readers[0][1])
    # Inference sorts the fields by name; put those of the first record in its order.
    keys = [k for k in dict.fromkeys(keys) if k in df.columns]
    df = df.select([column(c) for c in keys + [c for c in df.columns if c not in keys]])
    return _read_moments(df) if sniff else df


def _json_layouts(spark: SparkSession, path: str, all_laid: bool) -> tuple[list[str], list[str], list[tuple[str, str, bool]]]:
    """Files with one object on each line; others that are flat; and the rest with whether their first value is an array."""
    found = layouts(spark.read.option("lineSep", "}").text(path))
    rows = found.select("file", "array", (F.col("lines") & ~F.lit(all_laid)).alias("lines"), "flat", "objects").orderBy("file").collect()
    plain, others = [r for r in rows if r.lines], [r for r in rows if not r.lines]
    flat = [r for r in others if r.flat]
    if not any(r.objects for r in flat):
        flat = []  # a folder without lines has nothing to read
    return [_plain_path(r.file) for r in plain], [_plain_path(r.file) for r in flat], [(_plain_path(r.file), r.file, r.array) for r in others if r not in flat]


def _either_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that JSON inference gives values of both types."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        kinds = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            kinds[f.name] = _either_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
        return T.StructType([T.StructField(name, kinds[name]) for name in sorted(kinds)])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_either_type(a.elementType, b.elementType))
    if a == b:
        return a
    numbers = (T.LongType, T.DoubleType, T.DecimalType)
    if isinstance(a, numbers) and isinstance(b, numbers):
        if isinstance(a, T.DoubleType) or isinstance(b, T.DoubleType):
            return T.DoubleType()
        a, b = (T.DecimalType(20, 0) if isinstance(x, T.LongType) else x for x in (a, b))
        whole, scale = max(a.precision - a.scale, b.precision - b.scale), max(a.scale, b.scale)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    return T.StringType()


def _with_missing(known: T.DataType, full: T.DataType) -> T.DataType:
    """``known`` with the fields of ``full`` that it lacks as no value tells their type."""
    if isinstance(known, T.StructType) and isinstance(full, T.StructType):
        kinds = {f.name: f.dataType for f in full.fields}
        kinds |= {f.name: _with_missing(f.dataType, kinds[f.name]) if f.name in kinds else f.dataType for f in known.fields}
        return T.StructType([T.StructField(name, kinds[name]) for name in sorted(kinds)])
    if isinstance(known, T.ArrayType) and isinstance(full, T.ArrayType):
        return T.ArrayType(_with_missing(known.elementType, full.elementType))
    return known


def _read_moments(df: DataFrame) -> DataFrame:
    """Text leaves, also inside structs, whose every value is a date or a timestamp."""

    def leaves(schema, prefix=()):
        for field in schema.fields:
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, prefix + (field.name,))
            elif isinstance(field.dataType, T.StringType):
                yield prefix + (field.name,)

    def dotted(parts):
        return ".".join(quoted(p) for p in parts)

    paths = {f"leaf{i}": path for i, path in enumerate(leaves(df.schema))}
    found = sniff_types(df.select([F.col(dotted(p)).alias(a) for a, p in paths.items()]), allowed=TEMPORAL)
    columns = {c: column(c) for c in df.columns}
    for alias, kind in found.items():
        top, *inner = paths[alias]
        if kind.name != "VARCHAR":
            value = kind.read_sniffed(F.col(dotted(paths[alias])))
            columns[top] = columns[top].withField(dotted(inner), value) if inner else value
    return df.select([value.alias(name) for name, value in columns.items()])


def scan_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A FeatureCollection is one row with its ``features`` as an array; ``F.inline`` unfolds them."""
    return scan_json(spark, path)


# Format names.
FORMATS = {
    "csv": scan_csv,
    "tsv": scan_tsv,
    "json": scan_json,
    "geojson": scan_geojson,
    "excel": scan_excel,
    "parquet": scan_parquet,
}
FORMAT_OPTIONS = {
    "csv": ("delimiter", "encoding", "header", "multi_line", "types", "sniff", "sniff_rows", "ignore_errors"),
    "tsv": ("delimiter", "encoding", "header", "multi_line", "types", "sniff", "sniff_rows", "ignore_errors"),
    "json": ("schema", "multi_line", "sniff"),
    "geojson": (),
    "excel": ("sheet_name", "sheet_index", "place"),
    "parquet": (),
}


def scan_file(spark: SparkSession, path: str, file_format: str, **options) -> DataFrame:
    """Scan by format name. Options the format does not know, or that are None, are left out."""
    if file_format not in FORMATS:
        raise ValueError(f"no file format named {file_format!r}, choose from {', '.join(FORMATS)}")
    known = {k: v for k, v in options.items() if v is not None and k in FORMAT_OPTIONS[file_format]}
    return FORMATS[file_format](spark, path, **known)
