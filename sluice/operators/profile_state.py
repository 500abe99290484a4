"""Profiles that are kept: one state per Parquet file, merged for the whole, so that only new files are read.

The state of a file holds, by column, counts, ranges, format counts, the first values, a sketch of the distinct
values and, if asked for, a 128-bit digest of each of them. All of it merges: a file that is gone is left out,
one that has changed (size or time) is read anew. The list of files is the commit of an update, so one
that broke off is done again, and states written twice count once.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sluice.functions.casts import safe_cast
from sluice.functions.formats import STRING_FORMATS, format_choice, format_test
from sluice.functions.names import column, quoted
from sluice.functions.types import type_class, type_name
from sluice.operators.profile import COLUMNS_PER_PASS, SAMPLE_VALUES

FIRST_ROWS = 4 * SAMPLE_VALUES  # of a file that usually hold the first values of its columns
SKETCH_BITS = 12  # of a sketch of distinct values: 4,096 registers, an error of about 1.6 percent

FIRST = "array<struct<at: bigint, value: string>>"
COUNTS = ", ".join(f"{name}_n bigint" for name in STRING_FORMATS)
FILES = "file string, rows bigint, exact boolean"
COLUMNS = (
    "file string, rows bigint, position int, name string, inferred_type string, class string, filled bigint, min_value double, max_value double,"
    f" min_text string, max_text string, min_at bigint, max_at bigint, {COUNTS}, first {FIRST}, sketch binary, seen timestamp"
)
LATE = f"file string, name string, first {FIRST}"
DIGESTS = "file string, name string, digest binary"

# A file with its size and time, as one text in the order of the paths.
_FILE = "concat_ws('\\u0001', _metadata.file_path, CAST(_metadata.file_size AS STRING), CAST(unix_micros(_metadata.file_modification_time) AS STRING))"


def incremental_profile(spark: SparkSession, path: str, state: str, approximate: bool = False, values: int = SAMPLE_VALUES) -> DataFrame:
    """The profile of the Parquet files below ``path``, one row per column, like that of the whole table.

    Files that ``state``, a folder of its own, does not know are read and added to it, the others are not opened.
    First values come in the order of file paths, then of rows. Columns are united by name; one with two types
    is an error, as are intervals. ``approximate`` takes distinct counts from sketches and keeps no digests.
    A table without files gives an empty profile; up to five first values are kept.
    """
    if not 0 <= values <= SAMPLE_VALUES:
        raise ValueError(f"values must lie between 0 and {SAMPLE_VALUES}")
    update(spark, path, state, exact=not approximate)
    return merged(spark, path, state, approximate, values)


def update(spark: SparkSession, path: str, state: str, exact: bool = True) -> list[str]:
    """Reads the files that the state lacks and adds theirs; returns the paths that were read."""
    known = _table(spark, state, "files", FILES)
    if exact:
        known = known.where("exact")
    new = _listing(spark, path).join(known, "file", "left_anti")
    paths = sorted(r.path for r in new.select("path").collect())
    if not paths:
        return []
    escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]
    df = spark.read.option("mergeSchema", "true").option("basePath", path).parquet(*escaped)
    odd = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DayTimeIntervalType, T.YearMonthIntervalType))]
    if odd:
        raise ValueError(f"no kept profile of intervals: {', '.join(odd)}")
    if exact:
        # Before the list of files, which tells that the digests are there.
        _append(_digests(df), state, "digests")
    seen = datetime.now(timezone.utc)
    fields = list(enumerate(df.schema.fields, 1))
    passes = [_file_stats(df, fields[at : at + COLUMNS_PER_PASS], seen) for at in range(0, len(fields), COLUMNS_PER_PASS)]
    stats = f"{state.rstrip('/')}/columns"
    _append(reduce(DataFrame.unionAll, passes), state, "columns")
    written = spark.read.schema(COLUMNS).parquet(stats).where(F.col("seen") == F.lit(seen))
    sparse = [r.name for r in written.where(f"filled > size(first) AND size(first) < {SAMPLE_VALUES}").select("name").distinct().collect()]
    if sparse:
        _append(_late_values(df, sparse), state, "late")
    rows = written.groupBy("file").agg(F.max("rows").alias("rows"))
    files = new.select("file").distinct().join(rows, "file", "left")
    _append(files.select("file", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.lit(exact).alias("exact")), state, "files")
    return paths


def merged(spark: SparkSession, path: str, state: str, approximate: bool = False, values: int = SAMPLE_VALUES) -> DataFrame:
    """The profile from the states of the files that are below ``path`` now."""
    listing = _listing(spark, path).select("file")
    files = _table(spark, state, "files", FILES).groupBy("file").agg(F.max("rows").alias("rows"), F.max("exact").alias("exact"))
    files = files.join(listing, "file", "left_semi")
    parts = _table(spark, state, "columns", COLUMNS).dropDuplicates(["file", "name"]).join(files.select("file"), "file", "left_semi")
    types = F.when(F.min("inferred_type") == F.max("inferred_type"), F.min("inferred_type"))
    clash = F.raise_error(F.concat(F.lit("files differ in the type of column "), F.col("name")))
    whole = parts.groupBy("name").agg(
        F.min(F.struct("seen", "position")).alias("place"),
        types.alias("inferred_type"),
        F.min("class").alias("class"),
        F.sum("filled").alias("filled"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.min_by("min_text", "min_at").alias("min_text"),
        F.max_by("max_text", "max_at").alias("max_text"),
        *[F.sum(f"{name}_n").alias(f"{name}_n") for name in STRING_FORMATS],
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"),
    )
    total = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"))
    # One row beside one row per column.
    out = whole.join(F.broadcast(total), how="cross")
    if approximate:
        out = out.withColumn("unique_count", F.col("estimate"))
    else:
        digests = _table(spark, state, "digests", DIGESTS).join(files.where("exact").select("file"), "file", "left_semi")
        unique = digests.select("name", "digest").distinct().groupBy("name").agg(F.count("*").alias("unique_count"))
        out = out.join(unique, "name", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    if values:
        late = _table(spark, state, "late", LATE).join(files.select("file"), "file", "left_semi")
        held = parts.select("file", "name", "first").unionAll(late.select("file", "name", "first"))
        held = held.select("file", "name", F.inline("first")).distinct()
        rank = F.row_number().over(Window.partitionBy("name").orderBy("file", "at"))
        held = held.withColumn("rank", rank).where(F.col("rank") <= values)
        first = held.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("first"))
        first = first.select("name", F.col("first.value").alias("sample_values"))
        out = out.join(first, "name", "left").withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    found = format_choice({name: f"{name}_n / nullif(filled, 0)" for name in STRING_FORMATS})
    return out.select(
        "name",
        F.row_number().over(Window.orderBy("place")).alias("position"),
        F.coalesce("inferred_type", clash).alias("inferred_type"),
        "class",
        "row_count",
        (F.col("row_count") - F.col("filled")).alias("null_count"),
        (F.col("row_count") > F.col("filled")).alias("nullable"),
        *["min_value", "max_value", "min_text", "max_text"],
        F.expr(f"if(class = 'text', {found}, NULL)").alias("detected_format"),
        "unique_count",
        *(["sample_values"] if values else []),
    ).orderBy("position")


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, file`` of the Parquet files below a folder; nothing of them is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.selectExpr("path", f"{_FILE} AS file")


def _table(spark: SparkSession, state: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{state.rstrip('/')}/{name}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _append(df: DataFrame, state: str, name: str) -> None:
    df.write.mode("append").option("compression", "zstd").parquet(f"{state.rstrip('/')}/{name}")


def _file_stats(df: DataFrame, fields: list[tuple[int, T.StructField]], seen: datetime) -> DataFrame:
    """One row per file and column, from one pass."""
    cells = [F.expr(_FILE).alias("file"), F.col("_metadata.row_index").alias("row")]
    measures, records = [F.count("*").alias("n")], []
    for at, field in fields:
        value, kind = column(field.name), type_class(field.dataType)
        cells += [value.alias(f"c{at}"), _text(field).alias(f"t{at}"), F.xxhash64(_plain(field)).alias(f"h{at}")]
        measures.append(F.count(f"c{at}").alias(f"filled{at}"))
        measures.append(F.hll_sketch_agg(F.when(F.col(f"c{at}").isNotNull(), F.col(f"h{at}")), SKETCH_BITS).alias(f"sketch{at}"))
        near = (F.col("row") < FIRST_ROWS) & F.col(f"c{at}").isNotNull()
        measures.append(F.collect_list(F.when(near, F.struct(F.col("row").alias("at"), F.col(f"t{at}").alias("value")))).alias(f"first{at}"))
        low = high = low_text = high_text = low_at = high_at = F.lit(None)
        counts = {name: F.lit(None) for name in STRING_FORMATS}
        if kind in ("numeric", "temporal"):
            measures += [F.min(f"c{at}").alias(f"min{at}"), F.max(f"c{at}").alias(f"max{at}")]
        if kind == "numeric":
            low, high = F.col(f"min{at}"), F.col(f"max{at}")
        elif kind == "temporal":
            low_text, high_text = F.col(f"min{at}"), F.col(f"max{at}")
            low_at, high_at = _moment(low_text, field.dataType), _moment(high_text, field.dataType)
        elif kind == "text":
            for name in STRING_FORMATS:
                cells.append(F.expr(format_test(quoted(field.name), name)).alias(f"{name}{at}"))
                measures.append(F.count_if(F.col(f"{name}{at}")).alias(f"{name}_n{at}"))
                counts[name] = F.col(f"{name}_n{at}")
        records.append(
            F.struct(
                F.col("n").alias("rows"),
                F.lit(at).alias("position"),
                F.lit(field.name).alias("name"),
                F.lit(type_name(field.dataType)).alias("inferred_type"),
                F.lit(kind).alias("class"),
                F.col(f"filled{at}").alias("filled"),
                low.cast("double").alias("min_value"),
                high.cast("double").alias("max_value"),
                low_text.cast("string").alias("min_text"),
                high_text.cast("string").alias("max_text"),
                low_at.cast("long").alias("min_at"),
                high_at.cast("long").alias("max_at"),
                *[counts[name].cast("long").alias(f"{name}_n") for name in STRING_FORMATS],
                F.slice(F.array_sort(f"first{at}"), 1, SAMPLE_VALUES).alias("first"),
                F.col(f"sketch{at}").alias("sketch"),
            )
        )
    stats = df.select(cells).groupBy("file").agg(*measures)
    return stats.select("file", F.inline(F.array(*records))).withColumn("seen", F.lit(seen))


def _late_values(df: DataFrame, names: list[str]) -> DataFrame:
    """The first values by file of columns that the first rows of some file leave short: one more pass for all of them."""
    cells = [F.struct(F.lit(n).alias("name"), _text(df.schema[n]).alias("value")) for n in names]
    rows = df.select(F.expr(_FILE).alias("file"), F.col("_metadata.row_index").alias("at"), F.inline(F.array(*cells))).where("value IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("file", "name").orderBy("at"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_VALUES)
    return first.groupBy("file", "name").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("first"))


def _digests(df: DataFrame) -> DataFrame:
    """``file, name, digest``: each distinct value of a file's columns once, combined in each task."""
    cells = [F.struct(F.lit(f.name).alias("name"), F.unhex(F.md5(_plain(f).cast("binary"))).alias("digest")) for f in df.schema.fields]
    return df.select(F.expr(_FILE).alias("file"), F.inline(F.array(*cells))).where("digest IS NOT NULL").distinct()


def _text(field: T.StructField) -> Column:
    return F.when(column(field.name).isNotNull(), safe_cast(column(field.name), field.dataType, "VARCHAR"))


def _plain(field: T.StructField) -> Column:
    """A value as text that equal values share and others do not; null stays null."""
    value, dtype = column(field.name), field.dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(value == 0, F.lit("0.0")).otherwise(value.cast("double").cast("string"))
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    if isinstance(dtype, T.MapType):
        value = F.sort_array(F.map_entries(value))
    if isinstance(dtype, (T.MapType, T.ArrayType, T.StructType, T.VariantType)):
        return F.when(column(field.name).isNotNull(), F.to_json(F.struct(value.alias("v"))))
    return value.cast("string")


def _moment(value: Column, dtype: T.DataType) -> Column:
    """A number in the order of dates or moments."""
    return F.unix_date(value) if isinstance(dtype, T.DateType) else F.unix_micros(value.cast("timestamp"))
