"""The registered queries: every operator on the whole given tables.

Round trips write a table in a foreign format into the shared scratch folder and scan it back.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice.operators import joins, ledger, profile, quality, shape
from sluice.operators.positions import skip_rows, skipped_rows
from sluice.operators.profile_state import incremental_profile
from sluice.plans import convert, sink
from sluice.session import scratch_dir
from sluice.sources import databases, exports, files
from sluice.sources.sniff import sniff_report
from sluice.sources.sqlite import scan_sqlite, sqlite_tables
from sluice.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- Scans ---------------------------------------------------------------------------------------


def _written_csv(df: DataFrame, **options) -> str:
    path = scratch_dir(df.sparkSession, "csv")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**{"header": True, "quote": '"', "escape": '"', **keep, **options}).csv(path)
    return path


def _in_few_files(df: DataFrame) -> DataFrame:
    """Two files, or more for larger tables: each is read by several tasks and written by one that reads two splits."""
    return df.coalesce(max(2, math.ceil(df.rdd.getNumPartitions() / 2)))


def scan_csv(spark, sf_dir):
    return files.scan_csv(spark, _written_csv(read(spark, sf_dir, "orders")))


def scan_tsv(spark, sf_dir):
    return files.scan_tsv(spark, _written_csv(read(spark, sf_dir, "customer"), sep="\t"))


def scan_delimited(spark, sf_dir):
    path = _written_csv(read(spark, sf_dir, "part"), sep="||")
    return files.scan_csv(spark, path, delimiter="||")


def scan_csv_quoted(spark, sf_dir):
    """Whole texts with quotes, delimiters and line breaks."""
    path = _written_csv(read(spark, sf_dir, "documents"), emptyValue='""')
    return files.scan_csv(spark, path, multi_line=True, types={"text": "VARCHAR", "lang": "VARCHAR", "source": "VARCHAR"})


def scan_csv_breaks(spark, sf_dir):
    """Whole texts with quotes and line breaks, read with default options; files are split over several tasks."""
    path = _written_csv(_in_few_files(read(spark, sf_dir, "documents")), emptyValue='""')
    return files.scan_csv(spark, path, types={"text": "VARCHAR", "lang": "VARCHAR", "source": "VARCHAR"})


def scan_csv_mixed_headers(spark, sf_dir):
    """Files whose columns come in two orders, with texts that hold line breaks, and columns of their own."""
    path = scratch_dir(spark, "csv")
    docs = read(spark, sf_dir, "documents")
    odd = F.col("doc_id") % 2 == 1
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.where(odd).select("doc_id", "text", "lang").write.options(**options).csv(path)
    docs.where(~odd).select("text", "n_chars", "doc_id").write.mode("append").options(**options).csv(path)
    return files.scan_csv(spark, path, types={"text": "VARCHAR", "lang": "VARCHAR"})


def scan_csv_folders(spark, sf_dir):
    """Columns named by folders next to those of the files."""
    path = scratch_dir(spark, "csv")
    read(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").option("header", True).csv(path)
    return files.scan_csv(spark, path)


def scan_csv_headerless_detected(spark, sf_dir):
    """Files without a header keep their first records."""
    path = _written_csv(read(spark, sf_dir, "lineitem"), header=False)
    return files.scan_csv(spark, path, header=None)


def scan_csv_dialects(spark, sf_dir):
    """One folder of files with commas, semicolons, bars and single quotes; no option says which."""
    path = scratch_dir(spark, "csv")
    parts = read(spark, sf_dir, "part")
    for at, (mark, quote) in enumerate(((",", '"'), (";", '"'), ("|", '"'), (",", "'"))):
        own = parts.where(F.col("p_partkey") % 4 == at).withColumn("p_name", F.concat_ws(f"{mark} ", "p_name", "p_brand"))
        own.write.mode("append").options(header=True, sep=mark, quote=quote, escape=quote).csv(path)
    return files.scan_csv(spark, path, delimiter=None, header=None)


def convert_quarantine(spark, sf_dir):
    """Rows that a conversion cuts (a cell too many) or leaves out (a price that is none), with the reason."""
    root = scratch_dir(spark, "workspace")
    orders = read(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 50 == 7, F.lit("bad")).otherwise(F.col("o_totalprice").cast("string"))
    plain = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", price)
    line = F.when(F.col("o_orderkey") % 11 == 5, F.concat_ws(",", plain, F.lit("extra"))).otherwise(plain)
    # One file for each task, each with its header before its first row.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    headed = F.when(first, F.concat(F.lit("o_orderkey,o_orderstatus,o_totalprice\n"), line)).otherwise(line)
    orders.select(headed.alias("value")).write.text(sink.source_path(root, "acme", "orders"))
    sources = spark.createDataFrame([("orders", "acme", "file", "csv")], ledger.SOURCES)
    work = convert.Workspace(spark, root, sources)
    convert.convert_file(work, "orders", options={"types": {"o_totalprice": "DOUBLE"}})
    return work.quarantine("orders").select(F.split_part("row", F.lit(","), F.lit(1)).cast("bigint").alias("o_orderkey"), "reason", "dropped")


def scan_parquet(spark, sf_dir):
    return files.scan_parquet(spark, f"{sf_dir}/lineitem.parquet")


MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


ARRAY_ROWS = 100_000  # of a JSON array, at most


def _write_arrays(df: DataFrame, path: str, **options: str) -> None:
    """Arrays of ARRAY_ROWS objects at most, without line breaks: each task of a scan frames its own rows, one file for each."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.select(F.struct(*df.columns).alias("row"), F.spark_partition_id().alias("task"), at.alias("at"))
    ends = placed.groupBy("task").agg(F.max("at").alias("end"))
    first, last = F.col("at") % ARRAY_ROWS == 0, (F.col("at") % ARRAY_ROWS == ARRAY_ROWS - 1) | (F.col("at") == F.col("end"))
    framed = F.concat(F.when(first, F.lit("[")).otherwise(F.lit("")), F.to_json("row", options), F.when(last, F.lit("]")).otherwise(F.lit(",")))
    placed.join(F.broadcast(ends), "task").select(framed.alias("value")).write.mode("append").option("lineSep", " ").text(path)


def scan_json(spark, sf_dir):
    path = scratch_dir(spark, "json")
    read(spark, sf_dir, "events").write.option("timestampNTZFormat", MICROS).json(path)
    return files.scan_json(spark, path)


def scan_json_mixed(spark, sf_dir):
    """A folder of files with one object per line and of files that are one array."""
    path = scratch_dir(spark, "json")
    events = read(spark, sf_dir, "events")
    bucket = F.pmod(F.xxhash64("event_id"), F.lit(16))
    events.where(bucket < 8).write.option("timestampNTZFormat", MICROS).json(path)
    _write_arrays(events.where(bucket >= 8), path, timestampNTZFormat=MICROS)
    return files.scan_json(spark, path)


def scan_json_concatenated(spark, sf_dir):
    """Indented objects, many in one file, whose texts hold braces, quotes and line breaks."""
    path = scratch_dir(spark, "json")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.struct("lang", "source").alias("about"), F.concat_ws("", F.lit('}{"'), "text").alias("text"))
    _in_few_files(docs).select(F.to_json(F.struct(*docs.columns), {"pretty": "true"}).alias("value")).write.text(path)
    df = files.scan_json(spark, path)
    return df.select("doc_id", "about.lang", "about.source", F.expr("substring(text, 4)").alias("text"))


def scan_json_array(spark, sf_dir):
    """Arrays without line breaks, each in one file, read by several tasks."""
    path = scratch_dir(spark, "json")
    _write_arrays(read(spark, sf_dir, "lineitem"), path)
    return files.scan_json(spark, path)


def scan_json_nested(spark, sf_dir):
    """Structs, arrays, dates and timestamps survive the trip."""
    path = scratch_dir(spark, "json")
    orders = read(spark, sf_dir, "orders")
    price = F.struct(F.col("o_totalprice").alias("total"), F.array("o_orderkey", "o_custkey").alias("keys"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    moment = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("moment")
    orders.select("o_orderkey", price.alias("price"), day, moment).write.json(path)
    df = files.scan_json(spark, path)
    return df.select(
        "o_orderkey", F.col("price.total").alias("total"), F.col("price.keys")[1].alias("custkey"), F.dayofmonth("day").alias("day"), "moment"
    )


def scan_geojson(spark, sf_dir):
    """One FeatureCollection of two features per customer; each is one row of the scan."""
    path = scratch_dir(spark, "geojson")

    def feature(x: Column, y: Column) -> Column:
        point = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
        return F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("c_custkey", "c_name").alias("properties"))

    nation, balance = F.col("c_nationkey").cast("double"), F.col("c_acctbal")
    features = F.array(feature(nation, balance), feature(balance, nation)).alias("features")
    read(spark, sf_dir, "customer").select(F.lit("FeatureCollection").alias("type"), features).write.json(path)
    df = files.scan_geojson(spark, path)
    last = F.col("features")[1]
    return df.select("type", F.size("features").alias("feature_count"), last["geometry"]["coordinates"][0].alias("x"), last["properties"]["c_custkey"].alias("c_custkey"))


def scan_excel(spark, sf_dir):
    path = scratch_dir(spark, "excel")
    exports.export_workbooks(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, ("Notes", "Parts"))
    return files.scan_excel(spark, path, sheet_name="Parts")


def csv_null_padding(spark, sf_dir):
    """Every third row is written without its last cell."""
    orders = read(spark, sf_dir, "orders")
    cells = [F.col("o_orderkey").cast("string"), F.col("o_orderstatus")]
    short = F.concat_ws(",", *cells)
    line = F.when(F.col("o_orderkey") % 3 == 0, short).otherwise(F.concat_ws(",", short, F.col("o_totalprice").cast("string")))
    path = scratch_dir(spark, "csv")
    orders.select(line.alias("value")).write.text(path)
    return files.scan_csv(spark, path, header=False).toDF("o_orderkey", "o_orderstatus", "o_totalprice")


def csv_long_rows(spark, sf_dir):
    """Rows with a cell too many, as raw text."""
    orders = read(spark, sf_dir, "orders")
    plain = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"))
    line = F.when(F.col("o_orderkey") % 11 == 5, F.concat_ws(",", plain, F.lit("extra"))).otherwise(plain)
    path = scratch_dir(spark, "csv")
    orders.select(line.alias("value")).write.text(path)
    return files.long_rows(spark, path, width=2)


def csv_ignore_errors(spark, sf_dir):
    """Rows with an unreadable price are dropped whole."""
    price = F.when(F.col("o_orderkey") % 50 == 7, F.lit("bad")).otherwise(F.col("o_totalprice").cast("string"))
    path = _written_csv(read(spark, sf_dir, "orders").select("o_orderkey", price.alias("o_totalprice")))
    return files.scan_csv(spark, path, types={"o_totalprice": "DOUBLE"})


def sniff_types(spark, sf_dir):
    path = _written_csv(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"))
    return sniff_report(files.csv_text(spark, path))


def scan_sqlite_files(spark, sf_dir):
    path = exports.export_sqlite(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), scratch_dir(spark, "sqlite"), "supplier")
    return scan_sqlite(spark, path, "supplier")


def source_tables(spark, sf_dir):
    path = exports.export_sqlite(read(spark, sf_dir, "supplier"), scratch_dir(spark, "sqlite"), "supplier")
    return sqlite_tables(spark, path)


def _orders_database(spark, sf_dir):
    return exports.export_database(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "orders_copy")


def scan_jdbc(spark, sf_dir):
    return databases.scan_jdbc(spark, _orders_database(spark, sf_dir), table="orders_copy")


def scan_jdbc_partitioned(spark, sf_dir):
    options = _orders_database(spark, sf_dir)
    return databases.scan_jdbc(spark, options, table="orders_copy", partition_column="o_orderkey", partition_num=4)


def scan_jdbc_skewed(spark, sf_dir):
    """Nine of ten rows in a hundredth of the key's range, and rows without a key; ranges hold about as many rows each."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    far = F.when(F.col("o_orderkey") % 500 == 3, F.lit(None)).when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey") * 1000).otherwise(F.col("o_orderkey"))
    options = exports.export_database(orders.withColumn("far", far), "orders_far")
    return databases.scan_jdbc(spark, options, table="orders_far", partition_column="far", partition_num=6)


def extract_query_two_databases(spark, sf_dir):
    """Tables of one name in two databases of one kind, each by SQL under the same prefix, joined."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    query = 'SELECT "o_orderkey", "o_totalprice" FROM pg.ORDERS_COPY WHERE "o_totalprice" > 1000'.replace('"', "`")
    found = [databases.query_catalog(spark, "pg", exports.export_database(part, "orders_copy"), query) for part in (orders, orders.withColumn("o_totalprice", -F.col("o_totalprice") + 200_000))]
    other = found[1].select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("rest"))
    return found[0].join(other, F.col("o_orderkey") == F.col("key")).select("o_orderkey", "o_totalprice", "rest")


def extract_table(spark, sf_dir):
    path = exports.export_sqlite(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), scratch_dir(spark, "sqlite"), "supplier")
    return databases.extract_table(spark, "sqlite", {"file_path": path}, "supplier")


def extract_query_database(spark, sf_dir):
    """A query that the database itself runs."""
    query = 'SELECT "o_orderkey", "o_totalprice" FROM orders_copy WHERE "o_totalprice" > 100000'
    return databases.scan_jdbc(spark, _orders_database(spark, sf_dir), query=query)


def extract_query_prefix(spark, sf_dir):
    """A query over the prefixed tables of an attached file."""
    path = exports.export_sqlite(read(spark, sf_dir, "customer"), scratch_dir(spark, "sqlite"), "customers")
    query = "SELECT c_custkey, c_name FROM sqlite.customers WHERE c_acctbal > 0"
    return databases.extract_query(spark, "sqlite", {"database": path}, query)


# --- Shape ---------------------------------------------------------------------------------------


def column_mapping(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return shape.rename(orders, {"o_orderkey": "order_id", "o_custkey": "customer_id", "unknown": "ignored"})


def type_overrides(spark, sf_dir):
    priority = F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("o_orderpriority")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", priority)
    return shape.cast(orders, {"o_totalprice": "INTEGER", "o_orderdate": "DATE", "o_orderpriority": "INTEGER"})


def type_overrides_text(spark, sf_dir):
    """Numbers, dates and decimals to and from text, on whole columns."""
    line = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_shipdate", F.col("l_quantity").cast("string").alias("l_quantity")
    )
    types = {"l_extendedprice": "VARCHAR", "l_tax": "DECIMAL(10,1)", "l_shipdate": "VARCHAR", "l_quantity": "SMALLINT"}
    return shape.cast(line, types)


def rename_and_cast(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    mapping = {"o_orderkey": "id", "o_totalprice": "amount", "o_custkey": "cust"}
    return shape.shape(orders, mapping, {"amount": "BIGINT", "o_totalprice": "VARCHAR", "o_custkey": "VARCHAR"})


SKIPPED = [0, 1, 7, 100]


def skip_rows_ordered(spark, sf_dir):
    return skip_rows(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), SKIPPED, ["o_orderkey"])


def skip_rows_file(spark, sf_dir):
    """Positions in a folder of CSV files written in key order."""
    path = _written_csv(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey"))
    return skip_rows(files.scan_csv(spark, path), SKIPPED)


def skip_rows_many(spark, sf_dir):
    """Two of three rows by position: a list as long as the table."""
    lines = read(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    positions = spark.range(1_000_000).where("id % 3 <> 1")
    return skip_rows(lines.select(*keys), positions, keys)


def skip_rows_count(spark, sf_dir):
    return skipped_rows(read(spark, sf_dir, "orders"), [*SKIPPED, 999_999_999], ["o_orderkey"])


def describe_columns(spark, sf_dir):
    """Names, types and classes as read back from a written copy, with the values each column holds."""
    path = scratch_dir(spark, "parquet")
    sink.write_parquet(read(spark, sf_dir, "customer"), path)
    back = spark.read.parquet(path)
    filled = profile.column_stats(back, formats=False).select("name", (F.col("row_count") - F.col("null_count")).alias("value_count"))
    return shape.describe_columns(back).join(F.broadcast(filled), "name")


# --- Sinks ---------------------------------------------------------------------------------------


def sink_parquet(spark, sf_dir):
    path = scratch_dir(spark, "parquet")
    sink.write_parquet(read(spark, sf_dir, "lineitem"), path)
    return spark.read.parquet(path)


def sink_compression(spark, sf_dir):
    out = None
    for codec in sink.CODECS:
        path = scratch_dir(spark, "parquet")
        sink.write_parquet(read(spark, sf_dir, "orders"), path, compression=codec)
        part = spark.read.parquet(path).agg(F.lit(codec).alias("codec"), F.count("*").alias("n"))
        out = part if out is None else out.unionAll(part)
    return out


def versioned_output(spark, sf_dir):
    path = sink.output_path(scratch_dir(spark, "workspace"), "acme", "supplier", 1)
    sink.write_checked(read(spark, sf_dir, "supplier"), path)
    return spark.read.parquet(path)


def output_summary(spark, sf_dir):
    path = scratch_dir(spark, "parquet")
    sink.write_checked(read(spark, sf_dir, "customer"), path)
    return sink.output_summary(spark, path)


# --- Profile -------------------------------------------------------------------------------------


def _holes(spark, sf_dir) -> DataFrame:
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).alias("price")
    prio = F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("prio")
    return read(spark, sf_dir, "orders").select("o_orderkey", price, prio)


def sample_limit(spark, sf_dir):
    return profile.sample(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 1000, ["o_orderkey"])


def head_sample(spark, sf_dir):
    return profile.head(read(spark, sf_dir, "customer"), ["c_custkey"])


def profile_totals(spark, sf_dir):
    return profile.totals(read(spark, sf_dir, "orders"))


def profile_nulls(spark, sf_dir):
    return profile.null_counts(_holes(spark, sf_dir))


def profile_distinct(spark, sf_dir):
    counts = profile.distinct_counts(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey", "o_orderpriority"])
    return counts.select("name", "unique_count")


def profile_sample_values(spark, sf_dir):
    return profile.sample_values(_holes(spark, sf_dir), ["price"], ["o_orderkey"])


def profile_minmax_numeric(spark, sf_dir):
    return profile.numeric_ranges(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_linenumber", "l_extendedprice"])


def profile_minmax_temporal(spark, sf_dir):
    shipped = profile.temporal_ranges(read(spark, sf_dir, "lineitem"), ["l_shipdate"])
    return shipped.unionByName(profile.temporal_ranges(read(spark, sf_dir, "events"), ["ts"]))


def detect_string_format(spark, sf_dir):
    digest = F.md5("c_name")
    uid = F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    customers = read(spark, sf_dir, "customer").select(
        F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@example.com")).alias("mail"),
        F.concat(F.lit("+41 44 "), (F.col("c_custkey") + 1000000).cast("string")).alias("tel"),
        uid.alias("uid"),
        F.col("c_mktsegment").alias("none"),
    )
    pages = read(spark, sf_dir, "pages").select("url")
    return profile.detected_formats(customers).unionByName(profile.detected_formats(pages))


def warn_high_null(spark, sf_dir):
    return quality.null_warnings(_holes(spark, sf_dir), ["price", "prio"])


def _mixed(spark, sf_dir) -> DataFrame:
    mixed = F.when(F.col("p_partkey") % 10 == 3, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", mixed.alias("mixed"))


def warn_type_inconsistency(spark, sf_dir):
    found = quality.type_warnings(_mixed(spark, sf_dir), ["p_partkey"])
    return found.select("column_name", "issue", F.explode("affected_rows").alias("affected_row"))


def numeric_text_shares(spark, sf_dir):
    shares = quality.numeric_text_shares(_mixed(spark, sf_dir))
    return shares.select("column_name", F.round("numeric_share", 6).alias("numeric_share"), "other_count")


def profile_columns(spark, sf_dir):
    columns = profile.profile(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), values=0)
    return columns.select("name", "inferred_type", "null_count", "unique_count", "min_value", "max_value")


def profile_wide(spark, sf_dir):
    """Every column of the largest table, with ranges, distinct counts and first values."""
    columns = profile.profile(read(spark, sf_dir, "lineitem"), order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], values=1)
    first = F.col("sample_values")[0].alias("first_value")
    return columns.select("name", "inferred_type", "null_count", "unique_count", "min_value", "max_value", "min_text", "max_text", first)


def profile_incremental(spark, sf_dir):
    """Orders arrive in two lots of files; the profile after the second reads its files alone and merges the kept states."""
    path, state = scratch_dir(spark, "parquet"), scratch_dir(spark, "profile")
    orders = read(spark, sf_dir, "orders")
    late = F.col("o_orderkey") % 4 == 3
    for lot, chosen in (("first", ~late), ("second", late)):
        orders.where(chosen).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(f"{path}/{lot}")
        columns = incremental_profile(spark, path, state, values=1)
    first = F.col("sample_values")[0].alias("first_value")
    return columns.select("name", "inferred_type", "null_count", "unique_count", "min_value", "max_value", "min_text", "max_text", first)


def sample_uniform(spark, sf_dir):
    return profile.uniform_sample(read(spark, sf_dir, "orders"), 1000, ["o_orderkey"])


# --- Joins by order ------------------------------------------------------------------------------


def join_asof(spark, sf_dir):
    """Every event with the last purchase of its user up to then."""
    events = read(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("bought_id"), F.col("value").alias("bought_value"))
    asked = events.select("event_id", "user_id", "ts", "event_type")
    return joins.asof_join(asked, bought, "ts", ["user_id"], ["bought_id", "bought_value"])


def join_interval(spark, sf_dir):
    """For every returned line, the lines that its supplier shipped within a week before or after."""
    lines = read(spark, sf_dir, "lineitem")
    week = F.expr("INTERVAL 7 DAYS")
    back = lines.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("r_orderkey"), F.col("l_linenumber").alias("r_linenumber"), F.col("l_partkey").alias("r_partkey"), "l_suppkey",
        (F.col("l_shipdate") - week).alias("since"), (F.col("l_shipdate") + week).alias("until"),
    )
    sent = lines.select("l_suppkey", "l_shipdate", "l_quantity")
    pairs = joins.interval_join(back, sent, ("since", "until"), ("l_shipdate", "l_shipdate"), ["l_suppkey"])
    return pairs.groupBy("r_orderkey", "r_linenumber", "r_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


# --- Streams -------------------------------------------------------------------------------------

ARRIVALS = 6  # files, by a sixth of the time that the events span; every seventh event comes two files late


def stream_windows(spark, sf_dir):
    """Events by type and six hours, from files that arrive one after the other, the feed restarted half way."""
    events = read(spark, sf_dir, "events")
    path, out, checkpoint = (scratch_dir(spark, f"stream-{name}") for name in ("in", "out", "checkpoint"))
    first, last = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    due = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - first) * ARRIVALS / (last - first + 1)).cast("int")
    placed = events.withColumn("arrival", F.least(F.lit(ARRIVALS - 1), due + F.when(F.col("event_id") % 7 == 0, F.lit(2)).otherwise(F.lit(0))))
    sums = [F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")]
    for number in range(ARRIVALS):
        # One file each, so that a batch is a file; a feed of real files takes them as they come.
        placed.where(F.col("arrival") == number).drop("arrival").coalesce(1).write.mode("append").parquet(path)
        if number in (ARRIVALS // 2, ARRIVALS - 1):
            stream = ingest.windows(ingest.arriving(spark, path, events.schema, 1), "ts", "6 hours", "6 hours", ["event_type"], sums)
            ingest.feed(stream, out, checkpoint)
    return ingest.latest(spark, out, ["event_type"]).withColumn("since", F.col("since").cast("timestamp_ntz")).drop("until")


# --- Whole conversions ---------------------------------------------------------------------------


def convert_file(spark, sf_dir):
    """CSV upload -> typed, renamed Parquet version 1, read back through the ledger."""
    root = scratch_dir(spark, "workspace")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"))
    orders.write.option("header", True).csv(sink.source_path(root, "acme", "orders"))
    sources = spark.createDataFrame([("orders", "acme", "file", "csv")], ledger.SOURCES)
    work = convert.Workspace(spark, root, sources)
    options = {"column_mapping": {"o_orderkey": "order_id"}, "type_overrides": {"o_totalprice": "BIGINT", "o_custkey": "VARCHAR"}}
    convert.convert_file(work, "orders", options=options)
    return work.read("orders")


def convert_database(spark, sf_dir):
    """SQLite files -> Parquet version 1, read back through the ledger."""
    root = scratch_dir(spark, "workspace")
    path = exports.export_sqlite(read(spark, sf_dir, "orders"), scratch_dir(spark, "sqlite"), "orders")
    sources = spark.createDataFrame([("orders", "acme", "database", "sqlite")], ledger.SOURCES)
    work = convert.Workspace(spark, root, sources)
    convert.convert_database(work, "orders", {"file_path": path}, table_name="orders")
    return work.read("orders")


# --- User SQL ------------------------------------------------------------------------------------

USER_SQL = {
    "extract_query_filter": (["orders"], "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP_NTZ '1998-01-01'"),
    "extract_query_predicate": (["customer"], "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0"),
    "extract_query_join": (
        ["customer", "orders"],
        "SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey",
    ),
    "extract_query_semi_anti": (
        ["customer", "orders"],
        "SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AS has_orders FROM customer c",
    ),
    "extract_query_group": (
        ["orders"],
        "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers"
        " FROM orders GROUP BY o_orderstatus",
    ),
    "extract_query_rollup": (
        ["lineitem"],
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    ),
    "extract_query_window": (
        ["orders"],
        "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn"
        " FROM orders",
    ),
    "extract_query_topk": (["orders"], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
    "extract_query_setops": (
        ["customer", "supplier", "nation"],
        "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0",
    ),
    "extract_query_scalar": (
        ["orders"],
        "SELECT o_orderkey, upper(o_orderpriority) AS prio, year(o_orderdate) AS y, round(o_totalprice / 100, 1) AS hundreds FROM orders",
    ),
    "extract_query_json": (["events"], "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events"),
}


def _user_sql(name: str) -> Query:
    def run(spark, sf_dir):
        tables, query = USER_SQL[name]
        return databases.run_sql(spark, query, {t: read(spark, sf_dir, t) for t in tables})

    return run


# --- Ledger --------------------------------------------------------------------------------------


def _attempts(spark, sf_dir, *extra: Column) -> DataFrame:
    """Events as conversion attempts: one source per user, an ``error`` event is a failure."""
    status = F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("active")).alias("status")
    return read(spark, sf_dir, "events").select(F.col("ts").alias("event_ts"), F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), status, *extra)


def ledger_assign_versions(spark, sf_dir):
    numbered = ledger.assign_versions(_attempts(spark, sf_dir))
    return numbered.select(F.col("id").alias("event_id"), "source_id", "status", "version")


def ledger_latest_status(spark, sf_dir):
    return ledger.latest_status(ledger.assign_versions(_attempts(spark, sf_dir)))


def ledger_version_records(spark, sf_dir):
    size = F.floor("value").cast("bigint").alias("file_size_bytes")
    attempts = ledger.assign_versions(_attempts(spark, sf_dir, size, F.col("props").alias("error_message")))
    return ledger.version_records(attempts, ("file_size_bytes", "error_message")).withColumnRenamed("id", "event_id")


def ledger_current_version(spark, sf_dir):
    return ledger.current_versions(ledger.assign_versions(_attempts(spark, sf_dir)))


def ledger_metrics(spark, sf_dir):
    size = F.floor("value").cast("bigint").alias("file_size_bytes")
    attempts = _attempts(spark, sf_dir, F.col("event_id").alias("row_count"), size)
    return ledger.latest_metrics(attempts, ("row_count", "file_size_bytes"))


def ledger_last_query(spark, sf_dir):
    return ledger.last_queries(_attempts(spark, sf_dir, F.col("props").alias("extraction_query")))


def ledger_source_lookup(spark, sf_dir):
    """The source of every request: orders ask for customers."""
    requests = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("source_id"))
    sources = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_mktsegment").alias("connector_type"))
    return ledger.resolve_sources(requests, sources)


QUERIES: dict[str, Query] = {
    "scan_csv": scan_csv,
    "scan_tsv": scan_tsv,
    "scan_delimited": scan_delimited,
    "scan_csv_quoted": scan_csv_quoted,
    "scan_csv_breaks": scan_csv_breaks,
    "scan_csv_mixed_headers": scan_csv_mixed_headers,
    "scan_csv_folders": scan_csv_folders,
    "scan_csv_headerless_detected": scan_csv_headerless_detected,
    "scan_csv_dialects": scan_csv_dialects,
    "convert_quarantine": convert_quarantine,
    "scan_parquet": scan_parquet,
    "scan_json": scan_json,
    "scan_json_mixed": scan_json_mixed,
    "scan_json_concatenated": scan_json_concatenated,
    "scan_json_array": scan_json_array,
    "scan_json_nested": scan_json_nested,
    "scan_geojson": scan_geojson,
    "scan_excel": scan_excel,
    "csv_null_padding": csv_null_padding,
    "csv_long_rows": csv_long_rows,
    "csv_ignore_errors": csv_ignore_errors,
    "sniff_types": sniff_types,
    "scan_sqlite": scan_sqlite_files,
    "source_tables": source_tables,
    "scan_jdbc": scan_jdbc,
    "scan_jdbc_partitioned": scan_jdbc_partitioned,
    "scan_jdbc_skewed": scan_jdbc_skewed,
    "extract_query_two_databases": extract_query_two_databases,
    "extract_table": extract_table,
    "extract_query_database": extract_query_database,
    "extract_query_prefix": extract_query_prefix,
    "column_mapping": column_mapping,
    "type_overrides": type_overrides,
    "type_overrides_text": type_overrides_text,
    "rename_and_cast": rename_and_cast,
    "skip_rows": skip_rows_ordered,
    "skip_rows_file": skip_rows_file,
    "skip_rows_many": skip_rows_many,
    "skip_rows_count": skip_rows_count,
    "sample_uniform": sample_uniform,
    "join_asof": join_asof,
    "join_interval": join_interval,
    "describe_columns": describe_columns,
    "sink_parquet": sink_parquet,
    "sink_compression": sink_compression,
    "versioned_output": versioned_output,
    "output_summary": output_summary,
    "sample_limit": sample_limit,
    "head_sample": head_sample,
    "profile_totals": profile_totals,
    "profile_nulls": profile_nulls,
    "profile_distinct": profile_distinct,
    "profile_sample_values": profile_sample_values,
    "profile_minmax_numeric": profile_minmax_numeric,
    "profile_minmax_temporal": profile_minmax_temporal,
    "detect_string_format": detect_string_format,
    "warn_high_null": warn_high_null,
    "warn_type_inconsistency": warn_type_inconsistency,
    "numeric_text_shares": numeric_text_shares,
    "profile_columns": profile_columns,
    "profile_wide": profile_wide,
    "profile_incremental": profile_incremental,
    "stream_windows": stream_windows,
    "convert_file": convert_file,
    "convert_database": convert_database,
    **{name: _user_sql(name) for name in USER_SQL},
    "ledger_assign_versions": ledger_assign_versions,
    "ledger_latest_status": ledger_latest_status,
    "ledger_version_records": ledger_version_records,
    "ledger_current_version": ledger_current_version,
    "ledger_metrics": ledger_metrics,
    "ledger_last_query": ledger_last_query,
    "ledger_source_lookup": ledger_source_lookup,
}
