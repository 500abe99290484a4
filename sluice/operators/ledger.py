"""The version ledger: append-only status events, folded with aggregates and windows.

Every fold but the version numbering is an aggregate that combines map-side, so a source with a
third of all events costs one row per task. Numbering needs the order inside a source; see
``running_count``.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sluice.session import scratch_dir

STATUSES = ("pending", "active", "error")

EVENTS = T.StructType(
    [
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("column_count", T.IntegerType()),
        T.StructField("file_size_bytes", T.LongType()),
        T.StructField("processing_time_seconds", T.DoubleType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("extraction_query", T.StringType()),
    ]
)
SOURCES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("organization_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("connector_type", T.StringType()),
    ]
)
METRICS = ("row_count", "column_count", "file_size_bytes", "processing_time_seconds", "error_message")
BUCKETS = 64

# A source above both bounds is split: this many events, this share of all events. The share
# bounds the number of such sources by its inverse, whatever the size of the ledger.
HOT_EVENTS = 1_000_000
HOT_SHARE = 1 / 50_000


def append_events(events: DataFrame, path: str, source_id: str | None = None) -> None:
    """Add events, below the folder of their source's bucket, in a folder of their own.

    With ``source_id`` all events are of that source; writers of single sources never meet. Bulk
    loads without it should not run side by side.
    """
    if [(f.name, f.dataType) for f in events.schema.fields] != [(f.name, f.dataType) for f in EVENTS.fields]:
        raise ValueError("events must have the ledger's columns")
    batch = uuid.uuid4().hex
    if source_id is not None:
        events.write.parquet(f"{bucket_path(path, source_id)}/batch={batch}")
        return
    placed = events.withColumn("bucket", F.crc32(F.col("source_id").cast("binary")) % BUCKETS).withColumn("batch", F.lit(batch))
    placed.write.mode("append").partitionBy("bucket", "batch").parquet(path)


def bucket_path(path: str, source_id: str) -> str:
    return f"{path}/bucket={zlib.crc32(source_id.encode()) % BUCKETS}"


def read_events(spark: SparkSession, path: str, source_id: str | None = None) -> DataFrame:
    """The events; with ``source_id`` those of that source, and only its bucket is listed and read."""
    if source_id is not None:
        return spark.read.schema(EVENTS).parquet(bucket_path(path, source_id)).where(F.col("source_id") == source_id).select(EVENTS.fieldNames())
    return spark.read.schema(EVENTS).parquet(path).select(EVENTS.fieldNames())


def assign_versions(
    attempts: DataFrame,
    source: str = "source_id",
    order_by: tuple[str, ...] = ("event_ts", "id"),
    succeeded: Column | None = None,
    hot_events: int = HOT_EVENTS,
) -> DataFrame:
    """Number the attempts of each source: 1 + earlier successes, so a failed number is used again."""
    done = succeeded if succeeded is not None else F.col("status") == "active"
    flagged = attempts.withColumn("_done", F.when(done, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    counted = running_count(flagged, source, list(order_by), "_done", "_before", hot_events)
    return counted.withColumn("version", F.col("_before") + 1).drop("_done", "_before")


def running_count(df: DataFrame, group: str, order_by: list[str], flag: str, out: str, hot_rows: int = HOT_EVENTS) -> DataFrame:
    """``out`` = sum of ``flag`` over the earlier rows of the group.

    Groups of normal size take one window, that is one shuffle by group. A hot group is sorted into
    slices across the cluster, summed within each slice, and shifted by the sums of the slices
    before. Counting the groups reads one column and combines map-side.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_rows"))
    total, largest = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    bound = max(hot_rows, int(total * HOT_SHARE))
    if largest <= bound:
        return _running(df, [group], order_by, flag, out)
    # Fewer than total / bound groups, that is 50,000 at most: small enough to hold and to broadcast.
    found = sizes.where(F.col("_rows") > bound).select(F.col(group).alias("_hot"))
    hot = F.broadcast(df.sparkSession.createDataFrame(found.collect(), found.schema))
    is_hot = F.col(group).eqNullSafe(F.col("_hot"))
    cold = df.join(hot, is_hot, "left_anti")
    sliced = _sliced(df.join(hot, is_hot, "left_semi"), group, order_by, -(-total // bound) * 2)
    order = [*order_by, "_tie"]
    offsets = _slice_offsets(sliced, group, order, flag)
    within = _running(sliced, ["_slice", group], order, flag, "_within")
    same = within["_slice"].eqNullSafe(offsets["_slice"]) & within[group].eqNullSafe(offsets["_group"])
    # At most (slices + hot groups) offsets.
    shifted = within.join(F.broadcast(offsets), same, "left").withColumn(out, F.col("_within") + F.col("_shift"))
    return _running(cold, [group], order_by, flag, out).unionByName(shifted.select(*df.columns, out))


def _running(df: DataFrame, groups: list[str], order_by: list[str], flag: str, out: str) -> DataFrame:
    earlier = Window.partitionBy(*groups).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(flag).over(earlier), F.lit(0)))


def _sliced(df: DataFrame, group: str, order_by: list[str], slices: int) -> DataFrame:
    """The rows range-partitioned into part files by (group, order); ``_slice`` names the file.

    Written to the shared folder, so that a lost executor cannot change the slice of a row.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "slices")
    # The last key splits rows with equal keys over several slices.
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    tied.repartitionByRange(slices, group, *order_by, "_tie").write.parquet(path)
    return spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_slice"))


def _slice_offsets(sliced: DataFrame, group: str, order_by: list[str], flag: str) -> DataFrame:
    sums = sliced.groupBy("_slice", F.col(group).alias("_group")).agg(F.sum(flag).alias("_sum"), F.min(F.struct(*order_by)).alias("_first"))
    before = Window.partitionBy("_group").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_slice", "_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"))


def latest_status(events: DataFrame, order_by: tuple[str, ...] = ("event_ts", "id")) -> DataFrame:
    """The last status written for each version record."""
    return events.groupBy("source_id", "version").agg(F.max_by("status", F.struct(*order_by)).alias("status"))


def current_versions(events: DataFrame) -> DataFrame:
    """The highest active version of each source, 0 when there is none."""
    active = F.when(F.col("status") == "active", F.col("version"))
    return events.groupBy("source_id").agg(F.coalesce(F.max(active), F.lit(0)).alias("current_version"))


def version_records(events: DataFrame, metrics: tuple[str, ...] = METRICS, order_by: tuple[str, ...] = ("event_ts", "id")) -> DataFrame:
    """One row per attempt, by the id of its record: a failed one stays visible next to its retry.

    Each has its last status and last non-null metrics; a size of 0 is no size, and a success clears the error message.
    """
    order = F.struct(*order_by)
    kept = {m: F.nullif(F.col(m), F.lit(0)) if m == "file_size_bytes" else F.col(m) for m in metrics}
    last = [F.max_by(m, F.when(value.isNotNull(), order)).alias(m) for m, value in kept.items()]
    records = events.groupBy("id", "source_id", "version").agg(F.max_by("status", order).alias("status"), *last)
    if "error_message" not in metrics:
        return records
    return records.withColumn("error_message", F.when(F.col("status") != "active", F.col("error_message")))


def latest_metrics(events: DataFrame, metrics: tuple[str, ...] = METRICS[:4], order_by: tuple[str, ...] = ("event_ts", "id")) -> DataFrame:
    """Metrics of the last active event of each source; size 0 is no size."""
    sized = events.where(F.col("status") == "active")
    if "file_size_bytes" in metrics:
        sized = sized.withColumn("file_size_bytes", F.nullif(F.col("file_size_bytes"), F.lit(0)))
    last = sized.groupBy("source_id").agg(F.max_by(F.struct(*metrics), F.struct(*order_by)).alias("last"))
    return last.select("source_id", "last.*")


def last_queries(events: DataFrame, order_by: tuple[str, ...] = ("event_ts", "id")) -> DataFrame:
    """The query of the last extraction of each source that recorded one."""
    asked = events.where((F.col("status") == "active") & F.col("extraction_query").isNotNull() & (F.col("extraction_query") != ""))
    return asked.groupBy("source_id").agg(F.max_by("extraction_query", F.struct(*order_by)).alias("extraction_query"))


def lookup_sources(sources: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """The sources with the given ids; the filter reaches the scan."""
    return sources.where(F.col(key).isin(list(ids)))


def resolve_sources(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Each request (with ``source_id``) with its source; ``found`` is false for an unknown one."""
    known = sources.withColumn("found", F.lit(True))
    joined = requests.join(known.withColumnRenamed("id", "source_id"), "source_id", "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def get_source(sources: DataFrame, source_id: str) -> dict:
    """One source as a dict; a missing one raises ``ValueError``."""
    found = lookup_sources(sources, [source_id]).limit(2).collect()
    if not found:
        raise ValueError(f"no source {source_id!r}")
    return found[0].asDict()
