"""Files that keep arriving: windows by event time, written batch by batch.

Spark keeps the open windows as keyed state below the checkpoint folder, combines rows in each task before they are
shuffled, and forgets a window once the watermark has passed its end. A batch is written into a folder named by its
number, which replaces what an earlier run of the same batch left: after a restart every batch counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder, each read once, the older first."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def windows(rows: DataFrame, at: str, width: str, delay: str, keys: list[str], measures: list[Column]) -> DataFrame:
    """``since, until``, keys and measures of each window of ``width``.

    Rows may come up to ``delay`` late; a row whose window had ended before the watermark of the batch before is
    dropped. A null moment belongs to no window.
    """
    timed = rows.where(F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    grouped = timed.groupBy(F.window(at, width).alias("w"), *keys).agg(*measures)
    return grouped.select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), *keys, *[c for c in grouped.columns if c not in ("w", *keys)])


def feed(stream: DataFrame, out: str, checkpoint: str) -> int:
    """Handles all files that have arrived and ends; returns the number of the last batch, -1 if there was none.

    Each batch holds the windows that it changed, as they are behind it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return max((p["batchId"] for p in query.recentProgress), default=-1)


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Every window as the last batch that changed it left it."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    rest = [c for c in rows.columns if c not in ("since", "until", "batch", *keys)]
    last = rows.groupBy("since", "until", *keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select("since", "until", *keys, "last.*")
