"""Windows of arriving files, across restarts."""

from pyspark.sql import functions as F

from sluice.streaming import ingest

SCHEMA = "at timestamp_ntz, k string, v long"


def run(spark, tmp_path, name="out"):
    stream = ingest.arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, 1)
    timed = ingest.windows(stream, "at", "1 hour", "1 hour", ["k"], [F.count("*").alias("n"), F.sum("v").alias("total")])
    return ingest.feed(timed, str(tmp_path / name), str(tmp_path / f"{name}-state"))


def arrive(spark, tmp_path, *rows):
    moments = [(f"2024-01-01 {at}:00", k, v) for at, k, v in rows]
    df = spark.createDataFrame(moments, "at string, k string, v long").withColumn("at", F.col("at").cast("timestamp_ntz"))
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_restart_and_late_rows(spark, tmp_path):
    arrive(spark, tmp_path, ("00:10", "a", 1), ("00:50", "b", 2), ("01:10", "a", 4))
    first = run(spark, tmp_path)
    arrive(spark, tmp_path, ("00:20", "a", 8), ("04:00", "b", 16))  # late, but the window is still open
    second = run(spark, tmp_path)
    arrive(spark, tmp_path, ("00:30", "a", 32), ("03:10", "a", 64))  # the first is too late, the second is not
    third = run(spark, tmp_path)
    assert first < second < third
    run(spark, tmp_path)  # nothing new: an empty batch changes nothing
    found = {(r.since.hour, r.k): (r.n, r.total) for r in ingest.latest(spark, str(tmp_path / "out"), ["k"]).collect()}
    assert found == {(0, "a"): (2, 9), (0, "b"): (1, 2), (1, "a"): (1, 4), (4, "b"): (1, 16), (3, "a"): (1, 64)}


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    arrive(spark, tmp_path, ("00:10", "a", 1), ("01:10", "a", 4))
    run(spark, tmp_path)
    # As after a crash between the write of a batch and its commit: the batch is handled again.
    state = tmp_path / "out-state"
    last = max((state / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.rename(tmp_path / "commit-that-never-was")
    (state / "commits" / f".{last.name}.crc").rename(tmp_path / "its-checksum")
    run(spark, tmp_path)
    found = {r.since.hour: (r.n, r.total) for r in ingest.latest(spark, str(tmp_path / "out"), ["k"]).collect()}
    assert found == {0: (1, 1), 1: (1, 4)}
