"""Kept profiles against profiles of the whole table."""

import os

import pytest
from pyspark.sql import functions as F

from sluice.operators import ledger, profile
from sluice.operators.profile_state import incremental_profile, merged, update
from sluice.plans.convert import Workspace, convert_file


def frame(spark, low, high):
    rows = spark.range(low, high, 1, 1)
    return rows.select(
        "id",
        F.expr("CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN -0D WHEN id % 5 = 1 THEN 0D WHEN id % 11 = 0 THEN double('nan') ELSE id / 4D END AS price"),
        F.expr("concat('u', id % 40, '@example.com') AS name"),
        F.expr("date_add(DATE'2020-01-01', CAST(id % 90 AS INT)) AS day"),
        F.expr("timestamp_ntz'1969-12-30 00:00:00.5' + make_interval(0, 0, 0, CAST(id % 13 AS INT)) AS at"),
        F.expr("if(id % 3 = 0, NULL, array(CAST(id % 4 AS STRING), NULL)) AS tags"),
        F.expr("if(id % 100 = 99, concat('late', id), NULL) AS late"),
        F.expr("CAST(id % 6 AS INT) AS `odd.na``me`"),
        F.expr("CAST(NULL AS STRING) AS empty"),
        F.expr("CAST(CAST(id % 9 AS STRING) AS BINARY) AS raw"),
    )


def rows_of(df):
    return {r.name: r.asDict() for r in df.collect()}


def same(found, want):
    assert list(found) == list(want)
    for name, row in want.items():
        assert {k: str(v) for k, v in found[name].items()} == {k: str(v) for k, v in row.items()}


def test_equals_the_profile_of_the_whole(spark, tmp_path):
    path, state = str(tmp_path / "t"), str(tmp_path / "state")
    frame(spark, 0, 700).write.parquet(f"{path}/a")
    first = incremental_profile(spark, path, state)
    same(rows_of(first), rows_of(profile.profile(spark.read.parquet(f"{path}/a"), order_by=["id"])))
    assert update(spark, path, state) == []
    # The old files are not opened again: their bytes may be anything.
    for name in os.listdir(f"{path}/a"):
        if name.endswith(".parquet"):
            own = os.path.join(path, "a", name)
            old, size = os.stat(own), os.path.getsize(own)
            with open(own, "wb") as out:
                out.write(b"x" * size)
            os.utime(own, ns=(old.st_atime_ns, old.st_mtime_ns))
    frame(spark, 700, 1500).write.parquet(f"{path}/b")
    read = update(spark, path, state)
    assert read and all("/b/" in p for p in read)
    whole = frame(spark, 0, 700).unionAll(frame(spark, 700, 1500))
    found = rows_of(merged(spark, path, state))
    same(found, rows_of(profile.profile(whole, order_by=["id"])))
    assert found["late"]["sample_values"] == [f"late{i}" for i in (99, 199, 299, 399, 499)]
    estimated = rows_of(merged(spark, path, state, approximate=True, values=0))
    assert "sample_values" not in estimated["id"]
    assert estimated["id"]["unique_count"] == pytest.approx(1500, rel=0.08) and estimated["empty"]["unique_count"] == 0


def test_gone_changed_and_repeated_files(spark, tmp_path):
    path, state = str(tmp_path / "t"), str(tmp_path / "state")
    frame(spark, 0, 50).write.parquet(f"{path}/a")
    frame(spark, 50, 80).write.parquet(f"{path}/b")
    update(spark, path, state)
    frame(spark, 20, 200).write.mode("overwrite").parquet(f"{path}/b")
    whole = frame(spark, 0, 50).unionAll(frame(spark, 20, 200))
    same(rows_of(incremental_profile(spark, path, state)), rows_of(profile.profile(whole)))
    # An update that broke off before its list of files is done again and counts once.
    frame(spark, 900, 950).write.parquet(f"{path}/c")
    update(spark, path, state, exact=False)
    update(spark, path, state)
    update(spark, path, state)
    assert {(r.row_count, r.unique_count) for r in merged(spark, path, state).where("name = 'id'").collect()} == {(280, 250)}


def test_columns_of_some_files_and_types_that_differ(spark, tmp_path):
    path, state = str(tmp_path / "t"), str(tmp_path / "state")
    spark.createDataFrame([(1, "x"), (2, None)], "a int, b string").write.parquet(f"{path}/1")
    assert rows_of(incremental_profile(spark, path, state))["b"]["null_count"] == 1
    spark.createDataFrame([(3, True)], "a int, c boolean").write.parquet(f"{path}/2")
    spark.createDataFrame([], "a int, c boolean").write.parquet(f"{path}/3")
    found = rows_of(incremental_profile(spark, path, state))
    assert [(n, r["position"], r["row_count"], r["null_count"], r["unique_count"]) for n, r in found.items()] == [("a", 1, 3, 0, 3), ("b", 2, 3, 2, 1), ("c", 3, 3, 2, 1)]
    spark.createDataFrame([("4",)], "a string").write.parquet(f"{path}/4")
    with pytest.raises(Exception, match="files differ in the type of column a"):
        incremental_profile(spark, path, state).collect()


def test_no_files_and_limits(spark, tmp_path):
    os.makedirs(tmp_path / "t")
    assert incremental_profile(spark, str(tmp_path / "t"), str(tmp_path / "s")).collect() == []
    with pytest.raises(ValueError):
        incremental_profile(spark, str(tmp_path / "t"), str(tmp_path / "s"), values=6)


def test_profile_next_to_a_version(spark, tmp_path):
    frame(spark, 0, 30).select("id", "name").write.parquet(f"{tmp_path}/org-acme/uploads/s")
    work = Workspace(spark, str(tmp_path), spark.createDataFrame([("s", "acme", "file", "parquet")], ledger.SOURCES))
    convert_file(work, "s")
    for _ in range(2):
        assert [(r.name, r.unique_count, r.detected_format) for r in work.profile("s").collect()] == [("id", 30, None), ("name", 30, "email")]
    assert os.path.isdir(f"{tmp_path}/org-acme/processed/s/v1/profile/files") and work.read("s").columns == ["id", "name"]
