"""The ledger's folds, the splitting of hot sources, and the life of conversions."""

import datetime
import random
import sqlite3

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sluice.operators import ledger
from sluice.plans import convert, sink
from sluice.sources import exports


def attempts(spark, hot_share, n=3000, same_time=False):
    rng = random.Random(3)
    day = datetime.datetime(2024, 1, 1)
    rows = [
        (
            day if same_time else day + datetime.timedelta(seconds=rng.randrange(n // 2)),
            i,
            0 if rng.random() < hot_share else rng.randrange(1, 50),
            rng.choice(["active", "active", "error"]),
        )
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "event_ts timestamp_ntz, id long, source_id long, status string").repartition(5)


def brute_versions(rows):
    done, out = {}, {}
    for ts, i, source, status in sorted(rows):
        out[i] = done.get(source, 0) + 1
        done[source] = done.get(source, 0) + (status == "active")
    return out


@pytest.mark.parametrize("same_time", [False, True])
@pytest.mark.parametrize("hot_events", [ledger.HOT_EVENTS, 200, 20])
def test_versions(spark, hot_events, same_time):
    """With low bounds one source, or all, are split into slices; the numbers stay the same."""
    rows, df = attempts(spark, 0.4, same_time=same_time)
    out = ledger.assign_versions(df, hot_events=hot_events)
    assert out.columns == [*df.columns, "version"]
    assert {r.id: r.version for r in out.collect()} == brute_versions(rows)


def test_versions_of_an_empty_ledger_and_null_source(spark):
    _, df = attempts(spark, 0.4)
    assert ledger.assign_versions(df.limit(0)).count() == 0
    null = df.withColumn("source_id", F.when(F.col("source_id") > 0, F.col("source_id")))
    hot = {(r.id, r.version) for r in ledger.assign_versions(null, hot_events=100).collect()}
    assert hot == {(r.id, r.version) for r in ledger.assign_versions(null).collect()}


def event(i, source, version, status, **fields):
    row = dict.fromkeys(ledger.EVENTS.fieldNames())
    row.update(event_ts=datetime.datetime(2024, 1, 1, 0, 0, i, tzinfo=datetime.timezone.utc), id=str(i), source_id=source, version=version, status=status)
    return tuple({**row, **fields}.values())


def test_folds(spark):
    events = spark.createDataFrame(
        [
            event(1, "a", 1, "pending"),
            event(2, "a", 1, "active", row_count=5, column_count=2, file_size_bytes=10, extraction_query="q1"),
            event(3, "a", 2, "pending"),
            event(4, "a", 2, "error", error_message="boom"),
            event(5, "b", 1, "pending"),
            event(6, "a", 2, "pending"),
            event(7, "a", 2, "active", row_count=7, file_size_bytes=0, extraction_query=""),
        ],
        ledger.EVENTS,
    )
    assert {tuple(r) for r in ledger.latest_status(events).collect()} == {("a", 1, "active"), ("a", 2, "active"), ("b", 1, "pending")}
    assert {tuple(r) for r in ledger.current_versions(events).collect()} == {("a", 2), ("b", 0)}
    records = {(r.source_id, r.version): (r.row_count, r.file_size_bytes, r.error_message) for r in ledger.version_records(events).collect()}
    assert records == {("a", 1): (5, 10, None), ("a", 2): (7, None, None), ("b", 1): (None, None, None)}
    assert [tuple(r) for r in ledger.latest_metrics(events).collect()] == [("a", 7, None, None, None)]
    assert [tuple(r) for r in ledger.last_queries(events).collect()] == [("a", "q1")]


def test_events_on_disk(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for i in range(3):
        ledger.append_events(spark.createDataFrame([event(i, f"s{i}", 1, "active")], ledger.EVENTS), path)
    assert ledger.read_events(spark, path).count() == 3
    ledger.append_events(spark.createDataFrame([event(9, "s1", 2, "pending")], ledger.EVENTS), path, "s1")
    assert ledger.read_events(spark, path).count() == 4
    one = ledger.read_events(spark, path, "s1")
    assert [r.source_id for r in one.collect()] == ["s1", "s1"]
    assert one.schema == ledger.EVENTS
    with pytest.raises(ValueError):
        ledger.append_events(spark.range(1), path)


def test_source_lookup(spark):
    sources = spark.createDataFrame([("a", "org", "file", "csv")], ledger.SOURCES)
    assert ledger.get_source(sources, "a")["connector_type"] == "csv"
    with pytest.raises(ValueError, match="no source 'b'"):
        ledger.get_source(sources, "b")
    found = ledger.resolve_sources(spark.createDataFrame([("r1", "a"), ("r2", "b")], "request string, source_id string"), sources)
    assert {(r.request, r.found) for r in found.collect()} == {("r1", True), ("r2", False)}


@pytest.fixture
def work(spark, tmp_path):
    sources = spark.createDataFrame(
        [("f1", "org1", "file", "csv"), ("d1", "org1", "database", "sqlite"), ("p1", "org1", "database", "postgresql")], ledger.SOURCES
    )
    return convert.Workspace(spark, str(tmp_path), sources)


def upload(work, text, source="f1", name="x.csv"):
    import os

    folder = sink.source_path(work.root, "org1", source)
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as file:
        file.write(text)


def statuses(work, source):
    return [(r.version, r.status) for r in work.events(source).orderBy("event_ts").collect()]


def test_records_keep_failed_attempts(spark):
    rows = [
        event(1, "a", 1, "pending", id="r1"),
        event(2, "a", 1, "error", id="r1", error_message="boom"),
        event(3, "a", 1, "pending", id="r2"),
        event(4, "a", 1, "error", id="r2", error_message="late"),
        event(5, "a", 1, "active", id="r2", row_count=7, file_size_bytes=0),
    ]
    records = ledger.version_records(spark.createDataFrame(rows, ledger.EVENTS)).collect()
    assert sorted((r.id, r.version, r.status, r.error_message, r.row_count, r.file_size_bytes) for r in records) == [
        ("r1", 1, "error", "boom", None, None), ("r2", 1, "active", None, 7, None)]


def test_file_versions(work):
    upload(work, "id,v\n" + "".join(f"{i},{i / 2}\n" for i in range(12)))
    options = {"column_mapping": {"v": "half"}, "type_overrides": {"half": "INTEGER"}, "skip_rows": [0, 3, 500], "delimiter": None}
    first = convert.convert_file(work, "f1", options=options)
    assert (first["version"], first["rows"], first["columns"], first["rows_skipped"]) == (1, 10, 2, 2)
    assert first["column_schema"]["fields"] == [{"name": "id", "type": "BIGINT"}, {"name": "half", "type": "INTEGER"}]
    assert first["path"].endswith("org-org1/processed/f1/v1/data.parquet")
    assert {r.id: r.half for r in work.read("f1").collect()} == {i: round(i / 2) for i in range(12) if i not in (0, 3)}
    assert convert.convert_file(work, "f1")["version"] == 2
    assert work.current_version("f1") == 2
    assert work.read("f1", 1).count() == 10
    assert statuses(work, "f1") == [(1, "pending"), (1, "active"), (2, "pending"), (2, "active")]
    metrics = ledger.version_records(work.events("f1")).where("version = 2").first()
    assert (metrics.row_count, metrics.column_count, metrics.file_size_bytes > 0) == (12, 2, True)


def test_failure_is_recorded_and_its_number_used_again(work):
    upload(work, "id\n1\n")
    for bad in ({"file_format": "orc"}, {"options": {"type_overrides": {"id": "NOPE"}}}, {"compression": "lzo"}):
        with pytest.raises(ValueError):
            convert.convert_file(work, "f1", **bad)
    assert statuses(work, "f1") == [(1, "pending"), (1, "error")] * 3
    assert work.current_version("f1") == 0
    # What a failed write left behind gives way.
    work.spark.range(5).write.parquet(sink.output_path(work.root, "org1", "f1", 1))
    done = convert.convert_file(work, "f1")
    assert (done["version"], done["rows"], work.current_version("f1")) == (1, 1, 1)
    with pytest.raises(ValueError, match="no options"):
        convert.convert_file(work, "f1", options={"colunm_mapping": {}})


def test_files_without_a_record_are_not_overwritten(work):
    upload(work, "id\n1\n")
    work.spark.range(5).write.parquet(sink.output_path(work.root, "org1", "f1", 1))
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        convert.convert_file(work, "f1")
    assert statuses(work, "f1")[-1] == (1, "error")


def test_positions_are_counted_behind_rejected_rows(work):
    upload(work, "id,v\n" + "".join(f"{i},{'bad' if i in (1, 4) else i}\n" for i in range(10)))
    done = convert.convert_file(work, "f1", options={"types": {"v": "INTEGER"}, "skip_rows": [0, 1, 7]})
    assert (done["rows"], done["rows_skipped"]) == (5, 3)
    assert sorted(r.id for r in work.read("f1").collect()) == [3, 5, 6, 7, 8]


def test_workbooks_and_json_convert(work, table):
    parts = table("part").select("p_partkey", "p_name").orderBy("p_partkey").coalesce(1)
    exports.export_workbooks(parts, sink.source_path(work.root, "org1", "f1"), rows=50)
    done = convert.convert_file(work, "f1", "excel", {"skip_rows": [0, 60, 9999], "type_overrides": {"p_partkey": "INTEGER"}, "sheet_index": 0})
    everything = [r.p_partkey for r in parts.collect()]
    assert (done["rows"], done["rows_skipped"], done["columns"]) == (len(everything) - 2, 2, 2)
    left = {r.p_partkey for r in work.read("f1").collect()}
    assert set(everything) - left == {everything[0], everything[60]}
    upload(work, '[{"a": 1}, {"a": 2}, {"a": 3}]', "f1", "x.json")
    array = convert.plan_file(work.spark, sink.source_path(work.root, "org1", "f1") + "/x.json", "json", {"skip_rows": [1]})[0]
    assert sorted(r.a for r in array.collect()) == [1, 3]


def test_unknown_source(work):
    with pytest.raises(ValueError, match="no source"):
        convert.convert_file(work, "nope")


def test_sample_is_typed_by_its_own_rows(work):
    """Cells beyond the sample decide nothing, but the order of a sample is that of all values."""
    upload(work, "id;n;day\n" + "".join(f"{i};{'x' if i == 30 else i};2024-01-{i:02d}\n" for i in range(1, 31)))

    def types(**options):
        return {r.name: r.inferred_type for r in convert.infer_file(work, "f1", **options)["columns"].collect()}

    assert types(sample_size=10) == {"id": "BIGINT", "n": "BIGINT", "day": "DATE"}
    assert types(sample_size=None) == {"id": "BIGINT", "n": "VARCHAR", "day": "DATE"}
    found = convert.infer_file(work, "f1", sample_size=10, order_by=["id"])
    assert [r.id for r in found["head"].collect()] == list(range(1, 11))  # not 1, 10, 11 as texts
    assert {r.name: r.inferred_type for r in found["columns"].collect()}["n"] == "BIGINT"
    assert types(sample_size=10, order_by=["n"])["n"] == "VARCHAR"


def test_infer(work):
    upload(work, "id;mail\n" + "".join(f"{i};a{i}@b.co\n" for i in range(30)))
    found = convert.infer_file(work, "f1", order_by=["id"])
    columns = {r.name: r for r in found["columns"].collect()}
    assert (columns["id"].inferred_type, columns["mail"].detected_format, columns["mail"].unique_count) == ("BIGINT", "email", 30)
    assert (found["head"].count(), found["warnings"].count(), found["totals"].first().total_rows) == (30, 0, 30)
    assert {r.name for r in convert.infer_file(work, "f1", sample_size=None)["columns"].collect()} == {"id", "mail"}


def customers_file(tmp_path):
    path = str(tmp_path / "c.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE customers (id INTEGER PRIMARY KEY, name VARCHAR(255), is_active BOOLEAN, balance DECIMAL(10,2), created_at TIMESTAMP)")
    names = ["Ada", "Berta", "Cleo", "Dora", "Emil"]
    for i, name in enumerate(names, 1):
        db.execute("INSERT INTO customers VALUES (?, ?, ?, ?, '2024-01-15 10:30:00')", (i, name, i != 3, i * 10.5))
    db.commit()
    db.close()
    return path


def test_database_versions(work, tmp_path):
    credentials = {"file_path": customers_file(tmp_path)}
    done = convert.convert_database(work, "d1", credentials, table_name="customers", compression="snappy")
    assert (done["version"], done["rows"], done["columns"], done["source_type"]) == (1, 5, 5, "database")
    assert done["connection_info"]["query"] == "SELECT * FROM customers"
    assert [f["type"] for f in done["column_schema"]["fields"]] == ["BIGINT", "VARCHAR", "BOOLEAN", "DOUBLE", "TIMESTAMP"]
    query = "SELECT * FROM sqlite.customers WHERE is_active = TRUE"
    done = convert.convert_database(work, "d1", credentials, query=query, table_name="ignored")
    assert (done["version"], done["rows"]) == (2, 4)
    empty = convert.convert_database(work, "d1", credentials, query="SELECT * FROM sqlite.customers WHERE id > 99")
    assert (empty["rows"], work.read("d1").columns) == (0, ["id", "name", "is_active", "balance", "created_at"])
    assert ledger.last_queries(work.events("d1")).first().extraction_query == "SELECT * FROM sqlite.customers WHERE id > 99"


def test_database_failures(work, tmp_path):
    credentials = {"file_path": customers_file(tmp_path)}
    for bad, message in (
        ({}, "a query or a table"),
        ({"table_name": "customers; DROP TABLE x"}, "not a table"),
        ({"table_name": "nope"}, "no table nope"),
    ):
        with pytest.raises(Exception, match=message):
            convert.convert_database(work, "d1", credentials, **bad)
    with pytest.raises(ValueError, match="sqlite credentials need"):
        convert.convert_database(work, "d1", {}, table_name="customers")
    with pytest.raises(ValueError, match="need host"):
        convert.convert_database(work, "p1", {"database": "x"}, table_name="t")
    assert [s for _, s in statuses(work, "d1")] == ["pending", "error"] * 4
    assert work.events("p1").where("status = 'error'").first().error_message.startswith("postgresql credentials need host")
