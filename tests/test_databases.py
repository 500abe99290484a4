"""Connectors, JDBC on embedded Derby, SQLite files, sinks."""

import sqlite3

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sluice.plans import sink
from sluice.session import mounted_path, scratch_dir
from sluice.sources import databases, exports
from sluice.sources.sqlite import scan_sqlite, sqlite_tables

SPECIAL = {"username": "ann@x:y z", "password": "a/b?c=d&e#f %g", "host": "db.example", "port": None, "database": "my db?x=1"}


@pytest.mark.parametrize(
    "kind, url",
    [
        ("postgresql", "jdbc:postgresql://db.example:5432/my%20db%3Fx%3D1"),
        ("redshift", "jdbc:redshift://db.example:5432/my%20db%3Fx%3D1"),
        ("mysql", "jdbc:mysql://db.example:3306/my%20db%3Fx%3D1"),
        ("mariadb", "jdbc:mariadb://db.example:3306/my%20db%3Fx%3D1"),
    ],
)
def test_connection_options(kind, url):
    options = databases.connection_options(kind, {**SPECIAL, "ssl_mode": "prefer"})
    assert (options["url"], options["user"], options["password"]) == (url, SPECIAL["username"], SPECIAL["password"])
    assert "prefer" in options.values()


def test_connector_choice(spark):
    assert databases.list_connectors() == ["postgresql", "mysql", "sqlite", "mariadb", "redshift"]
    with pytest.raises(ValueError, match="no connector named 'oracle'"):
        databases.connection_options("oracle", {})
    for bad in ("a b", "a;b", 'a"b', "", "a\n"):
        with pytest.raises(ValueError, match="not a table"):
            databases.check_identifier(bad)
    failed = databases.test_connection(spark, "postgresql", {**SPECIAL, "port": 1})
    assert (failed["success"], failed["error"]) == (False, "connection_failed")


@pytest.fixture(scope="module")
def derby(spark, table):
    return exports.export_database(table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "orders_copy")


def test_jdbc_ranges_and_pushdown(spark, table, derby):
    df = databases.scan_jdbc(spark, derby, table="orders_copy", partition_column="o_orderkey", partition_num=4)
    orders = table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    assert df.rdd.getNumPartitions() == 4
    assert df.exceptAll(orders).count() == 0 and df.count() == orders.count()
    plan = df.where("o_totalprice > 100").select("o_orderkey")._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,100.0)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan
    query = 'SELECT "o_orderkey" FROM orders_copy WHERE "o_orderstatus" = \'F\''
    parts = databases.scan_jdbc(spark, derby, query=query, partition_column="o_orderkey", partition_num=3)
    assert parts.count() == orders.where("o_orderstatus = 'F'").count()
    none = databases.scan_jdbc(spark, derby, query=f"{query} AND 1 = 0", partition_column="o_orderkey", partition_num=3)
    assert (none.count(), none.columns) == (0, ["o_orderkey"])
    with pytest.raises(ValueError, match="a query or a table"):
        databases.scan_jdbc(spark, derby)


def test_jdbc_catalog(spark, table, derby):
    databases.register_catalog(spark, "pg", derby)
    query = "SELECT o_orderstatus, count(*) AS n FROM pg.ORDERS_COPY GROUP BY o_orderstatus"
    got = {r.o_orderstatus: r.n for r in spark.sql(query).collect()}
    assert got == {r.o_orderstatus: r["count"] for r in table("orders").groupBy("o_orderstatus").count().collect()}
    assert "PushedAggregates: [COUNT(*)]" in spark.sql(query)._jdf.queryExecution().toString()


def test_primary_key_gives_the_ranges(spark, derby):
    """The standard catalog views, set up by hand where the database has none."""
    assert spark.read.format("jdbc").options(**derby).option("query", 'SELECT MAX("o_orderkey") FROM orders_copy').load().count() == 1
    constraint = ("PK1", "APP", "ORDERS_COPY")
    views = {
        "table_constraints": [(*constraint, "PRIMARY KEY"), ("FK1", "APP", "ORDERS_COPY", "FOREIGN KEY")],
        "key_column_usage": [(*constraint, "o_orderkey"), ("FK1", "APP", "ORDERS_COPY", "o_orderstatus")],
    }
    for (name, rows), last in zip(views.items(), ("constraint_type", "column_name")):
        # Unquoted names in the catalog query are upper-cased by this database.
        names = [n.upper() for n in ("constraint_name", "table_schema", "table_name", last)]
        df = spark.createDataFrame(rows, names)
        kinds = ", ".join(f"{n} VARCHAR(100)" for n in names)
        df.write.format("jdbc").options(**derby).option("createTableColumnTypes", kinds).option("dbtable", f"information_schema.{name}").save()
    assert databases.range_key(spark, derby, "orders_copy") == "o_orderkey"
    assert databases.range_key(spark, derby, "app.orders_copy") == "o_orderkey"
    assert databases.range_key(spark, derby, "other.orders_copy") is None


def test_jdbc_tables(spark, derby):
    tables = databases.jdbc_tables(spark, derby, "SELECT TABLENAME AS table_name FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'")
    assert "ORDERS_COPY" in {r[0] for r in tables.collect()}


def test_sqlite_ranges(spark, tmp_path):
    path = str(tmp_path / "a.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT, d DATE, b BOOLEAN, r REAL, x BLOB)")
    # Row ids with a huge gap must not make a huge number of ranges.
    keys = [*range(1, 2000), 10**12]
    db.executemany("INSERT INTO t VALUES (?, ?, '2024-01-15', ?, ?, x'00ff')", [(k, f"text {k}" * 10, k % 2, k / 3) for k in keys])
    db.execute("CREATE TABLE w (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
    db.execute("INSERT INTO w VALUES ('a', 1)")
    db.execute('CREATE TABLE "empty one" (a INTEGER)')
    db.commit()
    db.close()
    df = scan_sqlite(spark, path, "t", partition_bytes=20_000)
    assert 1 < df.rdd.getNumPartitions() <= 20
    assert sorted(r.id for r in df.collect()) == keys
    assert [k for _, k in df.dtypes] == ["bigint", "string", "date", "boolean", "double", "binary"]
    row = df.where("id = 3").first()
    assert (row.b, row.r, bytes(row.x), str(row.d)) == (True, 1.0, b"\x00\xff", "2024-01-15")
    assert [tuple(r) for r in scan_sqlite(spark, path, "w").collect()] == [("a", 1)]
    assert scan_sqlite(spark, path, "empty one").collect() == []
    assert [r.table_name for r in sqlite_tables(spark, path).collect()] == ["empty one", "t", "w"]
    assert databases.test_connection(spark, "sqlite", {"database": path})["metadata"]["table_count"] == 3
    assert databases.extract_query(spark, "sqlite", {"database": path}, "SELECT count(*) AS n FROM sqlite.t JOIN sqlite.w ON v = id").first().n == 1


def test_sqlite_folder(spark, table, tmp_path):
    customers = table("customer").repartition(5)
    exports.export_sqlite(customers, str(tmp_path / "shards"), "customers")
    df = scan_sqlite(spark, str(tmp_path / "shards"), "customers")
    assert df.rdd.getNumPartitions() == 5
    assert df.withColumn("c_nationkey", F.col("c_nationkey").cast("int")).exceptAll(customers).count() == 0
    assert df.count() == customers.count()


def test_user_sql(spark):
    out = databases.run_sql(spark, "SELECT a.id FROM a LEFT ANTI JOIN b ON a.id = b.id", {"a": spark.range(5), "b": spark.range(3)})
    assert sorted(r.id for r in out.collect()) == [3, 4]


def test_parquet_layout(spark, tmp_path):
    path = str(tmp_path / "out")
    done = sink.write_checked(spark.range(0, 500_000, 1, 1).select("id"), path, row_group_size=122_880)
    assert (done.rows, done.columns, done.fields) == (500_000, 1, [("id", "BIGINT")])
    files = list((tmp_path / "out").glob("*.parquet"))
    assert done.size_bytes == sum(f.stat().st_size for f in files)
    meta = pq.ParquetFile(files[0]).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [122_880] * 4 + [8_480]
    assert meta.row_group(0).column(0).compression == "ZSTD"


@pytest.mark.parametrize("name, codec", [("snappy", "SNAPPY"), ("none", "UNCOMPRESSED"), ("zstd", "ZSTD")])
def test_compression(spark, tmp_path, name, codec):
    sink.write_parquet(spark.range(10), str(tmp_path / "out"), compression=name)
    file = next((tmp_path / "out").glob("*.parquet"))
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == codec


def test_sink_arguments(spark, tmp_path):
    with pytest.raises(ValueError, match="no compression"):
        sink.write_parquet(spark.range(1), str(tmp_path / "out"), compression="gzip")
    assert sink.output_path("/r/", "o", "s", 3) == "/r/org-o/processed/s/v3/data.parquet"
    assert sink.raw_path("/r", "o", "s", 3, "csv") == "/r/org-o/raw/s/v3/data.csv"
    assert sink.source_path("s3a://b", "o", "s") == "s3a://b/org-o/uploads/s"
    for bad in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            sink.output_path("/r", bad, "s", 1)


def test_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(base) and scratch_dir(spark, "x") != scratch_dir(spark, "x")
    assert mounted_path("file:///mnt/x") == "/mnt/x"
    with pytest.raises(ValueError):
        mounted_path("s3a://bucket/x")
