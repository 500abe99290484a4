"""Joins by order and positions as tables, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import profile
from sluice.operators.joins import asof_join, interval_join
from sluice.operators.positions import skip_rows, skipped_rows
from sluice.sources import databases, exports


@pytest.mark.parametrize("width", [None, 1, 7, 10_000])
def test_last_row_at_or_before(spark, width):
    rng = random.Random(2)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(-50, 300)])) for i in range(300)]
    right = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(-40, 250, 3)]), i) for i in range(120)]
    a = spark.createDataFrame(left, "id int, k string, at long")
    b = spark.createDataFrame(right, "k string, at long, v int")
    want = []
    for i, k, at in left:
        known = [(t, v) for k2, t, v in right if k is not None and k2 == k and t is not None and at is not None and t <= at]
        want.append((i, k, at, max(known)[1] if known else None))
    found = asof_join(a, b, "at", ["k"], ["v"], width=width)
    assert found.columns == ["id", "k", "at", "v"]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert asof_join(a, b.where("false"), "at", ["k"], ["v"]).where("v IS NOT NULL").count() == 0


@pytest.mark.parametrize("width", [None, 1, 13, 10_000])
def test_overlapping_spans(spark, width):
    rng = random.Random(3)
    spans = lambda n: [(i, rng.choice([None, "x", "y"]), at, at + rng.choice([-1, 0, 0, 3, 90])) for i, at in ((i, rng.randrange(-60, 200)) for i in range(n))]
    left, right = spans(90), spans(70)
    a = spark.createDataFrame(left, "i int, k string, a1 int, a2 int")
    b = spark.createDataFrame(right, "j int, k string, b1 int, b2 int")
    overlap = lambda p, q: p[2] <= p[3] and q[2] <= q[3] and max(p[2], q[2]) <= min(p[3], q[3])
    want = sorted((p[0], q[0]) for p in left for q in right if p[1] is not None and p[1] == q[1] and overlap(p, q))
    found = interval_join(a, b, ("a1", "a2"), ("b1", "b2"), ["k"], width)
    assert sorted((r.i, r.j) for r in found.collect()) == want
    free = interval_join(a.drop("k"), b.drop("k"), ("a1", "a2"), ("b1", "b2"), width=width)
    assert sorted((r.i, r.j) for r in free.collect()) == sorted((p[0], q[0]) for p in left for q in right if overlap(p, q))


def test_positions_as_a_table(spark, tmp_path):
    spark.range(0, 5000, 1, 7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    order = [r.id for r in df.collect()]
    wanted = [*range(0, 5000, 3), 4999, 10**12, -1, 3]
    found = skip_rows(df, spark.createDataFrame([(p,) for p in wanted], "p long"))
    by_list = skip_rows(df, wanted)
    left = sorted(set(range(5000)) - {p for p in wanted if 0 <= p < 5000})
    assert sorted(r.id for r in by_list.collect()) == sorted(r.id for r in found.collect())
    assert len(order) - found.count() == skipped_rows(df, wanted).first()[0] == 5000 - len(left)
    assert sorted(r.id for r in skip_rows(df, wanted, ["id"]).collect()) == left


def test_samples_do_not_follow_partitions(spark):
    df = spark.range(20_000).withColumn("n", F.when(F.col("id") % 3 > 0, F.col("id")))
    one, two = (sorted(r.id for r in profile.uniform_sample(df.repartition(n), 900).collect()) for n in (3, 11))
    assert one == two and len(one) == 900
    assert 250 < sum(i < 7000 for i in one) < 380


def test_ranges_by_rows(spark, tmp_path):
    rows = [(i % 1000 if i % 10 else i * 1000, f"n'{i % 70}", i) for i in range(4000)] + [(None, "x", 1), (5, "", 2)]  # this database takes no NULL text from the writer
    options = exports.database_options(spark)
    writer = spark.createDataFrame(rows, "k long, t string, v int").write.format("jdbc").options(**options)
    writer.option("dbtable", "keyed").option("createTableColumnTypes", "t VARCHAR(20)").save()
    for keys in ("k", "t", ["t", "k"]):
        df = databases.scan_jdbc(spark, options, table="keyed", partition_column=keys, partition_num=5)
        assert sorted((str(tuple(r)) for r in df.collect())) == sorted(map(str, rows))
        sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 5 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_prefixes_in_text():
    assert databases.names_prefix("SELECT * FROM mysql.t", "mysql")
    assert databases.names_prefix("select 1 from x join `pg`.s.t", "pg")
    assert not databases.names_prefix("SELECT pg.id FROM pages pg WHERE a = 'from pg.x' -- from pg.t", "pg")


def test_views_of_the_caller_stay(spark):
    spark.range(3).createOrReplaceTempView("mine")
    found = databases.run_sql(spark, "SELECT count(*) AS n FROM mine", {"mine": spark.range(10)})
    assert found.first().n == 10 and spark.table("mine").count() == 3
