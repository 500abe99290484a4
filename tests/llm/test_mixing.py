import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sluice.llm import mixing
from sluice.llm.queries import ORACLE_SQL, op6_mixing

SF = "/root/testdata/sf0.001"


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(ORACLE_SQL["op6_mixing"])
    names = [c[0] for c in found.description]
    want = Counter(tuple(r) for r in found.fetchall())
    assert Counter(tuple(r) for r in op6_mixing(spark, SF).select(*names).collect()) == want


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 7.5, 63.9, 150.0])
def test_copies_follow_the_distribution(spark, rate):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.lit("s").alias("source"))
    rates = spark.createDataFrame([("s", 80_000.0, rate)], "source string, chars double, rate double")
    mixed = mixing.mix(docs, rates)
    numbers = Counter({r.doc_id: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()})
    mean = sum(numbers.values()) / 20_000
    variance = sum((numbers[i] - mean) ** 2 for i in range(20_000)) / 20_000
    assert abs(mean - rate) <= 5 * math.sqrt(max(rate, 1e-9) / 20_000)
    assert abs(variance - rate) <= 0.1 * rate
    if rate == 1.0:
        kinds = Counter(numbers[i] for i in range(20_000))
        assert all(abs(kinds[k] / 20_000 - math.exp(-1) / math.factorial(k)) < 0.015 for k in range(5))


def test_order_is_a_global_shuffle(spark):
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("x" * 100_000).alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix(docs, mixing.source_rates(docs)).drop("text")
    assert mixed.rdd.getNumPartitions() == math.ceil(5_000 * 100_000 / mixing.PARTITION_CHARS)
    rows = mixed.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    above = sum(a.doc_id < b.doc_id for a, b in zip(rows, rows[1:])) / len(rows)
    assert 0.45 < above < 0.55


def test_target_weights(spark):
    docs = spark.createDataFrame([(i, "x" * 50, "big" if i % 10 else "small") for i in range(4000)], "doc_id bigint, text string, source string")
    rates = mixing.source_rates(docs, {"big": 1.0, "small": 1.0, "other": 2.0}, budget=100_000.0)
    assert {r.source: r.rate for r in rates.collect()} == {"big": pytest.approx(50_000 / 180_000), "small": pytest.approx(2.5)}
    sizes = {r.source: r.n for r in mixing.mix(docs, rates).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(sizes["big"] - 1000) < 120 and abs(sizes["small"] - 1000) < 120
    assert {r.source: r.rate for r in mixing.source_rates(docs, {"big": 1.0}).collect()}["small"] == 0.0


def test_odd_rows(odd, nothing):
    rates = mixing.source_rates(odd)
    mixed = mixing.mix(odd, rates)
    assert mixed.columns == [c for c in odd.columns if c not in ("copy_no", "position")] + ["copy_no", "position"]
    assert mixed.count() > 0 and sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(odd, rates).collect()))
    assert mixing.mix(nothing, mixing.source_rates(nothing)).count() == 0
    assert mixing.mix(odd, rates.where("false")).count() == 0


def test_many_sources_join_without_broadcast(spark, monkeypatch):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7).alias("source"))
    rates = mixing.source_rates(docs)
    few = Counter(map(str, mixing.mix(docs, rates).collect()))
    small = mixing.with_small
    monkeypatch.setattr(mixing, "with_small", lambda df, s, key: small(df, s, key, limit=2, salts=4))
    assert Counter(map(str, mixing.mix(docs, rates).collect())) == few
