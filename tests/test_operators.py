"""Shaping, positions, profiles and warnings against brute force on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F, types as T

from sluice.functions import formats
from sluice.operators import profile, quality, shape
from sluice.operators.positions import skip_rows, skipped_rows
from sluice.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_shape(spark):
    df = spark.createDataFrame([(1.5, "x", "2.5")], "a double, b string, `c.d` string")
    out = shape.shape(df, {"a": "n", "missing": "m", "c.d": "e.f"}, {"n": "INTEGER", "a": "VARCHAR", "c.d": "INTEGER"})
    assert (out.dtypes, rows(out)) == ([("n", "int"), ("b", "string"), ("e.f", "int")], [(2, "x", 3)])
    with pytest.raises(ValueError, match="Unknown type"):
        shape.cast(df, {"a": "INT) FROM x; --"})


def test_describe(spark):
    df = spark.createDataFrame([], "a int, b struct<x:int>, c timestamp, d boolean, e decimal(5,2)")
    got = [(r.position, r.name, r.type, r["class"]) for r in shape.describe_columns(df).collect()]
    assert got == [
        (1, "a", "INTEGER", "numeric"), (2, "b", "STRUCT(x INTEGER)", "other"), (3, "c", "TIMESTAMP WITH TIME ZONE", "temporal"),
        (4, "d", "BOOLEAN", "other"), (5, "e", "DECIMAL(5,2)", "numeric"),
    ]


POSITIONS = [0, 1, 7, 99, 100, 101, 998, 999, 5000, -3]


@pytest.fixture
def small_splits(spark):
    """Files are read in many splits, packed several to a task."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "512b")
    yield
    for key, value in keep.items():
        spark.conf.set(key, value)


def numbers(spark, n=1000, parts=3):
    return spark.range(0, n, 1, parts).select("id", F.md5(F.col("id").cast("string")).alias("text"))


def kept(n=1000):
    return [i for i in range(n) if i not in POSITIONS]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_skip_rows_in_files(spark, tmp_path, small_splits, kind):
    path = str(tmp_path / kind)
    numbers(spark).write.option("header", True).format(kind).save(path)
    df = files.scan_file(spark, path, kind)
    assert df.rdd.getNumPartitions() > 3
    out = skip_rows(df, POSITIONS)
    assert (out.columns, sorted(r.id for r in out.collect())) == (["id", "text"], kept())
    assert skipped_rows(df, POSITIONS).first().rows_removed == 8
    shaped = shape.shape(df, {"id": "n"}, {"n": "VARCHAR"})
    assert sorted(int(r.n) for r in skip_rows(shaped, POSITIONS).collect()) == kept()


def test_skip_rows_by_key(spark):
    df = numbers(spark, parts=7).select((999 - F.col("id")).alias("id"), F.lit(1).alias("same"))
    assert sorted(r.id for r in skip_rows(df, POSITIONS, ["id"]).collect()) == kept()
    assert skip_rows(df, POSITIONS, ["same"]).count() == 992
    assert skip_rows(df, [], ["id"]) is df


def test_skip_rows_needs_an_order(spark, tmp_path):
    with pytest.raises(ValueError, match="order_by"):
        skip_rows(spark.range(5).join(spark.range(5), "id"), [1])
    path = str(tmp_path / "p")
    numbers(spark).write.parquet(path)
    with pytest.raises(Exception, match="plain scan"):
        skip_rows(spark.read.parquet(path).where("id % 2 = 0"), [1]).collect()


def odd_table(spark):
    schema = "id long, f double, s string, t timestamp_ntz, b boolean, m map<string,int>, a array<int>, e string, `dot.ted` decimal(9,2)"
    return spark.createDataFrame([], schema).unionAll(
        spark.range(200).select(
            "id",
            F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("id") / 4).alias("f"),
            F.when(F.col("id") < 150, F.concat(F.lit("u"), (F.col("id") % 7).cast("string"), F.lit("@x.org"))).alias("s"),
            F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("t"),
            (F.col("id") % 2 == 0).alias("b"),
            F.create_map(F.lit("k"), (F.col("id") % 5).cast("int")).alias("m"),
            F.array((F.col("id") % 4).cast("int")).alias("a"),
            F.lit(None).cast("string").alias("e"),
            (F.col("id") % 11).cast("decimal(9,2)").alias("dot.ted"),
        )
    )


def test_profile_of_everything(spark):
    got = {r.name: r for r in profile.profile(odd_table(spark), order_by=["id"]).collect()}
    unique = {"id": 200, "f": 134, "s": 7, "t": 200, "b": 2, "m": 5, "a": 4, "e": 0, "dot.ted": 11}
    assert {n: r.unique_count for n, r in got.items()} == unique
    assert {n: r.null_count for n, r in got.items() if r.nullable} == {"s": 50, "e": 200}
    assert (got["id"].min_value, got["id"].max_value, got["dot.ted"].max_value) == (0.0, 199.0, 10.0)
    assert (got["t"].min_text, got["t"].max_text) == ("2024-01-01 00:00:00", "2024-07-18 00:00:00")
    assert (got["s"].detected_format, got["e"].detected_format, got["b"].min_value) == ("email", None, None)
    assert got["id"].sample_values == ["0", "1", "2", "3", "4"]
    assert (got["e"].sample_values, got["f"].sample_values[:2]) == ([], ["nan", "0.25"])
    assert [r.name for r in profile.profile(odd_table(spark), values=0).collect()] == odd_table(spark).columns


def test_sparse_sample_values(spark):
    """Values that start behind the first rows are still found."""
    df = spark.range(1000).select("id", F.when(F.col("id") > 900, F.col("id") * 2).alias("late"), F.when(F.col("id") == 950, 1).alias("one"))
    got = [(r.name, r.position, r.sample_value) for r in profile.sample_values(df, ["late", "one"], ["id"]).collect()]
    expected = [("late", i, str((900 + i) * 2)) for i in range(1, 6)] + [("one", 1, "1")]
    assert sorted(got) == expected
    unordered = [(r.name, r.position, r.sample_value) for r in profile.sample_values(df.coalesce(1), ["late", "one"]).collect()]
    assert sorted(unordered) == expected


def test_many_sparse_columns_in_one_pass(spark):
    names = [f"s{i}" for i in range(profile.OWN_READS + 3)]
    cells = [F.expr(f"if(id >= 30 AND id % {i + 2} = 0 AND {i} <> 1, id, NULL)").alias(n) for i, n in enumerate(names)]
    df = spark.range(0, 200, 1, 3).select("id", *cells)
    want = [(n, k + 1, str(v)) for i, n in enumerate(names) for k, v in enumerate([v for v in range(30, 200) if v % (i + 2) == 0 and i != 1][:5])]
    for order in (["id"], None):
        got = [(r.name, r.position, r.sample_value) for r in profile.sample_values(df, names, order).collect()]
        assert sorted(got) == sorted(want)



def test_sample_profile(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") < 5, F.lit("a@b.co")).otherwise(F.lit("none")).alias("s"))
    assert profile.sample(df, 10_000, ["id"]).count() == 10_000
    for size in (0, 10_001, 50_000):
        with pytest.raises(ValueError):
            profile.sample(df, size, ["id"])
    got = {r.name: r for r in profile.profile(df, sample_size=100, order_by=["id"]).collect()}
    # The first five values decide the format of a sample.
    assert (got["s"].detected_format, got["s"].row_count, got["id"].max_value) == ("email", 100, 99.0)
    assert profile.head(df, ["id"]).count() == 100


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    got = {r.name: (r.row_count, r.null_count, r.unique_count, r.nullable, r.sample_values) for r in profile.profile(df).collect()}
    assert got == {"a": (0, 0, 0, False, []), "b": (0, 0, 0, False, [])}
    assert quality.warnings(df, ["a"]).count() == 0


def test_distinct_counts_agree(spark, table):
    orders = table("orders")
    exact = {r.name: r.unique_count for r in profile.distinct_counts(orders).collect()}
    assert exact == {c: orders.select(c).distinct().count() for c in orders.columns}
    near = {r.name: r.unique_count for r in profile.distinct_counts(orders, approximate=True).collect()}
    assert all(abs(near[c] - exact[c]) <= 0.1 * exact[c] + 1 for c in exact)


TEXTS = [
    "a@b.co", "a@b.c", "a@b.co\n", "http://x", "https://x", "HTTP://x", "ftp://x", "+41 44 123 45", "123456789", "0123456789", "(044) 123-4567",
    "٠١٢٣٤٥٦٧٨٩", "1234 56789", "123e4567-e89b-12d3-a456-426614174000", "123E4567-E89B-12D3-A456-426614174000", "x123e4567-e89b-12d3-a456-426614174000",
    "5", "-5", "5.", "5.5", ".5", "5\n", "5\r\n", "٥", "1e5", "", " 5",
]


@pytest.mark.parametrize("name", [*formats.STRING_FORMATS, "numeric"])
def test_patterns_as_python(spark, name):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    test = formats.looks_numeric(F.col("t")) if name == "numeric" else F.expr(formats.format_test("t", name))
    pattern = formats.NUMERIC_LIKE if name == "numeric" else formats.STRING_FORMATS[name]
    got = [r.m for r in df.select(test.alias("m")).collect()]
    assert got == [bool(re.match(pattern, t.lower() if name == "uuid" else t)) for t in TEXTS]


@pytest.mark.parametrize("matching, expected", [(4, None), (5, "email")])
def test_format_threshold(spark, matching, expected):
    df = spark.createDataFrame([("a@b.co" if i < matching else "no",) for i in range(5)], "s string")
    assert profile.detected_formats(df).first().detected_format == expected


@pytest.mark.parametrize("nulls, total, message", [(1, 2, None), (2, 3, "66.7%"), (1001, 2000, "50.0%"), (3, 3, "100.0%")])
def test_null_warning(spark, nulls, total, message):
    df = spark.createDataFrame([(None if i < nulls else i,) for i in range(total)], "x int")
    got = [r.message for r in quality.null_warnings(df).collect()]
    assert got == ([f"Column has {message} null values"] if message else [])


def brute_type_warning(values):
    """Offending positions of one ordered column."""
    held = [v for v in values if v is not None][:100]
    numeric = [bool(re.match(r"^-?\d+\.?\d*$", v)) for v in held]
    if not held or sum(numeric[:20]) / min(20, len(held)) <= 0.5:
        return []
    return [i for i, ok in enumerate(numeric, 1) if not ok][:10]


@pytest.mark.parametrize(
    "values",
    [
        ["1"] * 10 + ["x"] * 10,
        ["1"] * 11 + ["x"] * 9,
        ["1"] * 20 + ["x"] * 200,
        ["1"] * 100 + ["x"],
        [None, "1", None, "x", "2"],
        ["1", "2"],
        [None],
        ["x"],
    ],
    ids=range(8),
)
def test_type_warning(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string").repartition(3)
    got = quality.type_warnings(df, ["i"], ["s"]).collect()
    expected = brute_type_warning(values)
    assert [r.affected_rows for r in got] == ([expected] if expected else [])


def test_wide_table_is_profiled_in_passes(spark):
    names = [f"c{i}" for i in range(230)]
    df = spark.range(10).select([(F.col("id") + i).alias(n) for i, n in enumerate(names)])
    got = profile.column_stats(df).orderBy("position").collect()
    assert [(r.name, r.min_value) for r in got] == [(n, float(i)) for i, n in enumerate(names)]
    assert isinstance(profile.column_stats(df).schema["min_value"].dataType, T.DoubleType)
