"""Safe casts against DuckDB's TRY_CAST."""

import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F, types as T

from sluice.functions.casts import safe_cast
from sluice.functions.types import ALIASES, spark_type, type_class, type_name

TEXTS = [
    "1.5", "2.5", "-2.5", "0.5", "1e3", "1_000", "1__0", "_1", "1_000.5", "0x1F", "0b101", "-0x1F", " 5 ", "5.", ".5",
    "+5", "1e-1", "1e", "5d", "5f", "infinity", "-inf", "nan", "", "  ", "abc", "127", "128", "-128", "2147483647",
    "2147483648", "2147483647.4", "2147483647.5", "9223372036854775807", "9223372036854775808", "1e30", "١",
    "0x1p3", "1.005", "99999999.994", "99999999.995", "00123", "true", "t", "yes", "1", "y", "no", "on", "TRUE", "f",
    "99999999999999999999.5", "--5", "1,5",
]
MOMENTS = [
    "2024-01-15", "2024/01/15", "2024-01", "2024-01-15 x", "2024-1-5", "2024-01-15T10:00:00", "2024-01-15 10:00",
    "2024-02-30", "01/15/2024", "20240115", "2024-01-15 10:30:00+02", "2024-01-15T10:30:00Z", "2024-01-15 25:00:00",
    "10:30:00", "9:05", "2024-01-15 10:30:00.123456", "2024-01-15 10", "2024 01 15", "2024\\01\\15", "2024-01/15", "",
    "2024-01-15 10:30:00.5", "  2024-01-15", "2024-13-01", "2023-02-29", "2024-02-29",
]


def duck(values, cast_from, target):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE TABLE v (i INTEGER, x {cast_from})")
    con.executemany("INSERT INTO v VALUES (?, ?)", list(enumerate(values)))
    return [r[0] for r in con.execute(f"SELECT TRY_CAST(x AS {target}) FROM v ORDER BY i").fetchall()]


def ours(spark, values, source, target):
    df = spark.createDataFrame(list(enumerate(values)), T.StructType([T.StructField("i", T.LongType()), T.StructField("x", source)]))
    out = df.select("i", safe_cast(F.col("x"), source, target).alias("y"))
    assert out.schema["y"].dataType == spark_type(target)
    return [r.y for r in out.orderBy("i").collect()]


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    if isinstance(a, datetime.time):
        a = a.strftime("%H:%M:%S")
    if isinstance(a, datetime.datetime) and a.tzinfo:
        a = a.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return a == b


def check(spark, values, source, cast_from, target):
    expected, got = duck(values, cast_from, target), ours(spark, values, source, target)
    wrong = [(v, e, g) for v, e, g in zip(values, expected, got) if not same(e, g)]
    assert not wrong, wrong


@pytest.mark.parametrize(
    "target",
    ["TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "UINTEGER", "UBIGINT", "DOUBLE", "DECIMAL(10,2)", "BOOLEAN", "VARCHAR"],
)
def test_text_to_number(spark, target):
    check(spark, TEXTS, T.StringType(), "VARCHAR", target)


@pytest.mark.parametrize("target", ["DATE", "TIMESTAMP", "TIME"])
def test_text_to_moment(spark, target):
    check(spark, MOMENTS, T.StringType(), "VARCHAR", target)


def test_text_to_zoned_moment(spark):
    check(spark, ["2024-01-15 10:30:00+02", "2024-01-15T10:30:00Z", "2024-01-15 10:30", "x"], T.StringType(), "VARCHAR", "TIMESTAMPTZ")


def doubles():
    rng = random.Random(7)
    fixed = [1.5, 2.5, -1.5, 3.7, 1e30, 1.005, 0.0, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 1e20, 1e-4, 1e-5, 1.5e-5, 0.001, 123456789.125, -1e300, float("nan"), float("inf"), -float("inf"), 2147483647.5, 2147483646.5, 127.5, 1.7976931348623157e308]
    return fixed + [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 18) for _ in range(300)]


@pytest.mark.parametrize("target", ["TINYINT", "INTEGER", "BIGINT", "DECIMAL(10,2)", "VARCHAR", "BOOLEAN"])
def test_double_to(spark, target):
    values = doubles()
    if target == "BOOLEAN":
        values = [v for v in values if not math.isnan(v)]
    check(spark, values, T.DoubleType(), "DOUBLE", target)


@pytest.mark.parametrize("target", ["INTEGER", "BIGINT", "DOUBLE", "VARCHAR", "DECIMAL(10,2)", "BOOLEAN", "TINYINT", "DATE"])
def test_long_to(spark, target):
    check(spark, [0, 1, -1, 127, 128, 2147483647, 2147483648, -(2**63), 2**63 - 1, 99999999], T.LongType(), "BIGINT", target)


@pytest.mark.parametrize("target", ["VARCHAR", "DATE", "INTEGER", "TIME", "TIMESTAMP"])
def test_timestamp_to(spark, target):
    values = [datetime.datetime(2024, 1, 15, 10, 30, 0, 500000), datetime.datetime(2024, 1, 15), datetime.datetime(1969, 12, 31, 23, 59, 59)]
    check(spark, values, T.TimestampNTZType(), "TIMESTAMP", target)


def test_decimal_and_boolean(spark):
    from decimal import Decimal

    check(spark, [Decimal("1.50"), Decimal("2.50"), Decimal("-0.50")], T.DecimalType(5, 2), "DECIMAL(5,2)", "INTEGER")
    check(spark, [True, False, None], T.BooleanType(), "BOOLEAN", "BIGINT")
    check(spark, [True, False, None], T.BooleanType(), "BOOLEAN", "VARCHAR")
    check(spark, ["[1, 2]", None], T.StringType(), "VARCHAR", "INTEGER[]")


def test_type_names():
    for name in ["BOOLEAN", "TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "FLOAT", "DOUBLE", "VARCHAR", "BLOB", "DATE", "TIMESTAMP", "TIMESTAMP WITH TIME ZONE", "DECIMAL(10,2)", "INTEGER[]", "BIGINT[][]"]:
        assert type_name(spark_type(name)) == name
    assert spark_type(" timestamp  with time zone ") == T.TimestampType()
    assert type_name(T.StructType([T.StructField("a", T.IntegerType())])) == "STRUCT(a INTEGER)"
    assert type_name(T.MapType(T.StringType(), T.LongType())) == "MAP(VARCHAR, BIGINT)"
    assert type_class(T.StructType([T.StructField("a", T.IntegerType())])) == "other"
    for bad in ["VARCHARS", "INT; DROP TABLE x", "DECIMAL(50,2)", "STRUCT(a INT)"]:
        with pytest.raises(ValueError):
            spark_type(bad)


@pytest.mark.parametrize("name", [*ALIASES, "DEC(9,2)", "TEXT(5)", "bpchar(3)", "int8[]"])
def test_other_names_of_types(spark, name):
    """Aliases convert like the types they stand for."""
    cells = ["1", "x", None, "2024-02-29 10:11:12", "3.5", "true"]
    con = duckdb.connect()
    listed = name.endswith("[]")
    meant = con.execute(f"SELECT typeof(CAST(NULL AS {name}))").fetchone()[0]
    assert type_name(spark_type(name)) == meant
    if listed or meant == "BLOB":
        return
    want = [con.execute(f"SELECT TRY_CAST(? AS {name})", [c]).fetchone()[0] for c in cells]
    df = spark.createDataFrame(list(enumerate(cells)), "n int, c string")
    found = df.select("n", safe_cast(F.col("c"), df.schema["c"].dataType, name).alias("v")).orderBy("n").collect()
    assert [r.v for r in found] == want
