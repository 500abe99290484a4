"""SQL type names of the catalogue and the Spark types behind them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Accepted type names.
SCALAR_TYPES = {
    "BOOLEAN": T.BooleanType(),
    "BOOL": T.BooleanType(),
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INTEGER": T.IntegerType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "HUGEINT": T.DecimalType(38, 0),
    "UTINYINT": T.ShortType(),
    "USMALLINT": T.IntegerType(),
    "UINTEGER": T.LongType(),
    "UBIGINT": T.DecimalType(20, 0),
    "FLOAT": T.FloatType(),
    "REAL": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "TEXT": T.StringType(),
    "STRING": T.StringType(),
    "UUID": T.StringType(),
    "JSON": T.StringType(),
    "TIME": T.StringType(),
    "BLOB": T.BinaryType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMP WITH TIME ZONE": T.TimestampType(),
    "TIMESTAMPTZ": T.TimestampType(),
}

# Other names of accepted types.
ALIASES = {
    "LOGICAL": "BOOLEAN",
    "INT1": "TINYINT",
    "INT2": "SMALLINT",
    "SHORT": "SMALLINT",
    "INT4": "INTEGER",
    "SIGNED": "INTEGER",
    "INT8": "BIGINT",
    "LONG": "BIGINT",
    "INT128": "HUGEINT",
    "FLOAT4": "FLOAT",
    "FLOAT8": "DOUBLE",
    "CHAR": "VARCHAR",
    "BPCHAR": "VARCHAR",
    "BYTEA": "BLOB",
    "BINARY": "BLOB",
    "VARBINARY": "BLOB",
    "DATETIME": "TIMESTAMP",
    "TIMESTAMP_US": "TIMESTAMP",
}

# Upper bounds of the unsigned types.
UNSIGNED_MAX = {
    "UTINYINT": 255,
    "USMALLINT": 65535,
    "UINTEGER": 4294967295,
    "UBIGINT": 18446744073709551615,
}

_DECIMAL = re.compile(r"(?:DECIMAL|NUMERIC|DEC)(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?")
_VARCHAR = re.compile(r"(?:VARCHAR|CHAR|BPCHAR|TEXT|STRING)\(\s*\d+\s*\)")


def canonical(name: str) -> str:
    """Upper-cased name with single blanks, an alias as what it stands for; length arguments of text types are dropped."""
    text = " ".join(name.strip().upper().split())
    if text.endswith("[]"):
        return canonical(text[:-2]) + "[]"
    return "VARCHAR" if _VARCHAR.fullmatch(text) else ALIASES.get(text, text)


def spark_type(name: str) -> T.DataType:
    """The Spark type of a catalogue type name; unknown names raise ``ValueError``."""
    text = canonical(name)
    if text.endswith("[]"):
        return T.ArrayType(spark_type(text[:-2]))
    if text in SCALAR_TYPES:
        return SCALAR_TYPES[text]
    decimal = _DECIMAL.fullmatch(text)
    if decimal:
        precision = int(decimal.group(1) or 18)
        scale = int(decimal.group(2) or (0 if decimal.group(1) else 3))
        if not (1 <= precision <= 38 and scale <= precision):
            raise ValueError(f"Invalid decimal type: {name}")
        return T.DecimalType(precision, scale)
    raise ValueError(f"Unknown type: {name}")


def type_name(dtype: T.DataType) -> str:
    """The catalogue name of a Spark type."""
    if isinstance(dtype, T.DecimalType):
        return "HUGEINT" if (dtype.precision, dtype.scale) == (38, 0) else f"DECIMAL({dtype.precision},{dtype.scale})"
    if isinstance(dtype, T.ArrayType):
        return type_name(dtype.elementType) + "[]"
    if isinstance(dtype, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {type_name(f.dataType)}" for f in dtype.fields) + ")"
    if isinstance(dtype, T.MapType):
        return f"MAP({type_name(dtype.keyType)}, {type_name(dtype.valueType)})"
    if isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "INTERVAL"
    names = {
        T.BooleanType: "BOOLEAN",
        T.ByteType: "TINYINT",
        T.ShortType: "SMALLINT",
        T.IntegerType: "INTEGER",
        T.LongType: "BIGINT",
        T.FloatType: "FLOAT",
        T.DoubleType: "DOUBLE",
        T.BinaryType: "BLOB",
        T.DateType: "DATE",
        T.TimestampNTZType: "TIMESTAMP",
        T.TimestampType: "TIMESTAMP WITH TIME ZONE",
    }
    return names.get(type(dtype), "VARCHAR")


def type_class(dtype: T.DataType) -> str:
    """``numeric``, ``temporal``, ``text`` or ``other``."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "temporal"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    return "other"
