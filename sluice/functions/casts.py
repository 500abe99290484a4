"""Safe casts: a value that cannot be converted becomes NULL, the row stays."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

from sluice.functions.types import UNSIGNED_MAX, canonical, spark_type, type_class

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# Decimal numbers in ASCII digits, single underscores allowed between digits.
NUMBER = r"^\s*[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+)(?:[eE][+-]?\d+)?\s*$"
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"
SPECIAL_NUMBER = r"^\s*(?i:[+-]?inf(?:inity)?|[+-]?nan)\s*$"
PREFIXED_INTEGER = r"^\s*0(?:[xX][0-9a-fA-F]{1,16}|[bB][01]{1,64})\s*$"
# Year first, one separator throughout, optionally followed by a clock time and a zone.
DATE_TEXT = r"^\s*\d{4,6}([-/ \\])\d{1,2}\1\d{1,2}\s*$"
MOMENT_TEXT = (
    r"^\s*\d{4,6}([-/ \\])\d{1,2}\1\d{1,2}[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
    r"\s*(?:Z|UTC|[+-]\d{1,2}(?::?\d{2})?)?\s*$"
)
CLOCK_TEXT = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2})(\.\d+)?)?\s*$"


def safe_cast(col: Column, source: T.DataType, target: str) -> Column:
    """``col`` (of Spark type ``source``) as catalogue type ``target``, NULL where impossible."""
    name, dtype = canonical(target), spark_type(target)
    if isinstance(dtype, T.ArrayType):
        return _to_array(col, source, name)
    if name == "TIME":
        return _to_clock(col, source)
    if isinstance(dtype, T.StringType):
        return _to_text(col, source)
    if isinstance(source, T.StringType):
        out = _from_text(col, dtype, isinstance(dtype, _INTEGRAL) or name in ("HUGEINT", "UBIGINT"))
    elif {type_class(source), type_class(dtype)} <= {"numeric", "other"} and not isinstance(
        source, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    ):
        out = _from_number(col, source, dtype)
    elif type_class(source) == type_class(dtype) == "temporal":
        out = col.try_cast(dtype)
    elif source == dtype:
        out = col
    else:
        out = F.lit(None).cast(dtype)
    if name in UNSIGNED_MAX:
        out = F.when(out.between(F.lit(0), F.lit(Decimal(UNSIGNED_MAX[name]))), out)
    return out


def _from_text(col: Column, dtype: T.DataType, integral: bool) -> Column:
    if isinstance(dtype, T.NumericType):
        bare = F.when(F.contains(col, F.lit("_")), F.regexp_replace(col, "_", "")).otherwise(col)
    if integral:
        # Fractions and exponents round half away from zero; tried only where the plain cast fails.
        wide = "decimal(38,10)" if isinstance(dtype, _INTEGRAL) else "decimal(38,0)"
        rounded = F.when(col.rlike(NUMBER), F.round(bare.try_cast(wide), 0).try_cast(dtype))
        digits, base = F.substring(F.trim(col), 3, 64), F.lower(F.substring(F.trim(col), 2, 1))
        prefixed = F.when(
            col.rlike(PREFIXED_INTEGER),
            F.when(base == "x", F.conv(digits, 16, 10)).otherwise(F.conv(digits, 2, 10)).try_cast(dtype),
        )
        # A failing cast of text to an integer is slow, so only whole numbers get there.
        plain = [F.when(col.rlike(WHOLE_NUMBER), col.try_cast(dtype))] if isinstance(dtype, _INTEGRAL) else []
        return F.coalesce(*plain, rounded, prefixed)
    if isinstance(dtype, T.DecimalType):
        return F.when(col.rlike(NUMBER), bare.try_cast(dtype))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(col.rlike(NUMBER), bare.try_cast(dtype)).when(col.rlike(SPECIAL_NUMBER), F.trim(col).try_cast(dtype))
    if isinstance(dtype, T.DateType):
        return F.when(col.rlike(DATE_TEXT), _dashed(col).try_cast("date")).when(
            col.rlike(MOMENT_TEXT), _dashed(col).try_cast("timestamp_ntz").cast("date")
        )
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        plain = col.rlike(MOMENT_TEXT) | (col.rlike(DATE_TEXT) & ~col.rlike(r"\s$"))
        return F.when(plain, _dashed(col).try_cast(dtype))
    return col.try_cast(dtype)


def _dashed(col: Column) -> Column:
    text = F.trim(col)
    dashes = F.regexp_replace(text, r"^(\d+)[-/ \\](\d{1,2})[-/ \\](\d{1,2})", "$1-$2-$3")
    return F.when(F.substring(text, 5, 1) == "-", text).otherwise(dashes)


def _from_number(col: Column, source: T.DataType, dtype: T.DataType) -> Column:
    fractional = isinstance(source, (T.FloatType, T.DoubleType))
    integral = isinstance(dtype, _INTEGRAL) or (isinstance(dtype, T.DecimalType) and dtype.scale == 0)
    if integral and fractional:
        return F.rint(col).try_cast(dtype)  # half to even
    if integral and isinstance(source, T.DecimalType):
        return F.round(col, 0).try_cast(dtype)  # half away from zero
    if isinstance(dtype, T.DecimalType) and fractional:
        power = float(10**dtype.scale)
        return (F.round(col * F.lit(power), 0) / F.lit(power)).try_cast(dtype)  # half away from zero
    if isinstance(dtype, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        return F.lit(None).cast(dtype)
    return col.try_cast(dtype)


def _to_text(col: Column, source: T.DataType) -> Column:
    text = col.cast("string")
    if not isinstance(source, (T.FloatType, T.DoubleType)):
        return text
    # Most values need no work; the rest goes through a lambda, which keeps the compiled code small.
    simple = ~F.contains(text, F.lit("E")) & (F.length(text) <= 16) & ~text.isin("NaN", "Infinity", "-Infinity")
    return F.when(simple, text).otherwise(F.transform(F.array(col), lambda x: _unusual_text(x, source))[0])


def _unusual_text(col: Column, source: T.DataType) -> Column:
    text = col.cast("string")
    # Older JVMs print some doubles with a digit too many: take 16 or 17 digits if they read back.
    wordy = F.length(F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), "[-.]", "")) >= 17
    for pattern in ("%.16e", "%.15e") if isinstance(source, T.DoubleType) else ():
        shorter = F.regexp_replace(F.regexp_replace(F.format_string(pattern, col), r"\.?0*e", "E"), r"E\+?(-?)0*(\d)", "E$1$2")
        text = F.when(wordy & (shorter.try_cast("double") == col), shorter).otherwise(text)
    # Spark writes 1.0E7 where positional digits are wanted between 1e-4 and 1e16.
    positional = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.abs(exponent).cast("string")
    signed = F.concat(F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.length(digits) < 2, F.lit("0")).otherwise(F.lit("")), digits)
    size = F.abs(col)
    return (
        F.when(F.isnan(col), F.lit("nan"))
        .when(size == float("inf"), F.when(col > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~F.contains(text, F.lit("E")), text)
        .when((size >= 1e-4) & (size < 1e16), positional)
        .otherwise(F.concat(mantissa, signed))
    )


def _to_clock(col: Column, source: T.DataType) -> Column:
    if isinstance(source, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "HH:mm:ss")
    if not isinstance(source, T.StringType):
        return F.lit(None).cast("string")
    # A clock time is checked by placing it on a fixed day.
    moment = F.when(col.rlike(CLOCK_TEXT), F.concat(F.lit("1970-01-01 "), F.trim(col))).when(
        col.rlike(MOMENT_TEXT) | col.rlike(DATE_TEXT), _dashed(col)
    )
    return F.date_format(moment.try_cast("timestamp_ntz"), "HH:mm:ss")


def _to_array(col: Column, source: T.DataType, name: str) -> Column:
    if isinstance(source, T.StringType):
        col, source = F.from_json(col, "array<string>"), T.ArrayType(T.StringType())
    if not isinstance(source, T.ArrayType):
        return F.lit(None).cast(spark_type(name))
    return F.transform(col, lambda item: safe_cast(item, source.elementType, name[:-2]))
