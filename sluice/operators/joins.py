"""Joins by order: the latest row at or before another, and intervals that overlap.

Both cut the order into buckets, so that neither a frequent key nor a long span ends in one task, and neither
compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sluice.functions.names import column

BUCKETS = 1024  # into which the order is cut, for want of a width


def _number(name: str, df: DataFrame) -> Column:
    """The order as a whole number: microseconds of moments, days of dates, the value of integers."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(column(name)).cast("long")
    if isinstance(kind, T.IntegralType):
        return column(name).cast("long")
    raise ValueError(f"{name} is neither a moment, a date nor a whole number")


def _width(df: DataFrame, at: Column, width: int | None) -> int:
    if width:
        return width
    low, high = df.agg(F.min(at), F.max(at)).first()
    return max(1, (high - low) // BUCKETS) if low is not None else 1


def _bucket(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("long") if width > 1 else at


def asof_join(left: DataFrame, right: DataFrame, at: str, keys: list[str], values: list[str], tie: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Each row of ``left`` with ``values`` of the last row of ``right`` with equal ``keys`` at or before its ``at``.

    Of rows of ``right`` at the same moment the greatest by ``tie`` counts, by default by the values. Rows of ``left``
    without such a row, with a null key or a null moment keep NULLs. Both sides are united and sorted within buckets
    of the order, ``width`` wide (whole numbers, days or microseconds); what a bucket inherits is the last value of
    the buckets before it, one row each. So a key with a third of all rows is spread over the buckets it spans.
    """
    tie = tie if tie is not None else values
    order_left, order_right = _number(at, left), _number(at, right)
    width = _width(right, order_right, width)
    own = [column(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    held = F.struct(*[column(v).alias(f"v{i}") for i, v in enumerate(values)])
    lasts = F.struct(*[column(t).alias(f"t{i}") for i, t in enumerate(tie)])
    row = F.struct(*[column(c) for c in left.columns])
    asked = left.select(*own, order_left.alias("_at"), F.lit(1).alias("_side"), row.alias("_row"))
    known = right.select(*own, order_right.alias("_at"), F.lit(0).alias("_side"), lasts.alias("_tie"), held.alias("_value"))
    known = known.where(" AND ".join([*[f"{k} IS NOT NULL" for k in ks], "_at IS NOT NULL"]))
    both = asked.unionByName(known, allowMissingColumns=True).withColumn("_bucket", _bucket(F.col("_at"), width))
    # The last row of each bucket that has any, and of those before: as many rows as filled buckets.
    ends = both.where("_side = 0").groupBy(*ks, "_bucket").agg(F.max_by("_value", F.struct("_at", "_tie")).alias("_end"))
    heirs = both.where("_side = 1").select(*ks, "_bucket").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    chain = ends.unionByName(heirs).groupBy(*ks, "_bucket").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = Window.partitionBy(*ks).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    chain = chain.select(*ks, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_inherited")).where("_inherited IS NOT NULL")
    within = Window.partitionBy(*ks, "_bucket").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_value", ignorenulls=True).over(within)).where("_side = 1").drop("_value", "_tie", "_side")
    joined = carried.join(chain, [*ks, "_bucket"], "left")
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_last", "_inherited"))
    return joined.select("_row", found.alias("_found")).select("_row.*", *[F.col(f"_found.v{i}").alias(v) for i, v in enumerate(values)])


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """All pairs of rows with equal ``keys`` whose closed spans overlap; a point is a span from a column to itself.

    A row is copied to each bucket that its span touches, ``width`` wide. A pair meets in every bucket both touch and
    counts only in the one in which the later of the two begins, so no pair is found twice and none is removed. Spans
    with a null end, or that end before they begin, overlap nothing. The sides' column names must differ but for keys.
    """
    keys = keys or []
    spans = {}
    for name, (df, (first, last)) in {"l": (left, left_span), "r": (right, right_span)}.items():
        spans[name] = df.withColumns({f"_{name}a": _number(first, df), f"_{name}b": _number(last, df)}).where(f"_{name}a <= _{name}b")
    if width is None:
        # About the mean length: few copies of a row, few rows in a bucket that do not meet.
        mean = [s.agg(F.avg(F.col(f"_{n}b") - F.col(f"_{n}a"))).first()[0] or 0 for n, s in spans.items()]
        width = max(1, int(max(mean)))
    sides = {}
    for name, df in spans.items():
        touched = F.sequence(_bucket(F.col(f"_{name}a"), width), _bucket(F.col(f"_{name}b"), width))
        sides[name] = df.withColumn("_bucket", F.explode(touched))
    met = sides["l"].join(sides["r"], [*keys, "_bucket"])
    later = F.greatest("_la", "_ra")
    pairs = met.where((later <= F.least("_lb", "_rb")) & (_bucket(later, width) == F.col("_bucket")))
    return pairs.drop("_bucket", "_la", "_lb", "_ra", "_rb")
