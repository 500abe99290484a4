"""Mixing sources to target weights by Poisson replication.

Every document is repeated a random number of times whose mean is its source's repetition rate,
``rate = target share / share held``. The number is the Poisson distribution inverted at a uniform
number hashed from the seed and the id, so any task that sees the document again repeats it as
often. Then all copies are shuffled: a hash of seed, id and copy is a uniform position between 0
and 1 that names both the output partition and the place in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.names import column
from sluice.llm.common import hold, whole_text, with_small

DIGITS = 13  # hexadecimal digits of a hash that make a uniform number: 52 bits, exact in a double
DRAW_RATE = 64.0  # mean of one draw at most; higher rates are sums of draws
PARTITION_CHARS = 32_000_000  # of a partition of shuffled copies


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(16.0**DIGITS)


def draws(rate: Column) -> Column:
    """How many independent draws make one number of copies: a sum of Poisson numbers is one again."""
    return F.greatest(F.lit(1), F.ceil(rate / F.lit(DRAW_RATE))).cast("int")


def cumulative(rate: Column) -> Column:
    """Probabilities of at most 0, 1, 2, ... events at ``rate``, up to DRAW_RATE; what is left out is below 1e-16."""
    steps = F.sequence(F.lit(1), F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(40.0)).cast("int"))

    def up_to(k: Column) -> Column:
        first = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))

        def one_more(state: Column, j: Column) -> Column:
            p = state.p * rate / j
            return F.struct(p.alias("p"), (state.c + p).alias("c"))

        return F.aggregate(F.slice(steps, F.lit(1), k), first, one_more, lambda state: state.c)

    return F.transform(F.concat(F.array(F.lit(0)), steps), up_to)


def copies(name: Column, seed: int, table: Column, times: Column) -> Column:
    """The Poisson distribution inverted at a uniform number, once per draw: the entries that the number passes."""

    def inverted(draw: Column) -> Column:
        number = uniform(F.lit(str(seed)), name, F.lit("draw"), draw.cast("string"))
        return F.aggregate(table, F.lit(0), lambda n, p: n + F.when(p <= number, 1).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), times), F.lit(0), lambda n, draw: n + inverted(draw))


def source_rates(docs: DataFrame, weights: dict | None = None, budget: float | None = None, power: float = 0.5, source: str = "source", text: str = "text") -> DataFrame:
    """``source, chars, rate`` for every source.

    ``weights`` gives target weights by source; a source that is not named gets weight zero. Without
    it a source's weight is its size to the ``power``. ``budget`` is the size of the mix in
    characters, by default that of the corpus. Sizes are sums over all documents, combined in each
    task. Sources that hold no characters get rate zero.
    """
    sizes = docs.groupBy(column(source).alias("source")).agg(F.sum(F.char_length(whole_text(text))).cast("double").alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, F.pow("chars", F.lit(power))).otherwise(0.0))
    else:
        pairs = [(k, float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(pairs, "name string, weight double")
        on = F.col("source").cast("string").eqNullSafe(F.col("name"))
        sizes = sizes.join(given, on, "left").select("source", "chars", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes = hold(sizes, "mixing-sizes")
    whole = sizes.agg(F.sum("chars"), F.sum(F.when(F.col("chars") > 0, F.col("weight")))).first()
    size, weight = (budget if budget is not None else whole[0] or 0.0), whole[1] or 0.0
    rate = F.when((F.col("chars") > 0) & (F.lit(weight) > 0), F.col("weight") / F.lit(weight or 1.0) * F.lit(size) / F.col("chars")).otherwise(0.0)
    return sizes.select("source", "chars", rate.alias("rate"))


def mix(docs: DataFrame, rates: DataFrame, seed: int = 17, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The copies in shuffled order: the columns of ``docs`` with ``copy_no`` (from 1) and ``position``.

    A document of a null id draws by its text; rows that repeat an id draw alike. A null source is a
    source like any other, and a source without a rate is left out as one of rate zero. Columns of
    ``docs`` named ``copy_no`` or ``position`` are replaced. An empty table gives an empty result.
    The table of rates is broadcast only while it is small; a larger one is joined with salts.
    """
    own = [c for c in docs.columns if c not in ("copy_no", "position")]
    times = draws(F.col("rate"))
    table = rates.select(F.col("source").alias("__source"), times.alias("__times"), cumulative(F.col("rate") / times).alias("__table"))
    keyed = docs.select(*own).withColumn("__source", column(source))
    drawn = with_small(keyed, hold(table, "mixing-rates"), "__source")
    name = F.coalesce(column(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(whole_text(text).cast("binary"))))
    drawn = drawn.where("__table IS NOT NULL").withColumn("__name", name)
    drawn = drawn.withColumn("__count", copies(F.col("__name"), seed, F.col("__table"), F.col("__times"))).where("__count > 0")
    exploded = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), "__count")))
    placed = exploded.withColumn("position", uniform(F.lit(str(seed)), F.col("__name"), F.col("copy_no").cast("string")))
    placed = placed.select(*[column(c) for c in own], "copy_no", "position")
    budget = rates.agg(F.sum(F.col("rate") * F.col("chars"))).first()[0] or 0.0
    parts = max(1, math.ceil(budget / PARTITION_CHARS))
    # A uniform position is its own partition number: no sampling pass, and equal partitions.
    return placed.repartitionById(parts, F.floor(F.col("position") * parts).cast("int")).sortWithinPartitions("position", column(doc_id), "copy_no")
