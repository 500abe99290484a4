"""Chat formatting of logged conversations, after collapsing cumulative snapshots.

A service that logs a conversation after each turn leaves its prefixes behind. Every conversation
gets rolling hashes over its turns, one for each prefix. Whole conversations whose last hash is an inner
hash of another one are its snapshots: an anti-join on distinct hashes, however many conversations
share a first turn, leaves the maximal ones. Only those are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.functions.names import column
from sluice.llm.common import hold

# The marks of the ChatML layout.
TEMPLATE = {"begin": "<|im_start|>", "middle": "\n", "end": "<|im_end|>\n"}


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """``turns`` with ``ordinal`` (from 1), the conversation's ``n_turns`` and ``prefix``, a hash of all turns so far.

    The prefix rolls on by exclusive or of hashes that know their ordinal, 128 bits in all; the
    window streams a conversation's turns in order, so a long one is not held in memory.
    """
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    numbered = turns.withColumn("ordinal", F.row_number().over(order))
    rolling = order.rowsBetween(Window.unboundedPreceding, 0)
    # A null role or text differs from an empty one.
    parts = [F.col("ordinal"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    halves = [F.bit_xor(F.xxhash64(F.lit(salt), *parts)).over(rolling) for salt in (1, 2)]
    prefix = F.struct(halves[0].alias("a"), halves[1].alias("b"))
    following = F.lead(F.lit(True)).over(order).isNull()
    return numbered.withColumn("prefix", prefix).withColumn("last", following)


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The maximal conversations, and the prefixes of all turns.

    The first has ``conv, n_turns, n_copies, n_snapshots``: how many conversations have just these turns,
    of which the smallest id stays, and how many conversations are shorter prefixes of it.
    """
    marked = hold(with_prefix_hashes(turns).select("conv", "ordinal", "prefix", "last"), "chat-prefixes")
    whole = marked.where("last").groupBy("ordinal", "prefix").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    whole = hold(whole.withColumnRenamed("ordinal", "n_turns"), "chat-whole")
    inner = marked.where(~F.col("last")).select("prefix", F.col("ordinal").alias("n_turns")).distinct()
    maximal = whole.join(inner, ["prefix", "n_turns"], "left_anti")
    # Snapshots of a maximal conversation: its own inner prefixes that are whole conversations.
    own = marked.where(~F.col("last")).join(maximal.select("conv"), "conv", "left_semi").select("conv", "prefix", F.col("ordinal").alias("n_turns"))
    found = own.join(whole.select("prefix", "n_turns", "n_copies"), ["prefix", "n_turns"]).groupBy("conv").agg(F.sum("n_copies").alias("n_snapshots"))
    out = maximal.join(found, "conv", "left").select("conv", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.coalesce("n_snapshots", F.lit(0)).alias("n_snapshots"))
    return out, marked


def render(role: Column, text: Column, template: dict[str, str] = TEMPLATE) -> Column:
    """One turn; a null role is ``user``, a null text is empty. Marks inside a text are taken out."""
    clean = F.coalesce(text, F.lit(""))
    for mark in (template["begin"].strip(), template["end"].strip()):
        clean = F.replace(clean, F.lit(mark), F.lit(""))
    return F.concat(F.lit(template["begin"]), F.coalesce(role, F.lit("user")), F.lit(template["middle"]), clean, F.lit(template["end"]))


def chat_format(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, n_turns, n_copies, n_snapshots, chat`` for every maximal conversation.

    Turns are ordered by number, nulls first, then role and text; repeated turns count as turns. Turns without a
    conversation id belong to no conversation. Other columns are left out. An empty table gives an empty
    result. A conversation is one row of the result; its turns are joined in one task.
    """
    named = conversations.where(column(conv_id).isNotNull())
    turns = named.select(
        column(conv_id).alias("conv"), column(turn).alias("turn"), column(role).cast("string").alias("role"), column(text).cast("string").alias("text")
    )
    maximal, _ = collapse(turns)
    maximal = hold(maximal, "chat-maximal")
    kept = turns.join(maximal.select("conv"), "conv", "left_semi")
    order = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", "text")
    told = kept.select("conv", F.struct(order.alias("order"), render(F.col("role"), F.col("text")).alias("turn")).alias("told"))
    chats = told.groupBy("conv").agg(F.sort_array(F.collect_list("told")).alias("told"))
    chats = chats.select("conv", F.array_join(F.col("told.turn"), "").alias("chat"))
    return maximal.join(chats, "conv").select(F.col("conv").alias(conv_id), "n_turns", "n_copies", "n_snapshots", "chat")
