"""Exact deduplication against a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest. A batch of documents is
reduced to one row per digest first, combined in each task, so a text with a third of all copies
costs one row per task. Those rows meet the index in a sort-merge anti-join on the buckets, without
shuffling the index, and what is new is appended.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice.functions.names import column
from sluice.llm.common import WORD_BREAK, hold, whole_text, without
from sluice.session import scratch_dir

INDEX = "digest BINARY, keep_id BIGINT, keep_chars BIGINT, batch STRING"
HOT_SHARE = 10_000  # a digest with more than one in so many rows of a batch joins by broadcast


def digest(text: Column) -> Column:
    """SHA-256, in hexadecimal digits, of a text without the white space of ASCII."""
    return F.sha2(F.regexp_replace(text, f"{WORD_BREAK}+", ""), 256)


class DigestIndex:
    """The digests seen so far, each with the document that was kept for it.

    ``path`` lies in shared storage; opening it again, also from another session, continues the
    index. ``buckets`` is fixed when the index is made: one file per bucket and batch, and a
    lookup reads a bucket in one task, so choose it by the size expected (about 5 million digests
    per bucket); by default it is the session's number of shuffle partitions. Batches are added one
    after the other.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        # One entry in the session's catalog for each index, whoever opens it; the files are at ``path``.
        self.table = f"sluice_digests_{hashlib.md5(self.path.encode()).hexdigest()}"
        made = self._made_with()
        if made is None:
            made = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(made,)], "buckets INT").coalesce(1).write.json(f"{self.path}/made")
        elif buckets not in (None, made):
            raise ValueError(f"the index was made with {made} buckets")
        self.buckets = made
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({INDEX}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {made} BUCKETS LOCATION '{self.path}/digests'"
        )

    def _made_with(self) -> int | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/made/_SUCCESS")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.schema("buckets INT").json(f"{self.path}/made").first().buckets if files.exists(path) else None

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Forget the index in this session; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batch: str | None = None) -> DataFrame:
        """Add a batch; returns ``docs`` with ``keep_id, group_size, kept, text_sha256``, one row for each row.

        Texts are equal when identical without the white space of ASCII; a null text is an empty one.
        The longest original stays (in code points), then the smallest id, nulls last, then any one
        of rows that repeat both. Where an earlier batch holds the digest, its document stays and no
        row of this batch is kept. ``group_size`` counts the rows of this batch. Columns of ``docs``
        with one of the four names are replaced. An empty table gives an empty result.

        ``batch`` names the batch: one that is run again, as its caller failed after it was added, gets the verdicts
        that it got before. Without a name every call is a batch of its own.
        """
        made = ("keep_id", "group_size", "kept", "text_sha256")
        own = [c for c in docs.columns if c not in made]
        rows = docs.select(*own).withColumn("__sha", digest(whole_text(text))).withColumn("__chars", F.char_length(whole_text(text)).cast("long"))
        marked = hold(rows.withColumn("__row", F.monotonically_increasing_id()), "digests")
        decided, hot = self._decide(marked, doc_id, batch)
        return _judged(marked, decided, hot, own)

    def verdicts(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batch: str | None = None) -> DataFrame:
        """As ``add``, but only ``doc_id`` of the documents' columns, which keeps the texts out of all later steps."""
        bare = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
        rows = bare.select("doc_id", digest(F.col("text")).alias("__sha"), F.char_length("text").cast("long").alias("__chars"))
        marked = hold(rows.withColumn("__row", F.monotonically_increasing_id()), "digests")
        decided, hot = self._decide(marked, "doc_id", batch)
        return _judged(marked, decided, hot, ["doc_id"])

    def _decide(self, marked: DataFrame, doc_id: str, batch: str | None) -> tuple[DataFrame, DataFrame]:
        """(digest -> keep_id, keep_row, size) after adding what is new, and those of very large groups."""
        batch = batch or uuid.uuid4().hex
        order = F.struct((-F.col("__chars")).alias("minus"), F.col(doc_id).isNull().alias("unnamed"), F.col(doc_id).cast("long").alias("id"), F.col("__row").alias("row"))
        groups = marked.groupBy("__sha").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
        groups = groups.select(
            F.unhex("__sha").alias("digest"),
            F.col("best.id").alias("keep_id"),
            F.col("best.row").alias("keep_row"),
            (-F.col("best.minus")).alias("keep_chars"),
            "group_size",
        )
        groups = hold(groups, "digest-groups")
        dealt = groups.repartition(self.buckets, "digest")  # as the buckets are
        new = dealt.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        self._append(new.select("digest", "keep_id", "keep_chars", F.lit(batch).alias("batch")))
        # What this batch added, now or in an earlier run of it, is its own; rows are numbered anew in each run.
        found = dealt.select("digest", "group_size", "keep_row").hint("merge").join(self.rows(), "digest")
        decided = hold(
            found.select("digest", "keep_id", "group_size", F.when(F.col("batch") == batch, F.col("keep_row")).alias("keep_row")), "digest-verdicts"
        )
        total = decided.agg(F.sum("group_size")).first()[0] or 0
        return decided, decided.where(F.col("group_size") > max(1, total // HOT_SHARE))

    def _append(self, new: DataFrame) -> None:
        # Materialised first: a table cannot be read and appended to in one plan.
        held = hold(new, "digest-new")
        held.repartition(self.buckets, "digest").write.mode("append").insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def _judged(marked: DataFrame, decided: DataFrame, hot: DataFrame, own: list[str]) -> DataFrame:
    """Each row with its group's verdict. The very large groups, fewer than HOT_SHARE, join by broadcast."""
    keyed = marked.withColumn("__digest", F.unhex("__sha"))
    few, many = hot.withColumnRenamed("digest", "__digest"), decided.withColumnRenamed("digest", "__digest")
    rest = keyed.join(F.broadcast(few.select("__digest")), "__digest", "left_anti").join(many, "__digest")
    both = keyed.join(F.broadcast(few), "__digest").unionByName(rest)
    kept = (F.col("__row") == F.coalesce("keep_row", F.lit(-1))).alias("kept")
    return both.select(*[F.col(f"`{c}`") for c in own], "keep_id", "group_size", kept, F.col("__sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; see ``DigestIndex.add``.

    Rows are decided by digests alone; the texts wait in the shared folder, and only the numbers of the rows that go
    are sent to them.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, scratch_dir(spark, "digest-index"))
    row = F.struct(*[column(c) for c in docs.columns])
    bare = docs.select(row.alias("row"), F.monotonically_increasing_id().alias("__row"))
    held = hold(bare, "digest-rows")
    whole = F.col("row").getField(text)
    slim = held.select(F.col("row").getField(doc_id).cast("long").alias("doc_id"), "__row", F.coalesce(whole.cast("string"), F.lit("")).alias("text"))
    slim = slim.select("doc_id", "__row", digest(F.col("text")).alias("__sha"), F.char_length("text").cast("long").alias("__chars"))
    marked = hold(slim, "digests")
    decided, hot = index._decide(marked, "doc_id", batch)
    gone = hold(_judged(marked, decided, hot, ["__row"]).where("NOT kept").select("__row"), "digest-gone")
    return without(held, gone, "__row").select("row.*")
