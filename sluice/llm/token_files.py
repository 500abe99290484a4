"""Token ids of whole documents in compressed, checked blocks, written and read by Spark.

The file format is a Parquet folder with one row per block of the range coder: where the block stands (part
and number), which documents it holds, and the coded bytes. Parts are ranges of document ids in ascending
order, so part, block and place give the order of all documents. A block is reset and checksummed by itself:
tasks decode blocks in any order, and a damaged one is found and named. Spark's committer writes the
folder, so lost executors and repeated tasks leave no trace in it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sluice.functions.names import column
from sluice.llm.bpe import Encoder
from sluice.llm.common import SLICE_ROWS, extended, hold, whole_text, worker_state
from sluice.llm.rangecoder import BLOCK, DamagedBlock, decode_block, encode_block

PART_CHARS = 16_000_000  # characters of a part, about
BLOCKS = "part int, block int, n_ids bigint, doc_ids array<bigint>, pieces array<int>, sizes array<bigint>, payload binary"
BLOCKS_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("pieces", pa.list_(pa.int32())),
        ("sizes", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def write_token_files(docs: DataFrame, definition: str, path: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode the texts, each followed by ``end_id``, and write them in ascending order of their ids.

    ``definition`` is the content of a tokenizer file; strings of its added tokens get their ids. A null text is an empty one; rows of null ids come
    first; rows that repeat an id stand side by side. A document longer than a block is written in
    pieces. Parts are cut by the size of the corpus, blocks hold BLOCK ids at most.
    """
    chars = docs.agg(F.sum(F.char_length(whole_text(text)))).first()[0] or 0
    parts = max(1, math.ceil(chars / PART_CHARS))
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"bpe {zlib.crc32(definition.encode())}", lambda: Encoder(definition, added=True))
        size = encoder.tokenizer.get_vocab_size()
        vocabulary = max(size, end_id + 1)
        part, number = TaskContext.get().partitionId(), 0
        block = _Block()

        def closed() -> pa.RecordBatch:
            nonlocal number, block
            row = block.row(part, number, vocabulary)
            number, block = number + 1, _Block()
            return pa.RecordBatch.from_pylist([row], BLOCKS_ARROW)

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(start, SLICE_ROWS)
                found = encoder.encode(some.column(1).to_pylist())
                for one, ids in zip(some.column(0).to_pylist(), found):
                    ids = np.append(np.frombuffer(ids, encoder.dtype).astype("<u4"), np.uint32(end_id))
                    if block.size and block.size + len(ids) > BLOCK:
                        yield closed()
                    for piece, first in enumerate(range(0, len(ids), BLOCK)):
                        block.add(one, piece, ids[first : first + BLOCK])
                        if first + BLOCK < len(ids):
                            yield closed()
        if block.size:
            yield closed()

    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(path)


class _Block:
    def __init__(self):
        self.doc_ids, self.pieces, self.ids, self.size = [], [], [], 0

    def add(self, doc_id: int | None, piece: int, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.pieces.append(piece)
        self.ids.append(ids)
        self.size += len(ids)

    def row(self, part: int, number: int, vocabulary: int) -> dict:
        return {
            "part": part,
            "block": number,
            "n_ids": self.size,
            "doc_ids": self.doc_ids,
            "pieces": self.pieces,
            "sizes": [len(x) for x in self.ids],
            "payload": encode_block(np.concatenate(self.ids), vocabulary),
        }


def read_pieces(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``part, block, place, doc_id, piece, n_ids, crc`` and, if wanted, ``ids`` of each piece of a document.

    Decoded block by block; a block whose checksum, sizes or layout do not fit fails the job, by name.
    """
    schema = "part int, block int, place int, doc_id bigint, piece int, n_ids bigint, crc bigint" + (", ids array<int>" if with_ids else "")
    fields = [("part", pa.int32()), ("block", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("n_ids", pa.int64()), ("crc", pa.int64())]
    arrow = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(BLOCKS_ARROW.names)}
                try:
                    ids = decode_block(r["payload"])
                except DamagedBlock as error:
                    raise DamagedBlock(f"part {r['part']}, block {r['block']}: {error}") from error
                if len(ids) != r["n_ids"] or sum(r["sizes"]) != len(ids):
                    raise DamagedBlock(f"part {r['part']}, block {r['block']}: the documents do not fill it")
                cuts = np.cumsum([0, *r["sizes"]])
                own = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
                n = len(own)
                columns = [[r["part"]] * n, [r["block"]] * n, list(range(n)), r["doc_ids"], r["pieces"], r["sizes"], [zlib.crc32(x.tobytes()) for x in own]]
                columns = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(run, schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the decoded ids.

    ``start`` counts the ids of all documents before it: sums by part, then by block in a part, then by place
    in a block. Only the sums by part, one row for PART_CHARS characters, are ordered in one task.
    """
    pieces = hold(read_pieces(spark, path, with_ids=False), "token-pieces")  # each block is decoded once
    within = Window.partitionBy("part").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spark.read.schema(BLOCKS).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("offset"))
    placed = pieces.withColumn("before", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    # The pieces of a document stand side by side; a piece 0 begins it.
    numbered = placed.withColumn("number", F.sum((F.col("piece") == 0).cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("piece", "n_ids", "crc")))
    documents = numbered.groupBy("part", "number").agg(
        F.min("doc_id").alias("doc_id"), F.min("before").alias("before"), F.sum("n_ids").alias("n_tokens"), parts.alias("parts")
    )
    whole = documents.where(F.size("parts") == 1).withColumn("ids_crc32", F.col("parts")[0]["crc"])
    cut = documents.where(F.size("parts") > 1).mapInArrow(_combined, extended(documents.schema, "ids_crc32 bigint"))
    both = whole.unionByName(cut).join(F.broadcast(offsets) if sizes.count() < 100_000 else offsets, "part")
    return both.select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for parts in batch.column(batch.schema.get_field_index("parts")).to_pylist():
            crc = parts[0]["crc"]
            for p in parts[1:]:
                crc = crc32_combine(crc, p["crc"], 4 * p["n_ids"])
            found.append(crc)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "ids_crc32"])


def crc32_combine(first: int, second: int, size: int) -> int:
    """The crc32 of two joined byte strings from that of each and the second one's size.

    Zeros appended to the first string multiply its checksum by a power of x modulo the polynomial; the
    powers are reached by squaring.
    """

    def times(a: int, b: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, factor, bits = 1 << 31, 1 << 23, size  # x^0, and x^8 for each byte
    while bits:
        if bits & 1:
            power = times(power, factor)
        factor = times(factor, factor)
        bits >>= 1
    return times(power, first) ^ second
