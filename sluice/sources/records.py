"""Records of delimited text whose quoted cells may hold line breaks, found in parallel.

A line maps the state in which it starts (outside or inside quotes) to the one in which it ends. A split's lines
compose to one such map, two bits; the maps of a file's splits compose by a prefix scan, which tells every split how
it starts. Each split then cuts its own records. What a border cuts in two travels as fragments, at most two per
split, and is put together by place. No file is read by one task, whatever its quotes.

Lines are read with ``\\n`` between them; a ``\\r`` before it, outside quotes, goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MOST_CHARS = 1 << 27  # of a record: a quote that nothing closes is an error, not a record of all that follows
FEW_SPLITS = 100_000  # that start inside quotes and are told so by broadcast


def pin_splits(spark: SparkSession) -> None:
    """Keep split sizes from following the number of executors, which may change between two passes."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def lines_of(spark: SparkSession, paths: str | list[str], base: str | None = None) -> DataFrame:
    """``line`` (binary), ``file`` (a hash of its path), ``start`` and ``length`` of its split, and columns named by folders."""
    reader = spark.read.option("lineSep", "\n")
    raw = (reader.option("basePath", base) if base else reader).text(paths)
    place = [F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.col("_metadata.file_block_length").alias("__length")]
    return raw.select(F.col("value").cast("binary").alias("__line"), *place, *[F.col(f"`{c}`") for c in raw.columns[1:]])


def inside_after(line: bytes, inside: bool, delimiter: bytes, quote: bytes = b'"') -> bool:
    """Whether a line ends inside quotes.

    A quote opens at the start of a cell only; inside, a quote closes the cell unless another follows at once;
    elsewhere it stands for itself.
    """
    pieces = line.split(quote)
    closed, fresh = False, not inside  # just behind a closing quote; at the start of a cell
    for piece in pieces[:-1]:
        if not inside and piece:
            closed, fresh = False, piece.endswith(delimiter)
        if inside:
            inside, closed, fresh = False, True, False
        elif closed or fresh:
            inside, closed = True, False
    return inside


def _quoted_lines(batch: pa.RecordBatch, quote: bytes) -> list[int]:
    return pc.indices_nonzero(pc.match_substring(batch.column("__line"), quote.decode())).to_pylist()


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """The batch cut where another split begins."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in ("__file", "__start", "__length"))))
    begin = 0
    for at in range(1, len(keys) + 1):
        if at == len(keys) or keys[at] != keys[begin]:
            yield keys[begin], batch.slice(begin, at - begin)
            begin = at


def split_states(lines: DataFrame, delimiter: str, quote: str = '"') -> DataFrame:
    """``(__file, __start, __length, inside)``: how each split starts.

    The maps are composed natively: a split keeps, swaps or resets the state. The state behind a split is what the
    last reset left, swapped as often as splits behind it say.
    """
    mark, q = delimiter.encode(), quote.encode()
    arrow = pa.schema([("__file", pa.int64()), ("__start", pa.int64()), ("__length", pa.int64()), ("outside_to", pa.bool_()), ("inside_to", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, int, int], list[bool]] = {}
        for batch in batches:
            for key, part in runs(batch):
                now = states.setdefault(key, [False, True])
                for at in _quoted_lines(part, q):
                    line = part.column("__line")[at].as_py()
                    same = now[0] == now[1]
                    now[0] = inside_after(line, now[0], mark, q)
                    now[1] = now[0] if same else inside_after(line, now[1], mark, q)
        rows = [(*key, *now) for key, now in states.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)

    maps = lines.select("__line", "__file", "__start", "__length").mapInArrow(run, "__file long, __start long, __length long, outside_to boolean, inside_to boolean")
    return started(maps).select("__file", "__start", "__length", "inside")


def started(maps: DataFrame) -> DataFrame:
    """``maps`` with ``inside``, how each split starts, from ``outside_to`` and ``inside_to``: a prefix scan by windows."""
    upto = Window.partitionBy("__file").orderBy("__start")
    odd = (F.sum((F.col("outside_to") & ~F.col("inside_to")).cast("int")).over(upto) % 2 == 1).alias("odd")
    counted = maps.select("*", odd)
    reset = F.when(F.col("outside_to") == F.col("inside_to"), F.col("outside_to") != F.col("odd"))
    after = F.coalesce(F.last(reset, ignorenulls=True).over(upto), F.lit(False)) != F.col("odd")
    behind = counted.withColumn("after", after)
    return behind.withColumn("inside", F.coalesce(F.lag("after").over(upto), F.lit(False))).drop("odd", "after")


def records(lines: DataFrame, states: DataFrame, delimiter: str, quote: str = '"', encoding: str = "utf-8") -> DataFrame:
    """``value`` (one record), ``__file``, ``first`` (of its file), its place ``__start, __at``, and the columns named by folders.

    Blank records are left out. Records of a file are in the order of the split they begin in and their place there.
    """
    told = states.where("inside").select("__file", "__start", "inside")
    size = states.agg(F.max("__length")).first()[0] or 1
    folders = [c for c in lines.columns if c not in ("__line", "__file", "__start", "__length")]
    if told.limit(FEW_SPLITS + 1).count() <= FEW_SPLITS:
        placed = lines.join(F.broadcast(told), ["__file", "__start"], "left")
    else:
        placed = lines.withColumn("__row", F.monotonically_increasing_id()).join(told, ["__file", "__start"], "left")
        placed = placed.repartition("__file", "__start").sortWithinPartitions("__file", "__start", "__row")
    placed = placed.select("__line", "__file", "__start", "__length", F.coalesce("inside", F.lit(False)).alias("inside"), *[F.col(f"`{c}`") for c in folders])
    mark, q = delimiter.encode(), quote.encode()
    kinds = [f for f in placed.schema.fields if f.name in folders]
    schema = ", ".join(["value string, __file long, first boolean, __start long, opens boolean, ends boolean, __at long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds]])

    def text(parts: list[bytes]) -> str:
        whole = b"\n".join(parts)
        if len(whole) > MOST_CHARS:
            raise ValueError(f"a quoted cell is not closed within {MOST_CHARS} bytes")
        return whole.decode(encoding, errors="replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, waiting, opened, before, folder, count = None, False, [], False, True, [], 0

        def row(parts: list[bytes], opens: bool, ends: bool, first: bool) -> tuple:
            nonlocal count
            count += 1
            return text(parts), key[0], first, key[1], opens, ends, count, *folder

        for batch in batches:
            out: list[tuple] = []
            for now, part in runs(batch):
                if now != key:
                    if waiting:
                        out.append(row(waiting, opened, False, before and opened))
                    if now[1] % size or now[2] > size:
                        raise RuntimeError("the files were split anew between two passes; run the scan again")
                    key, inside, waiting, count = now, part.column("inside")[0].as_py(), [], 0
                    # Only the first record of a file's first split is the file's first.
                    opened, before, folder = not inside, now[1] == 0, [part.column(c)[0].as_py() for c in folders]
                values = part.column("__line").to_pylist()
                at = 0
                for place in [*_quoted_lines(part, q), len(values)]:
                    # Lines without quotes change nothing: each is a record, or all belong to the open cell.
                    plain = values[at:place]
                    if inside:
                        waiting += plain
                    else:
                        for line in plain:
                            line = line.removesuffix(b"\r")
                            if line.strip():
                                out.append(row([line], True, True, before))
                                before = False
                    if place < len(values):
                        line, was = values[place], inside
                        inside = inside_after(line, was, mark, q)
                        waiting.append(line)
                        if not inside:
                            waiting[-1] = line.removesuffix(b"\r")
                            out.append(row(waiting, opened, True, before and opened))
                            waiting, opened, before = [], True, False
                    at = place + 1
            if out:
                yield _batch(out)
        if waiting:
            yield _batch([row(waiting, opened, False, before and opened)])

    from pyspark.sql.pandas.types import to_arrow_type

    extra = [(f.name, to_arrow_type(f.dataType)) for f in kinds]
    arrow = pa.schema([("value", pa.string()), ("__file", pa.int64()), ("first", pa.bool_()), ("__start", pa.int64()), ("opens", pa.bool_()), ("ends", pa.bool_()), ("__at", pa.int64()), *extra])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)

    cut = placed.mapInArrow(run, schema)
    kept = ["value", "__file", "first", "__start", "__at", *[f"`{c}`" for c in folders]]
    whole = cut.where("opens AND ends").select(*kept)
    # Fragments: the one that opens, those of splits that lie inside, the one that ends.
    pieces = cut.where("NOT (opens AND ends)")
    number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("__file").orderBy("__start", "opens")).alias("number")
    joined = pieces.select("*", number).groupBy("__file", "number", *[f"`{c}`" for c in folders])
    joined = joined.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__start", "value"))), lambda p: p["value"]), "\n").alias("value"),
        F.max("first").alias("first"),
        F.max_by("__at", F.struct("opens", "__at")).alias("__at"),
        F.min("__start").alias("__start"),
    )
    return whole.unionByName(joined.select(*kept))
