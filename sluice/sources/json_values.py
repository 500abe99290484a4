"""JSON objects of any layout, found in parallel by nesting depth.

The text is read in pieces that end with ``}``, wherever lines break, so one long array is many pieces in many
splits. A split maps (inside a string or not, depth) to the same behind it; a prefix scan over the splits of a file
tells each how it starts. A record is an object at the lowest level, or an element of an array there; it ends with
the piece behind which the depth is back. Records become lines of text in the shared folder, in their order, and are
read from there like any other lines.

A file whose every piece is a whole object without objects or arrays in it needs no depth: each piece is a record,
and Spark's own expressions cut them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sluice.functions.names import quoted
from sluice.session import scratch_dir
from sluice.sources.records import runs, started

_STRING = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_REST = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
BETWEEN = b" \t\r\n,[]\xef\xbb\xbf"  # white space, commas, array brackets and a byte order mark
LEAD = " \t\r\n,[]\ufeff"  # the same as text
# An object but for its closing brace, no other around or in it.
FLAT = r'(?s)^\{[^"{\[\]]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"{\[\]]*+)*+\z'
STATES = "__file long, __start long, __length long, outside_to boolean, inside_to boolean, outside_depth long, inside_depth long, bytes long"


def pieces_of(spark: SparkSession, paths: str | list[str], base: str | None = None) -> DataFrame:
    """``__line`` (binary, without its closing brace), ``__file``, ``__start``, ``__length``, ``__size``, and columns named by folders."""
    reader = spark.read.option("lineSep", "}")
    raw = (reader.option("basePath", base) if base else reader).text(paths)
    meta = {"__start": "file_block_start", "__length": "file_block_length", "__size": "file_size"}
    place = [F.xxhash64("_metadata.file_path").alias("__file"), *[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()]]
    return raw.select(F.col("value").cast("binary").alias("__line"), *place, *[F.col(quoted(c)) for c in raw.columns[1:]])


def on_lines(piece: Column) -> Column:
    """Whether a piece behind a file's first agrees with one object on each line: line breaks come between objects only, and always there."""
    after_break = piece.rlike(r"^[ \t\r]*\n\s*(?:\{[^\n]*)?$")
    return F.when(F.contains(piece, F.lit("\n")), after_break).otherwise(~F.startswith(F.ltrim(piece, F.lit(" \t")), F.lit("{")))


def is_flat(piece: Column, body: Column) -> Column:
    """Whether a piece is an object without others in it, all its strings closed, or only stands behind or between objects.

    ``body`` is the piece without what stands before an object.
    """
    return F.is_valid_utf8(piece) & ((body == "") | body.rlike(FLAT))


def layouts(raw: DataFrame) -> DataFrame:
    """``file, array, lines, flat, objects`` for each file of a text read in pieces that end with ``}``.

    ``array``: its first value is an array; ``lines``: it has one object on each line; ``flat``: each piece that a brace ends is an
    object, what is left behind the last one is none, and brackets match; ``objects``: how many pieces are objects.
    """
    piece, block = F.col("value"), F.col("block")
    told = raw.select("value", *[F.col(f"_metadata.{m}").alias(c) for c, m in {"file": "file_path", "block": "file_block_start", "size": "file_size"}.items()])
    told = told.withColumn("body", F.ltrim(piece, F.lit(LEAD)))
    body, lead = F.col("body"), F.substring_index(piece, "{", 1)
    count = lambda mark: F.length(lead) - F.length(F.replace(lead, F.lit(mark), F.lit("")))
    start = F.ltrim(piece, F.lit("\ufeff \t\n\x0b\f\r"))
    bits = {
        1: F.startswith(start, F.lit("[")),  # of the first piece
        2: F.startswith(start, F.lit("{")) & piece.rlike(r"^\ufeff?\s*\{[^\n]*$"),
        4: F.col("inner"),
        8: F.col("opened"),  # of the last piece
    }
    # Numbers only, so that the aggregate hashes: what the first and the last piece tell goes behind their place.
    flags = [F.when(flag if bit > 2 else (block == 0) & flag, F.lit(bit)).otherwise(F.lit(0)) for bit, flag in bits.items()]
    judged = told.select("*", on_lines(piece).alias("inner"), F.startswith(body, F.lit("{")).alias("opened"), is_flat(piece, body).alias("flat"))
    judged = judged.select("*", (F.monotonically_increasing_id() * 16 + sum(flags[1:], flags[0])).alias("mark"))
    blank = F.contains(piece, F.lit("\n")) & piece.rlike(r"^\s*\n\s*$")
    splits = judged.groupBy("file", "block", "size").agg(
        F.min("mark").alias("first"),
        F.max("mark").alias("last"),
        F.count_if(~F.col("inner")).alias("misfits"),
        F.count_if(blank).alias("blanks"),
        F.count_if(~F.col("flat")).alias("bent"),
        F.count_if("opened").alias("objects"),
        F.count_if(~F.col("opened")).alias("others"),
        F.sum(count("[") - count("]")).alias("depth"),
        F.sum(F.octet_length(piece) + 1).alias("bytes"),
    )
    sums = [F.sum(c).alias(c) for c in ("misfits", "blanks", "bent", "objects", "others", "depth", "bytes")]
    found = splits.groupBy("file", "size").agg(F.min_by("first", "block").alias("first"), F.max_by("last", "block").alias("last"), *sums)
    has = lambda mark, bit: F.col(mark).bitwiseAND(F.lit(bit)) != 0
    lines = has("first", 2) & (F.col("misfits") == F.when(has("first", 4), F.lit(0)).otherwise(F.lit(1))) & (F.col("blanks") <= 1)
    # Behind a last brace nothing is left; else the last piece has none and counts one byte more. The reader skips the three bytes of a mark.
    beyond = F.col("bytes") - F.col("size")
    whole = (beyond.isin(0, -3) & (F.col("others") == 0)) | (beyond.isin(1, -2) & (F.col("others") == 1) & ~has("last", 8))
    flat = (F.col("bent") == 0) & (F.col("depth") == 0) & whole
    return found.select("file", has("first", 1).alias("array"), lines.alias("lines"), flat.alias("flat"), "objects")


def flat_lines(spark: SparkSession, paths: list[str], base: str | None = None) -> str:
    """Writes the objects of flat files as lines, each task those of its splits; returns the folder."""
    reader = spark.read.option("lineSep", "}")
    raw = (reader.option("basePath", base) if base else reader).text(paths)
    folders = raw.columns[1:]
    body = F.ltrim("value", F.lit(LEAD))
    breaks = F.contains(body, F.lit("\n")) | F.contains(body, F.lit("\r"))
    line = F.concat(F.when(breaks, F.translate(body, "\r\n", "  ")).otherwise(body), F.lit("}"))
    lines = raw.where(F.startswith(body, F.lit("{"))).select(line.alias("value"), *[F.col(quoted(c)) for c in folders])
    out = scratch_dir(spark, "json-lines")
    lines.write.partitionBy(*folders).option("compression", "lz4").text(out)
    return out


def after(piece: bytes, inside: bool) -> tuple[bool, int]:
    """Whether a string is open behind a piece and its brace, and how much deeper it is there."""
    if inside:
        rest = _REST.match(piece)
        if rest is None:
            return True, 0
        piece = piece[rest.end() :]
    if b'"' in piece:
        piece = _STRING.sub(b"", piece)
        cut = piece.find(b'"')
        if cut >= 0:
            return True, _depth(piece[:cut])
    return False, _depth(piece) - 1


def _depth(text: bytes) -> int:
    return text.count(b"{") + text.count(b"[") - text.count(b"]")


def split_states(pieces: DataFrame) -> DataFrame:
    """``(__file, __start, __length, inside, depth)``: how each split starts; ``end`` is the depth behind the whole file."""
    arrow = pa.schema([(c, pa.int64()) for c in ("__file", "__start", "__length")] + [("outside_to", pa.bool_()), ("inside_to", pa.bool_())] + [(c, pa.int64()) for c in ("outside_depth", "inside_depth", "bytes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            for key, part in runs(batch):
                now = states.setdefault(key, [False, True, 0, 0, 0])
                for piece in part.column("__line").to_pylist():
                    now[4] += len(piece) + 1
                    (one, one_more), two = after(piece, now[0]), None
                    if now[0] != now[1]:
                        two = after(piece, now[1])
                    now[0], now[1] = one, one if two is None else two[0]
                    now[2] += one_more
                    now[3] += one_more if two is None else two[1]
        rows = [(*key, *now) for key, now in states.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)

    maps = started(pieces.select("__line", "__file", "__start", "__length").mapInArrow(run, STATES))
    upto = Window.partitionBy("__file").orderBy("__start")
    own = F.when(F.col("inside"), F.col("inside_depth")).otherwise(F.col("outside_depth"))
    whole = Window.partitionBy("__file")
    return maps.select(
        "__file", "__start", "__length", "inside", (F.sum(own).over(upto) - own).alias("depth"), F.sum(own).over(whole).alias("end"), F.sum("bytes").over(whole).alias("bytes")
    )


def check_ends(states: DataFrame, sizes: DataFrame) -> None:
    """Files that end inside a value are an error. ``sizes`` has ``__file, path, size``."""
    # A last piece without a brace counts one byte, and one level down, too many; the reader skips the three bytes of a mark.
    missing = F.when((F.col("bytes") - F.col("size")).isin(1, -2), F.lit(1)).otherwise(F.lit(0))
    ends = states.groupBy("__file").agg(F.max("end").alias("end"), F.max("bytes").alias("bytes"))
    bad = ends.join(sizes, "__file").where(F.col("end") + missing != 0).select("path").first()
    if bad:
        raise ValueError(f"{bad.path} ends inside a JSON value")


def object_lines(pieces: DataFrame, states: DataFrame, arrays: DataFrame) -> DataFrame:
    """``value`` (an object on one line), ``__rank``, ``__start``, ``late`` (pieced together) and columns named by folders.

    ``arrays`` has ``__file, __rank, base``: the file's place among all, and 1 if its first value is an array.
    """
    folders = [c for c in pieces.columns if not c.startswith("__")]
    size = states.agg(F.max("__length")).first()[0] or 1
    told = states.select("__file", "__start", "inside", "depth").join(F.broadcast(arrays), "__file")
    placed = pieces.join(F.broadcast(told), ["__file", "__start"])
    placed = placed.select("__line", "__file", "__start", "__length", "inside", "depth", "base", "__rank", *[F.col(quoted(c)) for c in folders])
    kinds = [f for f in placed.schema.fields if f.name in folders]
    schema = ", ".join(["value string, __rank long, __start long, opens boolean, ends boolean", *[f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kinds]])

    from pyspark.sql.pandas.types import to_arrow_type

    head = [("value", pa.string()), ("__rank", pa.int64()), ("__start", pa.int64()), ("opens", pa.bool_()), ("ends", pa.bool_())]
    arrow = pa.schema([*head, *[(f.name, to_arrow_type(f.dataType)) for f in kinds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, waiting, opened, inside, depth, floor, place = None, [], [], False, False, 0, 0, ()

        def put(ends: bool) -> None:
            text = b"}".join(waiting) + (b"}" if ends else b"")
            text = text.replace(b"\r", b" ").replace(b"\n", b" ").decode()
            out.append((text, place[0], key[1], opened, ends, *place[1:]))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

        for batch in batches:
            out = []
            for now, part in runs(batch):
                if now != key:
                    if waiting:
                        put(False)
                    if now[1] % size or now[2] > size:
                        raise RuntimeError("the files were split anew between two passes; run the scan again")
                    key, waiting, opened = now, [], False
                    inside, depth, floor = (part.column(c)[0].as_py() for c in ("inside", "depth", "base"))
                    place = tuple(part.column(c)[0].as_py() for c in ("__rank", *folders))
                    going = inside or depth > floor
                for piece in part.column("__line").to_pylist():
                    if not going:
                        body = piece.lstrip(BETWEEN)
                        lead = piece[: len(piece) - len(body)]
                        depth += lead.count(b"[") - lead.count(b"]")
                        if not body:
                            continue
                        if not body.startswith(b"{"):
                            raise ValueError(f"neither objects nor arrays of objects: {body[:40]!r}")
                        piece, opened, going, floor = body, True, True, depth
                    inside, more = after(piece, inside)
                    depth += more
                    waiting.append(piece)
                    if not inside and depth <= floor:
                        put(True)
                        waiting, opened, going = [], False, False
            if out:
                yield batch_of()
        if waiting:
            out = []
            put(False)
            yield batch_of()

    cut = placed.mapInArrow(run, schema)
    kept = ["value", "__rank", "__start", "late", *[quoted(c) for c in folders]]
    whole = cut.where("opens AND ends").withColumn("late", F.lit(0)).select(*kept)
    fragments = cut.where("NOT (opens AND ends)")
    number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("__rank").orderBy("__start", "opens")).alias("number")
    joined = fragments.select("*", number).groupBy("__rank", "number", *[quoted(c) for c in folders])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__start", "value"))), lambda p: p["value"]), "}")
    joined = joined.agg(text.alias("value"), F.min("__start").alias("__start")).withColumn("late", F.lit(1))
    return whole.unionByName(joined.select(*kept))


def as_lines(spark: SparkSession, files: list[tuple[str, str, bool]], base: str | None = None) -> str:
    """Writes the objects of some files as lines, in order; returns a pattern of folders to read them from.

    ``files`` has (path to read, path as it is, whether the first value is an array), sorted.
    """
    pieces = pieces_of(spark, [f[0] for f in files], base)
    path = scratch_dir(spark, "json-states")
    split_states(pieces).write.parquet(path)
    states = spark.read.parquet(path)
    named = spark.createDataFrame([(f[1], at, int(f[2])) for at, f in enumerate(files)], "path string, __rank long, base int").withColumn("__file", F.xxhash64("path"))
    known = pieces.select("__file", "__size").groupBy("__file").agg(F.max("__size").alias("size"))
    check_ends(states, known.join(named.select("__file", "path"), "__file"))
    lines = object_lines(pieces, states, named.select("__file", "__rank", "base"))
    # One folder for each split, and one for the record that goes on behind it: their names keep the order.
    place = F.format_string("%09d-%020d-%d", "__rank", "__start", "late").alias("__place")
    folders = [c for c in lines.columns if c not in ("value", "__rank", "__start", "late")]
    out = scratch_dir(spark, "json-lines")
    lines.select("value", place, *[F.col(quoted(c)) for c in folders]).write.partitionBy("__place", *folders).option("compression", "gzip").text(out)
    return f"{out}/__place=*"
