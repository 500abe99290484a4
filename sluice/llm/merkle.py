"""A Merkle manifest of a table: trees of digests in a postorder log, and proofs read from it.

Rows become leaves, ordered within their group; every ``FANOUT`` consecutive nodes get a parent until one is left,
and a last tree joins the groups' roots. Leaves get their numbers without sorting a group in one task: rows are
range-partitioned, numbered within each partition, and shifted by the counts of the partitions before.

Builders take aligned runs of ``FANOUT ** HEIGHT`` nodes, so that each one's part of the tree is whole, and append a
node as soon as its last child is there: the log is in postorder. A node's place then follows from the sizes of the
subtrees that end before it, with no index (``place``). A run's root is a leaf of the next round; the number of
rounds grows with the logarithm of the rows. A log row holds one run's nodes, and proofs are read from it from the
top round down: a run gets the siblings of its own root from the round above, addresses those inside by ``place``,
and hands both to its items. Nothing but the final root passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.llm.common import hold, with_small

FANOUT = 8
HEIGHT = 4  # levels of a builder's run: 4,096 items, about 150 KB of digests
SERIAL = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(digests: list[bytes]) -> bytes:
    """SHA-256 of the hexadecimal digits of some digests."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def place(level: int, index: int, leaves: int) -> int:
    """Where postorder puts a node: behind all nodes that are complete before it.

    The node is complete with its last leaf; ahead of a leaf lie the leaves before it and, on each level, the
    nodes whose subtrees they fill. Nodes on the right edge follow the last leaf.
    """
    last = min((index + 1) * FANOUT**level, leaves) - 1
    size, before = FANOUT, last
    while size <= last:
        before += last // size
        size *= FANOUT
    return before + level


def levels(leaves: int) -> int:
    """Levels above the leaves, up to the one with a single node."""
    count = 0
    while leaves > 1:
        leaves, count = -(-leaves // FANOUT), count + 1
    return count


def log_of(leaves: list[bytes], height: int) -> list[bytes]:
    """All nodes of a tree of ``height`` levels above its leaves, in the order of their completion."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(height + 1)]

    def put(level: int, digest: bytes) -> None:
        log.append(digest)
        waiting[level].append(digest)
        if len(waiting[level]) == FANOUT and level < height:
            close(level)

    def close(level: int) -> None:
        children, waiting[level] = waiting[level], []
        put(level + 1, hashed(children))

    for leaf in leaves:
        put(0, leaf)
    for level in range(height):
        if waiting[level]:
            close(level)
    return log


def siblings(log: list[bytes], index: int, leaves: int, height: int) -> list[tuple[int, list[bytes]]]:
    """From the leaf up: a node's place among its siblings, and their digests."""
    steps, width = [], leaves
    for level in range(height):
        at = index // FANOUT**level
        first = at // FANOUT * FANOUT
        run = range(first, min(first + FANOUT, width))
        steps.append((at - first, [log[place(level, k, leaves)] for k in run if k != at]))
        width = -(-width // FANOUT)
    return steps


def folded(digest: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for at, others in steps:
        digest = hashed([*others[:at], digest, *others[at:]])
    return digest


STEPS = "array<struct<at: int, others: array<binary>>>"
_STEPS = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.binary()))]))


def _steps(rows: list[dict]) -> list[tuple[int, list[bytes]]]:
    return [(s["at"], s["others"]) for s in rows]


def serial(value: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[serial(c) for c in columns.values()]), 256))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Each row with its number ``i`` within the group, from 0, and the group's size ``n``. Nulls come first."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    # Rows alike in all keys are dealt to several partitions: which of them comes first changes nothing.
    salted = rows.withColumn("__salt", F.monotonically_increasing_id() % 1024)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = salted.repartitionByRange(parts, *keys, "__salt").sortWithinPartitions(*keys, "__salt").drop("__salt")
    held = hold(spread.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "merkle-order")
    counts = held.groupBy("__part", group).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    earlier = Window.partitionBy(group).orderBy("__part")
    shifts = counts.select(
        "__part",
        group,
        "__first",
        (F.sum("__n").over(earlier) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy(group)).alias("n"),
    )
    # One row for each group in each partition: at most as many as partitions and groups together.
    keyed = hold(shifts.select(F.struct(F.col("__part").alias("p"), F.col(group).alias("g")).alias("__key"), "__first", "__before", "n"), "merkle-counts")
    joined = with_small(held.withColumn("__key", F.struct(F.col("__part").alias("p"), F.col(group).alias("g"))), keyed, "__key")
    return joined.withColumn("i", F.col("__row") - F.col("__first") + F.col("__before")).drop("__key", "__part", "__row", "__first", "__before")


def _round(items: DataFrame, height: int) -> DataFrame:
    """One round of builders over ``(grp, i, n, digest)``: a log row ``(grp, run, n, nodes, height)`` for each aligned run."""
    size = FANOUT**height
    arrow = pa.schema([("grp", pa.string()), ("run", pa.int64()), ("n", pa.int64()), ("items", pa.int32()), ("height", pa.int32()), ("nodes", pa.list_(pa.binary()))])

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        own, n = rows.column("digest").to_pylist(), rows.column("n")[0].as_py()
        up = height if n > size else levels(n)
        made = {"grp": rows.column("grp")[0].as_py(), "run": rows.column("run")[0].as_py(), "n": n, "items": len(own), "height": up, "nodes": log_of(own, up)}
        return pa.Table.from_pylist([made], schema=arrow)

    runs = items.withColumn("run", F.floor(F.col("i") / F.lit(size)).cast("long"))
    return runs.select("grp", "run", "i", "n", "digest").groupBy("grp", "run").applyInArrow(build, "grp string, run long, n long, items int, height int, nodes array<binary>")


def grow(items: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The log of one tree per group, a table for each round; the last round's rows hold their group's whole top.

    ``items`` has ``grp, i, n, digest``: the group, numbers from 0, their count, the leaf.
    """
    rounds, size = [], FANOUT**height
    while True:
        log = hold(_round(items, height), "merkle-log")
        rounds.append(log)
        # Groups that are one run now are done; the roots of the other runs are the items of the next round.
        items = log.where(F.col("n") > size).select(
            "grp", F.col("run").alias("i"), F.ceil(F.col("n") / F.lit(size)).cast("long").alias("n"), F.element_at("nodes", -1).alias("digest")
        )
        if items.isEmpty():
            return rounds


def tops(rounds: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """``(grp, digest)``: the root of each group's tree."""
    found = [r.where(F.col("n") <= FANOUT**height).select("grp", F.element_at("nodes", -1).alias("digest")) for r in rounds]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def paths(rounds: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The lowest round's log with the steps from each run's root to the very top: ``(grp, run, items, height, nodes, upper)``.

    ``above`` has ``(grp, upper)``: the steps from each group's root.
    """
    size = FANOUT**height
    arrow = pa.schema([("grp", pa.string()), ("run", pa.int64()), ("upper", _STEPS)])

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                rows = []
                for j in range(row["items"]):
                    own = siblings(row["nodes"], j, row["items"], row["height"])
                    rows.append({"grp": row["grp"], "run": row["run"] * size + j, "upper": [*({"at": a, "others": o} for a, o in own), *row["upper"]]})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    upper = None
    for log in reversed(rounds):
        top = with_small(log.where(F.col("n") <= size), above, "grp")
        if upper is not None:
            rest = log.where(F.col("n") > size).alias("l").join(upper.alias("u"), F.expr("l.grp <=> u.grp AND l.run = u.run")).select("l.*", "u.upper")
            top = top.union(rest)
        if log is rounds[0]:
            return top
        upper = hold(top.mapInArrow(hand_down, f"grp string, run long, upper {STEPS}"), "merkle-paths")
    raise ValueError("a tree has at least one round")


def manifest(docs: DataFrame, group: str = "lang", doc_id: str = "doc_id", columns: tuple[str, ...] = SERIAL, suspect: DataFrame | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, steps, folded_root``, digests in lowercase hex.

    A leaf is the SHA-256 of the row's ``columns``, written so that nulls and borders are told apart. Within a group
    leaves ascend by id, nulls first, then by leaf; groups ascend by name, null first, bytewise. ``steps`` are the siblings
    from the leaf to the root. ``suspect`` has the rows of ``docs`` as they are now, with the leaf on record in
    ``recorded_leaf``; by default nothing has changed. Its rows are folded with the recorded siblings: ``folded_root`` is
    the root only if the row is as it was. Texts of any length are hashed whole; repeated rows get a leaf each; other
    columns play no part; an empty table gives an empty result.
    """
    now = suspect if suspect is not None else docs.withColumn("recorded_leaf", leaf({c: F.col(c) for c in columns}))
    slim = now.select(
        F.col(doc_id).cast("long").alias("id"),
        F.col(group).cast("string").alias("grp"),
        F.col("recorded_leaf").alias("digest"),
        leaf({c: F.col(c) for c in columns}).alias("now"),
    )
    rows = numbered(hold(slim, "merkle-leaves"), "grp", ["id", "digest"])
    rounds = grow(rows.select("grp", "i", "n", "digest"), height)
    subroots = hold(tops(rounds, height), "merkle-subroots")
    # The tree over the groups: the same work with one group, whose leaves are the groups' roots.
    joined = numbered(subroots.select(F.lit("").alias("all"), "grp", "digest"), "all", ["grp"]).withColumnRenamed("grp", "name")
    joined = hold(joined.select(F.col("all").alias("grp"), "name", "i", "n", "digest"), "merkle-groups")
    last = grow(joined.select("grp", "i", "n", "digest"), height)
    top = tops(last, height).first()
    root = top.digest if top else b""
    ends = joined.select("grp").distinct().select("grp", F.array().cast(STEPS).alias("upper"))
    sub = _with_paths(paths(last, ends, height), joined.select("grp", "i", F.struct("name", F.col("digest").alias("now")).alias("own")), height, "struct<name: string, now: binary>")
    above = hold(sub.select(F.col("own.name").alias("grp"), F.struct(F.col("own.now").alias("subroot"), F.col("steps").alias("upper")).alias("top")), "merkle-tops")
    low = with_small(paths(rounds, above.select("grp", "top.upper"), height), above.select("grp", "top.subroot"), "grp")
    proven = _with_paths(low, rows.select("grp", "i", F.struct("id", "digest", "now").alias("own")), height, "struct<id: bigint, digest: binary, now: binary>")
    text = lambda c: F.lower(F.hex(c))
    return proven.select(
        F.col("own.id").alias("doc_id"),
        text(F.col("own.digest")).alias("leaf"),
        text(F.col("subroot")).alias("subroot"),
        F.lit(root.hex()).alias("root"),
        "steps",
        text(F.col("folded")).alias("folded_root"),
    )


def _with_paths(log: DataFrame, rows: DataFrame, height: int, own: str) -> DataFrame:
    """``(grp, own, steps, folded, subroot)``: each item's steps to the top, by its run's log, and the root they give with what it is now."""
    size = FANOUT**height
    schema = f"grp string, own {own}, steps {STEPS}, folded binary, subroot binary"

    def read(items: pa.Table, runs: pa.Table) -> pa.Table:
        run = runs.to_pylist()[0]
        owns, out, folds = items.column("own"), [], []
        for index, value in zip(items.column("i").to_pylist(), owns.to_pylist()):
            steps = [*siblings(run["nodes"], index % size, run["items"], run["height"]), *_steps(run["upper"])]
            out.append([{"at": a, "others": o} for a, o in steps])
            folds.append(folded(value["now"], steps))
        under = pa.array([run.get("subroot")] * len(folds), pa.binary())
        return pa.table({"grp": items.column("grp"), "own": owns, "steps": pa.array(out, _STEPS), "folded": pa.array(folds, pa.binary()), "subroot": under})

    placed = rows.withColumn("run", F.floor(F.col("i") / F.lit(size)).cast("long"))
    return placed.groupBy("grp", "run").cogroup(log.groupBy("grp", "run")).applyInArrow(read, schema)
