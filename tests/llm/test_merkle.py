"""Trees, proofs and tampering against a brute-force version that builds whole trees level by level."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.llm import merkle
from sluice.llm.queries import op12_merkle_manifest

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def serial(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves):
    """All levels, from the leaves to the root."""
    found = [list(leaves)]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i : i + 8])) for i in range(0, len(found[-1]), 8)])
    return found


def path(found, index):
    """(place, siblings) on each level below the root."""
    out = []
    for nodes in found[:-1]:
        first = index // 8 * 8
        run = nodes[first : first + 8]
        out.append((index - first, run[: index - first] + run[index - first + 1 :]))
        index //= 8
    return out


def fold(digest, steps):
    for at, others in steps:
        digest = sha("".join([*others[:at], digest, *others[at:]]))
    return digest


def brute_force(rows, changed):
    """Result rows for (doc_id, source, lang, n_chars, text); ``changed`` tells whose capitals are lowered."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    key = lambda r: (r[0] is not None, r[0] or 0, sha(serial(*r)))
    trees = {g: tree([sha(serial(*r)) for r in sorted(groups[g], key=key)]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(sorted(groups[g], key=key)):
            steps = path(trees[g], i) + path(top, k)
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None and changed(r[0]) else r[4]
            end = fold(sha(serial(*r[:4], text)), steps)
            out.append((r[0], sha(serial(*r)), trees[g][-1][0], top[-1][0], sha("".join("".join(o) for _, o in steps)), end, end == top[-1][0]))
    return Counter(out)


def third(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def columns(df):
    digests = F.transform(F.flatten(F.col("steps.others")), lambda d: F.lower(F.hex(d)))
    proof = F.sha2(F.concat_ws("", digests), 256)
    rows = df.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", F.col("folded_root") == F.col("root"))
    return Counter(map(tuple, rows.collect()))


def test_query_against_brute_force(spark, table):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in table("documents").collect()]
    found = op12_merkle_manifest(spark, SF)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = Counter(map(tuple, found.collect()))
    assert found == brute_force(rows, third)
    assert 0 < sum(not r[-1] for r in found) < len(rows) / 2


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert columns(merkle.manifest(odd)) == brute_force(rows, lambda _: False)
    by_source = [(d, s, s, n, t) for d, s, _, n, t in rows]
    assert columns(merkle.manifest(odd.withColumn("lang", F.col("source")))) == brute_force(by_source, lambda _: False)
    assert merkle.manifest(nothing).count() == 0


@pytest.mark.parametrize("height", [1, 2])
def test_several_rounds(spark, height):
    """Groups of 1, 8, 9, 64, 65 and 700 rows with low runs, many equal rows, and 70 groups more."""
    rng = random.Random(height)
    sizes = {"a": 1, None: 8, "b": 9, "é": 64, "Z": 65, "": 700, **{f"g{i}": 2 for i in range(70)}}
    rows = [(rng.choice([i, i, 5, None]), "s", g, 1, "Same" if i % 3 else f"text {i}") for g, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(6)
    assert columns(merkle.manifest(docs, height=height)) == brute_force(rows, lambda _: False)


def test_places_are_those_of_the_log():
    for leaves in (*range(1, 75), 511, 512, 513, 1000):
        digests = [bytes([i % 251, i // 251]) for i in range(leaves)]
        height = merkle.levels(leaves)
        log = merkle.log_of(digests, height)
        found = tree([d.hex() for d in digests])
        assert len(log) == sum(map(len, found)) and len(found) == height + 1
        for level, nodes in enumerate(found):
            for k, node in enumerate(nodes):
                assert log[merkle.place(level, k, leaves)].hex() == node
