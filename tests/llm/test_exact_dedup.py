import hashlib
import re
from collections import Counter, defaultdict

import pytest

from sluice.llm.exact_dedup import DigestIndex, exact_dedup
from sluice.llm.queries import op7_exact_dedup
from sluice.session import scratch_dir

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()


def expected(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row, and how many rows of a group stay: one."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[sha(text)].append((doc_id, text or ""))
    out = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(doc_id, keep, len(members), key) for doc_id, _ in members]
    return Counter(out)


def check(found, rows):
    found = found.collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected(rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert kept == Counter(set(r.text_sha256 for r in found))
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_query_against_brute_force(spark, table):
    check(op7_exact_dedup(spark, SF), [(r.doc_id, r.text) for r in table("documents").collect()])


def test_odd_rows(spark, odd):
    index = DigestIndex(spark, scratch_dir(spark, "test-index"), buckets=3)
    check(index.verdicts(odd), [(r.doc_id, r.text) for r in odd.collect()])


def test_rows_that_stay_keep_their_columns(odd):
    stay = exact_dedup(odd)
    assert stay.columns == odd.columns
    rows = stay.collect()
    assert len(rows) == len({sha(r.text) for r in odd.collect()}) == len({sha(r.text) for r in rows})
    assert {r.kept for r in rows} == {"own"} == {r.digest for r in rows}


def test_empty_table(spark, nothing):
    assert exact_dedup(nothing).count() == 0
    assert DigestIndex(spark, scratch_dir(spark, "test-index")).verdicts(nothing).count() == 0


def test_later_batches_yield_to_earlier_ones(spark):
    path = scratch_dir(spark, "test-index")
    first = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id bigint, text string")
    second = spark.createDataFrame([(1, "a  b longer?"), (2, "ab"), (3, "a\nb")], "doc_id bigint, text string")
    assert {r.doc_id for r in DigestIndex(spark, path, 4).verdicts(first).collect() if r.kept} == {5, 6}
    again = DigestIndex(spark, path)  # as another session opens it
    assert again.buckets == 4
    found = {r.doc_id: r for r in again.verdicts(second).collect()}
    assert [found[i].kept for i in (1, 2, 3)] == [True, False, False]
    assert [found[i].keep_id for i in (1, 2, 3)] == [1, 5, 5]
    assert again.rows().count() == 3
    with pytest.raises(ValueError):
        DigestIndex(spark, path, 5)


def test_a_batch_that_runs_again_gets_its_verdicts_again(spark, monkeypatch):
    """A caller that fails after its batch was added runs it again, by its name."""
    path = scratch_dir(spark, "test-index")
    early = spark.createDataFrame([(9, "old")], "doc_id bigint, text string")
    DigestIndex(spark, path, 3).verdicts(early, batch="b0").count()
    batch = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (3, "c"), (4, "o l d"), (None, None)], "doc_id bigint, text string")
    first = [r for r in DigestIndex(spark, path).verdicts(batch, batch="b1").collect()]

    class Crash(Exception):
        pass

    append = DigestIndex._append
    monkeypatch.setattr(DigestIndex, "_append", lambda self, new: (append(self, new), (_ for _ in ()).throw(Crash))[1])
    more = batch.unionByName(spark.createDataFrame([(7, "new")], "doc_id bigint, text string"))
    with pytest.raises(Crash):
        DigestIndex(spark, path).verdicts(more.where("doc_id = 7"), batch="b2")
    monkeypatch.setattr(DigestIndex, "_append", append)
    for name, rows, want in (("b1", batch, first), ("b2", more.where("doc_id = 7"), None)):
        index = DigestIndex(spark, path)
        again = index.verdicts(rows.repartition(3), batch=name).collect()
        if want:
            assert Counter(map(tuple, again)) == Counter(map(tuple, want)) and sum(r.kept for r in again) == 3
        else:
            assert [(r.doc_id, r.kept) for r in again] == [(7, True)]
        assert {r.doc_id: r.kept for r in exact_dedup_verdicts(index, rows, name)} == {r.doc_id: True for r in again if r.kept}
    assert not any(r.kept for r in DigestIndex(spark, path).verdicts(batch).collect())  # a batch without a name is another
    index.close()
    assert DigestIndex(spark, path).rows().count() == 5


def exact_dedup_verdicts(index, rows, batch):
    return exact_dedup(rows, index=index, batch=batch).selectExpr("doc_id", "true AS kept").collect()


def test_lookup_does_not_shuffle_the_index(spark):
    index = DigestIndex(spark, scratch_dir(spark, "test-index"), buckets=4)
    index.verdicts(spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id bigint, text string"))
    new = spark.createDataFrame([(bytes([i]) * 32,) for i in range(9)], "digest binary").repartition(4, "digest")
    plan = new.hint("merge").join(index.rows().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
