"""Files that queries write before they scan them: no task takes a fixed share of the table."""

import glob
import json

import pytest

from sluice.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture
def written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch_dir", lambda session, purpose: str(tmp_path / purpose))
    return lambda: [open(f, "rb").read() for f in glob.glob(f"{tmp_path}/*/part-*")]


@pytest.mark.parametrize("name, table, keys, most", [("scan_json_array", "lineitem", ("l_orderkey", "l_linenumber"), 1000), ("scan_json_mixed", "events", ("event_id",), 100)])
def test_arrays_grow_in_number(spark, written, monkeypatch, name, table, keys, most):
    monkeypatch.setattr(queries, "ARRAY_ROWS", most, raising=False)
    found = queries.QUERIES[name](spark, SF)
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    assert sorted(found.select(*keys).collect()) == sorted(rows.select(*keys).collect())
    arrays = [a.count(b'"event_id"') or a.count(b'"l_orderkey"') for f in written() if f.startswith(b"[") for a in f.split(b"[{")[1:]]
    assert len(arrays) > 1
    assert max(arrays) < 2 * most


@pytest.mark.parametrize("name", ["scan_csv_breaks", "scan_json_concatenated"])
def test_files_grow_in_number(spark, written, monkeypatch, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(queries, "read", lambda session, sf_dir, table: docs.repartition(9))
    found = queries.QUERIES[name](spark, SF)
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert len(written()) == 5


def test_each_task_closes_its_arrays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "ARRAY_ROWS", 8)
    for at, rows in enumerate((20, 1, 16, 0)):
        spark.range(100 * at, 100 * at + rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    found = spark.read.parquet(f"{tmp_path}/in")
    queries._write_arrays(found, f"{tmp_path}/out")
    arrays = [json.loads(a + "]") for f in glob.glob(f"{tmp_path}/out/part-*") for a in open(f).read().split("]")[:-1]]
    assert sorted(r["id"] for a in arrays for r in a) == [*range(20), 100, *range(200, 216)]
    assert max(map(len, arrays)) <= 8
