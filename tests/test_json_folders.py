"""Folders whose JSON files have different layouts."""

import json

import pytest

from sluice.sources import files

LINES = [{"z": 1, "a": "x", "n": None, "s": {"k": 1}}, {"z": 2, "a": "y"}, {"z": 3}]
ARRAY = [{"z": i + 0.5, "n": i, "b": True, "s": {"m": "2024-01-01"}} for i in range(5)]


@pytest.mark.parametrize("names", [("1.json", "2.json", "3.json"), ("3.json", "1.json", "2.json")])
def test_mixed_layouts(spark, tmp_path, names):
    lines, array, single = (tmp_path / n for n in names)
    lines.write_text("\n" + "\n".join(map(json.dumps, LINES)) + "\n")
    array.write_text(json.dumps(ARRAY))
    single.write_text(json.dumps({"z": 9, "a": 7}, indent=2))
    df = files.scan_json(spark, str(tmp_path))
    assert df.columns[:2] == ["z", "a"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    assert kinds == {"z": "double", "a": "string", "n": "bigint", "b": "boolean", "s": "struct<k:bigint,m:date>"}
    rows = df.collect()
    assert sorted(r.z for r in rows) == [0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4.5, 9]
    assert sorted(r.a for r in rows if r.a) == ["7", "x", "y"] and sorted(r.n for r in rows if r.n is not None) == [0, 1, 2, 3, 4]
    assert files.scan_json(spark, str(tmp_path), schema="z double").count() == 9


def test_folders_that_name_columns(spark, tmp_path):
    for day, text in ((1, "[" + '{"a": 1}, {"a": 2}' + "]"), (2, '{"a": 3}\n')):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "x.json").write_text(text)
    assert sorted((r.a, r.day) for r in files.scan_json(spark, str(tmp_path)).collect()) == [(1, 1), (2, 1), (3, 2)]
