"""JSON objects by nesting depth: arrays, indented and concatenated objects, split anywhere."""

import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from sluice.sources import files, json_values


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in before.items():
        spark.conf.set(key, value) if value else spark.conf.unset(key)


def odd_objects(n, seed):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(['a', "é", "{", "}", "[", "]", '"', "\\", "\n", ",", " ", '}{"']) for _ in range(rng.randrange(k)))
    return [{"id": i, "t": text(30 if i % 10 else 900), "n": {"a": [1, {"b": text(8)}], "e": {}}, "l": [[], [i]]} for i in range(n)]


@pytest.mark.parametrize(
    "layout",
    [
        lambda rows: json.dumps(rows),
        lambda rows: json.dumps(rows, indent=2),
        lambda rows: "\n".join(json.dumps(r, indent=1) for r in rows),
        lambda rows: " ".join(map(json.dumps, rows)),
        lambda rows: "".join(map(json.dumps, rows)) + "\n\n",
        lambda rows: "﻿\n[\n" + ",\n".join(map(json.dumps, rows)) + "\n]\n",
        lambda rows: json.dumps(rows[:40]) + "\n" + json.dumps(rows[40:]),
        lambda rows: "\n".join(map(json.dumps, rows)),
    ],
    ids=["array", "indented array", "indented objects", "on one line", "without gaps", "lines in brackets", "two arrays", "lines"],
)
def test_layouts_across_splits(spark, tmp_path, small_splits, layout):
    rows = odd_objects(60, 4)
    (tmp_path / "x.json").write_text(layout(rows), encoding="utf-8")
    df = files.scan_json(spark, str(tmp_path), sniff=False)
    got = sorted(((r.id, r.t, r.n.a[1] if isinstance(r.n.a[1], str) else None, r.l[1][0]) for r in df.collect()))
    assert [(i, t, k) for i, t, _, k in got] == [(r["id"], r["t"], r["l"][1][0]) for r in rows]
    assert json_values.pieces_of(spark, str(tmp_path)).select("__start").distinct().count() > 5


def test_order_is_that_of_the_file(spark, tmp_path, small_splits):
    rows = [{"id": i, "t": "x" * (i * 37 % 300)} for i in range(80)]
    (tmp_path / "b.json").write_text(json.dumps(rows[40:]))
    (tmp_path / "a.json").write_text(json.dumps(rows[:40], indent=3))
    folder = json_values.as_lines(spark, [(f"{tmp_path}/a.json", f"file:{tmp_path}/a.json", True), (f"{tmp_path}/b.json", f"file:{tmp_path}/b.json", True)])
    import glob
    import gzip

    lines = [line for name in sorted(glob.glob(f"{folder.removeprefix('file:')}/part-*")) for line in gzip.open(name, "rt")]
    assert [json.loads(line)["id"] for line in lines] == list(range(80))


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '{\n"a": 1}\n{"a": "x}', '[{"a": {"b": 1}]', '{"a":\n 1}}'])
def test_text_that_ends_inside_a_value(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):
        files.scan_json(spark, str(tmp_path)).collect()


def test_values_that_are_no_objects(spark, tmp_path):
    (tmp_path / "x.json").write_text("[1, 2,\n 3, {}]")
    with pytest.raises(Exception, match="neither objects"):
        files.scan_json(spark, str(tmp_path)).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.recursive(st.text('a"\\{}[]', max_size=5), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text('b"}', max_size=3), v, max_size=3), max_leaves=6), max_size=4))
def test_depths_of_pieces(values):
    text = json.dumps({"v": values}).encode()
    inside, depth, ends = False, 0, []
    for piece in text.split(b"}")[:-1]:
        inside, more = json_values.after(piece, inside)
        depth += more
        ends.append(not inside and depth == 0)
    assert ends[-1] and not any(ends[:-1])


FLAT_TEXTS = ["a", "é", "{", "[", "]", '"', "\\", "\n", ",", " ", ',{"', "]["]


def flat_objects(n, seed):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(FLAT_TEXTS) for _ in range(rng.randrange(k)))
    return [{"id": i, "t": text(30), **({"v": i / 4} if i % 3 else {})} for i in range(n)]


@pytest.mark.parametrize(
    "layout",
    [
        lambda rows: json.dumps(rows),
        lambda rows: json.dumps(rows, indent=2, ensure_ascii=False),
        lambda rows: " ".join(map(json.dumps, rows)),
        lambda rows: "\ufeff[" + ",\r\n".join(map(json.dumps, rows)) + "]\n",
        lambda rows: json.dumps(rows[:40]) + " " + json.dumps(rows[40:]),
        lambda rows: "\n".join(json.dumps(r, indent=1) for r in rows),
    ],
    ids=["array", "indented array", "on one line", "lines in brackets", "two arrays", "indented objects"],
)
def test_flat_objects_need_no_depth(spark, tmp_path, small_splits, monkeypatch, layout):
    monkeypatch.setattr(files, "as_lines", None)
    rows = flat_objects(90, 3)
    (tmp_path / "x.json").write_text(layout(rows), encoding="utf-8")
    df = files.scan_json(spark, str(tmp_path), sniff=False)
    assert sorted((r.id, r.t, r.v) for r in df.collect()) == [(r["id"], r["t"], r.get("v")) for r in rows]
    assert sorted(r.id for r in files.scan_json(spark, str(tmp_path), schema="id long").collect()) == list(range(90))


def test_flat_files_next_to_others(spark, tmp_path, small_splits, monkeypatch):
    taken = []
    monkeypatch.setattr(files, "as_lines", lambda session, found, base: taken.extend(f[0][-6:] for f in found) or json_values.as_lines(session, found, base))
    for name, rows in (("a.json", [{"id": 1, "t": "x"}, {"id": 2}]), ("b.json", [{"id": 3, "t": "},{"}, {"id": 4}]), ("c.json", [{"id": 5, "n": {"k": 1}}])):
        (tmp_path / name).write_text(json.dumps(rows))
    (tmp_path / "d.json").write_text('{"id": 6}\n{"id": 7, "t": "{"}\n')
    got = sorted((r.id, r.t, r.n and r.n.k) for r in files.scan_json(spark, str(tmp_path)).collect())
    assert got == [(1, "x", None), (2, None, None), (3, "},{", None), (4, None, None), (5, None, 1), (6, None, None), (7, "{", None)]
    assert sorted(taken) == ["b.json", "c.json"]


def test_flat_files_in_folders(spark, tmp_path, small_splits):
    for day in (1, 2):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "x.json").write_text(json.dumps([{"a": 10 * i + day} for i in range(100)]))
    df = files.scan_json(spark, str(tmp_path))
    assert sorted((r.a, r.day) for r in df.collect()) == [(10 * i + day, day) for i in range(100) for day in (1, 2)]


@pytest.mark.parametrize(
    "text, flat",
    [
        ('[{"a": 1}, {"a": "{[]"}]', True),
        ('[{"a": 1}, {"a": "\\"{"}]\n', True),
        ('[[{"a": 1}], [{"a": 2}]]', True),
        ('[{"a": 1}, {"a": 2', False),
        ('[{"a": 1}, {"a": 2}', False),
        ('{"a": 1}]', False),
        ('{"a": 1}}', False),
        ('[{"a": 1}, }]', False),
        ('[{"a": 1}, 2, {"a": 3}]', False),
        ('[{"a": "},{"}, {"a": ",{"}]', False),
        ('[{"a": [1]}]', False),
        ('[{"a": {}}]', False),
    ],
)
def test_which_files_are_flat(spark, tmp_path, text, flat):
    (tmp_path / "x.json").write_text(text)
    assert json_values.layouts(spark.read.option("lineSep", "}").text(str(tmp_path))).first().flat == flat


def test_text_that_is_not_utf8_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_bytes(b'[{"a": "x"}, {"a": "\xff"}]')
    with pytest.raises(Exception):
        files.scan_json(spark, str(tmp_path)).collect()
