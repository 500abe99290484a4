"""Records of CSV files by quote state, files of several dialects, headers that are there or not, folders, long rows."""

import csv
import io
import random

import pytest
from hypothesis import given, settings, strategies as st

from sluice.sources import files
from sluice.sources.records import inside_after, lines_of, pin_splits, records, split_states


@pytest.fixture
def small_splits(spark):
    """Splits of 300 bytes, so that records cross several."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in before.items():
        spark.conf.set(key, value) if value else spark.conf.unset(key)


def written(rows, path, **options):
    text = io.StringIO(newline="")
    csv.writer(text, **options).writerows(rows)
    path.write_bytes(text.getvalue().encode())


def test_records_across_splits(spark, tmp_path, small_splits):
    rng, want = random.Random(1), []
    for f in range(2):
        rows = [["id", "two\nlines"]]
        for i in range(60):
            pieces = ["a", "é", "\n", '"', ",", "\r\n", " ", "x\ny", '""']
            rows.append([f"{f}-{i}", "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40) if i % 20 else 700))])
        written(rows, tmp_path / f"{f}.csv", lineterminator="\n" if f else "\r\n")
        want += rows[1:]
    lines = lines_of(spark, str(tmp_path))
    assert lines.select("__file", "__start").distinct().count() > 10
    df = files.csv_text(spark, str(tmp_path))
    assert df.columns == ["id", "two\nlines"]
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want))


def test_quotes_inside_plain_cells_open_nothing(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n5" pipe,x\n"q ""w""\nend",y\n6" pipe,"z"\n')
    assert sorted(map(tuple, files.csv_text(spark, str(tmp_path)).collect())) == [('5" pipe', "x"), ('6" pipe', "z"), ('q "w"\nend', "y")]


def plain_state(text, inside):
    """Character by character."""
    fresh, closed = not inside, False
    for c in text:
        if inside:
            inside, closed = (False, True) if c == '"' else (True, False)
        elif c == '"' and (fresh or closed):
            inside = True
        else:
            fresh, closed = c == ",", False
        if inside or c == '"':
            fresh = False
    return inside


@settings(max_examples=300, deadline=None)
@given(st.text('a",', max_size=14), st.booleans())
def test_states_of_lines(text, inside):
    assert inside_after(text.encode(), inside, b",") == plain_state(text, inside)


def test_a_changed_split_is_an_error(spark, tmp_path, small_splits):
    (tmp_path / "x.csv").write_text("a,b\n" + '1,"x\ny"\n' * 200)
    pin_splits(spark)
    lines = lines_of(spark, str(tmp_path))
    states = spark.createDataFrame(split_states(lines, ",").collect(), "__file long, __start long, __length long, inside boolean")
    assert records(lines, states, ",").count() == 201
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    with pytest.raises(Exception, match="split anew"):
        records(lines_of(spark, str(tmp_path)), states, ",").count()


def test_dialects_of_one_folder(spark, tmp_path):
    rows = [["id", "name", "at"], *[[str(i), f"n,{i}" if i % 2 else f"n;{i}", "2024-01-15"] for i in range(30)]]
    written(rows, tmp_path / "a.csv", delimiter=",")
    written(rows, tmp_path / "b.csv", delimiter=";")
    written([r[::-1] for r in rows], tmp_path / "c.csv", delimiter="|")
    written([[r[0], f"{r[1]}, it" if r[0] != "id" else r[1], r[2]] for r in rows], tmp_path / "d.csv", quotechar="'")
    df = files.scan_csv(spark, str(tmp_path), delimiter=None)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("at", "date")]
    want = [(i, f"n,{i}" if i % 2 else f"n;{i}") for i in range(30)]
    assert sorted((r.id, r.name) for r in df.collect()) == sorted(want * 3 + [(i, f"{n}, it") for i, n in want])


@pytest.mark.parametrize(
    "text, names",
    [
        ("1,x\n2,z\n", ["column0", "column1"]),
        ("id,x\n2,y\n", ["id", "x"]),
        ("a,b\nc,d\n", ["a", "b"]),
        ("a,\nc,d\n", ["column0", "column1"]),
        ("2024-01-15,a\n2024-01-16,b\n", ["column0", "column1"]),
        ("day,a\n2024-01-16,b\n", ["day", "a"]),
        ("1,2\n", ["column0", "column1"]),
        ("a,b\n", ["a", "b"]),
        ("1,2\n3,x\n", ["column0", "column1"]),
        ("1,2,3\n4,5\n", ["column0", "column1", "column2"]),
        ('a,"b\nc"\n1,"x\ny"\n', ["a", "b\nc"]),
    ],
)
def test_headers_by_types(spark, tmp_path, text, names):
    (tmp_path / "x.csv").write_text(text)
    df = files.csv_text(spark, str(tmp_path), header=None)
    assert df.columns == names
    assert df.count() == len(list(csv.reader(io.StringIO(text)))) - (names[0] != "column0")


@pytest.mark.parametrize("options", [{}, {"encoding": "ISO-8859-1"}, {"encoding": "windows-1252"}, {"multi_line": False}])
def test_names_decide_with_any_option(spark, tmp_path, options):
    code = options.get("encoding", "utf-8")
    (tmp_path / "a.csv").write_bytes("id,name\n1,é\n".encode(code))
    (tmp_path / "b.csv").write_bytes("name,more,id\ny,m,2\n".encode(code))
    df = files.scan_csv(spark, str(tmp_path), **options)
    assert sorted((r.id, r.name, r.more) for r in df.collect()) == [(1, "é", None), (2, "y", "m")]


@pytest.mark.parametrize("names", [("v,w", "v,w"), ("v,w", "w,v")])
def test_columns_named_by_folders(spark, tmp_path, names):
    for day, header in enumerate(names, 1):
        (tmp_path / f"day={day}").mkdir()
        cells = {"v": str(day), "w": '"a\nb"' if day == 2 else "ab"}
        (tmp_path / f"day={day}" / "x.csv").write_text(f"{header}\n{','.join(cells[c] for c in header.split(','))}\n")
    df = files.scan_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"v": "bigint", "w": "string", "day": "int"}
    assert sorted((r.day, r.v, r.w) for r in df.collect()) == [(1, 1, "ab"), (2, 2, "a\nb")]


def test_long_rows_are_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n3,4,5\n"6\n7",8,"9,10"\n11\n12,13,\n')
    (tmp_path / "b.csv").write_text("b,a\n1,2\n")
    df = files.csv_text(spark, str(tmp_path), raw="whole")
    assert sorted((r.a, r.b, r.whole) for r in df.collect() if r.a != "11") == [
        ("1", "2", None), ("12", "13", "12,13,"), ("2", "1", None), ("3", "4", "3,4,5"), ("6\n7", "8", '"6\n7",8,"9,10"')]
