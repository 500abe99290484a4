"""File scans: types, padding, rejection, delimiters, JSON layouts, workbooks."""

import datetime
import zipfile
from decimal import Decimal

import duckdb
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sluice.functions.types import type_name
from sluice.operators import profile, quality
from sluice.operators.positions import skip_rows
from sluice.operators.shape import shape
from sluice.sources import exports, files
from sluice.sources.sniff import sniff_report, sniff_types

SNIFFED = [
    ["true", "false"], ["t", "f"], ["yes", "no"], ["1", "0"], ["TRUE", "False"], ["1", "true"], ["5", "1.5"], ["1e5", "2"], ["nan", "1.5"],
    ["00123", "5"], ["0", "-0"], ["007.5", "1"], ["-01", "2"], ["+5", "6"], [" 5 ", "6"], ["9223372036854775808", "1"],
    ["2024-01-15", "2024-01-16"], ["2024/01/15", "2024/02/16"], ["01/15/2024", "02/16/2024"], ["01/02/2024", "02/03/2024"],
    ["15/01/2024", "16/01/2024"], ["15-01-2024", "16-01-2024"], ["01-15-2024", "02-16-2024"], ["2024.01.15", "2024.02.16"],
    ["15.01.2024", "16.01.2024"], ["2024-1-5", "2024-01-16"], ["2024-01-15", "2024-01-15 10:00:00"], ["2024-01-15T10:30:00", "2024-01-15T10:31:00"],
    ["2024-01-15T10:30:00Z", "2024-01-15T10:30:00Z"], ["2024-01-15 10:30:00+02", "2024-01-15 10:30:00+02"], ["2024-01-15 10:30", "2024-01-15 10:31"],
    ["10:30:00", "11:00:00"], ["10:30", "11:00"], ["20240115", "20240116"], ["", "5"], ["", ""], ["NULL", "5"], ["1_000", "2"], [".5", "1."],
    ["1d", "2"], ["1.5f", "2"], ["infinity", "1"], ["2024-01-15 10:30:00.123", "2024-01-15 10:30:00"], ["on", "off"], ["2024-02-30", "2024-01-01"],
    ["1/15/2024", "2/6/2024"], ["abc", "5"], ["25:00:00", "10:00:00"],
]


@pytest.mark.parametrize("cells", SNIFFED, ids=lambda c: "|".join(c))
def test_types_and_values_as_duckdb(spark, tmp_path, cells):
    path = tmp_path / "x.csv"
    path.write_text("id,v\n" + "".join(f"{i},{c}\n" for i, c in enumerate(cells)))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    found = con.execute(f"SELECT v FROM read_csv('{path}', null_padding=true, ignore_errors=true, sep=',', header=true) ORDER BY id")
    kind, expected = str(found.description[0][1]).upper(), [r[0] for r in found.fetchall()]
    df = files.scan_csv(spark, str(path))
    got = [r.v for r in df.orderBy("id").collect()]
    if kind == "TIME":
        assert df.schema["v"].dataType.simpleString() == "string"
        expected = [e.strftime("%H:%M:%S") for e in expected]
    else:
        assert type_name(df.schema["v"].dataType) == kind

    def plain(v):
        if isinstance(v, datetime.datetime) and v.tzinfo:
            return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
        return str(v) if isinstance(v, float) else v

    assert [plain(g) for g in got] == [plain(e) for e in expected]


def test_padding_quotes_and_long_rows(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b,c\n1,"x ""y"", z",2.5\n2,only\n\n3,z,1.5,surplus\n4,"",7\n')
    df = files.scan_csv(spark, str(path))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 'x "y", z', 2.5), (2, "only", None), (3, "z", 1.5), (4, None, 7.0)]
    assert [r.row for r in files.long_rows(spark, str(path)).collect()] == ["3,z,1.5,surplus"]


def test_late_bad_cell(spark, tmp_path):
    """Head-only detection drops the row; detection on all rows makes the column text."""
    path = tmp_path / "late.csv"
    path.write_text("a,b\n" + "".join(f"{i},{i}\n" for i in range(30_000)) + "30000,bad\n")
    head = files.scan_csv(spark, str(path), sniff_rows=20_480)
    assert (head.dtypes, head.count()) == ([("a", "bigint"), ("b", "bigint")], 30_000)
    assert files.scan_csv(spark, str(path), sniff_rows=20_480, ignore_errors=False).where("b IS NULL").count() == 1
    whole = files.scan_csv(spark, str(path))
    assert (whole.dtypes[1][1], whole.count()) == ("string", 30_001)
    with pytest.raises(ValueError, match="sniff_rows"):
        files.scan_csv(spark, str(path), sniff_rows=10**9)
    given = files.scan_csv(spark, str(path), types={"b": "INTEGER"}, sniff=False)
    assert (given.dtypes, given.count()) == ([("a", "string"), ("b", "int")], 30_000)


def test_delimiters_and_headers(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a;b\n1;x,y\n2;z\n")
    assert files.detect_delimiter(spark, str(path)) == ";"
    assert files.scan_csv(spark, str(path), delimiter=None).columns == ["a", "b"]
    assert len(files.scan_csv(spark, str(path)).columns) == 1
    path = tmp_path / "y.csv"
    path.write_text("1,x\n2,y,7\n")
    df = files.scan_csv(spark, str(path), header=False)
    assert df.columns == ["column0", "column1", "column2"]
    assert [tuple(r) for r in df.orderBy("column0").collect()] == [(1, "x", None), (2, "y", 7)]
    path = tmp_path / "z.tsv"
    path.write_text("a\tb\n1\tx, y\n")
    assert files.scan_tsv(spark, str(path)).first() == (1, "x, y")
    path = tmp_path / "latin.csv"
    path.write_bytes("a,b\n1,caf\xe9\n".encode("latin-1"))
    assert files.scan_csv(spark, str(path), encoding="ISO-8859-1").first().b == "café"


def test_sniff_report_and_empty_file(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b c,`d`\n")
    text = files.csv_text(spark, str(path))
    assert {r.name: r.inferred_type for r in sniff_report(text).collect()} == {"a": "VARCHAR", "b c": "VARCHAR", "`d`": "VARCHAR"}
    assert files.scan_csv(spark, str(path)).count() == 0
    assert sniff_types(text.select()) == {}


def test_odd_column_names(spark, tmp_path):
    """From the header through typing, profile, warnings and skipped rows."""
    path = tmp_path / "x.csv"
    path.write_text('\ufeffa.b,c d,`e`,"f,g",a.b,A.B,,it\'s\n1,x,2024-01-15,2.5,7,8,9,p\n2,y,2024-01-16,,7,8,9,q\n', encoding="utf-8")
    df = files.scan_csv(spark, str(path))
    names = ["a.b", "c d", "`e`", "f,g", "a.b_1", "A.B_2", "column6", "it's"]
    assert df.columns == names
    assert [k for _, k in df.dtypes] == ["bigint", "string", "date", "double", "bigint", "bigint", "bigint", "string"]
    got = profile.profile(df, order_by=["a.b"]).collect()
    assert [(r.name, r.unique_count, r.null_count) for r in got] == [(n, u, n == "f,g") for n, u in zip(names, [2, 2, 2, 1, 1, 1, 1, 2])]
    assert quality.warnings(df, ["a.b"]).count() == 0
    assert [r[0] for r in skip_rows(df, [0]).collect()] == [2]
    assert [r[0] for r in skip_rows(df, [0], ["a.b"]).collect()] == [2]
    assert shape(df, {"a.b": "x.y"}, {"x.y": "VARCHAR"}).dtypes[0] == ("x.y", "string")


def test_json_layouts(spark, tmp_path):
    rows = '{"z": 1, "a": {"b": [1, 2], "d": "2024-01-15"}, "t": "2024-01-15 10:00:00", "s": "x"}'
    more = '{"z": 2, "a": {"b": [], "d": "2024-01-16"}, "t": null, "s": "2024-01-15"}'
    (tmp_path / "lines.json").write_text(f"{rows}\n{more}\n")
    (tmp_path / "array.json").write_text(f"[{rows},\n{more}]")
    expected = {"z": "bigint", "a": "struct<b:array<bigint>,d:date>", "t": "timestamp_ntz", "s": "string"}
    for name in ("lines", "array"):
        df = files.scan_json(spark, str(tmp_path / f"{name}.json"))
        assert dict(df.dtypes) == expected
        assert [r.z for r in df.orderBy("z").collect()] == [1, 2]
    assert files.scan_json(spark, str(tmp_path / "lines.json")).columns == ["z", "a", "t", "s"]
    (tmp_path / "bad.json").write_text(f"{rows}\nnot json\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.scan_json(spark, str(tmp_path / "bad.json")).collect()


@pytest.mark.parametrize("indent", [False, True])
def test_geojson_is_one_row(spark, tmp_path, indent):
    import json

    feature = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 2.5]}, "properties": {"n": i}} for i in range(2)]
    (tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feature}, indent=2 if indent else None))
    df = files.scan_geojson(spark, str(tmp_path / "x.geojson"))
    assert (df.count(), set(df.columns)) == (1, {"type", "features"})
    assert df.select(F.inline("features")).count() == 2


def test_format_choice(spark):
    with pytest.raises(ValueError, match="no file format named 'orc'"):
        files.scan_file(spark, "x", "orc")


STYLES = (
    '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="20"/></cellXfs></styleSheet>'
)


def write_book(path, sheets):
    with zipfile.ZipFile(path, "w") as book:
        exports.write_workbook_frame(book, tuple(sheets))
        book.writestr("xl/styles.xml", STYLES)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{exports.MAIN}"><si><t>shared</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(rows).encode()
            if i == len(sheets):
                book.writestr(f"xl/worksheets/sheet{i}.xml", exports.SHEET_START + body + exports.SHEET_END)


def test_workbooks(spark, tmp_path):
    header = '<row r="1"><c r="A1" t="inlineStr"><is><t>id</t></is></c><c r="B1" t="inlineStr"><is><t>name</t></is></c>'
    header += "".join(f'<c r="{c}1" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("CDEF", ("day", "at", "ok", "id"))) + "</row>"
    first = '<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>0</v></c><c r="C2" s="1"><v>45306</v></c><c r="D2" s="2"><v>45306.4375</v></c><c r="E2" t="b"><v>1</v></c></row>'
    gap = '<row r="3"><c r="A3"><v>2.5</v></c><c r="F3"><v>9</v></c></row><row r="5"><c r="A5"><v>99</v></c></row>'
    write_book(tmp_path / "a.xlsx", {"Notes": [], "Data": [header, first, gap]})
    other = '<row><c t="inlineStr"><is><t>name</t></is></c><c t="inlineStr"><is><t>extra</t></is></c></row><row><c t="s"><v>1</v></c><c t="str"><v>007</v></c></row>'
    write_book(tmp_path / "b.xlsx", {"Notes": [], "Data": [other]})
    for choice in ({"sheet_name": "Data"}, {"sheet_index": 1}):
        df = files.scan_file(spark, str(tmp_path), "excel", **choice)
        assert df.dtypes == [
            ("id", "double"), ("name", "string"), ("day", "date"), ("at", "timestamp_ntz"), ("ok", "boolean"), ("id_1", "double"), ("extra", "string"),
        ]
        # Row 4 is empty: the table of the first workbook ends there.
        assert {tuple(r) for r in df.collect()} == {
            (1.0, "shared", datetime.date(2024, 1, 15), datetime.datetime(2024, 1, 15, 10, 30), True, None, None),
            (2.5, None, None, None, None, 9.0, None),
            (None, "rich", None, None, None, None, "007"),
        }
    with pytest.raises(PySparkException, match="no sheet Missing"):
        files.scan_file(spark, str(tmp_path), "excel", sheet_name="Missing")


def test_exported_workbooks(spark, table, tmp_path):
    parts = table("part").select("p_partkey", "p_name").repartition(3)
    exports.export_workbooks(parts, str(tmp_path / "books"), ("Parts",), rows=50)
    back = files.scan_excel(spark, str(tmp_path / "books"))
    assert back.select(F.col("p_partkey").cast("long"), "p_name").exceptAll(parts).count() == 0
    assert back.count() == parts.count()


def test_types_of_big_numbers(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a\n99999999999999999999\n1\n")
    assert files.scan_csv(spark, str(path)).orderBy("a").collect()[1].a == Decimal("99999999999999999999")


def test_csv_files_with_other_headers_are_united_by_name(spark, tmp_path):
    (tmp_path / "a {1}.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("name,id\nq,9\n")
    (tmp_path / "c%20d.csv").write_text('\n\ufeffid,extra\n7,"z, ""w"""\n')
    (tmp_path / "empty.csv").write_text("")
    df = files.scan_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.select("id", "name", "extra").collect()) == [
        (1, "x", None), (2, "y", None), (7, None, 'z, "w"'), (9, "q", None)]
    assert dict(df.dtypes)["id"] == "bigint"


def test_csv_without_header_is_as_wide_as_its_widest_line(spark, tmp_path):
    lines = ["1,2"] * 1500 + ['3,"a,b",4,""', '"5, ""6""",7']
    (tmp_path / "wide.csv").write_text("\n".join(lines) + "\n")
    df = files.scan_csv(spark, str(tmp_path), header=False)
    assert len(df.columns) == 4 and df.count() == 1502
    assert [tuple(r) for r in df.where("column2 IS NOT NULL").collect()] == [("3", "a,b", 4, None)]


def test_long_rows_by_the_reader(spark, tmp_path):
    """Rows of more cells than their header are told without cutting all records in Python."""
    (tmp_path / "a.csv").write_text('a,b\n1,2\n3,4,5\n,6,7\n"x,y",8,9\n10\n"p,q",r\n')
    (tmp_path / "b.csv").write_text("b,a\r\n1,2,,\r\n3,4\r\n")
    checked = files.scan_csv_checked(spark, str(tmp_path), header=True)
    told = checked.quarantine()
    assert sorted(r.row for r in told.collect()) == ['"x,y",8,9', ",6,7", "1,2,,", "3,4,5"]
    assert {(r.reason, r.dropped) for r in told.collect()} == {("more cells than the header", False)}
    rows = {(r.a, r.b) for r in checked.data.collect()}
    assert rows == {("1", "2"), ("3", "4"), (None, "6"), ("x,y", "8"), ("10", None), ("p,q", "r"), ("2", "1"), ("4", "3")}
    assert sorted(r.row for r in files.long_rows(spark, f"{tmp_path}/a.csv").collect()) == ['"x,y",8,9', ",6,7", "3,4,5"]
    assert "MapInArrow" not in told._jdf.queryExecution().toString()
