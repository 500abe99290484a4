"""Versions by compare and set, and rows that conversions cut or leave out."""

import glob
import hashlib
import os
import threading

import pytest

from sluice.operators import ledger
from sluice.plans import convert, sink
from sluice.plans.claims import claim, holder


@pytest.fixture
def work(spark, tmp_path):
    sources = spark.createDataFrame([("f1", "org1", "file", "csv"), ("t1", "org1", "file", "tsv")], ledger.SOURCES)
    return convert.Workspace(spark, str(tmp_path), sources)


def upload(work, text, source="f1", name="x.csv"):
    folder = sink.source_path(work.root, "org1", source)
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="") as file:
        file.write(text)


def contents(work, version):
    names = sorted(glob.glob(f"{sink.output_path(work.root, 'org1', 'f1', version)}/*"))
    return {name: hashlib.md5(open(name, "rb").read()).hexdigest() for name in names}


def test_one_of_many_gets_a_number(spark, tmp_path):
    got, gate = [], threading.Barrier(8)

    def run(k):
        gate.wait()
        got.append(claim(spark, lambda n: f"{tmp_path}/v{n}", 3, f"r{k}", set()))

    threads = [threading.Thread(target=run, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == list(range(3, 11))
    place, owner = holder(spark, f"{tmp_path}/v5")
    assert claim(spark, lambda n: f"{tmp_path}/v{n}", 5, "again", {owner}) == 5
    assert holder(spark, f"{tmp_path}/v5") == (place + 1, "again")


def test_three_writers_and_a_crash(work, monkeypatch):
    upload(work, "id,v\n" + "".join(f"{i},{i}\n" for i in range(50)))
    made, append = [], ledger.append_events

    def run():
        made.append(convert.convert_file(work, "f1")["version"])

    threads = [threading.Thread(target=run) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(made) == [1, 2, 3] and work.current_version("f1") == 3
    before = {n: contents(work, n) for n in (1, 2, 3)}

    class Crash(BaseException):
        pass

    def crashing(events, *rest):
        if events.first().status == "active":
            raise Crash
        append(events, *rest)

    monkeypatch.setattr(ledger, "append_events", crashing)
    with pytest.raises(Crash):
        convert.convert_file(work, "f1")
    monkeypatch.setattr(ledger, "append_events", append)
    # The files are there, the version is not; its number is not given again.
    left = contents(work, 4)
    assert left and work.current_version("f1") == 3
    upload(work, "id,v\n1,1\n")
    done = convert.convert_file(work, "f1")
    assert (done["version"], done["rows"], work.current_version("f1")) == (5, 1, 5)
    assert {n: contents(work, n) for n in (1, 2, 3)} == before and contents(work, 4) == left


def test_bad_rows_lie_in_quarantine(work):
    upload(work, 'id,v\n1,1\n2,x\n3,3,more\n4,"a\nb"\n5,5,,\n6\n')
    done = convert.convert_file(work, "f1", options={"types": {"v": "INTEGER"}})
    assert sorted(tuple(r) for r in work.read("f1").collect()) == [(1, 1), (3, 3), (5, 5), (6, None)]
    assert done["warnings"] == ["2 rows cut to the width of the header", "2 rows left out, as cells do not fit their types"]
    assert sorted(tuple(r) for r in work.quarantine("f1").collect()) == [
        ("2,x", "v: not INTEGER", True),
        ("3,3,more", "more cells than the header", False),
        ('4,"a\nb"', "v: not INTEGER", True),
        ("5,5,,", "more cells than the header", False),
    ]
    upload(work, "id,v\n1,1\n")
    done = convert.convert_file(work, "f1", options={"types": {"v": "INTEGER"}})
    assert done["warnings"] == [] and work.quarantine("f1").count() == 0
    assert work.quarantine("f1", 1).count() == 4


def test_conversions_see_whether_there_is_a_header(work):
    upload(work, "1\tx\n2\tz\n", "t1", "x.tsv")
    assert convert.convert_file(work, "t1")["rows"] == 2
    assert work.read("t1").columns == ["column0", "column1"]


def test_positions_of_records_with_line_breaks(work):
    rows = "".join(f'{i},"a\nb{i}"\n' for i in range(20))
    upload(work, "id,v\n" + rows, name="a.csv")
    upload(work, "v,id\nx,100\ny,101\n", name="b.csv")
    done = convert.convert_file(work, "f1", options={"skip_rows": [0, 5, 19, 21, 99]})
    assert (done["rows"], done["rows_skipped"], done["columns"]) == (18, 4, 2)
    assert sorted(r.id for r in work.read("f1").collect()) == sorted(set(range(20)) - {0, 5, 19} | {100})
