import csv

import pytest
from railtide.operators import rejects as r

GOOD = "T1,8:05:00,08:06:00,S1,3"


@pytest.mark.parametrize(("line", "reason"), [
    (GOOD, None), ("﻿" + GOOD, None), (GOOD + "\r", None), ('"T1",08:05:00,,S1,"3"', None), ("T1, 47:59:59 ,x,S1, 3 ", None),
    ('"T ""1"" x",08:05:00,08:05:00,S1,3', None), ('"T\n1",08:05:00,08:05:00,S1,3', None), ('"T,1",08:05:00,,S1,3', None),
    ('T"1,08:05:00,08:05:00,S1,3', "quoting"), ('"T1,08:05:00,08:05:00,S1,3', "quoting"), ('"T1"x,08:05:00,08:05:00,S1,3', "quoting"),
    (' "T1",08:05:00,08:05:00,S1,3', "quoting"), ('"T "in" x",1,2', "quoting"), ('T1,08:05:00,08:05:00,S1,3"', "quoting"),
    ("T1,08:05:00,08:05:00,S1", "column_count"), (GOOD + ",", "column_count"), ("", "column_count"), (None, "column_count"),
    ("T1,48:00:00,,S1,3", "invalid_value"), ("T1,8:5:00,,S1,3", "invalid_value"), ("T1,08:60:00,,S1,3", "invalid_value"), ("T1,,,S1,3", "invalid_value"),
    ("T1,08:00:00,,S1,two", "invalid_value"), ("T1,08:00:00,,S1,-3", "invalid_value"), ("T1,08:00:00,,S1,", "invalid_value"), ("T1,08:00:00,,S1,²", "invalid_value"),
])
def test_stop_times(line, reason):
    assert r.parse_one("stop_times.txt", line)[0] == reason


@pytest.mark.parametrize(("lat", "ok"), [("90", 1), ("-90.0", 1), ("+4.5", 1), (" 41.25 ", 1), ("90.01", 0), ("1e1", 0), ("nan", 0), ("", 0), ("4,5", 0), ("43.8'1", 0)])
def test_latitude(lat, ok):
    assert (r.parse_one("stops.txt", f"S,Name,{lat},1,0,")[0] is None) == bool(ok)


def test_long_field_and_unknown_file():
    assert r.parse_one("stops.txt", f'S,"{"x" * 300_000}",1,1,0,')[0] is None
    assert r.parse_one("other.txt", GOOD)[0] == "unknown_file" == r.parse_one(None, GOOD)[0]


def test_assembly_resumes_after_a_lost_quote():
    lines = ["a,b", '"x', 'y",c', 'bad,"never closed', "d,e", "f,g"]
    assert list(r.assemble(iter(lines))) == ["a,b", '"x\ny",c', 'bad,"never closed', "d,e", "f,g"]
    assert list(r.assemble(iter([]))) == [] and list(r.assemble(iter(['"']))) == ['"']


def test_tables(spark):
    rows = [(1, "stop_times.txt", GOOD, 9), (2, "stops.txt", 'S1,"A ""b"" c",-4.5,x,,P', 9), (3, "stops.txt", "S1", 9), (4, None, None, 9), (1, "stop_times.txt", GOOD, 9)]
    p = r.parse_records(spark.createDataFrame(rows, "line_id long, file_name string, line string, reason int"))
    assert {tuple(x) for x in r.rejects(p).collect()} == {(3, "column_count"), (4, "unknown_file")}
    assert [tuple(x) for x in r.stop_times_of(p).collect()] == [(1, "T1", 29100, 29160, "S1", 3)] * 2
    assert [tuple(x) for x in r.stops_of(p).collect()] == [(2, "S1", 'A "b" c', -4.5, 0.0, 0, "P")]
    assert r.parse_records(spark.createDataFrame([], "line_id long, file_name string, line string")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station\r\n" 'S1,"Two\r\nlines",1,2,0,\r\n' 'S2,"lost,1,2,0,\r\n' "S3,x,4,5,1,\r\n", newline="")
    got = {x["record_no"]: (x["reason"], x["fields"] and x["fields"][0]) for x in r.load_csv(spark, str(tmp_path), r.LAYOUTS["stops.txt"]).collect()}
    assert got == {1: (None, "S1"), 2: ("quoting", None), 3: (None, "S3")}


def test_reader_is_strict():
    with pytest.raises(csv.Error):
        r.fields_of('"a" b,c')


def test_plain_records_go_through_the_reader():
    assert r.parse_one("stop_times.txt", "T1\r,08:05:00,,S1,3")[0] == "quoting" and r.parse_one("stop_times.txt", GOOD + "\r\n")[0] is None
    assert r.fields_of("") == [""] and r.fields_of("a,,b") == ["a", "", "b"]


def test_long_quoted_fields_are_whole(spark, tmp_path):
    name = "\n".join(f"line {k}" for k in range(250))
    assert r.parse_one("stops.txt", f'S1,"{name}",1,2,0,') == (None, ["S1", name, "1", "2", "0", ""])
    lost = ['S0,"lost,1,2,0,', *(f"S{k},x,1,2,0," for k in range(150))]  # the next quote is far away and closes nothing
    lines = [*lost, *f'S1,"{name}",1,2,0,'.split("\n"), "S3,x,4,5,1,"]
    assert list(r.assemble(iter(lines))) == [*lost, f'S1,"{name}",1,2,0,', "S3,x,4,5,1,"]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    got = [x["reason"] for x in r.load_csv(spark, str(tmp_path), r.LAYOUTS["stops.txt"]).orderBy("record_no").collect()]
    assert got == ["quoting", *[None] * 152]
