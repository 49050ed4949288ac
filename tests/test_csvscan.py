import csv
import io
import random

import pytest
from railtide.sources import csvscan, gtfs


def lenient(text):
    """The rules one character after the other."""
    rows, row, field, i, text = [], [], "", 0, text.replace("\r\n", "\n")
    state = "start"
    while i < len(text):
        c = text[i]
        if state == "quoted":
            nxt = text[i + 1 : i + 2]
            if c == '"' and nxt == '"':
                field, i = field + '"', i + 1
            elif c == '"' and nxt in (",", "\n", ""):
                state = "after"
            else:
                field += c
        elif c == "\n" or c == ",":
            row.append(field)
            field, state = "", "start"
            if c == "\n":
                rows.append(row)
                row = []
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            field, state = field + c, "plain"
        i += 1
    if row or field or state != "start":
        rows.append([*row, field.removesuffix("\n") if state == "quoted" else field])
    return [r for r in rows if r != [""]]


def scanned(spark, path):
    r = csvscan.records(spark, str(path))
    return [x["f"] for x in r.orderBy("file", "split", "line_no").select(csvscan.fields("value").alias("f")).collect()]


CASES = ['A,"He said ""hi"", ok",40.5,1,0,\n', "a,b\r\n\r\nc\n", '"two\nlines",x\ny,"1\n\n2"\n', 'a"b,"c" d,e\n', '"",""""\n', ' "x",y\n', 'x,"never closed\nz\n', '"a ""b"""\n', '"a "odd" b",c\n']


@pytest.mark.parametrize("text", CASES)
def test_lenient_quotes(spark, tmp_path, text):
    (tmp_path / "f.txt").write_text(text, newline="")
    assert scanned(spark, tmp_path / "f.txt") == lenient(text)


@pytest.mark.parametrize("size", ["40b", "300b", "128m"])
def test_splits_meet_in_the_right_record(spark, tmp_path, size):
    r = random.Random(3)
    pieces = ["a", "b c", '"', '""', ",", "\n", '"q, q"', "long text without anything ", '"line\nline\nline\nand more of it"']
    rows = []
    for k in range(70):
        rows.append([str(k), "".join(r.choice(pieces) for _ in range(r.randrange(6))), "x" * r.randrange(30), "end"])
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.txt").write_text(out.getvalue(), newline="")
    (tmp_path / "d" / "2.txt").write_text("plain,row\n", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        assert csvscan.lines(spark, str(tmp_path / "d" / "1.txt")).select("split").distinct().count() > 20 or size != "40b"
        assert scanned(spark, tmp_path / "d") == [*rows, ["plain", "row"]]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_scan_finds_columns_and_pads(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('﻿stop_id, stop_name ,stop_lat\n"7","The ""Old"" Mill, north",51.5\n8\n', newline="", encoding="utf-8")
    d = gtfs.scan(spark, str(tmp_path / "stops.txt"), ["stop_name", "stop_id", "zone"])
    assert [tuple(x) for x in d.orderBy("_row").drop("_row").collect()] == [('The "Old" Mill, north', "7", ""), ("", "8", "")]
    (tmp_path / "none.txt").write_text("")
    assert gtfs.scan(spark, str(tmp_path / "none.txt"), ["a"]).count() == 0
    with pytest.raises(Exception, match="not exist|PATH_NOT_FOUND"):
        gtfs.scan(spark, str(tmp_path / "missing.txt"), ["a"]).count()
