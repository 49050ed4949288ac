"""Rows that fail to parse: quote-aware record assembly, strict csv parsing, typed constructors, and a reason per reject.

Records go through the stages of ``parse_records`` in one pass over each partition (mapInPandas, which is mapPartitions
on batches): nothing is shuffled and no state outlives a record.
"""

from __future__ import annotations

import csv
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTING, COLUMNS, VALUE, FILE = "quoting", "column_count", "invalid_value", "unknown_file"
BLANKS = " \t\r\n"
csv.field_size_limit(2**31 - 1)  # a long field is no fault
_TIME = re.compile(r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})")
_DIGITS = re.compile(r"[0-9]+")
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)")


def time_seconds(text: str) -> int:
    """Seconds of H:MM:SS or HH:MM:SS with hours 0 to 47; ValueError otherwise."""
    m = _TIME.fullmatch(text.strip(BLANKS))
    if not m or int(m[1]) > 47 or int(m[2]) > 59 or int(m[3]) > 59:
        raise ValueError(text)
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3])


def sequence_number(text: str) -> int:
    t = text.strip(BLANKS)
    if not _DIGITS.fullmatch(t):
        raise ValueError(text)
    return int(t)


def latitude(text: str) -> float:
    t = text.strip(BLANKS)
    if not _DECIMAL.fullmatch(t) or not -90 <= float(t) <= 90:
        raise ValueError(text)
    return float(t)


@dataclass(frozen=True)
class Layout:
    """Column names of a file and the constructors of those that are checked."""

    columns: tuple[str, ...]
    typed: tuple[tuple[str, object], ...]


LAYOUTS = {
    "stop_times.txt": Layout(
        ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
        (("arrival_time", time_seconds), ("stop_sequence", sequence_number)),
    ),
    "stops.txt": Layout(
        ("stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station"),
        (("stop_lat", latitude),),
    ),
}


def assemble(lines: Iterator[str], max_lines: int | None = None) -> Iterator[str]:
    """Physical lines to records: a line break inside an open quoted field continues the record.

    A quote opens a field only at the field's start, so a stray quote within a plain field joins nothing. Where a field
    isn't closed by the end (or within ``max_lines`` lines, if given), or the joined lines are no record to the strict
    reader, the first line stands alone (and will fail to parse) and assembly starts again at the next, so a lost quote
    costs one line and not the rest of the file.
    """
    waiting: deque[str] = deque()
    source = iter(lines)
    while True:
        if not waiting:
            line = next(source, None)
            if line is None:
                return
            waiting.append(line)
        if not _open(waiting[0]):
            yield waiting.popleft()
            continue
        parts, inside = [waiting.popleft()], True
        while inside and (max_lines is None or len(parts) < max_lines):
            line = waiting.popleft() if waiting else next(source, None)
            if line is None:
                break
            parts.append(line)
            inside = _open(line, True)
        record = "\n".join(parts)
        if inside or not _reads(record):
            record = parts[0]
            waiting.extendleft(reversed(parts[1:]))
        yield record


def _open(text: str, inside: bool = False) -> bool:
    """True if the text, which may begin inside a quoted field, ends inside one."""
    i, n = 0, len(text)
    while inside or i < n:
        if inside or text[i] == '"':
            i += not inside
            inside = False
            while True:
                i = text.find('"', i)
                if i < 0:
                    return True
                if text[i + 1 : i + 2] != '"':
                    break
                i += 2
            i += 1
        i = text.find(",", i)
        if i < 0:
            return False
        i += 1
    return False


def _reads(record: str) -> bool:
    """True if the strict reader takes joined lines as one record."""
    try:
        return len(list(csv.reader([record.replace("\x00", "\ufffd")], strict=True))) == 1
    except csv.Error:
        return False


def fields_of(record: str) -> list[str]:
    """The fields by Python's strict csv reader; csv.Error where quotes stand other than around whole fields."""
    text = record.removeprefix("\ufeff").removesuffix("\n").removesuffix("\r")
    if "\x00" in text:
        text = text.replace("\x00", "\ufffd")  # the reader refuses NUL; it is an odd character, not a quoting fault
    rows = list(csv.reader(assemble(iter(text.split("\n"))) if "\n" in text else [text], strict=True))
    if len(rows) != 1:
        raise csv.Error("a line break outside quotes" if rows else "nothing")
    # The reader takes a quote inside a plain field as a character of it.
    if '"' in text:
        if _plain_quote(text):
            raise csv.Error("a quote inside a plain field")
    return rows[0] or [""]  # the reader gives an empty line no field


def _plain_quote(text: str) -> bool:
    """True if a field that doesn't begin with a quote holds one; quoted fields are known to be well formed."""
    i, n = 0, len(text)
    while i < n:
        if text[i] == '"':
            i += 1
            while True:
                i = text.find('"', i)
                if text[i + 1 : i + 2] != '"':
                    break
                i += 2
            i += 2  # past the quote and the comma
        else:
            end = text.find(",", i)
            end = n if end < 0 else end
            if '"' in text[i:end]:
                return True
            i = end + 1
    return False


def parse_one(name: str | None, record: str | None, layouts: dict[str, Layout] = LAYOUTS) -> tuple[str | None, list[str] | None]:
    """(reason, fields): the first fault of a record, or None and its fields."""
    layout = layouts.get((name or "").strip())
    if layout is None:
        return FILE, None
    try:
        got = fields_of(record or "")
    except csv.Error:
        return QUOTING, None
    if len(got) != len(layout.columns):
        return COLUMNS, None
    for column, make in layout.typed:
        try:
            make(got[layout.columns.index(column)])
        except ValueError:
            return VALUE, None
    return None, got


def parse_records(df: DataFrame, line_id: str = "line_id", file_name: str = "file_name", line: str = "line",
                  layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """(line_id, file_name, reason, fields): every record, either with a reason or with its fields.

    A null or empty line is a record with one empty field (column_count), a null or unlisted file name gives
    unknown_file. Other columns of df are ignored; repeated records come out as often as they stand. Empty input gives
    no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [parse_one(n, x, layouts) for n, x in zip(b["file_name"], b["line"])]
            yield pd.DataFrame({
                "line_id": b["line_id"], "file_name": b["file_name"],
                "reason": pd.Series([r for r, _ in out], dtype=object), "fields": pd.Series([f for _, f in out], dtype=object),
            })

    rows = df.select(F.col(line_id).cast("long").alias("line_id"), F.col(file_name).alias("file_name"), F.col(line).alias("line"))
    return rows.mapInPandas(run, "line_id long, file_name string, reason string, fields array<string>")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("line_id", "reason")


def _seconds(c) -> object:
    p = F.split(F.trim(c, F.lit(BLANKS)), ":")
    part = [F.get(p, F.lit(i)).try_cast("int") for i in range(3)]
    return (part[0] * 3600 + part[1] * 60 + part[2]).cast("int")


def stop_times_of(parsed: DataFrame) -> DataFrame:
    """Valid stop_times rows, typed; an unreadable departure takes the arrival."""
    f = F.col("fields")
    arrival = _seconds(f[1])
    return parsed.where("reason is null and trim(file_name) = 'stop_times.txt'").select(
        "line_id", F.trim(f[0], F.lit(BLANKS)).alias("trip_id"), arrival.alias("arrival_secs"),
        F.coalesce(_seconds(f[2]), arrival).alias("departure_secs"), F.trim(f[3], F.lit(BLANKS)).alias("stop_id"),
        F.trim(f[4], F.lit(BLANKS)).try_cast("long").alias("stop_sequence"),
    )


def stops_of(parsed: DataFrame) -> DataFrame:
    """Valid stops rows, typed; unreadable longitude or location type are 0."""
    f = F.col("fields")
    t = lambda i: F.trim(f[i], F.lit(BLANKS))
    return parsed.where("reason is null and trim(file_name) = 'stops.txt'").select(
        "line_id", t(0).alias("stop_id"), f[1].alias("stop_name"), t(2).try_cast("double").alias("stop_lat"),
        F.coalesce(t(3).try_cast("double"), F.lit(0.0)).alias("stop_lon"),
        F.coalesce(t(4).try_cast("int"), F.lit(0)).alias("location_type"), t(5).alias("parent_station"),
    )


def load_csv(spark, path: str, layout: Layout) -> DataFrame:
    """(file, record_no, reason, fields) of UTF-8 text files, whose records are assembled quote-aware.

    Lines are read in splits and brought together by file in order, so a file streams through one task whatever its size;
    which line a record begins at depends on all lines before it, since a lost quote starts assembly again. A record that
    begins with a quote is held while its closing quote is looked for. Use many files for large loads; a lenient scan that
    needs no such order is sources.csvscan.
    """
    from railtide.sources import csvscan

    names = ["file", "record_no", "reason", "fields"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = (x for b in batches for x in zip(b["file"], b["value"]))
        for name, own in groupby(lines, key=itemgetter(0)):
            out = []
            for no, record in enumerate(assemble(x for _, x in own)):
                if no == 0 and [x.strip() for x in record.split(",")] == list(layout.columns):
                    continue
                out.append((name, no, *parse_one("file", record, {"file": layout})))
                if len(out) == 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    placed = csvscan.lines(spark, path).repartition("file").sortWithinPartitions("file", "split", "line_no")
    return placed.select("file", "value").mapInPandas(run, "file string, record_no long, reason string, fields array<string>")
