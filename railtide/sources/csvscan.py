"""A splittable scan of CSV files that takes quotes leniently and line breaks inside quotes.

Lines are read by the text source, so a large file is many splits. A line is whole if no quoted field is open at its end;
where all lines are (one filter over the lines that hold a quote), records are lines and everything stays in the JVM.
Otherwise a first pass finds for every split in which state it ends if it begins outside or inside a quoted field, the
states are chained along each file (one row per split), and a second pass joins lines to records; only the pieces of
records that cross a split border are brought together by a shuffle.

A quote opens a field only at the field's start. Inside, a doubled quote is one quote, a quote before a comma or the end
of the line closes, and any other is a character. A field that is never closed holds the rest of its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a quoted field holds, possessive, so that no input makes it try again; then its closing quote.
_TEXT = r'(?:[^"]++|""|"(?!,|\z))*+'
_INSIDE = rf'{_TEXT}"(?=,|\z)'
_FIELD = rf'(?:"{_INSIDE}|(?!")[^,]*+)'
#: A field of a whole record: one that the end of the file left open counts as closed there.
_CLOSED = rf'(?:"{_TEXT}(?:"(?=,|\z)|\z)|(?!")[^,]*+)'
WHOLE = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
_py = lambda p: re.compile(p.replace(r"\z", r"\Z"))
_WHOLE, _REST = _py(WHOLE), _py(rf"\A{_INSIDE}")


def open_after(line: str, inside: bool) -> bool:
    """True if a quoted field is open at the end of a line that begins inside one, or outside."""
    if inside:
        m = _REST.match(line)
        if m is None:
            return True
        line = line[m.end() + 1 :]
    return _WHOLE.match(line) is None


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line_no, value): the lines of the files with their place; line_no grows within a split."""
    raw = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace("value", r"\r\z", "")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line_no"),
                      F.when(F.col("_metadata.file_block_start") == 0, F.regexp_replace(value, "^﻿", "")).otherwise(value).alias("value"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line_no, value): the records of the files, in place of their first line. Empty lines are none."""
    text = lines(spark, path)
    broken = text.where(F.contains("value", F.lit('"')) & ~F.rlike("value", F.lit(WHOLE))).limit(1).count()
    return (_joined(text) if broken else text).where("value <> ''")


OUTSIDE, OWN, BEFORE = 0, 1, 2  # no field open; one open in a record of this split; in the record open at its start


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """((file, split), rows) of a task's batches, which hold their splits one after the other."""
    for b in batches:
        yield from b.groupby(["file", "split"], sort=False)


def _states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split the state at its end, if it begins outside and if it begins inside a quoted field."""
    out: dict[tuple[str, int], list[int]] = {}
    for key, rows in _runs(batches):
        now = out.setdefault(key, [OUTSIDE, BEFORE])
        for line in rows["value"]:
            if '"' in line:
                for k, state in enumerate(now):
                    opened = open_after(line, state != OUTSIDE)
                    now[k] = (state or OWN) if opened else OUTSIDE
    yield pd.DataFrame([(*key, *now) for key, now in out.items()], columns=["file", "split", "outside", "inside"])


def _joined(text: DataFrame) -> DataFrame:
    """Lines joined to records, each split told which split the record open at its start began in, if any."""
    ends = text.mapInPandas(_states, "file string, split long, outside int, inside int").orderBy("file", "split")
    begins: dict[tuple[str, int], int] = {}
    file, origin = None, None
    for name, split, outside, inside in ends.toLocalIterator():
        if name != file:
            file, origin = name, None
        if origin is not None:
            begins[name, split] = origin
        end = outside if origin is None else inside
        origin = {OUTSIDE: None, OWN: split, BEFORE: origin}[end]
    pieces = text.mapInPandas(_assembler(begins), "file string, split long, line_no long, value string, piece long")
    x = F.sort_array(F.collect_list(F.struct("piece", "line_no", "value")))  # the pieces of one record
    crossing = pieces.where("piece is not null").groupBy("file", "split").agg(x.alias("x"))
    crossing = crossing.select("file", "split", F.get("x.line_no", F.lit(0)).alias("line_no"), F.array_join("x.value", "\n").alias("value"))
    return pieces.where("piece is null").drop("piece").unionByName(crossing)


def _assembler(begins: dict[tuple[str, int], int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "split", "line_no", "value", "piece"]
        key, held, first, origin = None, [], 0, None  # the record being read, its first line, and where it began if not here
        for now, rows in _runs(batches):
            out = []
            if now != key:
                if held:
                    out.append((key[0], origin if origin is not None else key[1], first, "\n".join(held), key[1]))
                key, held, origin = now, [], begins.get(now)
            for no, line in zip(rows["line_no"], rows["value"]):
                inside = bool(held) or origin is not None
                first = first if inside and held else no
                held.append(line)
                if not (open_after(line, inside) if '"' in line else inside):
                    out.append((key[0], key[1] if origin is None else origin, first, "\n".join(held), None if origin is None else key[1]))
                    held, origin = [], None
            yield pd.DataFrame(out, columns=names).astype({"piece": "Int64"})
        if held:
            yield pd.DataFrame([(key[0], key[1] if origin is None else origin, first, "\n".join(held), key[1])], columns=names)

    return run


def fields(value: str | Column) -> Column:
    """The fields of a record as an array of strings, quotes taken off."""
    v = F.col(value) if isinstance(value, str) else value
    raw = F.regexp_extract_all(F.concat(F.lit(","), v), F.lit(f",({_CLOSED})"), F.lit(1))
    raw = F.when(F.contains(v, F.lit('"')), raw).otherwise(F.split(v, ","))
    bare = lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.regexp_replace(x, r'^"|"\z', ""), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.when(F.contains(v, F.lit('"')), F.transform(raw, bare)).otherwise(raw)
