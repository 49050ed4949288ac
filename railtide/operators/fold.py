"""Ordered folds: one pass over each key's rows in order, with no more than one state held at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """Rows that ``step(state, row) -> (state, rows out)`` gives, over each key's rows in order.

    Keys are placed by hash and sorted within partitions, so a long key streams through its task and is never held.
    Rows are named tuples; nulls in whole-number columns arrive as None.
    """
    at = [df.columns.index(k) for k in keys]
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    whole = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        now, state = None, None
        for b in batches:
            for c in whole:
                if b[c].dtype.kind == "f":
                    b[c] = b[c].astype("Int64")
            out = []
            b = b.astype(object).where(b.notna(), None)
            for row in b.itertuples(index=False):
                key = tuple(row[k] for k in at)
                if key != now:
                    now, state = key, start()
                state, rows = step(state, row)
                out += rows
            yield pd.DataFrame(out, columns=names)

    return placed.mapInPandas(run, schema)
