"""Tables that outlive a query: rows by key, the newest version of each, with expiry, prefix scans and taking out."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtide.operators.messages import BUCKET_ROWS, MessageStore


class KeyedStore:
    """Rows by key in a folder of sorted runs (see MessageStore): writing a key again replaces its row.

    Every write has a ``version`` that grows with time, such as seconds of arrival; of one key the greatest stands, and of equal ones what was written last. A row
    that was removed is a row without a value, and a row whose version is older than ``ttl`` counts as gone. Runs are
    merged every ``every`` writes, when what is gone is left out. Keys are compared as they are, null equal to null.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], columns: list[str], ttl: int | None = None, every: int = 16, rows: int = BUCKET_ROWS):
        self.keys, self.columns, self.ttl, self.every = list(keys), [c for c in columns if c not in keys], ttl, every
        self.runs = MessageStore(spark, path, self.keys, ["__age", "__write"], ["__row"], rows)

    def put(self, rows: DataFrame, version: str, token: str | None = None) -> None:
        """Write rows with the version of each; the same token again replaces what it wrote."""
        v = -F.col(version).cast("long")
        self._write(rows.select(*self.keys, v.alias("__age"), F.struct(*self.columns).alias("__row")), token)

    def remove(self, keys: DataFrame, version: int, token: str | None = None) -> None:
        """Remove the rows of keys as of a version."""
        kind = self._kind()
        if kind is not None:
            self._write(keys.select(*self.keys, F.lit(-version).cast("long").alias("__age"), F.lit(None).cast(kind).alias("__row")), token)

    def _kind(self):
        names = self.runs.names()
        return self.runs._runs(names[:1]).schema["__row"].dataType if names else None

    def _write(self, rows: DataFrame, token: str | None) -> None:
        # of equal versions the later write stands
        self.runs.upsert(rows.withColumn("__write", F.lit(-time.time_ns())), token or uuid.uuid4().hex)
        if len(self.runs.names()) >= self.every:
            gone = F.col("__row").isNull()
            if self.ttl is not None:
                newest = -self.runs.read().agg(F.min("__age")).first()[0]
                gone |= F.col("__age") > self.ttl - newest
            self.runs.compact(but=token, only=~gone)  # what this token wrote may be written again

    def read(self, now: int | None = None, but: str | None = None) -> DataFrame | None:
        """All rows that stand (at a time, where rows expire; as they were without a token's); None while there are no runs."""
        if not any(but is None or not n.startswith(f"b-{but}-") for n in self.runs.names()):
            return None
        live = self.runs.read(but).where("__row is not null")
        if now is not None and self.ttl is not None:
            live = live.where(F.col("__age") <= self.ttl - now)
        return live.select(*self.keys, "__row.*")

    def get(self, now: int | None = None, **key) -> DataFrame | None:
        """The row of a key, or the rows of a part of it."""
        rows = self.read(now)
        for c, v in key.items():
            rows = None if rows is None else rows.where(F.col(c).eqNullSafe(F.lit(v)))
        return rows

    def scan(self, column: str, prefix: str, now: int | None = None) -> DataFrame | None:
        """The rows whose key column begins with a text."""
        rows = self.read(now)
        return None if rows is None else rows.where(F.startswith(F.col(column), F.lit(prefix)))

    def take(self, condition, version: int, token: str | None = None) -> DataFrame | None:
        """The rows that meet a condition, which are removed."""
        from railtide.session import cut

        rows = self.read(but=token)
        if rows is None:
            return None
        taken = cut(rows.where(condition))
        self.remove(taken.select(*self.keys), version, token)
        return taken
