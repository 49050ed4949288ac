"""Messages delivered more than once: an idempotent upsert store of hash-bucketed sorted runs, merged by compaction.

An upsert writes one sorted run: the batch is collapsed to one row per identifier (partial aggregation before the
shuffle, so a message delivered a million times moves one row per task), placed by hash bucket and sorted by the
identifier's hash; one shuffle does both. A batch delivered again is a run of the same token and takes its place.
Compaction reads one bucket of all runs per task, straight from their files and without a shuffle, merges the sorted runs
and collapses equal identifiers to the first delivery. The number of buckets follows from the number of rows, so that a
bucket fits a task; whatever repeats is gone from a run before, so a hot identifier makes no large bucket.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railtide.functions.ids import clean
from railtide.session import shared_path

#: Rows of a bucket that one task merges.
BUCKET_ROWS = 500_000
#: The most buckets that the file source reads as such.
MAX_BUCKETS = 100_000


def first_of(df: DataFrame, ids: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per identifier, the one with the smallest (order, keep); null ids are ids like others."""
    rest = [c for c in keep if c not in order]
    return (
        df.groupBy(*ids).agg(F.min(F.struct(*order, *rest)).alias("__first"))
        .select(*ids, *(F.col(f"__first.{c}").alias(c) for c in dict.fromkeys([*order, *rest])))
    )


def message_id() -> list[Column]:
    return [clean("trip_id").alias("trip_id"), clean("stop_id").alias("stop_id"), F.col("observed_at")]


def complete_runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs of a folder that were written to their end."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName().removeprefix("run=") for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets for a number of rows: a multiple of the shuffle partitions, so that a shuffle partition holds whole buckets."""
    parts = int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-rows // BUCKET_ROWS)
    return min(MAX_BUCKETS, max(1, -(-wanted // parts)) * parts)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """SQL settings for the time of a block."""
    names = {k: "spark.sql.sources.bucketing." + k for k in values}
    old = {n: spark.conf.get(n, None) for n in names.values()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


class MessageStore:
    """A folder of sorted runs. Identifiers, the order that says which copy is first, and the columns kept are fixed.

    Nulls in identifiers compare as equal; among copies nulls in the order columns come first. A store without
    runs reads as an empty table. Columns other than ids, order and keep are not stored, whatever their names. The number
    of buckets is that of the folder where it has runs already, whatever is asked for.
    """

    def __init__(self, spark: SparkSession, path: str | None, ids: list[str], order: list[str], keep: list[str] = (), rows: int = BUCKET_ROWS):
        self.spark = spark
        self.ids, self.order, self.keep = list(ids), list(order), list(keep)
        self.columns = list(dict.fromkeys([*self.ids, *self.order, *self.keep]))
        root = path or shared_path(spark, "messages")
        known = [n for n in self._folders(root) if n.startswith("buckets=")]
        self.buckets = int(known[0].removeprefix("buckets=")) if known else bucket_count(spark, rows)
        self.path = f"{root}/buckets={self.buckets}"

    def _folders(self, path: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _write(self, df: DataFrame, name: str) -> None:
        """Write a run in buckets, sorted. The table is only the writer's way to a bucketed folder and goes at once."""
        table = f"railtide_run_{uuid.uuid4().hex}"
        try:
            (df.write.bucketBy(self.buckets, *self.ids).sortBy("__hash", *self.ids).option("path", f"{self.path}/run={name}").format("parquet").saveAsTable(table))
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        if not any(f.startswith("part-") for f in self._folders(f"{self.path}/run={name}")):
            delete(self.spark, f"{self.path}/run={name}")  # no rows: no run

    def names(self) -> list[str]:
        return complete_runs(self.spark, self.path)

    def upsert(self, batch: DataFrame, token: str) -> None:
        """Write a batch as the sorted run of its token; the same token again replaces it, once it is complete."""
        name = f"b-{token}-{uuid.uuid4().hex[:8]}"
        first = first_of(batch.select(*self.columns), self.ids, self.order, self.keep)
        self._write(first.withColumn("__hash", F.xxhash64(*self.ids)), name)
        for old in self.names():
            if old.startswith(f"b-{token}-") and old != name:
                delete(self.spark, f"{self.path}/run={old}")

    def _runs(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/run={n}" for n in names))

    def read(self, but: str | None = None) -> DataFrame:
        """One row per identifier over all runs, or all but a token's. A compacted store is read as it is, others are aggregated."""
        names = [n for n in self.names() if but is None or not n.startswith(f"b-{but}-")]
        if not names:
            raise ValueError("the store has no runs yet")
        if len(names) == 1:  # a run holds each identifier once
            return self._runs(names).select(*self.columns)
        return first_of(self._runs(names), self.ids, self.order, self.keep).select(*self.columns)

    def _merged(self, names: list[str], view: str) -> DataFrame:
        """All runs bucket by bucket: every task gets one bucket's files of all runs, and merges them."""
        schema = self._runs(names[:1]).schema
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{c}`" for c in self.ids)
        self.spark.sql(f"CREATE TABLE {view} ({cols}, run STRING) USING parquet PARTITIONED BY (run) CLUSTERED BY ({by}) SORTED BY (`__hash`, {by}) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        for n in names:
            self.spark.sql(f"ALTER TABLE {view} ADD IF NOT EXISTS PARTITION (run = '{n}') LOCATION '{self.path}/run={n}'")
        runs = self.spark.table(view).drop("run")
        return runs.mapInArrow(merger(self.ids, self.order, [c for c in self.keep if c not in self.order]), T.StructType(schema.fields))

    def compact(self, but: str | None = None, only: Column | None = None) -> int:
        """Merge all runs (but a token's) into one, keeping of it only what a condition says; the number of runs merged.
        The new run is complete before the old ones go."""
        names = [n for n in self.names() if but is None or not n.startswith(f"b-{but}-")]
        if len(names) > 1 or (names and only is not None):
            view = f"railtide_runs_{uuid.uuid4().hex}"
            merged = f"m-{hashlib.sha256('/'.join(names).encode()).hexdigest()[:16]}"  # never one of the names it is made of
            try:
                with _settings(self.spark, **{"enabled": "true", "autoBucketedScan.enabled": "false", "maxBuckets": str(MAX_BUCKETS)}):
                    rows = self._merged(names, view)
                    if rows.rdd.getNumPartitions() != self.buckets:
                        raise RuntimeError("the runs aren't read by bucket")
                    self._write(rows if only is None else rows.where(only), merged)
            finally:
                self.spark.sql(f"DROP TABLE IF EXISTS {view}")
            for n in names:
                delete(self.spark, f"{self.path}/run={n}")
        return len(names)


def merger(ids: list[str], order: list[str], keep: list[str]):
    """A kernel over one bucket's sorted runs, one after the other: the rows of all in one order, the first of equal ids.

    Runs are sorted by the hash of the identifier. A stable merge sort of runs that are sorted already is their merge: it
    finds the runs and joins them pairwise. Only rows whose hash isn't alone are compared by their identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        h = t["__hash"].to_numpy()
        at = np.argsort(h, kind="stable")
        h = h[at]
        same = h[1:] == h[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        stays = ~shared
        if shared.any():
            ties = [c for c in keep if not pa.types.is_nested(t.schema.field(c).type)]
            some = t.select(["__hash", *ids, *order, *ties]).take(at[shared]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)
            first = some.sort_values(["__hash", *ids, *order, *ties], na_position="first", kind="stable").drop_duplicates(ids).index
            stays[np.flatnonzero(shared)[first]] = True
        yield from t.take(at[stays]).combine_chunks().to_batches(max_chunksize=50_000)

    return run


def first_deliveries(events: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Each message's first delivery: smallest received_at, then delivery_id. Adds the columns of keep."""
    rows = events.select(*message_id(), "received_at", "delivery_id", *keep)
    return first_of(rows, ["trip_id", "stop_id", "observed_at"], ["received_at", "delivery_id"], list(keep))


def repeated_deliveries(events: DataFrame, path: str | None = None, batches: int = 4) -> DataFrame:
    """delivery_id of all deliveries of a message but its first.

    The deliveries are upserted in consumer order in ``batches`` runs and compacted. What the store does not keep is a
    repetition; deliveries are matched by their unique id, so a message with a third of all rows makes no hot key. Null
    parts of an identifier compare as equal, without received_at a delivery is before others; an empty table has none.
    """
    rows = events.select(*message_id(), "received_at", "delivery_id")
    low, high, count = events.agg(F.min("delivery_id"), F.max("delivery_id"), F.count("*")).first()
    if low is None:
        return rows.select("delivery_id").limit(0)
    store = MessageStore(events.sparkSession, path, ["trip_id", "stop_id", "observed_at"], ["received_at", "delivery_id"], rows=count)
    width = -(-(high - low + 1) // batches)
    for i in range(batches):
        a, b = low + i * width, min(high, low + (i + 1) * width - 1)
        if a <= b:
            store.upsert(rows.where(F.col("delivery_id").between(a, b)), f"{i:05d}")
    store.compact()
    kept = store.read().select("delivery_id")
    return events.select("delivery_id").join(kept, "delivery_id", "left_anti")
