"""Per-period aggregates of a stream, corrected as late records arrive: a store of pane deltas fed by foreachBatch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtide.functions.ids import clean, is_measurement, route
from railtide.operators.messages import MessageStore, complete_runs, delete, first_of
from railtide.operators.panes import HOUR, cut_off
from railtide.session import cut, shared_path

KEY = ["agency_id", "route", "hour"]
IDS = ["trip_id", "stop_id", "observed_at"]
DAY = 86_400
#: Batches after which runs are merged.
EVERY = 8
#: Seconds past its cut-off after which a message is forgotten: a repetition that comes later still counts as a late record.
KEEP = 86_400


class HourStore:
    """Hours of routes as panes: a micro-batch writes its deltas as one run, and only the hours it touches are recomposed.

    Batches must arrive in order of received_at, as a consumer sees them: a message already stored is a repetition. A
    batch applied again replaces its run. Records after their cut-off are counted apart and change nothing. All is kept
    in the folder, so a restarted stream goes on where it was. Every ``every`` batches the runs of earlier batches are
    merged into one, and messages are forgotten ``keep`` seconds after their cut-off, so what a batch reads is bounded by
    the time that repetitions may take and by the days that it touches, not by the age of the stream.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, every: int = EVERY, keep: int = KEEP):
        self.spark, self.path, self.every, self.keep = spark, path or shared_path(spark, "hours"), every, keep
        self.seen = MessageStore(spark, f"{self.path}/seen", IDS, ["received_at", "delivery_id"])

    def apply(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Fold a batch in; the hours it changed, with their new values."""
        rows = batch.where("observed_at is not null").select(
            clean("trip_id").alias("trip_id"), clean("stop_id").alias("stop_id"), "observed_at", "received_at", "delivery_id",
            clean("agency_id").alias("agency_id"), route().alias("route"), "delay_seconds", is_measurement().alias("measured"))
        first = first_of(rows, IDS, ["received_at", "delivery_id"], ["agency_id", "route", "delay_seconds", "measured"])
        token = f"{batch_id:08d}"
        if any(not n.startswith(f"b-{token}-") for n in self.seen.names()):
            old = self.seen.read(token).select(*(F.col(c).alias(f"__{c}") for c in IDS))
            same = F.lit(True)
            for c in IDS:
                same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
            first = first.join(old, same, "left_anti")
        new = cut(first)
        late = F.coalesce(F.col("received_at") > cut_off("observed_at"), F.lit(False))
        hour = F.floor(F.col("observed_at") / HOUR)
        x = F.when(~late, F.col("delay_seconds"))
        delta = new.where("measured").groupBy("agency_id", "route", hour.alias("hour")).agg(
            F.count(x).alias("n"), F.sum(x.cast("long")).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"),
            F.count(F.when(~late & (F.col("received_at") < (hour + 1) * HOUR), 1)).alias("n_first"), F.count(F.when(late, 1)).alias("n_late"))
        self._write(delta, f"{batch_id:08d}-{batch_id:08d}")
        self.seen.upsert(new.select(*IDS, "received_at", "delivery_id"), token)
        if (batch_id + 1) % self.every == 0:
            self.compact(batch_id)
        return self._changed(batch_id, delta)

    def _changed(self, batch_id: int, delta: DataFrame) -> DataFrame:
        touched = cut(delta.select(*KEY))
        days = [r["day"] for r in touched.select(self._day()).distinct().orderBy("day").limit(1001).collect()]
        panes = self._panes()
        if len(days) <= 1000:  # else all days are read
            panes = panes.where(F.col("day").isin(days))
        return self._summed(panes).join(touched, KEY, "left_semi")

    @staticmethod
    def _day():
        return F.floor(F.col("hour") / 24).cast("long").alias("day")

    def _write(self, panes: DataFrame, name: str) -> None:
        panes.withColumn("day", self._day()).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/panes/run={name}")

    def _runs(self) -> list[str]:
        """Names first-last of the runs that hold every batch once: a merged run stands for those that it covers."""
        runs = sorted(complete_runs(self.spark, f"{self.path}/panes"), key=lambda n: (int(n[:8]), -int(n[9:17])))
        kept, last = [], -1
        for n in runs:
            if int(n[9:17]) > last:
                kept.append(n)
                last = int(n[9:17])
        return kept

    def _panes(self) -> DataFrame:
        names = self._runs()
        if not names:
            raise ValueError("the store has no runs yet")
        kind = "agency_id string, route string, hour long, n long, total long, low int, high int, n_first long, n_late long, day long"
        out = None
        for n in names:
            p = self.spark.read.schema(kind).parquet(f"{self.path}/panes/run={n}")
            out = p if out is None else out.unionByName(p)
        return out

    @staticmethod
    def _summed(panes: DataFrame) -> DataFrame:
        total = [F.sum(c).alias(c) for c in ("n", "total")] + [F.min("low").alias("low"), F.max("high").alias("high")] + [F.sum(c).alias(c) for c in ("n_first", "n_late")]
        return panes.groupBy(*KEY).agg(*total)

    def read(self) -> DataFrame:
        """All hours: agency_id, route, hour, n, total, low, high, n_first (counted when the hour ended), n_late."""
        return self._summed(self._panes())

    def compact(self, batch_id: int) -> None:
        """Merge what earlier batches wrote, this one's run apart, since it may be applied again; forget old messages."""
        old = [n for n in self._runs() if int(n[9:17]) < batch_id]
        if len(old) > 1:
            self._write(self._summed(self._panes_of(old)), f"{old[0][:8]}-{old[-1][9:17]}")
            for n in complete_runs(self.spark, f"{self.path}/panes"):
                if int(n[:8]) >= int(old[0][:8]) and int(n[9:17]) <= int(old[-1][9:17]) and n != f"{old[0][:8]}-{old[-1][9:17]}":
                    delete(self.spark, f"{self.path}/panes/run={n}")
        token = f"{batch_id:08d}"
        known = any(not n.startswith(f"b-{token}-") for n in self.seen.names())
        # what this batch may hold, should it be applied again, came after all that earlier batches held
        newest = self.seen.read(token).agg(F.max("received_at")).first()[0] if known else None
        if newest is not None:
            self.seen.compact(but=token, only=F.coalesce(cut_off("observed_at") + F.lit(self.keep) >= F.lit(newest), F.lit(True)))

    def _panes_of(self, names: list[str]) -> DataFrame:
        runs = self.spark.read.option("basePath", f"{self.path}/panes").parquet(*(f"{self.path}/panes/run={n}" for n in names))
        return runs.drop("run", "day")


def start(stream: DataFrame, store: HourStore, emit, checkpoint: str, **trigger):
    """Run a stream of delay events into the store; ``emit(changed, batch_id)`` gets the recomposed hours of each batch."""
    def fold(batch: DataFrame, batch_id: int) -> None:
        emit(store.apply(batch, batch_id), batch_id)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
