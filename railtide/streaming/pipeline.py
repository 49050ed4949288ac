"""The whole chain over a stream of delay events: state, transfers, alerts, cascades, predictions and what is learned.

One micro-batch is one pass over the chain by ``foreachBatch``; what must outlive it is in stores under one folder (see
operators.store), keyed by the batch, so that a batch applied again replaces what it wrote. When the stream lags, only
the state is kept up; when too many cascades run, further ones are shed. Both are counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtide import schema
from railtide.config import Propagation
from railtide.operators import cascade, evaluation, events, state, transfers
from railtide.operators.store import KeyedStore
from railtide.session import cut
from railtide.sources import topics
from railtide.sources.gtfs import Timetable, with_station
from railtide.streaming.alerts import AlertHub
from railtide.streaming.metrics import Metrics
from railtide.streaming.policy import CatchUp, Shedder

STORED = ["agency_id", "trip_id", "stop_id", "route_id", "delay_seconds", "observed_at", "confidence", "update_count", "arrived"]


def _names(kind: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in kind.split(", ")]


class Pipeline:
    """``apply`` is the function of foreachBatch. ``now`` gives the seconds of the clock, ``lag`` the messages yet to come."""

    def __init__(self, spark: SparkSession, timetable: Timetable, folder: str, agency: str, cfg: Propagation = Propagation(), hub: AlertHub | None = None,
                 metrics: Metrics | None = None, shedder: Shedder | None = None, now: Callable[[], int] | None = None, lag: Callable[[], int] | None = None):
        import time

        self.spark, self.t, self.folder, self.agency, self.cfg = spark, timetable, folder, agency, cfg
        self.hub, self.metrics, self.shedder = hub or AlertHub(), metrics or Metrics(), shedder
        self.now, self.lag, self.catch_up = now or (lambda: int(time.time())), lag or (lambda: 0), CatchUp()
        self.state = KeyedStore(spark, f"{folder}/state", state.KEY, STORED, ttl=state.TTL)
        self.pending = KeyedStore(spark, f"{folder}/pending", ["id"], _names(schema.PENDING))

    def current(self, now: int | None = None) -> DataFrame:
        """The delay state that stands."""
        rows = self.state.read(now)
        return rows if rows is not None else self.spark.createDataFrame([], f"{schema.DELAY_STATE}, arrived long")

    def history(self) -> DataFrame:
        return self._learned("history", schema.HISTORY)

    def stop_history(self) -> DataFrame:
        return self._learned("stop_history", schema.STOP_HISTORY)

    def _learned(self, name: str, kind: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(f"{kind}, batch long").parquet(f"{self.folder}/{name}").drop("batch")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        now = self.now()
        rows = cut(events.enrich(batch, self.t).withColumn("seq", F.monotonically_increasing_id()).withColumn("arrived", F.lit(now).cast("long")))
        n, hits, misses = rows.agg(F.count("*"), F.count_if("enriched"), F.count_if(~F.col("enriched"))).first()
        self.metrics.add("events", n)
        self.metrics.add("enriched", hits, result="hit")
        self.metrics.add("enriched", misses, result="miss")
        self._keep_state(rows, batch_id, now)
        if self.catch_up.update(self.lag()):
            self.metrics.add("skipped_batches")
        else:
            impacts = cut(transfers.transfer_impacts(rows.where(F.col("type").isin("ARRIVAL_DELAY", "DEPARTURE_DELAY")), self.t, state=self.current(now)))
            topics.write(impacts, "transfer-impacts", folder=self.folder)
            sent, lost = self.hub.publish(impacts)
            self.metrics.add("alerts", sent, result="sent")
            self.metrics.add("alerts", lost, result="dropped")
            broken = impacts.where("level = 'BROKEN'").withColumn("impact_id", F.concat_ws(":", F.lit(batch_id), "seq", "to_route_id", "station_id", "earliest_catch_secs"))
            if self.shedder is None:
                self._propagate(broken, batch_id, now)
            elif not self.shedder.run(self._propagate, broken, batch_id, now):
                self.metrics.add("shed_batches")
        self._evaluate(rows, batch_id, now)

    def _keep_state(self, rows: DataFrame, batch_id: int, now: int) -> None:
        token = f"{batch_id:08d}"
        before = self.state.read(now, token)
        log = state.reconcile_with_ttl(rows, arrived="arrived", stored=before)
        last = log.where("op = 'upsert'").groupBy(*state.KEY).agg(F.max_by(F.struct("seq", "delay_seconds", "observed_at", "confidence", "update_count"), "seq").alias("u")).select(*state.KEY, "u.*")
        last = last.join(rows.select("seq", "route_id"), "seq")
        gone = rows.where("type = 'TRIP_CANCELLED'").groupBy("agency_id", "trip_id").agg(F.max("seq").alias("cancelled"))
        skipped = rows.where("type = 'SKIP_STOP'").groupBy(*state.KEY).agg(F.max("seq").alias("skipped"))
        every = last.select(*state.KEY, "seq")
        if before is not None:
            every = every.unionByName(before.join(last, state.KEY, "left_anti").select(*state.KEY, F.lit(-1).cast("long").alias("seq")))
        dead = every.join(gone, ["agency_id", "trip_id"], "left").join(skipped, state.KEY, "left").where("coalesce(cancelled, -2) > seq or coalesce(skipped, -2) > seq")
        dead = cut(dead.select(*state.KEY))
        live = last.join(dead, state.KEY, "left_anti").withColumn("arrived", F.lit(now).cast("long"))
        # one write, so that the token stands for all of it: removed keys are rows without a value
        value = F.struct(*(c for c in STORED if c not in state.KEY))
        age = F.lit(-now).cast("long").alias("__age")
        live = live.select(*state.KEY, age, value.alias("__row"))
        self.state._write(live.unionByName(dead.select("*", age, F.lit(None).cast(live.schema["__row"].dataType).alias("__row"))), token)

    def _propagate(self, broken: DataFrame, batch_id: int, now: int) -> None:
        held = cut(self.current(now))
        live = state.live_max(held, self.t.stops)
        now_ns = now * 1_000_000_000
        estimated = cascade.initial_estimates(broken, self.t, live, cascade.average_impacts(self.history(), now_ns), self.cfg)
        found = cut(cascade.cascade(estimated, self.t, live, cascade.average_stop_impacts(self.stop_history(), now_ns), self.cfg))
        topics.write(found.join(broken.select("impact_id", F.col("station_id").alias("source_stop_id")), "impact_id"), "network-predictions", folder=self.folder)
        self.metrics.add("predictions", found.count())
        self.pending.put(evaluation.track(broken, found, held, self.t, self.agency).withColumn("version", F.lit(batch_id * 4)), "version", f"t{batch_id:08d}")

    def _evaluate(self, rows: DataFrame, batch_id: int, now: int) -> None:
        waiting = self.pending.read(but=f"m{batch_id:08d}")
        if waiting is None:
            return
        seen = evaluation.match(waiting.where(F.col("expires_at") >= now - evaluation.WINDOW), with_station(rows, self.t.stops), self.t.trips)
        seen = seen.where("matched").select("id", F.col("observed_max").alias("more"))
        moved = waiting.join(seen, "id").withColumns({"observed_max": F.greatest("observed_max", F.col("more").cast("int")), "matched": F.lit(True), "version": F.lit(batch_id * 4 + 1)})
        self.pending.put(cut(moved), "version", f"m{batch_id:08d}")
        done = self.pending.take(F.col("expires_at") <= now, batch_id * 4 + 2, f"x{batch_id:08d}")
        if done is None:
            return
        swept = cut(evaluation.sweep(done, evaluation.realized_wait(done, self.t, self.current(now))))
        for r in swept.groupBy("outcome").count().collect():
            self.metrics.add("finalized", r["count"], outcome=r["outcome"])
        for name, learned in (("history", evaluation.learned_history), ("stop_history", evaluation.learned_stop_history)):
            learned(swept, now * 1_000_000_000).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")


def start(stream: DataFrame, pipeline: Pipeline, checkpoint: str, **trigger):
    """Run a stream of delay events (schema.DELAY_EVENT) through the chain."""
    return stream.writeStream.foreachBatch(pipeline.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
