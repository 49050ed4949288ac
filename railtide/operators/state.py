"""Reconciled delay state as a changelog: out-of-order gate, smoothing, confidence streaks and retractions.

The rules are folds in arrival order, but they have a closed form in window functions (see ``changelog``); the fold is
kept for state that expires, where acceptance depends on the expiry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railtide.operators.fold import ordered_fold

KEY = ["agency_id", "trip_id", "stop_id"]
ACTIVE = 60
JUMP, CLOSE, EARLY = 120, 30, 3
TTL = 7200
#: Confidence after k close observations in a row: 0.5 and then 0.1 added k times in binary floating point.
STREAK = (0.5, 0.6, 0.7, 0.7999999999999999, 0.8999999999999999, 0.9999999999999999, 1.0)


def _smooth(x: Column, d: Column) -> Column:
    far = F.abs(x.cast("long") - d.cast("long")) > JUMP
    return F.when(far, F.round(x * F.lit(0.7) + d * F.lit(0.3)).cast("int")).otherwise(x)


def changelog(events: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per event: op upsert, drop or delete, and for upserts the state after it.

    ``events`` has agency_id, trip_id, stop_id, route_id, delay_seconds, observed_at, type and an arrival order. A
    cancelled trip deletes all its stops and a skipped stop itself; what follows starts afresh. Within such a segment an
    event is accepted if it was observed no earlier than any before it. The r-th accepted value counts r updates; only
    the second and third can be smoothed, so two lags give every stored delay. The confidence follows from the number
    of close observations in a row. Rows with a null delay, time or key part are no events and are left out.
    """
    e = events.where("delay_seconds is not null and observed_at is not null and agency_id is not null and trip_id is not null and stop_id is not null")
    e = e.select(F.col(seq).alias("seq"), *KEY, "route_id", "delay_seconds", "observed_at", "type")
    trip = Window.partitionBy("agency_id", "trip_id").orderBy("seq")
    stop = Window.partitionBy(*KEY).orderBy("seq")
    e = e.withColumn("cancel_no", F.count_if(F.col("type") == "TRIP_CANCELLED").over(trip))
    e = e.withColumn("skip_no", F.count_if(F.col("type") == "SKIP_STOP").over(stop))
    deletes = e.where(F.col("type").isin("TRIP_CANCELLED", "SKIP_STOP")).select("seq", *KEY, F.lit("delete").alias("op"), "cancel_no", "skip_no")
    seg = Window.partitionBy(*KEY, "cancel_no", "skip_no").orderBy("seq")
    u = e.where(~F.col("type").isin("TRIP_CANCELLED", "SKIP_STOP"))
    before = F.max("observed_at").over(seg.rowsBetween(Window.unboundedPreceding, -1))
    u = u.withColumn("ok", F.coalesce(F.col("observed_at") >= before, F.lit(True)))
    ups = Window.partitionBy(*KEY, "cancel_no", "skip_no", "ok").orderBy("seq")
    x = F.col("delay_seconds")
    u = u.withColumns({"r": F.row_number().over(ups), "x1": F.lag(x, 1).over(ups), "x2": F.lag(x, 2).over(ups)})
    d = F.when(F.col("r") == 2, _smooth(x, F.col("x1"))).when(F.col("r") == EARLY, _smooth(x, _smooth(F.col("x1"), F.col("x2")))).otherwise(x)
    u = u.withColumn("d", d.cast("int"))
    near = F.abs(x.cast("long") - F.lag("d").over(ups).cast("long")) <= CLOSE
    u = u.withColumn("island", F.sum(F.when(near, 0).otherwise(1)).over(ups))
    streak = Window.partitionBy(*KEY, "cancel_no", "skip_no", "ok", "island").orderBy("seq")
    u = u.withColumn("k", F.row_number().over(streak))
    conf = F.element_at(F.array(*(F.lit(c) for c in STREAK)), F.least(F.col("k"), F.lit(len(STREAK))))
    kept = lambda v: F.when(F.col("ok"), v)
    out = u.select("seq", *KEY, F.when(F.col("ok"), "upsert").otherwise("drop").alias("op"), "cancel_no", "skip_no", kept(F.col("route_id")).alias("route_id"),
                   kept(F.col("d")).alias("delay_seconds"), kept(F.col("observed_at")).alias("observed_at"), kept(conf).alias("confidence"), kept(F.col("r")).cast("int").alias("update_count"))
    return out.unionByName(deletes, allowMissingColumns=True)


def current(log: DataFrame) -> DataFrame:
    """The state that holds after all of a changelog: the last upsert of each key that no later delete took away."""
    total = log.groupBy("agency_id", "trip_id").agg(F.max("cancel_no").alias("__c"))
    last = log.groupBy(*KEY).agg(F.max("skip_no").alias("__s"), F.max_by(F.struct("cancel_no", "skip_no", "route_id", "delay_seconds", "observed_at", "confidence", "update_count"), F.when(F.col("op") == "upsert", F.col("seq"))).alias("u"))
    live = last.join(total, ["agency_id", "trip_id"]).where("u is not null and u.cancel_no = __c and u.skip_no = __s")
    return live.select(*KEY, "u.route_id", "u.delay_seconds", "u.observed_at", "u.confidence", "u.update_count")


def as_of(probes: DataFrame, log: DataFrame, seq: str, agency: str, trip: str, stop: str, out: str = "state_delay") -> DataFrame:
    """probes with the stored delay of a key at their arrival (own event included); null where there is no state."""
    p = probes.withColumns({"__seq": F.col(seq), "__a": F.col(agency), "__t": F.col(trip), "__s": F.col(stop)})
    cols = p.columns
    p = p.withColumn("__probe", F.lit(1))
    m = log.where("op <> 'drop'").select(
        F.col("seq").alias("__seq"), F.col("agency_id").alias("__a"), F.col("trip_id").alias("__t"), F.col("stop_id").alias("__s"),
        F.when(F.col("op") == "upsert", F.struct("delay_seconds", "cancel_no", "skip_no")).alias("__u"),
        F.when(F.col("op") == "delete", F.col("cancel_no")).alias("__cn"), F.when(F.col("op") == "delete", F.col("skip_no")).alias("__sn"), F.lit(0).alias("__probe"))
    both = p.unionByName(m, allowMissingColumns=True)
    of_trip = Window.partitionBy("__a", "__t").orderBy("__seq", "__probe")
    of_stop = Window.partitionBy("__a", "__t", "__s").orderBy("__seq", "__probe")
    both = both.withColumns({
        "__u": F.last("__u", ignorenulls=True).over(of_stop), "__sn": F.coalesce(F.max("__sn").over(of_stop), F.lit(0)),
        "__cn": F.coalesce(F.max("__cn").over(of_trip), F.lit(0))})
    held = F.when((F.col("__u.cancel_no") == F.col("__cn")) & (F.col("__u.skip_no") == F.col("__sn")), F.col("__u.delay_seconds"))
    return both.where("__probe = 1").select(*(c for c in cols if not c.startswith("__")), held.alias(out))


def changes(log: DataFrame) -> DataFrame:
    """(agency_id, trip_id, stop_id, seq, delay): what changes the stored delay of a key that ever had one; null where it is deleted."""
    up = log.where("op = 'upsert'").select(*KEY, "seq", F.col("delay_seconds").alias("delay"))
    none = F.lit(None).cast("int").alias("delay")
    gone = log.where("op = 'delete'")
    # the first delete of a number of cancellations is that cancellation, which takes all stops of the trip
    cancels = gone.where("cancel_no > 0").groupBy("agency_id", "trip_id", "cancel_no").agg(F.min("seq").alias("seq"))
    of_all = cancels.join(up.select(*KEY).distinct(), ["agency_id", "trip_id"]).select(*KEY, "seq", none)
    return up.unionByName(gone.select(*KEY, "seq", none)).unionByName(of_all)


def reconcile_with_ttl(events: DataFrame, seq: str = "seq", arrived: str = "received_at", ttl: int = TTL, stored: DataFrame | None = None) -> DataFrame:
    """The changelog's upserts and drops where a key also expires ``ttl`` seconds of arrival time after its last accepted
    event. An ordered fold per trip: a cancelled trip clears all its stops. ``stored`` is the state before the events
    (key, delay_seconds, observed_at, confidence, update_count, arrived), from which their trips go on."""
    rows = events.where("delay_seconds is not null and observed_at is not null").select(
        F.col(seq).alias("seq"), F.col(arrived).alias("arrived"), *KEY, "delay_seconds", "observed_at", "type",
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("int").alias("update_count"))
    if stored is not None:
        own = stored.join(rows.select("agency_id", "trip_id").distinct(), ["agency_id", "trip_id"], "left_semi")
        rows = rows.unionByName(own.select(F.lit(None).cast("long").alias("seq"), "arrived", *KEY, "delay_seconds", "observed_at", F.lit("STORED").alias("type"), "confidence", "update_count"))

    def step(state, row):
        if row.type == "STORED":  # without a number of arrival these come first
            state[row.stop_id] = (row.delay_seconds, row.observed_at, row.confidence, row.update_count, row.arrived)
            return state, []
        if row.type == "TRIP_CANCELLED":
            return {}, []
        if row.type == "SKIP_STOP":
            state.pop(row.stop_id, None)
            return state, []
        old = state.get(row.stop_id)
        if old and row.arrived - old[4] > ttl:
            old = None
        x = row.delay_seconds
        key = (row.seq, row.agency_id, row.trip_id, row.stop_id)
        if old is None:
            new = (x, row.observed_at, 0.5, 1, row.arrived)
        elif row.observed_at < old[1]:
            return state, [(*key, "drop", None, None, None, None)]
        else:
            d = x
            if abs(x - old[0]) > JUMP and old[3] < EARLY:
                v = x * 0.7 + old[0] * 0.3
                d = int(abs(v) + 0.5) * (1 if v >= 0 else -1)
            new = (d, row.observed_at, min(1.0, old[2] + 0.1) if abs(x - old[0]) <= CLOSE else 0.5, old[3] + 1, row.arrived)
        state[row.stop_id] = new
        return state, [(*key, "upsert", *new[:4])]

    return ordered_fold(rows, ["agency_id", "trip_id"], ["seq"], "seq long, agency_id string, trip_id string, stop_id string, op string, "
                        "delay_seconds int, observed_at long, confidence double, update_count int", dict, step)


def active(state: DataFrame) -> DataFrame:
    """Delays of more than a minute either way."""
    return state.where(F.abs(F.col("delay_seconds").cast("long")) > ACTIVE)


def live_max(state: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """(route_id, station, delay): the largest active lateness per route and parent station."""
    from railtide.sources.gtfs import with_station

    s = state.where(F.col("delay_seconds") > ACTIVE)
    s = with_station(s, stops) if stops is not None else s.withColumn("station", F.col("stop_id"))
    return s.groupBy("route_id", "station").agg(F.max("delay_seconds").alias("delay"))


def delay_stats(state: DataFrame) -> DataFrame:
    """One row over the active delays: count, mean and largest size."""
    size = F.abs(F.col("delay_seconds").cast("long"))
    return active(state).agg(F.count("*").alias("active"), F.avg(size).alias("mean_abs"), F.max(size).alias("max_abs"))


def top_delays(state: DataFrame, k: int = 5) -> DataFrame:
    """The k largest active delays of each route, largest first, with how many more there are."""
    w = Window.partitionBy("route_id").orderBy(F.desc("delay_seconds"), "trip_id", "stop_id")
    a = active(state).withColumn("position", F.row_number().over(w)).withColumn("more", F.greatest(F.lit(0), F.count("*").over(Window.partitionBy("route_id")) - k))
    return a.where(F.col("position") <= k).select("route_id", "position", "trip_id", "stop_id", "delay_seconds", "more")
