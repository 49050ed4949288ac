"""The feedback loop: track predictions, match them with later events, finalize them, and learn from the outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railtide.functions.time import confidence_bucket, hour_of, seconds_of_day
from railtide.operators.panes import pane_points
from railtide.operators.schedule import departure_minutes, next_second
from railtide.session import broadcast_if_small
from railtide.sources.gtfs import Timetable, with_station

WINDOW = 1800
MIN_CONFIDENCE = 0.3
MAX_TRACKED = 20
BASELINE_ROUTES = 3
CANDIDATES = 10
MIN_VERIFIED, RATIO = 15, 0.5
RETENTION_NS = 30 * 86_400 * 1_000_000_000
ERROR_BUCKETS = (5, 15, 30, 60, 120, 300, 600, 1200)
HOUR = 3600


def baseline_delays(results: DataFrame, state: DataFrame, stops: DataFrame) -> DataFrame:
    """(impact_id, route_id, station, baseline): the largest stored lateness per station, for the first three distinct
    routes of a result in the order of its impacts."""
    first = results.groupBy("impact_id", "route_id").agg(F.min("position").alias("at"))
    rank = F.row_number().over(Window.partitionBy("impact_id").orderBy("at"))
    routes = first.withColumn("n", rank).where(F.col("n") <= BASELINE_ROUTES).select("impact_id", "route_id")
    base = with_station(state.where("delay_seconds > 0"), stops).groupBy("route_id", "station").agg(F.max("delay_seconds").alias("baseline"))
    wanted = results.select("impact_id", "route_id", F.col("stop_id").alias("station")).distinct()
    return wanted.join(routes, ["impact_id", "route_id"], "left_semi").join(base, ["route_id", "station"]).select("impact_id", "route_id", "station", "baseline")


def track(impacts: DataFrame, results: DataFrame, state: DataFrame, t: Timetable, agency: str, computed_at: str = "detected_at") -> DataFrame:
    """Pending predictions of cascade results: the primary first, then in order, at most 20 of each result.

    The primary is the one-hop impact on the receiving route with the smallest delay, the first of equals. Others need
    a confidence of 0.3. Ids are made of the impact and the position, so tracking again gives the same ids.
    """
    trips = t.trips.select(F.col("trip_id").alias("__t"), F.col("direction_id").alias("__d"))
    src = with_station(impacts, t.stops, "station_id", "source_station").join(trips, F.col("next_viable_trip_id") == F.col("__t"), "left")
    src = src.select("impact_id", F.col("from_route_id").alias("from_route"), "to_route_id", "source_station", F.coalesce("__d", F.lit(-1)).alias("__dir"),
                     F.col("source_delay_seconds").alias("source_delay_secs"), F.col("sched_connection_departure_secs").alias("sched_conn_dep_secs"),
                     "earliest_catch_secs", F.col(computed_at).alias("created_at"))
    r = results.join(src, "impact_id")
    own = (F.col("hops_from_source") == 1) & (F.col("route_id") == F.col("to_route_id"))
    best = F.row_number().over(Window.partitionBy("impact_id").orderBy(own.desc(), "predicted_additional_delay", "position"))
    r = r.withColumn("is_primary", own & (best == 1)).where(F.col("is_primary") | (F.col("confidence").cast("double") >= MIN_CONFIDENCE))
    order = F.row_number().over(Window.partitionBy("impact_id").orderBy(F.desc("is_primary"), "position"))
    r = r.withColumn("__n", order).where(F.col("__n") <= MAX_TRACKED)
    b = baseline_delays(results, state, t.stops).withColumnRenamed("station", "stop_id")
    r = r.join(b, ["impact_id", "route_id", "stop_id"], "left")
    return r.select(
        F.concat_ws(":", "from_route", "route_id", "stop_id", "impact_id", "position").alias("id"), F.lit(agency).alias("agency_id"), "from_route", "route_id",
        F.col("stop_id").alias("station_id"), "source_station", F.when(F.col("route_id") == F.col("to_route_id"), F.col("__dir")).otherwise(-1).cast("int").alias("direction"),
        "source_delay_secs", F.col("predicted_additional_delay").alias("predicted_secs"), F.coalesce("baseline", F.lit(0)).cast("int").alias("baseline_secs"),
        "sched_conn_dep_secs", "earliest_catch_secs", F.col("confidence").cast("double").alias("confidence"), F.col("hops_from_source").cast("int").alias("hops"),
        hour_of(seconds_of_day("created_at", t.tz)).alias("hour"), "is_primary", "created_at", (F.col("created_at") + WINDOW).alias("expires_at"),
        F.lit(0).alias("observed_max"), F.lit(False).alias("matched"))


def add_pending(pending: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """The table with new predictions; those that expired over ten minutes ago are refused, known ids are kept as they are."""
    return pending.unionByName(new.where(F.col("expires_at") + 600 > now).join(pending.select("id"), "id", "left_anti"))


def pop_expired(pending: DataFrame, now: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(expired, rest): what has expired, up to a limit earliest first, and the table without it."""
    expired = pending.where(F.col("expires_at") <= now)
    if limit is not None:
        expired = expired.orderBy("expires_at", "id").limit(limit)
    return expired, pending.join(expired.select("id"), "id", "left_anti")


def match(pending: DataFrame, events: DataFrame, directions: DataFrame | None = None) -> DataFrame:
    """(id, observed_max, matched) of distinct predictions after the events observed in their windows.

    ``events`` has agency_id, route_id, station, trip_id, delay_seconds, observed_at, type; only measurements count.
    Events are first brought down to panes, the slices between the bounds of all windows of a route and station (see
    panes), and windows are put together from the panes that they cover, so no event meets every window around it.
    ``directions`` (trip_id, direction_id) holds a prediction with a direction to events of trips that are not known to
    run the other way: an event stands once for all directions and once for its own. A prediction without a baseline
    takes 0.
    """
    p = pending.select("id", "agency_id", "route_id", F.col("station_id").alias("station"), "direction", "baseline_secs", "created_at", "expires_at").distinct()
    e = events.where(F.col("type").isin("ARRIVAL_DELAY", "DEPARTURE_DELAY") & F.col("delay_seconds").isNotNull() & F.col("observed_at").isNotNull())
    if directions is not None:
        e = e.join(directions.select("trip_id", F.col("direction_id").alias("__dir")), "trip_id", "left")
    else:
        e = e.withColumn("__dir", F.lit(None).cast("int"))
    way = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    key = lambda c: F.concat_ws("\x01", "route_id", c)
    e = e.where("route_id is not null").select(
        "agency_id", F.explode(F.array(key(F.lit("any")), key(way("__dir")))).alias("route"), F.col("station").alias("stop_id"), "delay_seconds", "observed_at",
        F.lit(True).alias("measured"), F.lit(False).alias("late"), F.lit(0).cast("long").alias("received_at"), F.lit(0).cast("long").alias("delivery_id"))
    ways = F.when(F.coalesce("direction", F.lit(-1)) < 0, F.array(key(F.lit("any")))).otherwise(F.array(key(F.lit("unknown")), key(way("direction"))))
    w = p.where("expires_at >= created_at and route_id is not null").select(
        "id", "agency_id", F.explode(ways).alias("route"), F.col("station").alias("stop_id"), F.col("created_at").alias("from_at"), F.col("expires_at").alias("to_at"), "baseline_secs")
    at = ["agency_id", "route", "stop_id", "hour", "pane"]
    slices = pane_points(e, w).groupBy(*at).agg(F.max("delay_seconds").alias("high"))
    hours = w.withColumn("hour", F.explode(F.sequence(F.floor(F.col("from_at") / HOUR), F.floor(F.col("to_at") / HOUR))))
    hit = hours.join(slices, at[:-1]).where((F.col("pane") >= F.col("from_at")) & (F.col("pane") <= F.col("to_at")))
    more = F.greatest(F.lit(0), F.col("high").cast("long") - F.coalesce("baseline_secs", F.lit(0)))
    got = hit.groupBy("id").agg(F.max(more).alias("observed_max"))
    return p.select("id").join(got, "id", "left").select("id", F.coalesce("observed_max", F.lit(0)).cast("long").alias("observed_max"), F.col("observed_max").isNotNull().alias("matched"))


def realized_wait(pending: DataFrame, t: Timetable, state: DataFrame) -> DataFrame:
    """(id, wait) of primaries with a scheduled connection: until the first train that could really be boarded.

    The next ten departures of the route are tried (the limit counts before the direction does), up to 30 minutes past
    the earliest catch, each with its stored delay at that stop. No row where none could be boarded.
    """
    p = pending.where("is_primary and sched_conn_dep_secs > 0")
    p = with_station(p, t.stops, "source_station", "__station")
    p = next_second(p, broadcast_if_small(departure_minutes(t.departures)), "__station", "route_id", F.col("sched_conn_dep_secs"), "__dep").where("__dep is not null")
    # the trip's stored delay is under the stop it calls at first there by sequence, the station's own id before its platforms
    calls = t.departures.where("departure_secs >= 0").select("trip_id", "station", "route_id", "direction_id", "stop_id", "stop_sequence", F.col("departure_secs").alias("dep"))
    own = Window.partitionBy("trip_id", "station").orderBy(F.col("stop_id") != F.col("station"), "stop_sequence", "stop_id")
    calls = calls.withColumn("__at", F.first("stop_id").over(own))
    s = state.select(F.col("agency_id").alias("agency"), F.col("trip_id").alias("__t"), F.col("stop_id").alias("__s"), F.col("delay_seconds").alias("delay"))
    s = s.groupBy("__t", "__s").agg(F.collect_list(F.struct("agency", "delay")).alias("delays"))
    calls = calls.join(s, (F.col("trip_id") == F.col("__t")) & (F.col("__at") == F.col("__s")), "left").drop("__t", "__s", "__at")
    # the candidates of a departure's second are worked out once, not for every prediction
    row = F.struct("dep", "trip_id", "stop_sequence", "stop_id", "direction_id", "delays")
    order = Window.partitionBy("station", "route_id").orderBy("dep", "trip_id", "stop_sequence", "stop_id", "direction_id")
    calls = calls.withColumns({"__c": F.collect_list(row).over(order.rowsBetween(0, CANDIDATES - 1)), "__before": F.lag("dep").over(order)})
    calls = calls.where("__before is null or __before < dep").select(F.col("station").alias("__st"), F.col("route_id").alias("__r"), F.col("dep").alias("__d"), "__c")
    p = p.select("id", "agency_id", "direction", "__station", "route_id", "sched_conn_dep_secs", "earliest_catch_secs", "__dep")
    c = p.join(calls, (F.col("__station") == F.col("__st")) & (F.col("route_id") == F.col("__r")) & (F.col("__dep") == F.col("__d")))
    late = lambda d: F.coalesce(F.get(F.filter(d["delays"], lambda x: x["agency"] == F.col("agency_id")), F.lit(0))["delay"], F.lit(0))
    tried = F.filter(F.transform("__c", lambda d, n: d.withField("n", n)), lambda d: (d["dep"] <= F.col("earliest_catch_secs") + WINDOW) & ((F.col("direction") < 0) | (d["direction_id"] == F.col("direction")))
                     & (d["dep"] + late(d) >= F.col("earliest_catch_secs")))
    c = c.withColumn("__x", F.get(tried, F.lit(0))).where("__x is not null")
    c = c.withColumn("real", F.col("__x.dep") + late(F.col("__x")))
    return c.groupBy("id").agg(F.min_by(F.greatest(F.lit(0), F.col("real") - F.col("sched_conn_dep_secs")), F.col("__x.n")).cast("int").alias("wait"))


def sweep(expired: DataFrame, waits: DataFrame | None = None) -> DataFrame:
    """Expired predictions with their outcome: final observed_max, verified or falsified, and the error in seconds.

    A primary with a realized wait takes it; verified needs 15 s and half of what was predicted. Null predictions or
    observations read as 0.
    """
    e = expired
    if waits is not None:
        e = e.join(waits.select("id", "wait"), "id", "left").withColumn("observed_max", F.coalesce("wait", "observed_max")).drop("wait")
    seen, said = F.coalesce("observed_max", F.lit(0)).cast("long"), F.coalesce("predicted_secs", F.lit(0)).cast("long")
    ok = (seen >= MIN_VERIFIED) & (seen >= said * F.lit(RATIO))
    return e.withColumns({"observed_max": seen, "outcome": F.when(ok, "verified").otherwise("falsified"), "abs_error": F.abs(said - seen)})


def learned_history(swept: DataFrame, at_ns: int) -> DataFrame:
    """Rows for the transfer history: primaries, at their transfer station, or the impacted one where that is unset."""
    station = F.when(F.coalesce("source_station", F.lit("")) == "", F.col("station_id")).otherwise(F.col("source_station"))
    return swept.where("is_primary").select("from_route", F.col("route_id").alias("to_route"), station.alias("station"), "hour",
                                            F.col("source_delay_secs").alias("source_delay"), F.col("observed_max").cast("int").alias("downstream_impact"), F.lit(at_ns).cast("long").alias("at"))


def learned_stop_history(swept: DataFrame, at_ns: int) -> DataFrame:
    return swept.where("not is_primary").select(F.col("route_id").alias("route"), F.col("station_id").alias("station"), "hour", F.col("observed_max").cast("int").alias("observed"), F.lit(at_ns).cast("long").alias("at"))


def retained(history: DataFrame, now_ns: int) -> DataFrame:
    """The last 30 days of a history table."""
    return history.where(F.col("at") >= now_ns - RETENTION_NS)


def eval_metrics(swept: DataFrame) -> DataFrame:
    """One row per confidence bucket and outcome: finalized, sum of squared errors, RMSE, and errors by upper bound."""
    e = F.col("abs_error")
    squares = F.sum(e.cast("decimal(19,0)") * e.cast("decimal(19,0)")).cast("double")  # exact, whatever the order of rows
    w = swept.withColumn("bucket", confidence_bucket("confidence"))
    return w.groupBy("bucket", "outcome").agg(
        F.count("*").alias("finalized"), squares.alias("squared_error"), F.sqrt(squares / F.count("*")).alias("rmse"),
        *(F.count_if(e <= b).alias(f"le_{b}") for b in ERROR_BUCKETS))


def transfer_reliability(history: DataFrame, station: str | None = None, hour: int | None = None) -> DataFrame:
    """(station, hour, from_route, to_route, avg_delay, n, reliability_pct): mean outcomes of transfer pairs; the
    percentage is defined but always 0."""
    h = history.where("downstream_impact is not null")
    if station is not None:
        h = h.where(F.col("station") == station)
    if hour is not None:
        h = h.where(F.col("hour") == hour)
    return h.groupBy("station", "hour", "from_route", "to_route").agg(
        F.avg("downstream_impact").alias("avg_delay"), F.count("*").alias("n"), F.lit(0.0).cast("float").alias("reliability_pct"))
