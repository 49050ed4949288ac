"""From feed snapshots to delay events: normalization, differencing against what was last published, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtide.functions.ids import route_from_trip
from railtide.functions.time import DAY, seconds_of_day
from railtide.operators.fold import ordered_fold
from railtide.operators.schedule import resolve_trips, scheduled_stop_times
from railtide.sources.gtfs import Timetable

THRESHOLD = 15
UNSEEN = 1800


def normalize(feed: DataFrame, agency: str | Column) -> DataFrame:
    """Delay events of feed trip updates (see schema.FEED), with feed_id and poll_no.

    A cancelled trip gives one TRIP_CANCELLED event without a stop. A skipped stop gives SKIP_STOP with delay 0. Any
    other stop update gives one event if it has a delay or a non-zero time, by its arrival, else its departure; the
    scheduled time is known only where both are. An unset route is read from the trip id; updates without a trip give
    nothing.
    """
    agency = F.lit(agency) if isinstance(agency, str) else agency
    t = feed.where("trip is not null").withColumns({
        "agency_id": agency, "trip_id": F.coalesce("trip.trip_id", F.lit("")),
        "cancelled": F.coalesce(F.col("trip.schedule_relationship") == "CANCELED", F.lit(False))})
    t = t.withColumn("route_id", F.when(F.coalesce("trip.route_id", F.lit("")) == "", route_from_trip("trip_id")).otherwise(F.col("trip.route_id")))
    keep = ["feed_id", "poll_no", "agency_id", "trip_id", "route_id", "observed_at"]
    zero = F.lit(0).cast("long")
    gone = t.where("cancelled").select(*keep, F.lit("").alias("stop_id"), F.lit(0).alias("delay_seconds"), zero.alias("scheduled_arrival"),
                                       zero.alias("predicted_arrival"), F.lit("TRIP_CANCELLED").alias("type"))
    u = t.where("not cancelled").select(*keep, F.explode("stop_time_update").alias("u"))
    usable = lambda e: e["delay"].isNotNull() | (F.coalesce(e["time"], F.lit(0)) != 0)
    a, d = F.col("u.arrival"), F.col("u.departure")
    by_arrival = F.coalesce(usable(a), F.lit(False))
    pick = F.when(by_arrival, a).when(F.coalesce(usable(d), F.lit(False)), d)
    u = u.withColumn("e", pick).withColumn("skip", F.coalesce(F.col("u.schedule_relationship") == "SKIPPED", F.lit(False)))
    u = u.where(F.col("skip") | F.col("e").isNotNull())
    when = F.coalesce(F.col("e.time"), F.lit(0))
    stops = u.select(
        *keep, F.coalesce("u.stop_id", F.lit("")).alias("stop_id"), F.when(F.col("skip"), 0).otherwise(F.coalesce("e.delay", F.lit(0))).cast("int").alias("delay_seconds"),
        F.when(F.col("e.delay").isNotNull() & (when > 0), when - F.col("e.delay")).otherwise(0).cast("long").alias("scheduled_arrival"), when.cast("long").alias("predicted_arrival"),
        F.when(F.col("skip"), "SKIP_STOP").when(by_arrival, "ARRIVAL_DELAY").otherwise("DEPARTURE_DELAY").alias("type"))
    return gone.unionByName(stops)


def _differs(old: tuple, row) -> bool:
    return old[2] != row.type or abs(old[0] - row.delay_seconds) > THRESHOLD or abs(old[1] - row.predicted_arrival) > THRESHOLD


def diff(polls: DataFrame, feed: str = "feed_id", poll: str = "polled_at") -> DataFrame:
    """The events to publish: unseen, of another type, or moved by more than 15 s against what was last published.

    ``polls`` has the feed, the poll's time, trip_id, stop_id, delay_seconds, predicted_arrival and type; nulls in the
    numbers read as 0. Rows of one key within a poll are all compared with the state before that poll, and the last of
    them stands. A key that a feed didn't carry for over 30 minutes up to its previous poll is forgotten.
    """
    rows = polls.select(F.col(feed).alias("feed_id"), F.col(poll).cast("long").alias("polled_at"), "trip_id", "stop_id",
                        F.coalesce("delay_seconds", F.lit(0)).cast("long").alias("delay_seconds"),
                        F.coalesce("predicted_arrival", F.lit(0)).cast("long").alias("predicted_arrival"), "type")
    from pyspark.sql.window import Window

    times = rows.select("feed_id", "polled_at").distinct()
    times = times.withColumn("before", F.lag("polled_at").over(Window.partitionBy("feed_id").orderBy("polled_at")))
    rows = rows.join(times, ["feed_id", "polled_at"])

    def step(state, row):
        # (published before this poll, published so far, time of the poll, last seen)
        base, done, at, seen = state
        if at != row.polled_at:
            if seen is not None and row.before is not None and row.before - seen > UNSEEN:
                done = None
            base, at = done, row.polled_at
        out = []
        if base is None or _differs(base, row):
            out = [(row.feed_id, row.polled_at, row.trip_id, row.stop_id, row.delay_seconds, row.predicted_arrival, row.type)]
            done = (row.delay_seconds, row.predicted_arrival, row.type)
        return (base, done, at, row.polled_at), out

    return ordered_fold(rows, ["feed_id", "trip_id", "stop_id"], ["polled_at", "delay_seconds", "predicted_arrival", "type"],
                        "feed_id string, polled_at long, trip_id string, stop_id string, delay_seconds long, predicted_arrival long, type string",
                        lambda: (None, None, None, None), step)


def enrich(events: DataFrame, t: Timetable) -> DataFrame:
    """events with a delay worked out from the timetable where the feed gave only a predicted time.

    Only where delay and scheduled time are 0 and a time is predicted, for arrivals and departures. The distance from
    the scheduled second of the day is taken to the nearest day. ``enriched`` tells hit (true), miss (false) or not
    needed (null).
    """
    need = ((F.col("delay_seconds") == 0) & (F.col("scheduled_arrival") == 0) & (F.col("predicted_arrival") != 0)
            & F.col("type").isin("ARRIVAL_DELAY", "DEPARTURE_DELAY"))
    e = scheduled_stop_times(resolve_trips(events, t.departures), t.departures, t.stops)
    a, d = F.nullif(F.col("arrival_secs"), F.lit(0)), F.nullif(F.col("departure_secs"), F.lit(0))
    sched = F.when(F.col("type") == "DEPARTURE_DELAY", F.coalesce(d, a)).otherwise(F.coalesce(a, d))
    raw = seconds_of_day("predicted_arrival", t.tz) - sched
    near = F.when((F.abs(raw) <= F.abs(raw - DAY)) & (F.abs(raw) <= F.abs(raw + DAY)), raw).when(F.abs(raw - DAY) <= F.abs(raw + DAY), raw - DAY).otherwise(raw + DAY)
    e = e.withColumn("__d", F.when(need, near)).withColumn("enriched", F.when(need, F.col("__d").isNotNull()))
    return e.withColumns({
        "delay_seconds": F.coalesce("__d", "delay_seconds").cast("int"),
        "scheduled_arrival": F.when(F.col("__d").isNotNull(), F.col("predicted_arrival") - F.col("__d")).otherwise(F.col("scheduled_arrival"))}
    ).drop("__d", "sched_stop_id", "arrival_secs", "departure_secs", "static_trip_id")
