"""Transfer connections that a delay breaks or endangers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtide.functions.time import clock
from railtide.operators.schedule import DAY, MINUTE_BITS, OVERNIGHT, first_departures, next_marked, night_seconds, numbered_places, second_index
from railtide.operators.state import as_of, changes
from railtide.session import broadcast_if_small, stored
from railtide.sources.gtfs import Timetable, with_station

MIN_TRANSFER = 120
BUFFER = 60
#: Up to so many changes of a stop's stored delay travel with its departure; with more, all changes are merged in order.
MOST_CHANGES = 64


def possible_connections(t: Timetable) -> DataFrame:
    """(from_station, to_station, to_route_id, min_transfer): transfers with the routes at their destination."""
    r = _places(t).select(F.col("station").alias("to_station"), F.col("route_id").alias("to_route_id"))
    m = F.when(F.col("min_transfer_time") <= 0, MIN_TRANSFER).otherwise(F.col("min_transfer_time"))
    return t.transfers.withColumn("min_transfer", m).join(r, "to_station").select("from_station", "to_station", "to_route_id", "min_transfer")


def _places(t: Timetable) -> DataFrame:
    return t.once("places", lambda: broadcast_if_small(numbered_places(t.departures)))


def firsts(t: Timetable) -> DataFrame:
    """first_departures with the number of their place, stored once."""
    return t.once("firsts", lambda: stored(first_departures(t.departures).join(_places(t), ["station", "route_id"])))


def _judged(events: DataFrame, t: Timetable, log: DataFrame | None, seq: str, state: DataFrame | None, most_changes: int, distinct: bool, unread: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Broken and endangered connections with the second (viable_dep) and way of the next departure that can be caught, and
    the timetable's seconds. What is stored of connecting trips is fetched only for departures that something is stored of."""
    late = events.where(F.col("delay_seconds") > 0)
    late = with_station(late, t.stops, "stop_id", "from_station")
    tod = clock("scheduled_arrival", t.tz)
    late = late.withColumn("tod", F.when(tod == 0, clock("observed_at", t.tz)).otherwise(tod))
    late = late.select(F.col(seq).alias("seq"), "agency_id", F.col("trip_id").alias("from_trip_id"), F.col("route_id").alias("from_route_id"), "from_station",
                       "stop_id", "delay_seconds", "observed_at", "tod")
    first = firsts(t)
    conn = first.select("place", "dep", F.col("trip_id").alias("conn_trip"), F.col("stop_id").alias("conn_stop"))
    dense = False
    if log is not None:
        known = changes(log).groupBy(F.col("trip_id").alias("conn_trip"), F.col("stop_id").alias("conn_stop"))
        dense = (known.agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > most_changes
        known = known.agg(*([] if dense else [F.collect_list(F.struct(F.col("seq").alias("at"), "agency_id", "delay")).alias("steps")]), F.count("*").alias("n")).drop("n")
        known = stored(conn.join(known, ["conn_trip", "conn_stop"]))
    elif state is not None:
        known = conn.join(state.select(F.col("agency_id").alias("__a"), F.col("trip_id").alias("conn_trip"), F.col("stop_id").alias("conn_stop"), F.col("delay_seconds").alias("conn_delay")), ["conn_trip", "conn_stop"])
        known = stored(known)
    else:
        known = None
    seconds = broadcast_if_small(second_index(first, known))
    after = lambda c, time, out: next_marked(c, seconds, "place", time, out)
    second = lambda c: F.shiftright(c, 2).cast("int")
    on = possible_connections(t).join(_places(t).withColumnsRenamed({"station": "to_station", "route_id": "to_route_id"}), ["to_station", "to_route_id"])
    c = late.join(broadcast_if_small(on.distinct() if distinct else on), "from_station").where("to_route_id <> from_route_id")
    # the frame that fits: before 04:00 that of the night before, where it has a departure and the raw time none or a later one
    nights = broadcast_if_small(night_seconds(_places(t), seconds).withColumnRenamed("at", "__at"))
    c = c.join(nights, F.when(F.col("tod") < OVERNIGHT, F.shiftleft("place", MINUTE_BITS) + F.floor(F.col("tod") / 60)) == F.col("__at"), "left")
    c = c.withColumn("eff", F.expr(f"tod + getbit(coalesce(nights, 0L), tod % 60) * {DAY}").cast("int")).drop("__at", "nights", "tod", "from_station")
    # stored: filters on what a look-up gives would else be worked out again with all before them
    c = stored(after(c, F.col("eff") + F.col("min_transfer"), "x").drop(*unread))
    c = c.withColumn("dep", second("x")).withColumn("catch", F.col("eff") + F.col("delay_seconds") + F.col("min_transfer"))
    plain, held = c.where("x & 2 = 0").drop("x"), c.where("x & 2 <> 0").drop("x")
    c = plain.withColumn("conn_delay", F.lit(None).cast("int"))
    if known is not None:
        if log is not None and dense:
            held = as_of(held.join(known, ["place", "dep"]), log, "seq", "agency_id", "conn_trip", "conn_stop", "conn_delay")
        elif log is not None:
            held = held.join(known, ["place", "dep"])
            held = held.withColumn("conn_delay", F.array_max(F.filter("steps", lambda x: (x["at"] <= F.col("seq")) & (x["agency_id"] == F.col("agency_id"))))["delay"])
        else:
            one = known.withColumnsRenamed({"place": "__p", "dep": "__d"})
            held = held.join(one, (F.col("place") == F.col("__p")) & (F.col("dep") == F.col("__d")) & (F.col("agency_id") == F.col("__a")), "left")
        c = c.unionByName(held.select(*c.columns))
    c = c.withColumn("original", F.col("dep") - F.col("eff"))
    c = c.withColumn("remaining", F.col("original") - F.col("delay_seconds") + F.coalesce("conn_delay", F.lit(0)))
    level = F.when(F.col("remaining") < F.col("min_transfer"), "BROKEN").when(F.col("remaining") < F.col("min_transfer") + BUFFER, "AT_RISK")
    c = c.withColumn("level", level).where("level is not null").drop("conn_delay", "min_transfer", "agency_id", "eff")
    c = after(c, F.when(F.col("level") == "BROKEN", F.col("catch")), "x")
    return c.withColumns({"viable_dep": second("x"), "viable_way": F.col("x").bitwiseAND(1).cast("int")}).drop("x"), seconds


def transfer_impacts(events: DataFrame, t: Timetable, log: DataFrame | None = None, seq: str = "seq", state: DataFrame | None = None,
                     most_changes: int = MOST_CHANGES) -> DataFrame:
    """Broken and endangered connections of late events, with the event's seq.

    An event's own (enriched) delay counts, not the stored one, and events that the state drops count too. The time of
    day is that of the scheduled arrival, else of the observation. In the frame that fits the night, the first departure
    after the transfer time is the connection; its own stored delay, as known at the event's arrival, moves the margin.
    A broken connection has the next scheduled departure that can be caught. In place of the log of all changes the
    ``state`` as it stands may be given.
    """
    c, _ = _judged(events, t, log, seq, state, most_changes, False)
    broken = F.col("level") == "BROKEN"
    # rows that look for no departure are spread over keys that none has
    c = c.withColumn("viable_dep", F.coalesce("viable_dep", -1 - F.pmod(F.hash("seq"), F.lit(4096))))
    viable = firsts(t).select("place", F.col("dep").alias("viable_dep"), F.col("dep").alias("__dep"), F.col("trip_id").alias("viable_trip"))
    c = c.join(viable, ["place", "viable_dep"], "left")
    return c.select(
        "seq", "from_trip_id", "from_route_id", "to_route_id", F.col("stop_id").alias("from_stop_id"), F.col("to_station").alias("station_id"),
        F.col("delay_seconds").alias("source_delay_seconds"), F.col("original").cast("int").alias("original_transfer_margin_seconds"),
        F.col("remaining").cast("int").alias("remaining_margin_seconds"), "level", F.col("observed_at").alias("detected_at"),
        F.when(broken, F.coalesce("viable_trip", F.lit(""))).otherwise("").alias("next_viable_trip_id"),
        F.when(broken, _wait("__dep")).otherwise(0).cast("int").alias("additional_wait_seconds"),
        F.when(broken, F.col("dep")).otherwise(0).cast("int").alias("sched_connection_departure_secs"),
        F.when(broken, F.col("catch")).otherwise(0).cast("int").alias("earliest_catch_secs"))


def _wait(viable: str) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.col(viable) - F.col("dep")), F.lit(0))


#: A broken connection's id.
IMPACT_ID = ("seq", "to_route_id", "station_id", "earliest_catch_secs")


def broken_directed(events: DataFrame, t: Timetable, log: DataFrame, most_changes: int = MOST_CHANGES) -> DataFrame | None:
    """Broken connections, each id once, as the cascade reads them: with station and direction, without the trips' names.

    The direction of the next departure comes with its second, so nothing is joined by trip. None where the timetable has
    other directions than 0 and 1: those come by the trip."""
    c, seconds = _judged(events, t, log, "seq", None, most_changes, True, ("from_trip_id", "stop_id"))
    if not seconds.where("odd <> 0").isEmpty():
        return None
    c = c.where("level = 'BROKEN'").select(
        "seq", "from_route_id", "to_route_id", F.col("to_station").alias("station_id"), F.col("delay_seconds").alias("source_delay_seconds"), F.col("observed_at").alias("detected_at"),
        _wait("viable_dep").cast("int").alias("additional_wait_seconds"), F.col("catch").cast("int").alias("earliest_catch_secs"), F.coalesce("viable_way", F.lit(0)).alias("direction_id"))
    c = with_station(c.withColumn("impact_id", F.concat_ws(":", *IMPACT_ID)), t.stops, "station_id", "station")
    # connections are distinct, so an id can only repeat where an event's number does or a part holds the separator
    repeats = not events.groupBy("seq").count().where("count > 1").isEmpty() or not _places(t).where("instr(route_id, ':') > 0 or instr(station, ':') > 0").isEmpty()
    return c.dropDuplicates(["impact_id"]) if repeats else c


def alerts(impacts: DataFrame, routes: list[str] = (), stations: list[str] = ()) -> DataFrame:
    """Impacts that touch one of the routes or stations; all where no filter is given. Works on streams too."""
    if not routes and not stations:
        return impacts
    return impacts.where(F.col("from_route_id").isin(*routes) | F.col("to_route_id").isin(*routes) | F.col("station_id").isin(*stations))


def broken_by_station(impacts: DataFrame) -> DataFrame:
    return impacts.where("level = 'BROKEN'").groupBy("station_id", "to_route_id").agg(
        F.count("*").alias("broken"), F.sum("additional_wait_seconds").cast("long").alias("total_wait"), F.max("additional_wait_seconds").alias("max_wait"))
