"""The six queries of the service, as functions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtide.config import Propagation
from railtide.operators import cascade as C
from railtide.operators.evaluation import transfer_reliability
from railtide.operators.state import active, live_max
from railtide.operators.transfers import alerts
from railtide.sources.gtfs import Timetable, with_station

__all__ = ["alerts", "blast_radius", "network_state", "network_state_map", "predict_impact", "route_delays", "transfer_reliability"]


def named(state: DataFrame, stops: DataFrame, parent_fallback: bool) -> DataFrame:
    """state with stop_name: the stop's, else (network state only) its parent's, else its id."""
    own = stops.select(F.col("stop_id").alias("__s"), F.nullif("stop_name", F.lit("")).alias("__n"), F.nullif("parent_station", F.lit("")).alias("__p"))
    d = state.join(own, F.col("stop_id") == F.col("__s"), "left")
    if not parent_fallback:
        return d.withColumn("stop_name", F.coalesce("__n", "stop_id")).drop("__s", "__n", "__p")
    up = stops.select(F.col("stop_id").alias("__u"), F.nullif("stop_name", F.lit("")).alias("__un"))
    return d.join(up, F.col("__p") == F.col("__u"), "left").withColumn("stop_name", F.coalesce("__n", "__un", "stop_id")).drop("__s", "__n", "__p", "__u", "__un")


def network_state(state: DataFrame, stops: DataFrame) -> DataFrame:
    """(route_id, delays): the active delays of each route as an array, in order of trip and stop."""
    d = named(active(state), stops, True)
    one = F.struct("trip_id", "stop_id", "stop_name", "delay_seconds", "confidence", "observed_at")
    return d.groupBy("route_id").agg(F.sort_array(F.collect_list(one)).alias("delays"))


def network_state_map(state: DataFrame, stops: DataFrame, as_of: int) -> DataFrame:
    """One row: routes as a map of route to its delays, and as_of."""
    return network_state(state, stops).agg(F.map_from_entries(F.collect_list(F.struct("route_id", "delays"))).alias("routes"), F.lit(as_of).cast("long").alias("as_of"))


def route_delays(state: DataFrame, stops: DataFrame, route: str | None = None) -> DataFrame:
    """Every stored delay of a route (of all routes without one), however small."""
    d = state if route is None else state.where(F.col("route_id") == route)
    return named(d, stops, False).select("route_id", "trip_id", "stop_id", "stop_name", "delay_seconds", "confidence", "observed_at")


def synthetic_impacts(state: DataFrame, t: Timetable) -> DataFrame:
    """State rows as impacts on their own route, whose cascade is then predicted."""
    s = with_station(state, t.stops)
    trips = t.trips.select("trip_id", F.col("route_id").alias("__route"), F.col("direction_id").alias("__way"))
    s = s.join(trips, "trip_id", "left")
    r = F.coalesce("__route", F.lit(""))
    return s.select(
        F.concat_ws(":", "agency_id", "trip_id", "stop_id").alias("impact_id"), F.col("trip_id").alias("from_trip_id"), r.alias("from_route_id"), r.alias("to_route_id"),
        F.col("station").alias("station_id"), F.col("delay_seconds").alias("source_delay_seconds"), F.col("observed_at").alias("detected_at"),
        F.col("trip_id").alias("next_viable_trip_id"), F.lit(0).alias("additional_wait_seconds"), F.lit(0).alias("sched_connection_departure_secs"), F.lit(0).alias("earliest_catch_secs"),
        "station", F.coalesce("__way", F.lit(0)).alias("direction_id"))


def _predict(state: DataFrame, chosen: DataFrame, t: Timetable, history: DataFrame, stop_history: DataFrame | None, cfg: Propagation) -> DataFrame:
    live = live_max(state, t.stops)
    est = C.initial_estimates(synthetic_impacts(chosen, t), t, live, C.average_impacts(history), cfg)
    return C.cascade(est, t, live, C.average_stop_impacts(stop_history) if stop_history is not None else None, cfg)


def predict_impact(state: DataFrame, t: Timetable, history: DataFrame, trip: str, stop: str, stop_history: DataFrame | None = None, cfg: Propagation = Propagation()) -> DataFrame:
    """The cascade of one stored delay; nothing where it isn't stored."""
    return _predict(state, state.where((F.col("trip_id") == trip) & (F.col("stop_id") == stop)), t, history, stop_history, cfg)


def blast_radius(state: DataFrame, t: Timetable, history: DataFrame, station: str | None = None, stop_history: DataFrame | None = None, cfg: Propagation = Propagation()) -> DataFrame:
    """The cascades of all stored delays at a station (of all stations without one), early and on-time trains included."""
    at = with_station(state, t.stops, "stop_id", "__st")
    at = at.where(F.col("__st") == station) if station is not None else at
    known = t.departures.select(F.col("station").alias("__st"), "route_id").distinct()
    return _predict(state, at.join(known, ["__st", "route_id"], "left_semi").drop("__st"), t, history, stop_history, cfg)
