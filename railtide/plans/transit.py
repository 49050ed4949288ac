"""Registered queries of the transit operators. Timetable queries run on the adapter views, the others on their tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtide.config import Propagation
from railtide.functions.ids import clean, route, route_from_trip
from railtide.functions.time import confidence_bucket, seconds_of_day, service_seconds, shorten
from railtide.operators import api, cascade, evaluation, events, schedule, state, transfers
from railtide.session import cut, shared_path
from railtide.sources import gtfs
from railtide.sources.adapters import AGENCY, Adapter
from railtide.sources.tables import table

SERVICE_DAY = dt.date(2024, 1, 10)
CFG = Propagation()


def active_services(spark: SparkSession, folder: str) -> DataFrame:
    return gtfs.active_services(table(spark, folder, "calendar"), SERVICE_DAY)


def _written(spark: SparkSession, name: str, rows: DataFrame) -> str:
    """A folder of CSV files of a table, quoted only where needed, as a timetable file comes."""
    path = shared_path(spark, "csv")
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{path}/{name}")
    return path


#: Stop names as they come in some files: with commas, doubled quotes and line breaks.
ODD_NAME = "concat(stop_name, CASE WHEN length(stop_id) % 2 = 0 THEN concat(', \"', stop_id, '\"') WHEN stop_id LIKE '%1' THEN concat({newline}, 'platform', {newline}, ',\"\"') ELSE '' END)"


def gtfs_stops(spark: SparkSession, folder: str) -> DataFrame:
    """Stops written to CSV files and read back."""
    s = Adapter(spark, folder)["g_stops"].withColumn("stop_name", F.expr(ODD_NAME.format(newline="'\n'")))
    return gtfs.read_stops(spark, _written(spark, "stops.txt", s))


def gtfs_stop_times(spark: SparkSession, folder: str) -> DataFrame:
    """Stop times written to CSV files as H:MM:SS and read back; a few can't be read and are left out."""
    s = Adapter(spark, folder)["g_stop_times"]
    text = lambda c: F.concat_ws(":", F.floor(F.col(c) / 3600), *(F.lpad(x.cast("string"), 2, "0") for x in (F.floor(F.col(c) / 60) % 60, F.col(c) % 60)))
    odd = F.col("arrival_secs") % 53
    s = s.select("trip_id", F.when(odd == 0, "soon").otherwise(text("arrival_secs")).alias("arrival_time"), F.when(odd == 1, "").otherwise(text("departure_secs")).alias("departure_time"),
                 "stop_id", "stop_sequence")
    return gtfs.read_stop_times(spark, _written(spark, "stop_times.txt", s))


def calendar_exceptions(spark: SparkSession, folder: str) -> DataFrame:
    """Services of a day with exceptions, read from CSV files: of several for one service the last in the file stands."""
    c = table(spark, folder, "calendar")
    days = c.select("service_id", "start_date", "end_date", "published_at").distinct().orderBy("published_at", "service_id", "end_date", "start_date")
    date = F.when(F.ascii(F.substring("service_id", -1, 1)) % 3 > 0, SERVICE_DAY.strftime("%Y%m%d")).otherwise(F.col("start_date"))
    kind = (F.substring("start_date", -2, 2).cast("int") % 4).cast("string")
    read = gtfs.read_calendar_dates(spark, _written(spark, "calendar_dates.txt", days.select("service_id", date.alias("date"), kind.alias("exception_type"))))
    return gtfs.active_services(c, SERVICE_DAY, read)


def active_trips(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "trips").join(active_services(spark, folder), "service_id", "left_semi").select("trip_id").distinct()


def stop_parent(spark: SparkSession, folder: str) -> DataFrame:
    return gtfs.stations(Adapter(spark, folder)["g_stops"])


def routes_at_stop(spark: SparkSession, folder: str) -> DataFrame:
    return schedule.routes_at_stop(Adapter(spark, folder).timetable().departures)


def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    t = Adapter(spark, folder).timetable()
    return schedule.graph_stats(t.stops, t.routes, t.transfers)


def transfers_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return Adapter(spark, folder).timetable().transfers


def headway_index(spark: SparkSession, folder: str) -> DataFrame:
    return schedule.headway_index(Adapter(spark, folder).timetable().departures)


def _probes(a: Adapter) -> DataFrame:
    """Events with station, time of day and their trip's direction."""
    e = gtfs.with_station(a["g_events"], a["g_stops"])
    d = a["g_trips"].select("trip_id", "direction_id")
    return e.join(d, "trip_id").withColumn("tod", seconds_of_day("observed_at")).select("seq", "route_id", "direction_id", "station", "tod")


def headway_lookup(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    index = schedule.headway_index(a.timetable().departures)
    return schedule.scheduled_headway(_probes(a), index, "route_id", "direction_id", "station", "tod").select("seq", "headway")


def next_departures_n(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    index = schedule.departure_index(a.timetable().departures, 3)
    d = schedule.next_departures(_probes(a), index, "station", "route_id", "tod", 3)
    return d.select("seq", F.posexplode("deps").alias("n", "d")).select("seq", "n", "d.trip_id", "d.dep")


def next_departure_overnight(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    index = schedule.departure_index(a.timetable().departures, 1)
    d = schedule.next_overnight(_probes(a), index, "station", "route_id", "tod", 1)
    return d.select("seq", "effective_tod", F.get("deps", F.lit(0))["trip_id"].alias("trip_id"))


def resolve_trip(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    return schedule.resolve_trips(a["g_predictions"], a.timetable().departures).select("seq", "trip_id", "static_trip_id")


def scheduled_stop_time(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    t = a.timetable()
    r = schedule.resolve_trips(a["g_predictions"], t.departures)
    return schedule.scheduled_stop_times(r, t.departures, t.stops).select("seq", "sched_stop_id", "arrival_secs", "departure_secs")


def downstream_stops(spark: SparkSession, folder: str) -> DataFrame:
    return schedule.downstream_stops(Adapter(spark, folder).timetable().departures)


def service_time_parse(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "raw_lines").where("file_name = 'stop_times.txt'")
    return r.select("line_id", service_seconds(F.coalesce(F.get(F.split("line", ","), F.lit(1)), F.lit(""))).alias("secs"))


def route_of_trip(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "delay_events").select(clean("trip_id").alias("trip_id")).distinct()
    return d.select("trip_id", route_from_trip("trip_id").alias("route_id"), schedule.suffix("trip_id").alias("suffix"), shorten("trip_id", 12).alias("short_id"))


def confidence_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "delay_state").groupBy(confidence_bucket("confidence").alias("bucket")).agg(F.count("*").alias("n"))


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """delay_snapshots as nested feed messages: what normalize reads."""
    s = table(spark, folder, "delay_snapshots")
    gone, skip = (F.col("predicted_arrival") % 97 == 0), (F.col("predicted_arrival") % 7 == 0)
    event = F.struct(F.col("delay_seconds").alias("delay"), F.col("predicted_arrival").alias("time"))
    none = F.lit(None).cast("struct<delay: int, time: bigint>")
    u = F.struct("stop_id", F.when(skip, "SKIPPED").otherwise("SCHEDULED").alias("schedule_relationship"),
                 F.when(F.col("type") == "ARRIVAL_DELAY", event).otherwise(none).alias("arrival"), F.when(F.col("type") == "ARRIVAL_DELAY", none).otherwise(event).alias("departure"))
    return s.groupBy("feed_id", "taken_at", "agency_id", F.col("trip_id").alias("t")).agg(
        F.collect_list(u).alias("stop_time_update"), F.max(F.when(F.coalesce(gone, F.lit(False)), "CANCELED").otherwise("SCHEDULED")).alias("x"), F.min(F.when(F.coalesce(gone, F.lit(False)), 1).otherwise(0)).alias("c"),
    ).select("feed_id", F.col("taken_at").alias("poll_no"), F.col("taken_at").alias("observed_at"), "agency_id",
             F.struct(F.col("t").alias("trip_id"), F.lit("").alias("route_id"), F.when(F.col("c") == 1, "CANCELED").otherwise("SCHEDULED").alias("schedule_relationship")).alias("trip"), "stop_time_update")


def normalize_events(spark: SparkSession, folder: str) -> DataFrame:
    return events.normalize(feed(spark, folder), F.col("agency_id"))


def diff_events(spark: SparkSession, folder: str) -> DataFrame:
    return events.diff(table(spark, folder, "delay_snapshots").withColumn("trip_id", clean("trip_id")), "feed_id", "taken_at")


def enrich_delay(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    return events.enrich(a["g_predictions"], a.timetable()).select("seq", "delay_seconds", "scheduled_arrival", "enriched")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "delay_events")
    return e.select(F.col("delivery_id").alias("seq"), clean("agency_id").alias("agency_id"), clean("trip_id").alias("trip_id"), clean("stop_id").alias("stop_id"),
                    route().alias("route_id"), "delay_seconds", "observed_at", "received_at", "type")


def state_changelog(spark: SparkSession, folder: str) -> DataFrame:
    log = state.changelog(_events(spark, folder)).where("op <> 'delete'")
    return log.select("seq", "op", "delay_seconds", "observed_at", "confidence", "update_count")


def state_changelog_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The changelog with its retractions: what state_changelog has, and a row for every cancelled trip and skipped stop."""
    log = state.changelog(_events(spark, folder))
    return log.select("seq", *state.KEY, "op", "delay_seconds", "observed_at", "confidence", "update_count")


def delay_state_current(spark: SparkSession, folder: str) -> DataFrame:
    return state.current(state.changelog(_events(spark, folder)))


def state_with_ttl(spark: SparkSession, folder: str) -> DataFrame:
    return state.reconcile_with_ttl(_events(spark, folder)).select("seq", "op", "delay_seconds", "observed_at", "confidence", "update_count")


def _state(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "delay_state").where("delay_seconds is not null").withColumns({"trip_id": clean("trip_id"), "route_id": route()})


def active_delays(spark: SparkSession, folder: str) -> DataFrame:
    return state.active(_state(spark, folder)).select("state_id", "route_id", "delay_seconds")


def delay_stats(spark: SparkSession, folder: str) -> DataFrame:
    return state.delay_stats(_state(spark, folder))


def top5_per_route(spark: SparkSession, folder: str) -> DataFrame:
    return state.top_delays(_state(spark, folder))


def live_max(spark: SparkSession, folder: str) -> DataFrame:
    return state.live_max(_state(spark, folder))


def _live_state(a: Adapter) -> DataFrame:
    return a.once("state", lambda: state.current(_log(a)))


def _log(a: Adapter) -> DataFrame:
    a.keep("g_stop_times")
    return a.once("log", lambda: state.changelog(a.once("events", lambda: a["g_events"])))


def network_state(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    n = api.network_state(_live_state(a), a["g_stops"])
    text = F.transform("delays", lambda d: F.concat_ws("|", d["trip_id"], d["stop_id"], d["stop_name"], d["delay_seconds"].cast("string"),
                                                     F.round(d["confidence"] * 1_000_000).cast("long").cast("string"), d["observed_at"].cast("string")))
    return n.select("route_id", F.size("delays").cast("long").alias("stops"), F.array_join(text, ";").alias("delays"))


def route_delays(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    return api.route_delays(_live_state(a), a["g_stops"])


def _impacts(a: Adapter) -> DataFrame:
    log = _log(a)
    return transfers.transfer_impacts(_delays(a), a.timetable(), log)


def _delays(a: Adapter) -> DataFrame:
    return a.once("events", lambda: a["g_events"]).where(F.col("type").isin("ARRIVAL_DELAY", "DEPARTURE_DELAY"))


def transfer_impacts(spark: SparkSession, folder: str) -> DataFrame:
    return _impacts(Adapter(spark, folder))


def broken_transfers_by_station(spark: SparkSession, folder: str) -> DataFrame:
    return transfers.broken_by_station(transfer_impacts(spark, folder))


def alerts_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return transfers.alerts(transfer_impacts(spark, folder), ["R1"], ["N3", "N7"])


def _broken(a: Adapter) -> DataFrame:
    """Broken connections with an id; computed once, as several steps of a query read them."""
    i = _impacts(a).where("level = 'BROKEN'")
    ids = F.concat_ws(":", "seq", "to_route_id", "station_id", "earliest_catch_secs")
    return a.once("broken", lambda: i.withColumn("impact_id", ids).dropDuplicates(["impact_id"]))


def _estimated(a: Adapter, broken: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    live = _live(a) if live is None else live
    if broken is None:
        broken = transfers.broken_directed(_delays(a), a.timetable(), _log(a))
    return cascade.initial_estimates(_broken(a) if broken is None else broken, a.timetable(), live, _adapted_history(a), CFG)


def _live(a: Adapter) -> DataFrame:
    return a.once("live", lambda: state.live_max(_live_state(a), a["g_stops"]))


def _adapted_history(a: Adapter) -> DataFrame:
    """Averages of the history table on the adapter's routes and stations."""
    h = table(a.spark, a.folder, "history").where("downstream_impact is not null and hour is not null")
    r = lambda c: F.concat(F.lit("R"), (F.ascii(F.substring(c, 2, 1)) % 5 + 1).cast("string"))
    h = h.select(r("from_route").alias("from_route"), r("to_route").alias("to_route"), F.concat(F.lit("N"), (F.ascii("station") % 25).cast("string")).alias("station"), "hour", "downstream_impact", "at")
    return cascade.average_impacts(h)


def initial_delay_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return _estimated(Adapter(spark, folder)).select("impact_id", "direction_id", "hour", "initial_delay")


def dwell_seed(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    return cascade.dwell_seeds(_estimated(a), a.timetable(), None, CFG)


def first_hop_cascade(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    live, t = _live(a), a.timetable()
    hops = cascade.transfer_hops(cascade.dwell_seeds(_estimated(a, None, live), t, None, CFG), t, live, CFG)
    return hops.select("impact_id", "position", "to_station", "to_route_id", "new_delay", "new_confidence")


def _walked(a: Adapter, broken: DataFrame | None = None) -> DataFrame:
    live = _live(a)
    return cascade.cascade(_estimated(a, broken, live), a.timetable(), live, None, CFG)


def cascade_walk(spark: SparkSession, folder: str) -> DataFrame:
    return _walked(Adapter(spark, folder))


def cascade_walk_averages(spark: SparkSession, folder: str) -> DataFrame:
    """The walk with later stops blended with the averages of their past outcomes."""
    a = Adapter(spark, folder)
    live = _live(a)
    return cascade.cascade(_estimated(a, None, live), a.timetable(), live, _adapted_stop_averages(spark, folder), CFG)


def predict_impact(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    s = _live_state(a)
    one = s.orderBy(F.desc("delay_seconds"), "trip_id", "stop_id").select("trip_id", "stop_id").first()
    return api.predict_impact(s, a.timetable(), table(spark, folder, "history"), *(one or ("", "")))


def blast_radius(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    return api.blast_radius(_live_state(a), a.timetable(), table(spark, folder, "history"))


def track_predictions(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    broken = _broken(a)
    return evaluation.track(broken, cut(_walked(a, broken)), _live_state(a), a.timetable(), AGENCY)


def baseline_delays(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    seeds = cascade.dwell_seeds(_estimated(a), a.timetable(), None, CFG)
    results = seeds.select("impact_id", "position", "route_id", F.col("station").alias("stop_id"))
    return evaluation.baseline_delays(results, _live_state(a), a["g_stops"])


def match_predictions(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "trips").groupBy(clean("trip_id").alias("trip_id")).agg(F.max_by("direction_id", "published_at").alias("direction_id"))
    e = _events(spark, folder).withColumn("station", F.col("stop_id"))
    return evaluation.match(table(spark, folder, "pending_predictions"), e, d)


def _primaries(a: Adapter) -> DataFrame:
    """Broken connections as primary predictions of their extra wait."""
    return _broken(a).select(
        F.col("impact_id").alias("id"), F.lit(AGENCY).alias("agency_id"), F.col("to_route_id").alias("route_id"), F.col("station_id").alias("source_station"),
        (F.col("seq") % 3 - 1).cast("int").alias("direction"), F.col("sched_connection_departure_secs").alias("sched_conn_dep_secs"), "earliest_catch_secs", F.lit(True).alias("is_primary"),
        F.col("additional_wait_seconds").alias("predicted_secs"), F.lit(0).alias("observed_max"))


def realized_wait(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    return evaluation.realized_wait(_primaries(a), a.timetable(), _live_state(a))


def sweep_waits(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of primaries whose connection is known: the realized wait decides."""
    a = Adapter(spark, folder)
    p = _primaries(a)
    return evaluation.sweep(p, evaluation.realized_wait(p, a.timetable(), _live_state(a))).select("id", "outcome", "abs_error", "observed_max")


def _swept(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.sweep(evaluation.pop_expired(table(spark, folder, "pending_predictions").where("expires_at <> 0").distinct(), 1 << 40)[0])


def sweep_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _swept(spark, folder).select("id", "outcome", "abs_error", "observed_max")


def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.eval_metrics(_swept(spark, folder))


def learned_history(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.learned_history(_swept(spark, folder), 0)


def learned_stop_history(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.learned_stop_history(_swept(spark, folder), 0)


NOW_NS = 1_705_276_800 * 1_000_000_000


def history_average(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.average_impacts(table(spark, folder, "history"), NOW_NS, 10)


def stop_history_average(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.average_stop_impacts(table(spark, folder, "stop_history"), NOW_NS, 10)


def transfer_reliability(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.transfer_reliability(table(spark, folder, "history"))


def _adapted_stop_averages(spark: SparkSession, folder: str) -> DataFrame:
    """Averages of the stop history on the adapter's routes and stations."""
    h = table(spark, folder, "stop_history").where("observed is not null and hour is not null")
    return cascade.average_stop_impacts(h.select(
        F.concat(F.lit("R"), (F.ascii(F.substring("route", 2, 1)) % 5 + 1).cast("string")).alias("route"),
        F.concat(F.lit("N"), (F.ascii("station") % 25).cast("string")).alias("station"), "hour", "observed", "at"))


def per_stop_blend(spark: SparkSession, folder: str) -> DataFrame:
    a = Adapter(spark, folder)
    return cascade.dwell_seeds(_estimated(a), a.timetable(), _adapted_stop_averages(spark, folder), CFG)


QUERIES = {f.__name__: f for f in (
    active_services, gtfs_stops, gtfs_stop_times, calendar_exceptions, active_trips, stop_parent, routes_at_stop, graph_stats, transfers_normalized, headway_index, headway_lookup, next_departures_n,
    next_departure_overnight, resolve_trip, scheduled_stop_time, downstream_stops, service_time_parse, route_of_trip, confidence_buckets, normalize_events,
    diff_events, enrich_delay, state_changelog, state_changelog_whole, delay_state_current, state_with_ttl, active_delays, delay_stats, top5_per_route, live_max, network_state,
    route_delays, transfer_impacts, broken_transfers_by_station, alerts_filtered, initial_delay_estimate, dwell_seed, per_stop_blend, first_hop_cascade,
    cascade_walk, cascade_walk_averages, predict_impact, blast_radius, track_predictions, baseline_delays, match_predictions, realized_wait, sweep_waits, sweep_outcomes, eval_metrics,
    learned_history, learned_stop_history, history_average, stop_history_average, transfer_reliability)}
