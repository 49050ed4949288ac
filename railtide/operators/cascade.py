"""Delay cascades: initial estimates, downstream seeds, transfer hops, and the best-first walk over both.

Everything that is a lookup is a join. Only the walk, whose next step depends on all before it, is a kernel; it runs in
mapInPandas over impacts with the timetable's graph at hand, so impacts are never shuffled or grouped.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railtide import schema
from railtide.config import Propagation
from railtide.functions.time import hour_of, seconds_of_day
from railtide.operators.schedule import DAY, OVERNIGHT, downstream_stops, headway_index, scheduled_headway
from railtide.operators.transfers import firsts, possible_connections
from railtide.session import broadcast_if_small, cut, stored, total_bytes
from railtide.sources.gtfs import Timetable, with_station

#: The walk's graph, which grows with a service day's timetable and not with the events, is sent to all executors only up
#: to this many bytes of values; a larger one is walked hour by hour, and an hour beyond it is an error.
GRAPH_BYTES = 256 << 20
NO_HEADWAY = 900


def directed(impacts: DataFrame, t: Timetable) -> DataFrame:
    """impacts with station, tod and hour of detection, and the direction of the next viable trip (0 where unknown); station
    and direction may be there already."""
    if not {"station", "direction_id"} <= set(impacts.columns):
        impacts = _with_direction(impacts, t)
    i = impacts.withColumn("tod", seconds_of_day("detected_at", t.tz))
    return i.withColumn("hour", hour_of("tod"))


def _with_direction(impacts: DataFrame, t: Timetable) -> DataFrame:
    trips = t.trips.select(F.col("trip_id").alias("__t"), F.col("direction_id").alias("__d"))
    i = with_station(impacts, t.stops, "station_id", "station").join(trips, F.col("next_viable_trip_id") == F.col("__t"), "left").drop("__t")
    return i.withColumn("direction_id", F.coalesce("__d", F.lit(0))).drop("__d")


def average_impacts(history: DataFrame, now_ns: int | None = None, days: int = 30) -> DataFrame:
    """(from_route, to_route, station, hour, average, n) of downstream impacts, of the last days where now is given."""
    h = history if now_ns is None else history.where(F.col("at") >= now_ns - days * DAY * 1_000_000_000)
    return h.groupBy("from_route", "to_route", "station", "hour").agg(F.avg("downstream_impact").alias("average"), F.count("downstream_impact").alias("n")).where("n > 0")


def average_stop_impacts(stop_history: DataFrame, now_ns: int | None = None, days: int = 30) -> DataFrame:
    h = stop_history if now_ns is None else stop_history.where(F.col("at") >= now_ns - days * DAY * 1_000_000_000)
    return h.groupBy("route", "station", "hour").agg(F.avg("observed").alias("average"), F.count("observed").alias("n")).where("n > 0")


def initial_estimates(impacts: DataFrame, t: Timetable, live: DataFrame, averages: DataFrame, cfg: Propagation = Propagation()) -> DataFrame:
    """directed impacts with ``initial_delay``.

    A train's own route keeps its delay. Another route waits the larger of the extra wait and half a headway, or, where
    both are nothing, a part of the source delay; a late connecting train adds its delay, up to a headway. The estimate
    is then shrunk towards the average of past outcomes by their number.
    """
    i = directed(impacts, t)
    i = scheduled_headway(i, t.once("headways", lambda: broadcast_if_small(headway_index(t.departures))), "to_route_id", "direction_id", "station", "tod")
    lv = broadcast_if_small(live.select(F.col("route_id").alias("__r"), F.col("station").alias("__s"), F.col("delay").alias("__live")))
    i = i.join(lv, (F.col("to_route_id") == F.col("__r")) & (F.col("station") == F.col("__s")), "left").drop("__r", "__s")
    av = broadcast_if_small(averages).select(F.col("from_route").alias("__f"), F.col("to_route").alias("__r"), F.col("station").alias("__s"), F.col("hour").alias("__h"), F.col("average").alias("__avg"), F.col("n").alias("__n"))
    i = i.join(av, (F.col("from_route_id") == F.col("__f")) & (F.col("to_route_id") == F.col("__r")) & (F.col("station") == F.col("__s")) & (F.col("hour") == F.col("__h")), "left").drop("__f", "__r", "__s", "__h")
    return i.withColumn("initial_delay", estimate(cfg)).drop("__live", "__avg", "__n", "headway")


def estimate(cfg: Propagation = Propagation()):
    """The estimate as a column over source_delay_seconds, additional_wait_seconds, headway, __live, __avg and __n."""
    src, wait = F.col("source_delay_seconds").cast("double"), F.col("additional_wait_seconds").cast("double")
    base = F.greatest(wait, F.coalesce(F.col("headway") / 2, F.lit(0.0)))
    base = F.when(base <= 0, src * cfg.load * cfg.elasticity).otherwise(base)
    live = F.coalesce("__live", F.lit(0)).cast("double")
    base = base + F.when(live > 0, F.least(live, F.coalesce("headway", F.lit(float(NO_HEADWAY))))).otherwise(0.0)
    n = F.coalesce("__n", F.lit(0)).cast("double")
    w = n / (n + cfg.shrink)
    blended = F.round(w * F.coalesce("__avg", F.lit(0.0)) + (1 - w) * base).cast("int")
    own = (F.col("from_route_id") == F.col("to_route_id")) & (F.col("from_route_id") != "")
    return F.when(own, F.col("source_delay_seconds")).otherwise(blended)


def _downstream(t: Timetable) -> DataFrame:
    return t.once("downstream", lambda: broadcast_if_small(downstream_stops(t.departures)))


def dwell_seeds(estimated: DataFrame, t: Timetable, stop_averages: DataFrame | None = None, cfg: Propagation = Propagation()) -> DataFrame:
    """(impact_id, position, route_id, stop_id, station, delay, confidence): the seeds of the first hop.

    The first stop has the initial delay; the p-th adds (p - 1) times the rounded extra dwell, with confidence decaying
    by the stop, for as long as both stay above their limits. With stop averages, later stops are blended with them.
    """
    d = _downstream(t).select(F.col("route_id").alias("to_route_id"), "direction_id", "station", "position", "stop_id", "next_station")
    s = estimated.join(d, ["to_route_id", "direction_id", "station"])
    dwell = int(np.floor(cfg.base_dwell * cfg.load * cfg.elasticity + 0.5))
    first = F.col("position") == 1
    s = s.withColumns({"delay": F.col("initial_delay") + (F.col("position") - 1) * dwell,
                       "confidence": F.when(first, 1.0).otherwise(F.pow(F.lit(cfg.decay), F.col("position")))})
    # delay rises and confidence falls along the stops, so cutting at the first failing stop is a filter at the second's delay
    s = s.where(first | ((F.col("confidence") >= cfg.min_confidence) & (F.col("initial_delay") + dwell >= cfg.min_delay)))
    if stop_averages is not None:
        a = broadcast_if_small(stop_averages).select(F.col("route").alias("to_route_id"), F.col("station").alias("next_station"), "hour", "average", "n")
        s = s.join(a, ["to_route_id", "next_station", "hour"], "left")
        w = F.col("n") / (F.col("n") + cfg.shrink)
        s = s.withColumn("delay", F.when(first | F.col("n").isNull() | (F.col("n") < cfg.per_stop_min), F.col("delay")).otherwise(F.round(w * F.col("average") + (1 - w) * F.col("delay"))).cast("int"))
    return s.select("impact_id", "position", F.col("to_route_id").alias("route_id"), "stop_id", F.col("next_station").alias("station"), F.col("delay").cast("int").alias("delay"), "confidence")


def transfer_hops(items: DataFrame, t: Timetable, live: DataFrame, cfg: Propagation = Propagation()) -> DataFrame:
    """Connecting routes that a delay at a station reaches: (items' columns, to_station, to_route_id, new_delay, new_confidence).

    ``items`` has route_id, station, delay, confidence. Live lateness of the connecting route makes it easier to catch.
    """
    c = broadcast_if_small(possible_connections(t).withColumnRenamed("from_station", "station"))
    lv = broadcast_if_small(live).select(F.col("route_id").alias("to_route_id"), F.col("station").alias("to_station"), F.col("delay").alias("__live"))
    h = items.join(c, "station").where("to_route_id <> route_id").join(lv, ["to_route_id", "to_station"], "left")
    h = h.where(F.col("delay") >= F.col("min_transfer") + F.coalesce("__live", F.lit(0)))
    h = h.withColumns({"new_confidence": F.col("confidence") * cfg.decay, "new_delay": (F.col("delay") * F.lit(cfg.elasticity)).cast("int")})
    return h.where((F.col("new_confidence") >= cfg.min_confidence) & (F.col("new_delay") >= cfg.min_delay)).drop("__live", "min_transfer")


@dataclass
class Graph:
    """What the walk looks up, as plain dictionaries of one service day."""

    downstream: dict = field(default_factory=dict)  # (route, direction, station) -> [(stop, station)]
    transfers: dict = field(default_factory=dict)  # station -> [(station, route, least transfer)]
    next_dirs: dict = field(default_factory=dict)  # (route, station) -> ([dep], [direction])
    live: dict = field(default_factory=dict)  # (route, station) -> delay
    averages: dict = field(default_factory=dict)  # (route, station, hour) -> (average, n)

    def direction(self, route: str, station: str, tod: int) -> int | None:
        deps, dirs = self.next_dirs.get((route, station), ((), ()))
        i = bisect_left(deps, tod)
        if tod < OVERNIGHT:
            j = bisect_left(deps, tod + DAY)
            if j < len(deps) and (i == len(deps) or deps[j] - DAY < deps[i]):
                i = j
        return dirs[i] if i < len(deps) else None


def _tables(t: Timetable, live: DataFrame, averages: DataFrame | None, cfg: Propagation, hour: int | None) -> dict[str, DataFrame]:
    deps = firsts(t).select("route_id", "station", F.col("dep").alias("departure_secs"), "direction_id")
    if hour is not None:
        # with the first departure after the hour, in either frame, every time of day of the hour finds its next
        upto = Window.partitionBy("route_id", "station").orderBy("departure_secs")
        frames = []
        for low in (hour * 3600, hour * 3600 + DAY):
            after = F.count_if(F.col("departure_secs") >= low + 3600).over(upto)
            frames.append(deps.where(F.col("departure_secs") >= low).withColumn("__n", after).where("__n <= 1").drop("__n"))
        deps = frames[0].unionByName(frames[1]).distinct()
        averages = averages.where(F.col("hour") == hour) if averages is not None else None
    deps = deps.groupBy("route_id", "station").agg(F.sort_array(F.collect_list(F.struct("departure_secs", "direction_id"))).alias("x"))
    deps = cut(deps.select("route_id", "station", F.col("x.departure_secs").alias("secs"), F.col("x.direction_id").alias("ways")))
    out = {"downstream": _downstream(t), "transfers": possible_connections(t), "deps": deps, "live": live}
    if averages is not None:
        out["averages"] = averages.where(F.col("n") >= cfg.per_stop_min)
    return out


def collect_graph(tables: dict[str, DataFrame]) -> Graph:
    g = Graph(defaultdict(list), defaultdict(list), {}, {}, {})
    for r in tables["downstream"].orderBy("route_id", "direction_id", "station", "position").toLocalIterator():
        g.downstream[r["route_id"], r["direction_id"], r["station"]].append((r["stop_id"], r["next_station"]))
    for r in tables["transfers"].orderBy("from_station", "to_station", "to_route_id").toLocalIterator():
        g.transfers[r["from_station"]].append((r["to_station"], r["to_route_id"], r["min_transfer"]))
    for r in tables["deps"].toLocalIterator():
        # numbers side by side; only unknown directions need a list
        ways = r["ways"] if None in r["ways"] else array("i", r["ways"])
        g.next_dirs[r["route_id"], r["station"]] = array("i", r["secs"]), ways
    g.live = {(r["route_id"], r["station"]): r["delay"] for r in tables["live"].toLocalIterator()}
    if "averages" in tables:
        g.averages = {(r["route"], r["station"], r["hour"]): (r["average"], r["n"]) for r in tables["averages"].toLocalIterator()}
    return Graph(dict(g.downstream), dict(g.transfers), g.next_dirs, g.live, g.averages)


def _half_away(x: float) -> int:
    return int(np.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def walk(g: Graph, route: str, station: str, direction: int, start: int, tod: int, cfg: Propagation) -> list[tuple]:
    """(route, station, delay, confidence, hops, type) in the order found: largest delay first; ties by fewer hops, higher
    confidence, route and station."""
    queue: list[tuple] = []
    hour = tod // 3600 % 24
    dwell = _half_away(cfg.base_dwell * cfg.load * cfg.elasticity)

    def put(r: str, s: str, delay: int, conf: float, hops: int, kind: str) -> None:
        heapq.heappush(queue, (-delay, hops, -conf, r, s, kind))

    def seed(r: str, s: str, way: int, delay: int, conf: float, hops: int, kind: str) -> None:
        for k, (_, at) in enumerate(g.downstream.get((r, way, s), ())):
            c = conf * cfg.decay ** (k + 1) if k else conf
            total = delay + k * dwell
            if k and (c < cfg.min_confidence or total < cfg.min_delay):
                break
            avg, n = g.averages.get((r, at, hour), (0.0, 0)) if k else (0.0, 0)
            if n >= cfg.per_stop_min:
                w = n / (n + cfg.shrink)
                total = _half_away(w * avg + (1 - w) * total)
            put(r, at, total, c, hops, kind)

    seed(route, station, direction, start, 1.0, 1, "dwell_increase")
    seen, out = set(), []
    while queue and len(out) < cfg.max_impacts:
        d, hops, c, r, s, kind = heapq.heappop(queue)
        delay, conf = -d, -c
        if (r, s) in seen:
            continue
        seen.add((r, s))
        out.append((r, s, delay, conf, hops, kind))
        if hops >= cfg.max_depth or delay < cfg.min_delay:
            continue
        less, later = conf * cfg.decay, int(delay * cfg.elasticity)
        if less >= cfg.min_confidence and later >= cfg.min_delay:
            for to, r2, least in g.transfers.get(s, ()):
                if r2 != r and (r2, to) not in seen and delay >= least + g.live.get((r2, to), 0):
                    put(r2, to, later, less, hops + 1, "cascade_transfer")
        if kind == "cascade_transfer" and (way := g.direction(r, s, tod)) is not None:
            seed(r, s, way, delay, conf, hops, "cascade_dwell")
    return out


def cascade(estimated: DataFrame, t: Timetable, live: DataFrame, stop_averages: DataFrame | None = None, cfg: Propagation = Propagation(),
            most: int = GRAPH_BYTES, most_of_hour: int = GRAPH_BYTES) -> DataFrame:
    """Downstream impacts of every impact (schema.DOWNSTREAM), by the best-first walk; position is the order of finding.

    Impacts without a time or an estimate have none. The graph is measured before it is collected, and broadcast once.
    """
    spark = estimated.sparkSession
    tables = _tables(t, live, stop_averages, cfg, None)
    rows = stored(estimated.select("impact_id", "to_route_id", "station", "direction_id", "initial_delay", "tod", "hour").where("tod is not null and initial_delay is not null"))
    if sum(map(total_bytes, tables.values())) <= most:
        return _walk_all(rows, spark.sparkContext.broadcast(collect_graph(tables)), stop_averages is not None, cfg)
    out = None
    for hour in sorted(r["hour"] for r in rows.select("hour").distinct().collect()) or [0]:
        tables = _tables(t, live, stop_averages, cfg, hour)
        if (size := sum(map(total_bytes, tables.values()))) > most_of_hour:
            raise ValueError(f"the timetable of hour {hour} takes {size} bytes: divide it by region, or raise most_of_hour")
        graph = spark.sparkContext.broadcast(collect_graph(tables))
        part = _walk_all(rows.where(F.col("hour") == hour), graph, stop_averages is not None, cfg)
        out = part if out is None else out.unionByName(part)
    return out


#: What a walk depends on as long as it doesn't ask for the direction of a connecting route, which the second decides.
START = ["to_route_id", "station", "direction_id", "initial_delay", "hour"]
FOUND = [x.strip() for x in schema.DOWNSTREAM.split(",")][2:]


def _walk_all(rows: DataFrame, graph: Broadcast, hourly: bool, cfg: Propagation) -> DataFrame:
    """The walks of all rows. Rows of one start share a walk, unless it asks for the time: those walk row by row."""
    if not hourly:
        rows = rows.withColumn("hour", F.lit(0))
    starts = rows.select(*START).distinct()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in starts.schema)
    shared = stored(starts.mapInArrow(_sharer(graph, cfg), f"{kinds}, found array<struct<{', '.join(f.replace(' ', ': ', 1) for f in FOUND)}>>"))
    asks = shared.where("found is null").select(*START)
    out = rows.join(broadcast_if_small(shared.where("found is not null")), START)
    out = out.select("impact_id", F.posexplode("found").alias("position", "x")).select("impact_id", "position", "x.*")
    if asks.isEmpty():
        return out
    return out.unionByName(rows.join(broadcast_if_small(asks), START, "left_semi").mapInPandas(_walker(graph, cfg), schema.DOWNSTREAM))


class AsksTheTime(Exception):
    """A walk needs more than the hour."""


class Timeless(Graph):
    def direction(self, route: str, station: str, tod: int) -> int | None:
        if (route, station) in self.next_dirs:
            raise AsksTheTime
        return None


def _sharer(graph: Broadcast, cfg: Propagation):
    names = [x.split(" ")[0] for x in FOUND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Timeless(**vars(graph.value))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.float32(), pa.int32(), pa.string()]
        of = pa.list_(pa.struct(list(zip(names, kinds))))
        for b in batches:
            found = []
            for route, station, way, start, hour in zip(*(b.column(c).to_pylist() for c in START)):
                try:
                    found.append([dict(zip(names, x)) for x in walk(g, route, station, way, start, hour * 3600, cfg)])
                except AsksTheTime:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in START), pa.array(found, of)], [*START, "found"])

    return run


def _walker(graph: Broadcast, cfg: Propagation):
    names = [x.strip().split(" ")[0] for x in schema.DOWNSTREAM.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.value
        for b in batches:
            out = []
            for i, route, station, way, start, tod in b[["impact_id", "to_route_id", "station", "direction_id", "initial_delay", "tod"]].itertuples(index=False):
                for k, (r, s, delay, conf, hops, kind) in enumerate(walk(g, route, station, int(way), int(start), int(tod), cfg)):
                    out.append((i, k, r, s, delay, np.float32(conf), hops, kind))
            yield pd.DataFrame(out, columns=names)

    return run
