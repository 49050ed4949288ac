"""Lookups on the timetable: headways, next departures, trip resolution, scheduled stops and downstream stops.

Probes may be billions of rows, the timetable is one service day. Every lookup is therefore an equi-join of the probes
with an index built from the timetable, never a range join: the next-departure index holds, per station, route and
slot of ten minutes, the departures of that slot and the first ones after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railtide.session import broadcast_if_small

OVERNIGHT = 14_400
DAY = 86_400
MAX_GAP = 10_800
MAX_HOUR = 27
#: Seconds per slot of the next-departure index: a few headways.
SLOT = 600


def routes_at_stop(departures: DataFrame) -> DataFrame:
    return departures.select("station", "route_id").distinct()


def graph_stats(stops: DataFrame, routes: DataFrame, transfers: DataFrame) -> DataFrame:
    """One row: stops, parent stations, routes and transfer rows."""
    s = stops.agg(F.count("*").alias("total_stops"), F.count_if(F.col("location_type") == 1).alias("parent_stops"))
    return s.crossJoin(routes.agg(F.count("*").alias("total_routes"))).crossJoin(transfers.agg(F.count("*").alias("transfer_pairs")))


def headway_index(departures: DataFrame) -> DataFrame:
    """(route_id, direction_id, station, hour, headway, gaps): exact median gap of departures that begin in an hour."""
    key = ["route_id", "direction_id", "station"]
    minute = F.floor(F.col("departure_secs") / 60).cast("int")
    m = departures.where("departure_secs >= 0").groupBy(*key, minute.alias("minute")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(departure_secs % 60 AS INT))")).alias("bits"))
    # gaps are counted between different seconds only, so an hour is the sorted seconds of its minutes
    secs = F.expr("transform(filter(sequence(0, 59), x -> getbit(bits, x) = 1), x -> minute * 60 + x)")
    h = m.groupBy(*key, F.floor(F.col("minute") / 60).cast("int").alias("hour")).agg(F.sort_array(F.flatten(F.collect_list(secs))).alias("secs"))
    h = h.withColumn("after", F.lead(F.get("secs", F.lit(0))).over(Window.partitionBy(*key).orderBy("hour"))).where(F.col("hour") <= MAX_HOUR)
    gap = F.zip_with("secs", F.concat(F.expr("slice(secs, 2, size(secs))"), F.array("after")), lambda a, b: b - a)
    h = h.withColumn("gap", F.sort_array(F.filter(gap, lambda x: x <= MAX_GAP))).withColumn("n", F.size("gap")).where("n > 0")
    return h.select(*key, "hour", F.expr("(gap[(n - 1) DIV 2] + gap[n DIV 2]) / 2").alias("headway"), F.col("n").cast("long").alias("gaps"))


def scheduled_headway(probes: DataFrame, headways: DataFrame, route: str, direction: str, station: str, secs: str, out: str = "headway") -> DataFrame:
    """probes with the headway at a time; before 04:00 without one, the same hour of the night before (hour + 24)."""
    hour = F.floor(F.col(secs) / 3600).cast("int")
    h = headways.select(F.col("route_id").alias("__r"), F.col("direction_id").alias("__d"), F.col("station").alias("__s"), F.col("hour").alias("__h"), F.col("headway").alias("__w"))

    def join(df: DataFrame, at: Column, name: str) -> DataFrame:
        x = h.withColumnRenamed("__w", name)
        return df.join(x, (F.col(route) == F.col("__r")) & (F.col(direction) == F.col("__d")) & (F.col(station) == F.col("__s")) & (at == F.col("__h")), "left").drop("__r", "__d", "__s", "__h")

    df = join(probes, F.when((hour >= 0) & (hour <= MAX_HOUR), hour), "__w0")
    df = join(df, F.when((hour >= 0) & (hour < 4), hour + 24), "__w1")
    return df.withColumn(out, F.coalesce("__w0", "__w1")).drop("__w0", "__w1")


def departure_minutes(departures: DataFrame) -> DataFrame:
    """(station, route_id, minute, bits, later): the seconds of each minute with a departure, and the first second after it.

    One row per station, route and minute from 0 to the last departure's. It doesn't grow with the departures of a second."""
    key = ["station", "route_id"]
    d = departures.where("departure_secs >= 0").select(*key, F.col("departure_secs").alias("dep")).withColumn("minute", F.floor(F.col("dep") / 60).cast("int"))
    m = d.groupBy(*key, "minute").agg(F.bit_or(F.expr("shiftleft(1L, CAST(dep % 60 AS INT))")).alias("bits"), F.min("dep").alias("first"))
    grid = m.groupBy(*key).agg(F.max("minute").alias("last")).select(*key, F.explode(F.sequence(F.lit(0), "last")).alias("minute"))
    after = Window.partitionBy(*key).orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.join(m, [*key, "minute"], "left")
    return grid.select(*key, "minute", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"), F.min("first").over(after).cast("int").alias("later"))


def next_second(probes: DataFrame, minutes: DataFrame, station: str, route: str, after: Column, out: str) -> DataFrame:
    """probes with the second of the first departure at or after a time; null where there is none."""
    m = minutes.select(F.col("station").alias("__s"), F.col("route_id").alias("__r"), F.col("minute").alias("__m"), F.col("bits").alias("__bits"), F.col("later").alias("__later"))
    p = probes.withColumn("__t", F.greatest(after, F.lit(0)).cast("int")).withColumn("__t", F.when(after.isNotNull(), F.col("__t")))
    p = p.withColumn("__minute", F.floor(F.col("__t") / 60).cast("int"))
    j = p.join(m, (F.col(station) == F.col("__s")) & (F.col(route) == F.col("__r")) & (F.col("__minute") == F.col("__m")), "left")
    j = j.withColumn("__rest", F.expr("shiftright(__bits, CAST(__t % 60 AS INT))"))
    hit = F.when(F.col("__rest") == 0, F.col("__later")).otherwise(F.col("__t") + F.expr("bit_count(~__rest & (__rest - 1L))"))
    return j.withColumn(out, hit.cast("int")).drop("__s", "__r", "__m", "__bits", "__later", "__t", "__minute", "__rest")


def first_departures(departures: DataFrame) -> DataFrame:
    """(station, route_id, dep, trip_id, stop_id, direction_id): of each second the first departure by trip and sequence."""
    x = F.min(F.struct("trip_id", "stop_sequence", "stop_id", "direction_id")).alias("x")
    return departures.where("departure_secs >= 0").groupBy("station", "route_id", F.col("departure_secs").alias("dep")).agg(x).select(
        "station", "route_id", "dep", "x.trip_id", "x.stop_id", "x.direction_id")


def numbered_places(departures: DataFrame) -> DataFrame:
    """(station, route_id, place): a number for each route at each station."""
    return routes_at_stop(departures).select("station", "route_id", (F.row_number().over(Window.orderBy("station", "route_id")) - 1).cast("long").alias("place"))


#: Bits of a place's minutes in the keys of second_index; departure_secs / 60 is below it.
MINUTE_BITS = 26


def second_index(first: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(at, bits, ways, odd, marks, later): as departure_minutes by numbered place, with what is known of each second's first departure.

    ``first`` has place, dep and direction_id of first departures, ``marked`` the place and dep of those to be told apart.
    Bits of ``ways`` say direction 1, of ``odd`` one that is neither 0, 1 nor unknown. Seconds come out of next_marked as
    4 x second + 2 x mark + way, and ``later`` holds one so. All columns are whole numbers, so probes hash one number."""
    minute = F.floor(F.col("dep") / 60).cast("int").alias("minute")
    bit, none = F.expr("shiftleft(1L, CAST(dep % 60 AS INT))"), F.lit(0).cast("long")
    way = F.coalesce("direction_id", F.lit(0))
    m = first.groupBy("place", minute).agg(F.bit_or(bit).alias("bits"), F.bit_or(F.when(way == 1, bit).otherwise(none)).alias("ways"), F.bit_or(F.when(way.isin(0, 1), none).otherwise(bit)).alias("odd"))
    if marked is None:
        m = m.withColumn("marks", none)
    else:
        m = m.join(marked.groupBy("place", minute).agg(F.bit_or(bit).alias("marks")), ["place", "minute"], "left").withColumn("marks", F.coalesce("marks", none))
    m = m.withColumn("low", F.expr("bit_count(~bits & (bits - 1L))"))
    m = m.withColumn("own", F.expr("(minute * 60L + low) * 4 + getbit(marks, low) * 2 + getbit(ways, low)"))
    grid = m.groupBy("place").agg(F.max("minute").alias("last")).select("place", F.explode(F.sequence(F.lit(0), "last")).alias("minute"))
    after = Window.partitionBy("place").orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.join(m, ["place", "minute"], "left")
    at = F.shiftleft("place", MINUTE_BITS) + F.col("minute")
    return grid.select(at.alias("at"), *(F.coalesce(c, none).alias(c) for c in ("bits", "ways", "odd", "marks")), F.min("own").over(after).alias("later"))


def next_marked(probes: DataFrame, seconds: DataFrame, place: str, after: Column, out: str) -> DataFrame:
    """probes with the first departure at or after a time as second_index tells it; null where there is none."""
    s = seconds.select(*(F.col(c).alias(f"__{c}") for c in ("at", "bits", "ways", "marks", "later")))
    p = probes.withColumn("__t", F.when(after.isNotNull(), F.greatest(after, F.lit(0)).cast("int")))
    j = p.join(s, F.shiftleft(F.col(place), MINUTE_BITS) + F.floor(F.col("__t") / 60) == F.col("__at"), "left")
    j = j.withColumn("__rest", F.expr("shiftright(__bits, CAST(__t % 60 AS INT))")).withColumn("__x", F.expr("CAST(__t % 60 + bit_count(~__rest & (__rest - 1L)) AS INT)"))
    hit = F.when(F.col("__rest") == 0, F.col("__later")).otherwise(F.expr("(__t - __t % 60 + __x) * 4L + getbit(__marks, least(__x, 63)) * 2 + getbit(__ways, least(__x, 63))"))
    return j.withColumn(out, hit).drop("__at", "__bits", "__ways", "__marks", "__later", "__t", "__rest", "__x")


def night_seconds(places: DataFrame, seconds: DataFrame) -> DataFrame:
    """(at, nights): the seconds before 04:00 of each place that belong to the night before, keyed as second_index: there
    the time plus a day has a departure, and the raw time none or one after a longer wait."""
    p = next_marked(places.select("place", F.explode(F.sequence(F.lit(0), F.lit(OVERNIGHT - 1))).alias("tod")), seconds, "place", F.col("tod"), "raw")
    p = next_marked(p, seconds, "place", F.col("tod") + DAY, "wrap")
    night = F.col("wrap").isNotNull() & (F.col("raw").isNull() | (F.shiftright("wrap", 2) - DAY < F.shiftright("raw", 2)))
    at = F.shiftleft("place", MINUTE_BITS) + F.floor(F.col("tod") / 60)
    return p.where(night).groupBy(at.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, tod % 60)")).alias("nights"))


def departure_index(departures: DataFrame, n: int, slot: int = SLOT) -> DataFrame:
    """(station, route_id, slot, deps): departures of a slot and the first n after it, in order of (dep, trip, sequence).

    One row per station, route and slot from 0 to the last departure's, so any time of day finds its row by equality.
    What follows a slot is found by rank: the departures numbered next after those up to the slot.
    """
    key = ["station", "route_id"]
    x = F.struct(F.col("departure_secs").alias("dep"), "trip_id", "stop_sequence", "stop_id", "direction_id")
    d = departures.where("departure_secs >= 0").select(*key, F.floor(F.col("departure_secs") / slot).cast("int").alias("slot"), x.alias("x"))
    d = d.withColumn("rk", F.row_number().over(Window.partitionBy(*key).orderBy("x")))
    own = d.groupBy(*key, "slot").agg(F.sort_array(F.collect_list("x")).alias("own"), F.count("*").alias("c"))
    grid = own.groupBy(*key).agg(F.max("slot").alias("last")).select(*key, F.explode(F.sequence(F.lit(0), "last")).alias("slot"))
    upto = Window.partitionBy(*key).orderBy("slot")
    grid = grid.join(own, [*key, "slot"], "left").withColumn("upto", F.sum(F.coalesce("c", F.lit(0))).over(upto))
    wanted = grid.select(*key, "slot", F.explode(F.sequence(F.col("upto") + 1, F.col("upto") + n)).alias("rk"))
    after = wanted.join(d.select(*key, F.col("rk").cast("long").alias("rk"), "x"), [*key, "rk"]).groupBy(*key, "slot").agg(F.sort_array(F.collect_list("x")).alias("after"))
    none = F.array().cast(own.schema["own"].dataType)
    return grid.join(after, [*key, "slot"], "left").select(*key, "slot", F.concat(F.coalesce("own", none), F.coalesce("after", none)).alias("deps"))


def next_departures(probes: DataFrame, index: DataFrame, station: str, route: str, after: str | Column, n: int, out: str = "deps", slot: int = SLOT) -> DataFrame:
    """probes with an array of the first n departures at or after a time (any direction); empty where there is none.

    ``index`` must be made for at least n and with the same slot."""
    t = F.col(after) if isinstance(after, str) else after
    i = index.select(F.col("station").alias("__s"), F.col("route_id").alias("__r"), F.col("slot").alias("__h"), F.col("deps").alias("__deps"))
    p = probes.withColumn("__t", t).withColumn("__slot", F.when(F.col("__t").isNotNull(), F.floor(F.greatest(F.col("__t"), F.lit(0)) / slot).cast("int")))
    j = p.join(i, (F.col(station) == F.col("__s")) & (F.col(route) == F.col("__r")) & (F.col("__slot") == F.col("__h")), "left")
    # sorted, so what lies before the time is counted on the seconds alone, and only the wanted departures are copied
    before = F.size(F.filter(F.col("__deps.dep"), lambda x: x < F.col("__t")))
    hit = F.when(F.col("__t").isNotNull(), F.slice("__deps", before + 1, F.lit(n)))
    return j.withColumn(out, F.coalesce(hit, F.array().cast(index.schema["deps"].dataType))).drop("__s", "__r", "__h", "__deps", "__t", "__slot")


def next_overnight(probes: DataFrame, index: DataFrame, station: str, route: str, tod: str, n: int, out: str = "deps", eff: str = "effective_tod") -> DataFrame:
    """As next_departures, in the frame that fits: before 04:00 also the time plus a day is tried, and taken if it has a
    departure and the raw time has none or a longer wait. ``eff`` is the time in the chosen frame."""
    p = next_departures(probes, index, station, route, tod, n, "__raw")
    p = next_departures(p, index, station, route, F.when(F.col(tod) < OVERNIGHT, F.col(tod) + DAY), n, "__wrap")
    wait = lambda c, add: F.get(F.col(c), F.lit(0))["dep"] - F.col(tod) - add
    wrapped = (F.size("__wrap") > 0) & ((F.size("__raw") == 0) | (wait("__wrap", DAY) < wait("__raw", 0)))
    return p.withColumn(eff, F.when(wrapped, F.col(tod) + DAY).otherwise(F.col(tod))).withColumn(out, F.when(wrapped, F.col("__wrap")).otherwise(F.col("__raw"))).drop("__raw", "__wrap")


def suffix(trip: str | Column) -> Column:
    """Text after the first '_'; null without one, or where nothing follows."""
    t = F.col(trip) if isinstance(trip, str) else trip
    at = F.instr(t, "_")
    return F.when((at > 0) & (at < F.length(t)), F.substr(t, at + 1))


def resolve_trips(df: DataFrame, departures: DataFrame, trip: str = "trip_id", out: str = "static_trip_id") -> DataFrame:
    """df with the timetable's id of a trip: the exact id, else the one trip whose id ends so after its first '_'."""
    ids = departures.select(F.col("trip_id").alias("__id")).distinct()
    short = ids.groupBy(suffix("__id").alias("__suffix")).agg(F.count("*").alias("__n"), F.min("__id").alias("__long")).where("__n = 1 and __suffix is not null").drop("__n")
    d = df.join(ids, F.col(trip) == F.col("__id"), "left").join(short, F.col(trip) == F.col("__suffix"), "left")
    return d.withColumn(out, F.coalesce("__id", "__long")).drop("__id", "__suffix", "__long")


def scheduled_stop_times(df: DataFrame, departures: DataFrame, stops: DataFrame, trip: str = "static_trip_id", stop: str = "stop_id") -> DataFrame:
    """df with sched_stop_id, arrival_secs, departure_secs of the trip's stop: the same stop, else one of its station;
    of several the first by stop_sequence. Null where the trip doesn't call there."""
    from railtide.sources.gtfs import with_station

    first = F.min(F.struct("stop_sequence", F.col("stop_id").alias("sched_stop_id"), "arrival_secs", "departure_secs"))
    raw = departures.groupBy("trip_id", F.col("stop_id").alias("__stop")).agg(first.alias("__raw")).withColumnRenamed("trip_id", "__t1")
    par = departures.groupBy("trip_id", F.col("station").alias("__st")).agg(first.alias("__par")).withColumnRenamed("trip_id", "__t2")
    d = with_station(df, stops, stop, "__station")
    d = d.join(raw, (F.col(trip) == F.col("__t1")) & (F.col(stop) == F.col("__stop")), "left")
    d = d.join(par, (F.col(trip) == F.col("__t2")) & (F.col("__station") == F.col("__st")), "left")
    x = F.coalesce("__raw", "__par")
    return d.withColumns({c: x[c] for c in ("sched_stop_id", "arrival_secs", "departure_secs")}).drop("__t1", "__stop", "__raw", "__t2", "__st", "__par", "__station")


def downstream_stops(departures: DataFrame) -> DataFrame:
    """(route_id, direction_id, station, position, stop_id, next_station): the later stops of the day's earliest trip of
    a route and direction that calls at a station other than as its last stop."""
    d = departures.select("route_id", "direction_id", "trip_id", "station", "stop_id", "stop_sequence", "departure_secs")
    last = Window.partitionBy("trip_id").orderBy(F.desc("stop_sequence"), F.desc("departure_secs"), F.desc("stop_id"))
    pick = F.min(F.struct("departure_secs", "trip_id", "stop_sequence")).alias("x")
    first = (
        d.withColumn("__l", F.row_number().over(last)).where("__l > 1").groupBy("route_id", "direction_id", F.col("station").alias("from_station")).agg(pick)
        .select("route_id", "direction_id", "x.trip_id", "from_station", F.col("x.stop_sequence").alias("from_seq"))
    )
    first = broadcast_if_small(first)
    later = first.join(d.select("trip_id", F.col("station").alias("next_station"), "stop_id", "stop_sequence", "departure_secs"), "trip_id").where("stop_sequence > from_seq")
    pos = Window.partitionBy("route_id", "direction_id", "from_station").orderBy("stop_sequence", "departure_secs", "stop_id")
    return later.select("route_id", "direction_id", F.col("from_station").alias("station"), F.row_number().over(pos).alias("position"), "stop_id", "next_station")
