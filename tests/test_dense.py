"""Look-ups on dense timetables: what a probe reads doesn't grow with the departures."""

import random

from pyspark.sql import functions as F

from railtide.operators import evaluation, schedule, state, transfers
from railtide.sources.gtfs import Timetable

DEPARTURES = "trip_id string, route_id string, direction_id int, station string, stop_id string, stop_sequence int, departure_secs int"
EVENT = "seq long, agency_id string, trip_id string, route_id string, stop_id string, delay_seconds int, observed_at long, scheduled_arrival long, type string"
A = "ARRIVAL_DELAY"


def test_minutes_of_a_dense_timetable(spark):
    r = random.Random(3)
    rows = [(f"t{k}", "L", 0, "P", "P", 1, r.choice([r.randrange(90_000), 28_800 + r.randrange(120)])) for k in range(4000)] + [("x", "M", 0, "P", "P", 1, 59)]
    d = spark.createDataFrame(rows, DEPARTURES)
    minutes = schedule.departure_minutes(d)
    last = max(x[6] for x in rows)
    assert minutes.count() == last // 60 + 2  # before: every departure was in an array that each probe of its slot went through
    assert set(minutes.dtypes) == {("station", "string"), ("route_id", "string"), ("minute", "int"), ("bits", "bigint"), ("later", "int")}
    probes = [(i, r.choice("LMN"), t) for i, t in enumerate([*(r.randrange(-50, 91_000) for _ in range(300)), 0, 59, 60, last, last + 1, 200_000, None])]
    got = schedule.next_second(spark.createDataFrame(probes, "i int, r string, t int").withColumn("s", F.lit("P")), minutes, "s", "r", F.col("t"), "dep")
    got = {x["i"]: x["dep"] for x in got.collect()}
    for i, route, t in probes:
        assert got[i] == min((x[6] for x in rows if x[1] == route and t is not None and x[6] >= t), default=None)
    first = {(x["route_id"], x["dep"]): x["trip_id"] for x in schedule.first_departures(d).collect()}
    assert first == {(a, s): min(x[0] for x in rows if (x[1], x[6]) == (a, s)) for a, s in {(x[1], x[6]) for x in rows}}


def test_stored_delays_of_connections_either_way(spark):
    """Changes that travel with their departure say the same as all changes merged in order; agencies are kept apart."""
    r = random.Random(5)
    deps = [(f"t{k}", "T", 0, "P", r.choice(["P", "P1"]), 1, 30_000 + 120 * k) for k in range(12)] + [("f", "F", 1, "P", "P", 1, 30_000)]
    d = spark.createDataFrame(deps, DEPARTURES)
    stops = spark.createDataFrame([("P", "", ""), ("P1", "", "P")], "stop_id string, stop_name string, parent_station string")
    trips = d.select("trip_id", "route_id", "direction_id").distinct()
    t = Timetable(stops, None, trips, spark.createDataFrame([("P", "P", 2, 90)], "from_station string, to_station string, transfer_type int, min_transfer_time int"), d)
    at = 1_704_844_800
    log, late = [], []
    for n in range(400):
        if n % 2:
            late.append((n, r.choice("ab"), "f", "F", "P", r.randrange(1, 600), at + n, at + r.randrange(29_000, 31_500), A))
        else:
            trip = r.choice(deps[:12])
            log.append((n, r.choice("aab"), trip[0], "T", r.choice(["P", "P1"]), r.randrange(-100, 300), at + n, 0, r.choice([A, A, A, "SKIP_STOP", "TRIP_CANCELLED"])))
    changes = state.changelog(spark.createDataFrame(log, EVENT))
    assert changes.where("op = 'delete'").count() > 20
    e = spark.createDataFrame(late, EVENT)
    found = [sorted(map(tuple, transfers.transfer_impacts(e, t, changes, most_changes=n).collect())) for n in (1000, 0)]
    assert found[0] == found[1] and len(found[0]) > 50
    none = transfers.transfer_impacts(e, t).collect()
    assert sorted(map(tuple, none)) != found[0]  # the stored delays do decide


def test_realized_wait_by_the_second(spark):
    """Predictions share the candidates of their departure's second; wanted values step by step."""
    r = random.Random(8)
    deps = [(f"t{k}", "T", k % 2, "P", r.choice(["P", "P1"]), 1, 30_000 + 60 * r.randrange(40)) for k in range(60)]
    d = spark.createDataFrame(deps, DEPARTURES)
    stops = spark.createDataFrame([("P", "", ""), ("P1", "", "P")], "stop_id string, stop_name string, parent_station string")
    t = Timetable(stops, None, None, None, d)
    held = {(a, x[0], x[4]): r.randrange(-200, 400) for a in "ab" for x in deps if r.random() < 0.5}
    st = spark.createDataFrame([(*k, v) for k, v in held.items()], "agency_id string, trip_id string, stop_id string, delay_seconds int")
    pending = [(f"p{n}", r.choice("ab"), "T", "P", r.choice([-1, 0, 1]), x, x + r.randrange(0, 900), True) for n, x in enumerate(30_000 + r.randrange(2500) for _ in range(200))]
    p = spark.createDataFrame(pending, "id string, agency_id string, route_id string, source_station string, direction int, sched_conn_dep_secs int, earliest_catch_secs int, is_primary boolean")
    want = {}
    for i, a, _, _, way, at, catch, _ in pending:
        for x in sorted((x for x in deps if x[6] >= at), key=lambda x: (x[6], x[0]))[:10]:
            real = x[6] + held.get((a, x[0], x[4]), 0)
            if x[6] <= catch + 1800 and way in (-1, x[2]) and real >= catch:
                want[i] = max(0, real - at)
                break
    minutes = schedule.departure_minutes
    try:  # before: an index row for each slot held every departure of it
        used = []
        evaluation.departure_minutes = lambda x: used.append(1) or minutes(x)
        got = {x["id"]: x["wait"] for x in evaluation.realized_wait(p, t, st).collect()}
    finally:
        evaluation.departure_minutes = minutes
    assert used and got == want and 50 < len(want) < 200


def test_seconds_with_ways_and_marks(spark):
    """The first departure of a time with its direction and mark, and the frame of each second before 04:00."""
    r = random.Random(4)
    rows = [(f"t{k}", "L", k % 2, "P", "P", 1, r.choice([r.randrange(100_000), 3_600 + r.randrange(90)])) for k in range(300)] + [("x", "M", 1, "P", "P", 1, 59)]
    d = spark.createDataFrame(rows, DEPARTURES)
    places = schedule.numbered_places(d)
    number = {x["route_id"]: x["place"] for x in places.collect()}
    first = schedule.first_departures(d).join(places, ["station", "route_id"])
    seconds = schedule.second_index(first, first.where("dep % 3 = 0").select("place", "dep"))
    probes = [(i, number.get(route, 9), t) for i, (route, t) in enumerate([*((r.choice("LMN"), r.randrange(-50, 101_000)) for _ in range(300)), ("L", 0), ("M", 59), ("M", 60), ("L", None)])]
    got = {x["i"]: x["x"] for x in schedule.next_marked(spark.createDataFrame(probes, "i int, p long, t int"), seconds, "p", F.col("t"), "x").collect()}
    route_of = {v: k for k, v in number.items()}

    def following(p, t):
        return min(((x[6], x[0], x[2]) for x in rows if x[1] == route_of.get(p) and t is not None and x[6] >= t), default=None)

    for i, p, t in probes:
        n = following(p, t)
        assert got[i] == (None if n is None else n[0] * 4 + (n[0] % 3 == 0) * 2 + n[2])
    nights = {x["at"]: x["nights"] for x in schedule.night_seconds(places, seconds).collect()}
    for p in number.values():
        for t in range(0, schedule.OVERNIGHT, 7):
            raw, wrap = following(p, t), following(p, t + schedule.DAY)
            night = wrap is not None and (raw is None or wrap[0] - schedule.DAY < raw[0])
            assert night == bool(nights.get((p << schedule.MINUTE_BITS) + t // 60, 0) >> t % 60 & 1)


def broken_case(spark, odd=1, seqs=None):
    r = random.Random(6)
    deps = [(f"t{k}", "T", odd if k % 3 == 0 else 0, "P", "P", 1, 30_000 + 37 * k) for k in range(40)] + [("f", "F", 1, "P", "P", 1, 30_000)]
    d = spark.createDataFrame(deps, DEPARTURES)
    stops = spark.createDataFrame([("P", "", "")], "stop_id string, stop_name string, parent_station string")
    pairs = spark.createDataFrame([("P", "P", 2, 90), ("P", "P", 2, 90)], "from_station string, to_station string, transfer_type int, min_transfer_time int")
    t = Timetable(stops, None, d.select("trip_id", "route_id", "direction_id").distinct(), pairs, d)
    at = 1_704_844_800
    e = spark.createDataFrame([(n if seqs is None else n % seqs, "a", "f", "F", "P", r.randrange(1, 900), at + n, at + r.randrange(29_000, 31_500), A) for n in range(200)], EVENT)
    return e, t, state.changelog(e)


def test_broken_connections_without_trips(spark):
    """They are transfer_impacts' broken ones, each id once, with the direction of the next trip: but without any join by trip."""
    from railtide.operators.cascade import directed

    cols = ["impact_id", "seq", "from_route_id", "to_route_id", "station_id", "source_delay_seconds", "detected_at", "additional_wait_seconds", "earliest_catch_secs", "direction_id", "station"]
    e, t, log = broken_case(spark)
    ids = F.concat_ws(":", *transfers.IMPACT_ID)
    want = directed(transfers.transfer_impacts(e, t, log).where("level = 'BROKEN'").withColumn("impact_id", ids).dropDuplicates(["impact_id"]), t)
    found = transfers.broken_directed(e, t, log)
    assert sorted(map(tuple, found.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert {x["direction_id"] for x in found.collect()} == {0, 1} and "next_viable_trip_id" not in found.columns
    assert transfers.broken_directed(*broken_case(spark, odd=7)) is None  # other directions come by the trip
    twice = transfers.broken_directed(*broken_case(spark, seqs=100))
    assert twice.count() == twice.select("impact_id").distinct().count()


def test_walks_are_shared(spark, monkeypatch):
    """Impacts of one start have one walk; only those that need the time of day have their own. Both say what a walk of each says."""
    from railtide.config import Propagation
    from railtide.operators import cascade

    r = random.Random(9)
    legs = [(f"{x}{k}", x, k % 2, s, s, n, 20_000 + 700 * k + 60 * n) for x in "TWV" for k in range(12) for n, s in enumerate(r.sample("PQRS", 4), 1)]
    d = spark.createDataFrame(legs, DEPARTURES)
    pairs = spark.createDataFrame([(a, b, 2, 60) for a in "PQRS" for b in "PQ"], "from_station string, to_station string, transfer_type int, min_transfer_time int")
    t = Timetable(None, None, None, pairs, d)
    live = spark.createDataFrame([("W", "P", 30)], "route_id string, station string, delay int")
    starts = [(f"i{n}", r.choice("TWV"), r.choice("PQRS"), n % 2, r.choice([10, 40, 400, 900]), 60 * r.randrange(300, 500)) for n in range(400)]
    est = spark.createDataFrame(starts, "impact_id string, to_route_id string, station string, direction_id int, initial_delay int, tod int").withColumn("hour", F.floor(F.col("tod") / 3600).cast("int"))
    rows = []
    walker = cascade._walker
    monkeypatch.setattr(cascade, "_walker", lambda g, cfg: rows.append(g) or walker(g, cfg))
    got = cascade.cascade(est, t, live)
    g = rows[0].value
    want = [(i, k, a, s, x, c, h, kind) for i, route, station, way, start, tod in starts for k, (a, s, x, c, h, kind) in enumerate(cascade.walk(g, route, station, way, start, tod, Propagation()))]
    plain = lambda xs: sorted((*x[:5], round(x[5], 5), *x[6:]) for x in xs)
    assert plain(map(tuple, got.collect())) == plain(want)
    few = est.where("initial_delay < 100")  # none of these reaches another route
    rows.clear()
    assert cascade.cascade(few, t, live).count() == sum(1 for x in want if dict((s[0], s[4]) for s in starts)[x[0]] < 100)
    assert not rows  # before: every impact walked by itself


def test_graph_and_synthetic_impacts_of_a_dense_timetable(spark):
    """The walk's graph has one departure a second, however many there are; stored delays bring station and direction along."""
    from railtide.config import Propagation
    from railtide.operators import api, cascade

    legs = [(f"t{k}", "T", k % 2, s, s, n, 20_000 + k % 3 + 60 * n) for k in range(30) for n, s in enumerate("PQ", 1)]
    d = spark.createDataFrame(legs, DEPARTURES)
    stops = spark.createDataFrame([("P", "", ""), ("Q", "", "")], "stop_id string, stop_name string, parent_station string")
    pairs = spark.createDataFrame([("P", "Q", 2, 60)], "from_station string, to_station string, transfer_type int, min_transfer_time int")
    t = Timetable(stops, None, d.select("trip_id", "route_id", "direction_id").distinct(), pairs, d)
    live = spark.createDataFrame([], "route_id string, station string, delay int")
    g = cascade.collect_graph(cascade._tables(t, live, None, Propagation(), None))
    assert {k: list(v[0]) for k, v in g.next_dirs.items()} == {("T", "P"): [20_060, 20_061, 20_062], ("T", "Q"): [20_120, 20_121, 20_122]}  # before: 30 each
    st = spark.createDataFrame([("a", "t1", "Q", 100, 5)], "agency_id string, trip_id string, stop_id string, delay_seconds int, observed_at long")
    assert api.synthetic_impacts(st, t).select("station", "direction_id").first() == ("Q", 1)  # before: the trips were joined once more
