"""Golden cases of the transit operators."""

import datetime as dt
import functools
import random

import pytest
from pyspark.sql import functions as F
from railtide import config, schema
from railtide.functions import time as ftime
from railtide.functions.ids import route_from_trip
from railtide.operators import api, cascade, evaluation, events, schedule, state, transfers
from railtide.sources import gtfs

HMS = lambda h, m=0, s=0: h * 3600 + m * 60 + s
NINE = 1_700_000_000 - 1_700_000_000 % 86_400  # a midnight, UTC


def timetable(spark, stops, trips, stop_times, xfers=(), tz="UTC"):
    s = spark.createDataFrame([(i, n, 0.0, 0.0, 1 if not p else 0, p) for i, n, p in stops], schema.STOPS)
    r = spark.createDataFrame([(x, x, x, "") for x in sorted({t[1] for t in trips})], schema.ROUTES)
    t = spark.createDataFrame([(a, b, "WK", d) for a, b, d in trips], schema.TRIPS)
    st = spark.createDataFrame([(a, b, c, c, q) if len(x) == 4 else x for x in stop_times for a, b, c, q in [x[:2] + (x[2], x[-1])]], schema.STOP_TIMES)
    return gtfs.build(s, r, t, st, spark.createDataFrame(list(xfers), schema.TRANSFERS), spark.createDataFrame([("WK",)], "service_id string"), tz)


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


# --- sources and functions -------------------------------------------------------------------------------------------


@pytest.fixture
def csv_folder(tmp_path):
    """Two lines of a harbour town; names, zones and faults as timetables have them."""
    files = {
        "stops.txt": "﻿zone_id,stop_id, stop_name ,stop_lat,location_type,parent_station\n"
                     '3,quay,"Quay ""Nord"", ferry",51.25,1,\n3,quay-2,,north,,quay\n4,mill,"Old\nMill",51.5,1,\n4,quay,Quay,52,1,\n9,fort\n',
        "routes.txt": "route_color,route_id,route_short_name\nff8800,ferry,F1\n",
        "trips.txt": "service_id,trip_id,route_id,direction_id\nworkdays,f-early,ferry,1\nfairs,f-late,ferry,up\n",
        "stop_times.txt": "stop_sequence,trip_id,stop_id,arrival_time,departure_time\n"
                          "4,f-early,quay-2,5:47:10,\n9,f-early,mill,06:01:00,06:02:30\n11,f-early,fort,soon,06:20:00\n2,f-late,mill,23:59:00,24:03:00\n",
        "transfers.txt": "min_transfer_time,from_stop_id,to_stop_id,transfer_type\n95,quay-2,mill,2\n,mill,quay,3\n,mill,fort,0\n",
        "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
                        "workdays,1,1,1,1,1,0,0,20250901,20250930\nfairs,0,0,0,0,0,1,1,20250101,20251231\n",
        "calendar_dates.txt": "date,service_id,exception_type\n20250909,fairs,2\n20250909,fairs,1\n20250910,workdays,2\n20250909,unknown,2\n",
        "agency.txt": "agency_timezone,agency_id\nEurope/Lisbon,harbour\n",
    }
    for n, text in files.items():
        (tmp_path / n).write_text(text, encoding="utf-8", newline="")
    return tmp_path


def test_csv_folder(spark, csv_folder):
    tuesday, wednesday = dt.date(2025, 9, 9), dt.date(2025, 9, 10)
    t = gtfs.load(spark, str(csv_folder), tuesday)
    assert t.tz == "Europe/Lisbon"
    got = sorted(rows(t.departures, "trip_id", "stop_id", "station", "arrival_secs", "departure_secs", "stop_sequence"))
    assert got == [("f-early", "mill", "mill", HMS(6, 1), HMS(6, 2, 30), 9), ("f-early", "quay-2", "quay", HMS(5, 47, 10), HMS(5, 47, 10), 4),
                   ("f-late", "mill", "mill", HMS(23, 59), HMS(24, 3), 2)]  # the fair runs: the later exception of the day stands
    assert sorted(rows(t.transfers)) == [("mill", "fort", 0, 0), ("quay", "mill", 2, 95)]
    assert sorted(rows(t.stops, "stop_id", "stop_name", "stop_lat", "parent_station")) == [
        ("fort", "", 0.0, ""), ("mill", "Old\nMill", 51.5, ""), ("quay", "Quay", 52.0, ""), ("quay-2", "", 0.0, "quay")]
    assert gtfs.load(spark, str(csv_folder), wednesday).departures.count() == 0
    (csv_folder / "calendar_dates.txt").unlink()
    (csv_folder / "agency.txt").unlink()
    t = gtfs.load(spark, str(csv_folder), wednesday)
    assert t.tz == "UTC" and {r["trip_id"] for r in t.departures.collect()} == {"f-early"}
    (csv_folder / "calendar.txt").unlink()
    with pytest.raises(Exception, match="calendar"):
        gtfs.load(spark, str(csv_folder), wednesday)


def test_times(spark):
    r = random.Random(31)
    want = {f"{h:02d}:{m:02d}:{x:02d}": HMS(h, m, x) for h, m, x in ((r.randrange(30), r.randrange(60), r.randrange(60)) for _ in range(20))}
    want |= {" 7:08:09\t".replace("\t", " "): HMS(7, 8, 9), "7:8": None, "7:8:9:10": None, "x:y:z": None, " ": None}
    d = spark.createDataFrame(list(want.items()), "x string, want int")
    assert d.where(~ftime.service_seconds("x").eqNullSafe(F.col("want"))).count() == 0
    summer, winter = (int(dt.datetime(2025, m, 2, 21, 15, 40, tzinfo=dt.timezone.utc).timestamp()) for m in (7, 12))
    clocks = spark.createDataFrame([(summer,), (winter,), (0,)], "t long").select(ftime.clock("t", "Europe/Athens"))
    assert [r[0] for r in clocks.collect()] == [HMS(0, 15, 40), HMS(23, 15, 40), 0]
    edges = spark.createDataFrame([(0.39,), (0.4,), (0.59,), (0.6,), (0.79,), (0.8,)], "c double").select(ftime.confidence_bucket("c"))
    assert [r[0][:3] for r in edges.collect()] == ["0.2", "0.4", "0.4", "0.6", "0.6", "0.8"]
    assert gtfs.valid_timezone("Mars/Olympus") == "UTC" and gtfs.valid_timezone("", "Asia/Tokyo") == "Asia/Tokyo"


def test_route_of_trip(spark):
    """What stands between the first underscore and the point that follows; ids without an inner underscore are taken whole."""
    r = random.Random(32)
    ids = ["_".join("".join(r.choice("k7.") for _ in range(r.randrange(4))) for _ in range(r.randrange(1, 4))) for _ in range(200)]

    def rule(t):
        head, mark, tail = t.partition("_")
        return tail.split(".")[0] if mark and tail else t

    d = spark.createDataFrame([(k,) for k in ids], "t string").select("t", route_from_trip("t").alias("r"))
    assert all(x["r"] == rule(x["t"]) for x in d.collect())


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("agency_id: ag\nfeeds:\n- {name: a, url: u}\n- {name: b, url: v, poll_interval: 500ms, routes: [L]}\npropagation: {max_depth: 0, min_delay: 20}\n")
    c = config.load(str(p))
    assert (c.kafka_topic, c.polling_default_interval, c.feeds[0].poll_interval, c.feeds[1].poll_interval) == ("delay-events", 15.0, 15.0, 0.5)
    assert (c.propagation.max_depth, c.propagation.min_delay, c.propagation.decay) == (5, 20, 0.7)


# --- schedule ----------------------------------------------------------------------------------------------------------


def lookup(spark, deps, *probes):
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(probes)], "i int, r string, d int, s string, t int")
    return [r["headway"] for r in schedule.scheduled_headway(p, schedule.headway_index(deps), "r", "d", "s", "t").orderBy("i").collect()]


def test_headways(spark):
    """Half-hourly one way, every seven minutes the other, from a platform and from the station itself; and a night line."""
    slow, fast, night = [HMS(13) + 1800 * k for k in range(3)], [HMS(13, 2) + 420 * k for k in range(6)], [HMS(24, 10), HMS(24, 35), HMS(25, 5)]
    trips = [(f"s{k}", "tram", 0) for k in range(3)] + [(f"f{k}", "tram", 1) for k in range(6)] + [(f"n{k}", "owl", 0) for k in range(3)] + [("g1", "gap", 0), ("g2", "gap", 0)]
    times = [(f"s{k}", "fort-a", x, 1) for k, x in enumerate(slow)] + [(f"f{k}", "fort", x, 1) for k, x in enumerate(fast)] + [(f"n{k}", "fort", x, 1) for k, x in enumerate(night)]
    t = timetable(spark, [("fort", "", ""), ("fort-a", "", "fort")], trips, times + [("g1", "fort", HMS(9), 1), ("g2", "fort", HMS(12, 0, 1), 1)])
    got = lookup(spark, t.departures, ("tram", 0, "fort", HMS(13, 59)), ("tram", 1, "fort", HMS(13)), ("tram", 0, "fort", HMS(15)), ("bus", 0, "fort", HMS(13)),
                 ("owl", 0, "fort", HMS(24, 1)), ("owl", 0, "fort", HMS(0, 59)), ("owl", 0, "fort", HMS(4)), ("gap", 0, "fort", HMS(9)))
    # the night's gaps are 25 and 30 minutes: the hour that begins at midnight has both, seen from either day; over three hours is no headway
    assert got == [1800, 420, None, None, 1650, 1650, None, None]


def overnight(spark, deps, *tods):
    p = spark.createDataFrame([(i, "pier", "L", t) for i, t in enumerate(tods)], "i int, s string, r string, t int")
    got = schedule.next_overnight(p, schedule.departure_index(deps, 1), "s", "r", "t", 1).orderBy("i").collect()
    return [(r["deps"][0]["trip_id"] if r["deps"] else None, r["effective_tod"]) for r in got]


def test_overnight(spark):
    """Before four in the morning yesterday's trips, numbered beyond 24:00, count if they come sooner than today's first."""
    st = [("pier", "", "")]
    trips, deps = [("first", "L", 0), ("ghost", "L", 0)], {"first": HMS(4, 50), "ghost": HMS(25, 20)}
    t = timetable(spark, st, trips, [(k, "pier", x, 1) for k, x in deps.items()])
    probes = (HMS(1), HMS(1, 21), HMS(3, 59), HMS(4), HMS(5), HMS(26))
    want = []
    for tod in probes:
        frames = [(d - f, f, k) for k, d in deps.items() for f in ((tod, tod + 86_400) if tod < HMS(4) else (tod,)) if d >= f]
        best = min(frames, default=None)
        want.append((best[2] if best else None, best[1] if best else tod))
    assert overnight(spark, t.departures, *probes) == want and want[0] == ("ghost", HMS(25))
    t = timetable(spark, st, trips[:1], [("first", "pier", HMS(4, 50), 1)])
    assert overnight(spark, t.departures, HMS(1)) == [("first", HMS(1))]


def test_next_departures_against_brute_force(spark):
    r = random.Random(11)
    trips = [(f"t{k}", r.choice("LG"), k % 2) for k in range(150)]
    times = [(f"t{k}", r.choice(["A", "B", "A1"]), r.choice([r.randrange(100_000), 3600 * r.randrange(27)]), 1) for k in range(150)]
    t = timetable(spark, [("A", "", ""), ("A1", "", "A"), ("B", "", "")], trips, times)
    probes = [(i, r.choice("ABC"), r.choice("LG"), r.choice([r.randrange(100_000), 600 * r.randrange(160), 99_999, 200_000])) for i in range(300)]
    p = spark.createDataFrame(probes, "i int, s string, r string, t int")
    for n in (1, 4):
        got = {x["i"]: [(d["dep"], d["trip_id"]) for d in x["deps"]] for x in schedule.next_departures(p, schedule.departure_index(t.departures, n), "s", "r", "t", n).collect()}
        route = {a: b for a, b, _ in trips}
        for i, s, rt, at in probes:
            want = sorted((c, a) for a, b, c, _ in times if {"A1": "A"}.get(b, b) == s and route[a] == rt and c >= at)[:n]
            assert got[i] == want


def test_resolution(spark):
    """A trip is found by its id or by what follows the first underscore, unless two trips end so; a stop by itself, then by its station."""
    whole = "SU25-harbour-7_morning_F..up"
    t = timetable(spark, [("quay", "", ""), ("quay-2", "", "quay"), ("mill", "", "")], [(whole, "F", 0), ("a_twin", "G", 0), ("b_twin", "G", 0)],
                  [(whole, "quay-2", HMS(7), HMS(7, 1), 1), (whole, "mill", HMS(7, 30), 2), ("a_twin", "mill", HMS(8), 1), ("b_twin", "mill", HMS(8, 5), 1)])
    asked = [(whole, "quay-2"), ("morning_F..up", "quay"), ("morning_F..up", "mill"), ("F..up", "mill"), ("twin", "mill"), ("", "mill"), (whole, "fort")]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "i int, trip_id string, stop_id string")
    r = schedule.resolve_trips(d, t.departures)
    s = {x["i"]: (x["static_trip_id"], x["arrival_secs"]) for x in schedule.scheduled_stop_times(r, t.departures, t.stops).collect()}
    assert s == {0: (whole, HMS(7)), 1: (whole, HMS(7)), 2: (whole, HMS(7, 30)), 3: (None, None), 4: (None, None), 5: (None, None), 6: (whole, None)}


# --- events ------------------------------------------------------------------------------------------------------------


def update(trip, *stops, rel="SCHEDULED", route="", poll=1):
    ev = lambda x: None if x is None else {"delay": x[0], "time": x[1]}
    return ("f", poll, 1_700_000_000, {"trip_id": trip, "route_id": route, "schedule_relationship": rel} if trip is not None else None,
            [{"stop_id": s, "schedule_relationship": k, "arrival": ev(a), "departure": ev(d)} for s, k, a, d in stops])


def test_normalize(spark):
    at = 1_760_000_000
    told = {  # stop: (relationship, arrival (delay, time), departure) -> (delay, scheduled, predicted, type), None for no event
        "both": (("SCHEDULED", (-45, at + 70), (5, at + 90)), (-45, at + 115, at + 70, "ARRIVAL_DELAY")),
        "time only": (("SCHEDULED", (None, at + 7), None), (0, 0, at + 7, "ARRIVAL_DELAY")),
        "delay only": (("SCHEDULED", (33, None), None), (33, 0, 0, "ARRIVAL_DELAY")),
        "zero delay": (("SCHEDULED", (0, 0), None), (0, 0, 0, "ARRIVAL_DELAY")),
        "empty arrival": (("SCHEDULED", (None, 0), (12, at)), (12, at - 12, at, "DEPARTURE_DELAY")),
        "nothing": (("SCHEDULED", None, (None, 0)), None),
        "skipped": (("SKIPPED", None, None), (0, 0, 0, "SKIP_STOP")),
    }
    feed = [update("x9_K.up", *((s, *given) for s, (given, _) in told.items()), route=""), update("y_M.", ("both", "SCHEDULED", (1, 1), None), rel="CANCELED", route="own"),
            update(None, ("both", "SCHEDULED", (1, 1), None))]
    got = {(r["trip_id"], r["stop_id"]): (r["delay_seconds"], r["scheduled_arrival"], r["predicted_arrival"], r["type"], r["route_id"])
           for r in events.normalize(spark.createDataFrame(feed, schema.FEED), "ag").collect()}
    assert got == {**{("x9_K.up", s): (*want, "K") for s, (_, want) in told.items() if want}, ("y_M.", ""): (0, 0, 0, "TRIP_CANCELLED", "own")}


def emitted(spark, *polls):
    data = [("f", at, "t", s, d, p, k) for at, keys in polls for s, d, p, k in keys]
    df = spark.createDataFrame(data, "feed_id string, polled_at long, trip_id string, stop_id string, delay_seconds int, predicted_arrival long, type string")
    return sorted((r["polled_at"], r["stop_id"], r["delay_seconds"]) for r in events.diff(df).collect())


def test_diff(spark):
    """Against the rules step by step, over random polls with gaps, ties and changes of type."""
    r = random.Random(33)
    polls, published, seen, want, before = [], {}, {}, [], None
    for k in range(60):
        at = 20 * k + (2500 if k >= 40 else 0)
        polls.append((at, []))
        base = dict(published)
        for key in sorted(r.sample("abcd", r.randrange(1, 5)) if k % 9 else ["z"]):
            if before is not None and key in seen and before - seen[key] > 1800:
                base.pop(key, None)
            row = (r.randrange(40), r.choice([0, 50 + r.randrange(40)]), r.choice(["ARRIVAL_DELAY"] * 5 + ["SKIP_STOP"]))
            polls[-1][1].append((key, *row))
            old = base.get(key)
            if old is None or old[2] != row[2] or abs(old[0] - row[0]) > 15 or abs(old[1] - row[1]) > 15:
                want.append((at, key, row[0]))
                published[key] = row
            seen[key] = at
        before = at
    assert emitted(spark, *polls) == sorted(want) and len(want) < sum(len(p) for _, p in polls)
    twice = [("a", 7, 0, "ARRIVAL_DELAY"), ("a", 9, 0, "ARRIVAL_DELAY")]
    assert emitted(spark, (5, twice)) == [(5, "a", 7), (5, "a", 9)]  # both of one poll are compared with what was before it
    assert emitted(spark) == []


def test_enrich(spark):
    """The distance from the scheduled second of the day, to the nearest day, where only a time was predicted."""
    sched = {"day": (HMS(11), HMS(11, 2)), "night": (HMS(24, 30), HMS(24, 31)), "last": (HMS(23, 58), HMS(23, 58, 30))}
    t = timetable(spark, [("pier", "", "")], [(k, "L", 0) for k in sched], [(k, "pier", a, d, 1) for k, (a, d) in sched.items()])
    off = {1: ("day", 0, 75, "ARRIVAL_DELAY"), 2: ("day", 1, -20, "DEPARTURE_DELAY"), 3: ("night", 0, 400, "ARRIVAL_DELAY"), 4: ("last", 0, 290, "ARRIVAL_DELAY")}
    ev = [(i, k, (sched[k][x] + d) % 86_400, kind, 0) for i, (k, x, d, kind) in off.items()]
    ev += [(5, "other", HMS(11), "ARRIVAL_DELAY", 0), (6, "day", HMS(12), "ARRIVAL_DELAY", -9), (7, "day", HMS(12), "SKIP_STOP", 0), (8, "day", None, "DEPARTURE_DELAY", 0)]
    d = spark.createDataFrame([(i, k, "pier", x, 0, NINE + p if p is not None else 0, kind) for i, k, p, kind, x in ev],
                              "i int, trip_id string, stop_id string, delay_seconds int, scheduled_arrival long, predicted_arrival long, type string")
    got = {r["i"]: (r["delay_seconds"], r["enriched"]) for r in events.enrich(d, t).collect()}
    assert got == {**{i: (x[2], True) for i, x in off.items()}, 5: (0, False), 6: (-9, None), 7: (0, None), 8: (0, None)}


# --- state -------------------------------------------------------------------------------------------------------------

EV = "seq long, agency_id string, trip_id string, stop_id string, route_id string, delay_seconds int, observed_at long, received_at long, type string"


def stream(spark, *xs):
    return spark.createDataFrame([(i, "a", t, s, "R", d, o, i, k) for i, (t, s, d, o, k) in enumerate(xs)], EV)


def stored(spark, *xs):
    return {(r["trip_id"], r["stop_id"]): (r["delay_seconds"], r["confidence"], r["update_count"]) for r in state.current(state.changelog(stream(spark, *xs))).collect()}


A = "ARRIVAL_DELAY"


def test_state(spark):
    one = lambda *v: stored(spark, *[("t", "s", d, o, A) for d, o in v])["t", "s"]
    assert one((-15, 7)) == (-15, 0.5, 1)
    assert one((-15, 7), (900, 6)) == (-15, 0.5, 1)  # observed before what is stored
    jump = one((100, 7), (500, 8))
    assert jump == (round(0.7 * 500 + 0.3 * 100), 0.5, 2)
    assert one((100, 7), (220, 7))[0] == 220 and one((100, 7), (221, 7))[0] == round(0.7 * 221 + 0.3 * 100)
    confidence = 0.5
    for n in range(2, 9):  # one tenth more for every close value, in floating point, up to one
        confidence = min(1.0, confidence + 0.1)
        assert one(*[(40 + 30 * (k % 2), k) for k in range(n)])[1:] == (confidence, n)
    rest = [("k", "north", 10, 1, A), ("k", "south", 20, 1, A), ("m", "north", 30, 1, A)]
    keys = lambda *more: set(stored(spark, *rest, *more))
    assert keys(("k", "", 0, 0, "TRIP_CANCELLED")) == {("m", "north")} and keys(("k", "south", 0, 0, "SKIP_STOP")) == {("k", "north"), ("m", "north")}
    assert keys(("k", "", 0, 0, "TRIP_CANCELLED"), ("k", "south", 5, 0, A)) == {("k", "south"), ("m", "north")}
    assert stored(spark, ("t", "s", None, 1, A)) == {}


def test_state_goes_on_from_what_is_stored(spark):
    r = random.Random(34)
    xs = [(i, "a", f"t{i % 3}", f"s{r.randrange(2)}", "R", r.randrange(-200, 200), 100 + i - r.choice([0, 0, 7]), 1000 + 60 * i, r.choice([A] * 9 + ["SKIP_STOP"])) for i in range(120)]
    whole = state.reconcile_with_ttl(spark.createDataFrame(xs, EV)).collect()
    first = spark.createDataFrame(xs[:70], EV)
    log = {}
    for row in sorted(state.reconcile_with_ttl(first).where("op = 'upsert'").collect(), key=lambda x: x["seq"]):
        log[row["trip_id"], row["stop_id"]] = row
    gone = {(x[2], x[3]): x[0] for x in xs[:70] if x[8] == "SKIP_STOP"}
    held = [("a", *k, v["delay_seconds"], v["observed_at"], v["confidence"], v["update_count"], xs[v["seq"]][7]) for k, v in log.items() if gone.get(k, -1) < v["seq"]]
    before = spark.createDataFrame(held, "agency_id string, trip_id string, stop_id string, delay_seconds int, observed_at long, confidence double, update_count int, arrived long")
    rest = state.reconcile_with_ttl(spark.createDataFrame(xs[70:], EV), stored=before).collect()
    assert sorted(map(tuple, rest)) == sorted(tuple(x) for x in whole if x["seq"] >= 70)


def fold(xs):
    """The rules step by step."""
    out, held = {}, {}
    for i, (t, s, d, o, k) in enumerate(xs):
        if k == "TRIP_CANCELLED":
            held = {x: v for x, v in held.items() if x[0] != t}
        elif k == "SKIP_STOP":
            held.pop((t, s), None)
        else:
            h = held.get((t, s))
            if h is None:
                h = (d, o, 0.5, 1)
            elif o < h[1]:
                out[i] = ("drop",)
                continue
            else:
                v = 0.7 * d + 0.3 * h[0]
                n = int(abs(v) + 0.5) * (1 if v >= 0 else -1) if abs(d - h[0]) > 120 and h[3] < 3 else d
                h = (n, o, min(1.0, h[2] + 0.1) if abs(d - h[0]) <= 30 else 0.5, h[3] + 1)
            held[t, s] = h
            out[i] = ("upsert", *h)
    return out, held


def test_window_form_equals_fold(spark):
    r = random.Random(12)
    kinds = [A] * 30 + ["DEPARTURE_DELAY"] * 5 + ["SKIP_STOP"] * 2 + ["TRIP_CANCELLED"]
    xs = [(f"t{r.randrange(6)}", f"s{r.randrange(3)}", r.choice([r.randrange(-50, 50), r.randrange(-400, 400), 2**31 - 1]), 1000 + i // 3 - r.choice([0, 0, 0, 40]), r.choice(kinds)) for i in range(1500)]
    xs = [(t, "" if k == "TRIP_CANCELLED" else s, d, o, k) for t, s, d, o, k in xs]
    want, held = fold(xs)
    log = state.changelog(stream(spark, *xs)).where("op <> 'delete'")
    got = {x["seq"]: ("drop",) if x["op"] == "drop" else ("upsert", x["delay_seconds"], x["observed_at"], x["confidence"], x["update_count"]) for x in log.collect()}
    assert got == want
    assert {(x["trip_id"], x["stop_id"]): x["delay_seconds"] for x in state.current(state.changelog(stream(spark, *xs))).collect()} == {k: v[0] for k, v in held.items()}
    ttl = state.reconcile_with_ttl(stream(spark, *xs), ttl=10**9)
    got = {x["seq"]: ("drop",) if x["op"] == "drop" else ("upsert", x["delay_seconds"], x["observed_at"], x["confidence"], x["update_count"]) for x in ttl.collect()}
    assert got == want
    probes = [(i, "a", f"t{r.randrange(7)}", f"s{r.randrange(3)}", r.randrange(1500)) for i in range(200)]
    p = spark.createDataFrame(probes, "i int, ag string, tr string, st string, at long")
    got = {x["i"]: x["state_delay"] for x in state.as_of(p, state.changelog(stream(spark, *xs)), "at", "ag", "tr", "st").collect()}
    for i, _, t, s, at in probes:
        assert got[i] == (fold(xs[: at + 1])[1].get((t, s)) or (None,))[0]


def test_ttl(spark):
    xs = spark.createDataFrame([(1, "a", "t", "s", "R", 60, 1, 0, A), (2, "a", "t", "s", "R", 60, 2, 7200, A), (3, "a", "t", "s", "R", 60, 0, 14_401, A)], EV)
    assert [r["update_count"] for r in state.reconcile_with_ttl(xs).orderBy("seq").collect()] == [1, 2, 1]


# --- transfers ---------------------------------------------------------------------------------------------------------


@functools.cache
def pier(spark, deps, least):
    return timetable(spark, [("pier", "", "")], [(k, "F" if k.startswith("f") else "T", 0) for k, _ in deps], [(k, "pier", x, 1) for k, x in deps], [("pier", "pier", 2, least)])


def impacts(spark, deps, *ev, log=(), least=90):
    """Impacts of events on line F at the pier, where lines T leave as given (trip: seconds) and a change takes ``least`` seconds."""
    t = pier(spark, tuple(deps.items()), least)
    e = spark.createDataFrame([(9, "a", tr, "F", "pier", d, NINE + tod, NINE + tod, 0, A) for tr, d, tod in ev],
                              "seq long, agency_id string, trip_id string, route_id string, stop_id string, delay_seconds int, scheduled_arrival long, observed_at long, x int, type string")
    return transfers.transfer_impacts(e, t, state.changelog(stream(spark, *log)))


IMPACT = ("level", "original_transfer_margin_seconds", "remaining_margin_seconds", "next_viable_trip_id", "additional_wait_seconds", "sched_connection_departure_secs", "earliest_catch_secs")


def expected(deps, tod, delay, least=90, late=None):
    """The rule step by step: the first departure after the change is the connection, its own lateness moves the margin."""
    lines = sorted((x, k) for k, x in deps.items() if k.startswith("t"))
    frames = [min((x - f, f) for x, _ in lines if x >= f) for f in ((tod, tod + 86_400) if tod < HMS(4) else (tod,)) if any(x >= f for x, _ in lines)]
    eff = min(frames)[1]
    dep, trip = next((x, k) for x, k in lines if x >= eff + least)
    left = dep - eff - delay + (late or {}).get(trip, 0)
    if left >= least + 60:
        return []
    if left >= least:
        return [("AT_RISK", dep - eff, left, "", 0, 0, 0)]
    catch = eff + delay + least
    viable = next(((x, k) for x, k in lines if x >= catch), (dep, ""))
    return [("BROKEN", dep - eff, left, viable[1], max(0, viable[0] - dep), dep, catch)]


def test_transfers(spark):
    deps = {"f1": HMS(16), "t1": HMS(16, 4), "t2": HMS(16, 11), "t3": HMS(16, 30)}
    for delay in (60, 90, 91, 150, 151, 3600):
        assert rows(impacts(spark, deps, ("f1", delay, HMS(16))), *IMPACT) == expected(deps, HMS(16), delay), delay
    assert rows(impacts(spark, deps, ("f1", 0, HMS(16)))) == [] == rows(impacts(spark, deps, ("f1", -30, HMS(16))))
    for late in (40, 100, -35):  # the connecting trip's own delay
        got = impacts(spark, deps, ("f1", 120, HMS(16)), log=[("t1", "pier", late, 1, A)])
        assert rows(got, *IMPACT) == expected(deps, HMS(16), 120, late={"t1": late})
    night = {"f1": HMS(24, 20), "t1": HMS(24, 25), "t2": HMS(24, 45), "t9": HMS(5)}
    got = rows(impacts(spark, night, ("f1", 500, HMS(0, 20))), *IMPACT)
    assert got == expected(night, HMS(0, 20), 500) and got[0][:4] == ("BROKEN", 300, -200, "t2")
    close = dict(deps, t0=HMS(16, 1))  # leaves before one could change
    assert rows(impacts(spark, close, ("f1", 100, HMS(16))), *IMPACT) == expected(close, HMS(16), 100)
    some = impacts(spark, deps, ("f1", 200, HMS(16)))
    assert [transfers.alerts(some, *a).count() for a in ((), (["T"],), (["W"],), (["W"], ["pier"]), ([], ["mill"]))] == [1, 1, 0, 1, 0]


# --- cascade -----------------------------------------------------------------------------------------------------------


@functools.cache
def cascade_table(spark):
    """Line T runs quay - mill - fort - gate, line W leaves the fort's platform for the lake; F brings the late train to the quay."""
    stops = [("quay", "", ""), ("mill", "", ""), ("fort", "", ""), ("fort-w", "", "fort"), ("gate", "", ""), ("lake", "", "")]
    trips = [("t1", "T", 0), ("t2", "T", 0), ("w1", "W", 0), ("w2", "W", 0), ("f1", "F", 0)]
    legs = {"t1": [("quay", HMS(7, 10)), ("mill", HMS(7, 14)), ("fort", HMS(7, 19)), ("gate", HMS(7, 23))], "t2": [("quay", HMS(7, 25))],
            "w1": [("fort-w", HMS(7, 22)), ("lake", HMS(7, 31))], "w2": [("fort-w", HMS(7, 58)), ("lake", HMS(8, 7))], "f1": [("quay", HMS(7, 5))]}
    times = [(k, s, x, n) for k, calls in legs.items() for n, (s, x) in enumerate(calls, 1)]
    return timetable(spark, stops, trips, times, [("quay", "quay", 2, 100), ("fort", "fort-w", 2, 45)])


def impact(spark, src="F", to="T", delay=240, wait=0, at=HMS(7, 12), viable="t1"):
    return spark.createDataFrame([("i", "f1", src, to, "quay", delay, NINE + at, viable, wait, HMS(7, 10), HMS(7, 16))],
                                 "impact_id string, from_trip_id string, from_route_id string, to_route_id string, station_id string, source_delay_seconds int, detected_at long, "
                                 "next_viable_trip_id string, additional_wait_seconds int, sched_connection_departure_secs int, earliest_catch_secs int")


LIVE = "route_id string, station string, delay int"


def estimated(spark, t, live=(), hist=(), **kw):
    i = impact(spark, **kw)
    av = spark.createDataFrame([("F", "T", "quay", h, float(a), n) for h, a, n in hist], "from_route string, to_route string, station string, hour int, average double, n long")
    return cascade.initial_estimates(i, t, spark.createDataFrame([("T", "quay", x) for x in live], LIVE), av)


@pytest.mark.parametrize("hour", [7, 15])
@pytest.mark.parametrize(("wait", "late", "average", "n"), [(0, 0, 0, 0), (700, 0, 0, 0), (250, 130, 0, 0), (250, 5000, 0, 0), (250, 0, 80, 12), (0, 60, 400, 2), (250, 0, 33, 1)])
def test_initial_estimates(spark, hour, wait, late, average, n):
    """The rule in plain numbers: wait or half a headway, else a part of the source delay; a late train up to a headway; then the past."""
    cfg = config.Propagation()
    headway = {7: HMS(7, 25) - HMS(7, 10)}.get(hour)  # two departures of T, in the morning
    base = max(wait, (headway or 0) / 2) or 240 * cfg.load * cfg.elasticity
    base += min(late, headway or 900) if late else 0
    share = n / (n + cfg.shrink)
    want = int(share * average + (1 - share) * base + 0.5)
    got = estimated(spark, cascade_table(spark), live=[late] if late else [], hist=[(hour, average, n)] if n else [], wait=wait, at=HMS(hour, 12))
    assert rows(got, "initial_delay") == [(want,)]


def walked(spark, t=None, live=(), averages=None, cfg=config.Propagation(), most=10**9, **kw):
    t = t or cascade_table(spark)
    lv = spark.createDataFrame(list(live), LIVE)
    none = spark.createDataFrame([], "from_route string, to_route string, station string, hour int, average double, n long")
    est = cascade.initial_estimates(impact(spark, **kw), t, lv, none, cfg)
    return {(r["route_id"], r["stop_id"]): r for r in cascade.cascade(est, t, lv, averages, cfg, most).collect()}


def test_walk(spark):
    """A wait of 500 s at the quay: it grows by the second and loses confidence along T, and W at the fort takes a part of it."""
    cfg = config.Propagation()
    w = walked(spark, wait=500)
    along = [w["T", s] for s in ("mill", "fort", "gate")]
    assert [r["predicted_additional_delay"] for r in along] == [500, 501, 502] and {r["impact_type"] for r in along} == {"dwell_increase"}
    assert [round(r["confidence"], 5) for r in along] == [1.0, round(cfg.decay**2, 5), round(cfg.decay**3, 5)]
    onward = int(501 * cfg.elasticity)
    assert [(w["W", s]["predicted_additional_delay"], w["W", s]["impact_type"], w["W", s]["hops_from_source"]) for s in ("fort", "lake")] == [(onward, "cascade_transfer", 2), (onward, "cascade_dwell", 2)]
    assert [r["position"] for r in sorted(w.values(), key=lambda r: -r["predicted_additional_delay"])][:3] == [0, 1, 2]
    assert w == walked(spark, wait=500, most=0)  # hour by hour
    with pytest.raises(ValueError, match="hour"):
        cascade.cascade(estimated(spark, cascade_table(spark)), cascade_table(spark), spark.createDataFrame([], LIVE), None, cfg, 0, 0)
    assert not any(r == "W" for r, _ in walked(spark, wait=500, live=[("W", "fort", 457)]))  # W waits of its own accord: 45 + 457 > 501
    assert any(r == "W" for r, _ in walked(spark, wait=500, live=[("W", "fort", 456)]))
    assert len(walked(spark, wait=500, cfg=config.Propagation(max_impacts=2))) == 2
    assert {s for _, s in walked(spark, delay=100, at=HMS(15))} == {"mill"}  # 4 s: the first stop has it, nothing goes on
    assert walked(spark, src="T", delay=77)["T", "mill"]["predicted_additional_delay"] == 77
    past = cascade.average_stop_impacts(spark.createDataFrame([("T", "fort", 7, 900, 0)] * 6, schema.STOP_HISTORY))
    assert walked(spark, wait=500, averages=past)["T", "fort"]["predicted_additional_delay"] == int(6 / 16 * 900 + 10 / 16 * 501 + 0.5)


def test_seeds_equal_the_walk(spark):
    t = cascade_table(spark)
    s = {r["station"]: r["delay"] for r in cascade.dwell_seeds(estimated(spark, t, wait=500), t).collect()}
    assert s == {k[1]: r["predicted_additional_delay"] for k, r in walked(spark, wait=500).items() if k[0] == "T"}


def test_walk_against_plain_search():
    r = random.Random(13)
    for _ in range(30):
        g = cascade.Graph()
        st, rt = [f"s{i}" for i in range(6)], list("ABC")
        g.downstream = {(x, 0, s): [(q, q) for q in r.sample(st, 3)] for x in rt for s in st if r.random() < 0.7}
        g.transfers = {s: [(r.choice(st), r.choice(rt), r.choice([30, 120])) for _ in range(3)] for s in st}
        g.next_dirs = {(x, s): ([1000], [0]) for x in rt for s in st}
        got = cascade.walk(g, "A", "s0", 0, 2000, 500, config.Propagation())
        assert len({x[:2] for x in got}) == len(got) <= 100
        # every item is at most as late as what was still open, so a later item exceeds an earlier only if that one led to it
        assert all(a[2] >= b[2] or b[4] >= a[4] for a, b in zip(got, got[1:]))


# --- evaluation --------------------------------------------------------------------------------------------------------


@functools.cache
def eval_table(spark):
    """T both ways at the mill's platform, W at the fort, and two trains of T at the quay a quarter of an hour apart."""
    stops = [("quay", "", ""), ("mill", "", ""), ("fort", "", ""), ("mill-2", "", "mill")]
    trips = [("t-out", "T", 0), ("t-back", "T", 1), ("w1", "W", 0), ("q1", "T", 0), ("q2", "T", 0)]
    return timetable(spark, stops, trips, [("t-out", "mill", 500, 1), ("t-back", "mill", 700, 1), ("w1", "fort", 900, 1), ("q1", "quay", HMS(9, 30), 1), ("q2", "quay", HMS(9, 45), 1)])


def results(spark, *xs):
    return spark.createDataFrame([("i", k, *x, "t") for k, x in enumerate(xs)], schema.DOWNSTREAM)


STATE = "agency_id string, trip_id string, stop_id string, route_id string, delay_seconds int"


def test_tracking(spark):
    """The one-hop impact on the receiving line with the least delay is the primary; others need a confidence of 0.3, at most twenty stay."""
    t = eval_table(spark)
    st = spark.createDataFrame([("ag", "x", "mill-2", "T", 85), ("ag", "y", "mill", "T", 40), ("ag", "z", "fort", "W", -20)], STATE)
    res = results(spark, ("T", "fort", 410, 0.6, 1), ("T", "mill", 400, 1.0, 1), ("W", "fort", 120, 0.31, 2), ("W", "lake", 36, 0.29, 3))
    got = {(r["route_id"], r["station_id"]): r for r in evaluation.track(impact(spark, viable="t-back"), res, st, t, "ag").collect()}
    assert set(got) == {("T", "fort"), ("T", "mill"), ("W", "fort")}
    p = got["T", "mill"]
    assert (p["is_primary"], p["baseline_secs"], p["direction"], p["source_station"], p["hour"], p["expires_at"] - p["created_at"]) == (True, 85, 1, "quay", 7, 1800)
    assert not got["T", "fort"]["is_primary"] and (got["W", "fort"]["direction"], got["W", "fort"]["baseline_secs"]) == (-1, 0)
    many = results(spark, *[("W", f"x{k}", 800 - k, 0.9, 2) for k in range(30)], ("T", "mill", 16, 0.1, 1))
    got = evaluation.track(impact(spark), many, st, t, "ag").collect()
    assert len(got) == 20 == len({r["id"] for r in got}) and [r["station_id"] for r in got if r["is_primary"]] == ["mill"]
    assert {r["station_id"] for r in got} - {"mill"} == {f"x{k}" for k in range(19)}


def pending(spark, **kw):
    base = dict(id="p", agency_id="ag", from_route="F", route_id="T", station_id="mill", source_station="quay", direction=0, source_delay_secs=240, predicted_secs=200, baseline_secs=0,
                sched_conn_dep_secs=0, earliest_catch_secs=0, confidence=0.9, hops=1, hour=7, is_primary=True, created_at=5000, expires_at=6800, observed_max=0, matched=False)
    return spark.createDataFrame([tuple((base | kw).values())], schema.PENDING)


def test_matching(spark):
    t = eval_table(spark)
    seen = [("t-out", 95, 5000), ("t-out", 70, 6000), ("t-back", 310, 6100), ("unknown", 120, 6800), ("t-out", 2000, 6801), ("t-out", 2000, 4999)]
    ev = spark.createDataFrame([("ag", "T", tr, "mill-2", d, o, A) for tr, d, o in seen] + [("ag", "T", "t-out", "mill-2", 700, 6000, "TRIP_CANCELLED"), ("ag", "T", "t-out", "mill-2", None, 6000, A)],
                               "agency_id string, route_id string, trip_id string, stop_id string, delay_seconds int, observed_at long, type string")
    e = gtfs.with_station(ev, t.stops)
    m = lambda **kw: rows(evaluation.match(pending(spark, **kw), e, t.trips), "observed_max", "matched")[0]
    assert m() == (120, True) and m(direction=1) == (310, True) and m(direction=-1) == (310, True)  # a trip of unknown direction counts
    assert m(baseline_secs=50) == (70, True) and m(baseline_secs=400) == (0, True) and m(station_id="fort") == (0, False)
    assert m(expires_at=5999) == (95, True) and m(agency_id="other") == (0, False)


def test_sweep_and_learning(spark):
    ps = [dict(id="half", predicted_secs=120, observed_max=60), dict(id="less", predicted_secs=122, observed_max=60, source_station="", station_id="gate", hour=9),
          dict(id="small", predicted_secs=10, observed_max=14, station_id="lake", is_primary=False), dict(id="fits", predicted_secs=30, observed_max=31, route_id="W", is_primary=False),
          dict(id="open", expires_at=99_999)]
    p = pending(spark, **ps[0])
    for x in ps[1:]:
        p = p.unionByName(pending(spark, **x))
    expired, rest = evaluation.pop_expired(p, 6800)
    assert rows(rest, "id") == [("open",)] and evaluation.pop_expired(p, 6800, 3)[0].count() == 3
    s = evaluation.sweep(expired)
    assert {r["id"]: r["outcome"] for r in s.collect()} == {"half": "verified", "less": "falsified", "small": "falsified", "fits": "verified"}
    assert sorted(rows(evaluation.learned_history(s, 1), "station", "hour", "downstream_impact")) == [("gate", 9, 60), ("quay", 7, 60)]
    assert sorted(rows(evaluation.learned_stop_history(s, 1), "route", "station", "observed")) == [("T", "lake", 14), ("W", "mill", 31)]
    assert sum(r["finalized"] for r in evaluation.eval_metrics(s).collect()) == 4
    assert rows(evaluation.add_pending(rest, p, 9000), "id") == [("open",)]
    assert evaluation.add_pending(rest, p, 7000).count() == 5


def test_realized_wait(spark):
    """Trains at the quay at 9:30 and 9:45; the connection was the first, and can be caught from 9:33 on."""
    t = eval_table(spark)
    p = pending(spark, sched_conn_dep_secs=HMS(9, 30), earliest_catch_secs=HMS(9, 33))
    wait = lambda state, q=p: rows(evaluation.realized_wait(q, t, spark.createDataFrame(state, STATE)), "wait")
    assert wait([]) == [(900,)]
    assert wait([("ag", "q1", "quay", "T", 179)]) == [(900,)] and wait([("ag", "q1", "quay", "T", 180)]) == [(180,)]
    assert wait([("ag", "q2", "quay", "T", 60), ("other", "q1", "quay", "T", 600)]) == [(960,)]
    assert wait([], pending(spark, sched_conn_dep_secs=HMS(9, 30), earliest_catch_secs=HMS(9, 46))) == [] == wait([], pending(spark, sched_conn_dep_secs=HMS(9, 30), earliest_catch_secs=HMS(9, 33), is_primary=False))
    w = evaluation.realized_wait(p, t, spark.createDataFrame([("ag", "q1", "quay", "T", 180)], STATE))
    assert rows(evaluation.sweep(p, w), "observed_max", "outcome") == [(180, "verified")]


def test_history(spark):
    r = random.Random(35)
    past = [(r.choice("FT"), r.choice("TW"), r.choice(["quay", "fort"]), r.choice([7, 8]), 0, r.choice([None, r.randrange(900)]), r.randrange(100)) for _ in range(60)]
    h = spark.createDataFrame(past, schema.HISTORY)
    got = {tuple(x)[:2]: tuple(x)[2:] for x in rows(evaluation.transfer_reliability(h, "quay", 7), "from_route", "to_route", "avg_delay", "n", "reliability_pct")}
    by = {}
    for a, b_, s, hour, _, x, _ in past:
        if (s, hour) == ("quay", 7) and x is not None:
            by.setdefault((a, b_), []).append(x)
    assert {k: (pytest.approx(sum(v) / len(v)), len(v), 0.0) for k, v in by.items()} == got
    assert evaluation.retained(h, 50 + evaluation.RETENTION_NS).count() == sum(x[6] >= 50 for x in past)
    s = spark.createDataFrame([("T", "gate", 6, x, 0) for x in (7, 50, None, 63)], schema.STOP_HISTORY)
    assert rows(cascade.average_stop_impacts(s)) == [("T", "gate", 6, 40.0, 3)]


# --- queries -----------------------------------------------------------------------------------------------------------


def test_api(spark):
    t = cascade_table(spark)
    at = NINE + HMS(7, 12)
    st = spark.createDataFrame([("ag", "t1", "quay", "T", 180, 0.5, at), ("ag", "w1", "fort-w", "W", 45, 0.5, at), ("ag", "stray", "quay", "T", 900, 0.5, at)],
                               STATE + ", confidence double, observed_at long")
    names = spark.createDataFrame([("quay", "The Quay", 0.0, 0.0, 1, ""), ("fort", "The Fort", 0.0, 0.0, 1, ""), ("fort-w", "", 0.0, 0.0, 0, "fort")], schema.STOPS)
    n = {r["route_id"]: [(d["trip_id"], d["stop_name"]) for d in r["delays"]] for r in api.network_state(st, names).collect()}
    assert n == {"T": [("stray", "The Quay"), ("t1", "The Quay")]}
    assert api.network_state_map(st, names, 5).collect()[0]["routes"]["T"][1]["delay_seconds"] == 180
    assert rows(api.route_delays(st, names, "W"), "stop_name", "delay_seconds") == [("fort-w", 45)]
    h = spark.createDataFrame([], schema.HISTORY)
    got = {(r["route_id"], r["stop_id"]): r["predicted_additional_delay"] for r in api.predict_impact(st, t, h, "t1", "quay").collect()}
    part = int(181 * 0.3)
    assert got == {("T", "mill"): 180, ("T", "fort"): 181, ("T", "gate"): 182, ("W", "fort"): part, ("W", "lake"): part}
    assert rows(api.predict_impact(st, t, h, "t1", "lake")) == [] == rows(api.predict_impact(st, t, h, "stray2", "quay"))
    assert {r["impact_id"] for r in api.blast_radius(st, t, h, "fort").collect()} == {"ag:w1:fort-w"}
    top = state.top_delays(st, 1).collect()
    assert [(r["trip_id"], r["more"]) for r in top] == [("stray", 1)]
    assert rows(state.delay_stats(st)) == [(2, 540.0, 900)]


def test_every_event_has_its_stop_time(spark, folder):
    from railtide.sources.adapters import Adapter
    from railtide.sources.tables import table

    a = Adapter(spark, folder)
    got = {e["seq"]: (e["trip_id"], e["stop_id"]) for e in a["g_events"].collect()}
    stops = sorted((s["trip_id"], s["stop_sequence"], s["stop_id"]) for s in a["g_stop_times"].collect())
    ids = [e["event_id"] for e in table(spark, folder, "events").select("event_id").collect()]
    assert a["g_events"].count() == a["g_predictions"].count() == len(ids)
    assert got == {i: stops[i % len(stops)][::2] for i in ids}


def test_whole_changelog_has_the_retractions(spark, folder):
    import __spark_entry__ as entry
    from railtide.sources.tables import table

    log = entry.queries()["state_changelog_whole"](spark, folder)
    e = table(spark, folder, "delay_events").where("type in ('TRIP_CANCELLED', 'SKIP_STOP') and delay_seconds is not null and observed_at is not null")
    want = sorted(rows(e, "delivery_id"))
    assert want and sorted(rows(log.where("op = 'delete'"), "seq")) == want
