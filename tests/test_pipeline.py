"""The whole chain as a stream: feed messages to events, state, impacts, alerts, cascades, predictions and what is learned."""

import time

from pyspark.sql import functions as F
from railtide import schema
from railtide.operators import events
from railtide.sources import gtfs, topics
from railtide.streaming.alerts import AlertHub
from railtide.streaming.metrics import Metrics
from railtide.streaming.pipeline import Pipeline, start
from railtide.streaming.policy import Shedder

A, MIDNIGHT = "ARRIVAL_DELAY", 1_750_032_000  # a midnight, UTC
AT = lambda h, m=0: MIDNIGHT + 3600 * h + 60 * m


def timetable(spark):
    """F reaches the quay at 9:00, from where T leaves at 9:03 and 9:20 for the mill and the fort."""
    stops = spark.createDataFrame([(s, s.title(), 0.0, 0.0, 1, "") for s in ("quay", "mill", "fort")], schema.STOPS)
    routes = spark.createDataFrame([(r, r, r, "") for r in "FT"], schema.ROUTES)
    trips = spark.createDataFrame([("f1_F.", "F", "all", 0), ("t1_T.", "T", "all", 0), ("t2_T.", "T", "all", 0)], schema.TRIPS)
    calls = [("f1_F.", "quay", 540, 1), *((f"t{k}_T.", s, 543 + 17 * (k - 1) + 4 * n, n + 1) for k in (1, 2) for n, s in enumerate(("quay", "mill", "fort")))]
    times = spark.createDataFrame([(t, s, 60 * m, 60 * m, n) for t, s, m, n in calls], schema.STOP_TIMES)
    return gtfs.build(stops, routes, trips, times, spark.createDataFrame([("quay", "quay", 2, 120)], schema.TRANSFERS), spark.createDataFrame([("all",)], "service_id string"))


def event(trip, stop, delay, at, sched, kind=A, predicted=0):
    return ("ag", trip, trip[-2], stop, delay, at, sched, predicted, kind)


def test_chain(spark, tmp_path):
    clock, lag, hub, metrics = {"now": AT(9)}, {"n": 0}, AlertHub(), Metrics()
    mine, other = hub.subscribe(["T"]), hub.subscribe(stations=["mill"])
    t = timetable(spark)
    p = Pipeline(spark, t, f"{tmp_path}/store", "ag", hub=hub, metrics=metrics, now=lambda: clock["now"], lag=lambda: lag["n"])

    def send(*rows):
        topics.write(spark.createDataFrame(list(rows), schema.DELAY_EVENT).coalesce(1), "delay-events", folder=f"{tmp_path}/topic")
        start(topics.read_stream(spark, "delay-events", schema.DELAY_EVENT, folder=f"{tmp_path}/topic"), p, f"{tmp_path}/cp").awaitTermination(240)
        return {(r["trip_id"], r["stop_id"]): r["delay_seconds"] for r in p.current(clock["now"]).collect()}

    # F is 100 s late: the change takes 120 of the 180 s, so the connection is broken; the delay itself is worked out from the timetable
    assert send(event("f1_F.", "quay", 0, AT(9), 0, predicted=AT(9) + 100)) == {("f1_F.", "quay"): 100}
    assert metrics.value("enriched", result="hit") == 1 and len(mine.drain()) == 1 and not other.drain()
    impact = spark.read.parquet(f"{tmp_path}/store/transfer-impacts").collect()
    assert [(r["level"], r["next_viable_trip_id"], r["additional_wait_seconds"]) for r in impact] == [("BROKEN", "t2_T.", 1020)]
    found = {(r["route_id"], r["stop_id"]): r["predicted_additional_delay"] for r in spark.read.parquet(f"{tmp_path}/store/network-predictions").collect()}
    assert found[("T", "mill")] == 1020 and found[("T", "fort")] == 1021
    waiting = {r["station_id"]: r for r in p.pending.read().collect()}
    assert set(waiting) == {"mill", "fort"} and waiting["mill"]["is_primary"] and not waiting["fort"]["is_primary"]

    # while the stream lags only the state is kept up, and predictions are still matched
    clock["now"], lag["n"] = AT(9, 10), 5000
    assert send(event("t1_T.", "mill", 400, AT(9, 9), AT(9, 7)), event("f1_F.", "quay", 500, AT(9, 9), AT(9)))[("t1_T.", "mill")] == 400
    assert metrics.value("skipped_batches") == 1 and not mine.drain()
    assert {r["station_id"]: (r["observed_max"], r["matched"]) for r in p.pending.read().collect()} == {"mill": (400, True), "fort": (0, False)}

    # half an hour later predictions expire: the wait that was needed and what was seen are learned
    clock["now"], lag["n"] = AT(9, 40), 0
    state = send(event("f1_F.", "", 0, AT(9, 39), 0, "TRIP_CANCELLED"), event("t2_T.", "fort", 90, AT(9, 39), AT(9, 28)))
    assert state == {("t1_T.", "mill"): 400, ("t2_T.", "fort"): 90}
    assert p.pending.read() is None or p.pending.read().where("source_station = 'quay' and created_at <= %d" % AT(9)).count() == 0
    learned = [(r["from_route"], r["to_route"], r["station"], r["hour"], r["downstream_impact"]) for r in p.history().collect()]
    assert learned == [("F", "T", "quay", 9, 1020)]  # the next train, on time
    assert [(r["route"], r["station"], r["observed"]) for r in p.stop_history().collect()] == [("T", "fort", 0)]
    assert metrics.value("finalized", outcome="verified") == 1 and metrics.value("finalized", outcome="falsified") == 1

    # state expires after two hours
    clock["now"] = AT(12)
    assert p.current(clock["now"]).count() == 0


def test_batches_applied_again_and_shedding(spark, tmp_path):
    t, shed = timetable(spark), Shedder(0 + 1)
    p = Pipeline(spark, t, f"{tmp_path}/store", "ag", shedder=shed, now=lambda: AT(9))
    first = spark.createDataFrame([event("f1_F.", "quay", 100, AT(9), AT(9)), event("t1_T.", "fort", 30, AT(9), AT(9, 11))], schema.DELAY_EVENT)
    again = spark.createDataFrame([event("f1_F.", "quay", 400, AT(9, 1), AT(9)), event("t1_T.", "", 0, AT(9, 1), 0, "TRIP_CANCELLED")], schema.DELAY_EVENT)
    gate = {"open": False}
    slow = p._propagate

    def waits(*args):
        while not gate["open"]:
            time.sleep(0.05)
        slow(*args)

    p._propagate = waits
    for k, batch in ((0, first), (1, again), (1, again)):  # the second batch is applied twice
        p.apply(batch, k)
    assert (shed.ran, shed.shed) == (1, 2) and p.metrics.value("shed_batches") == 2
    got = {(r["trip_id"], r["stop_id"]): (r["delay_seconds"], r["update_count"]) for r in p.current(AT(9)).collect()}
    assert got == {("f1_F.", "quay"): (310, 2)}
    gate["open"] = True
    for _ in range(600):
        if p.pending.read() is not None:
            break
        time.sleep(0.1)
    assert {r["station_id"] for r in p.pending.read().collect()} == {"mill", "fort"}


def test_failed_polls_are_counted(spark):
    feed = spark.createDataFrame([("f", 1, 5, None, None), ("g", 1, 5, None, [])], schema.FEED)
    from railtide.sources.feed import failures

    assert [tuple(r) for r in failures(feed).collect()] == [("f", 1, 5)] and events.normalize(feed, "ag").count() == 0
    assert feed.where(F.col("trip").isNotNull()).count() == 0
