import random
import time

import pytest
from railtide import schema
from railtide.operators import events, panes, state, transfers
from railtide.sources import feed, topics
from railtide.streaming import panes as spanes
from railtide.streaming import policy, stateful

A = "ARRIVAL_DELAY"


def through_files(spark, rows, kind, folder, pieces):
    """The rows as a stream of several files, in order."""
    step = -(-len(rows) // pieces)
    for k in range(pieces):
        spark.createDataFrame(rows[k * step : (k + 1) * step], kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(spark.createDataFrame([], kind).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drained(stream, folder, name, rows=None):
    """What a query gives for all its input; ``rows`` where it has timeouts and so never runs out of batches."""
    w = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/cp")
    if rows is None:
        w.trigger(availableNow=True).start().awaitTermination(60)
    else:
        q, end = w.trigger(processingTime="500 milliseconds").start(), time.monotonic() + 60
        while sum(p["numInputRows"] for p in q.recentProgress) < rows and time.monotonic() < end and q.exception() is None:
            time.sleep(0.2)
        assert q.exception() is None
        q.stop()
    return stream.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_differ_stream_equals_batch(spark, tmp_path):
    r = random.Random(14)
    rows = [("f", 15 * (i // 6), "t", f"s{i % 6}", r.randrange(60), 1000 + r.randrange(40), A) for i in range(240)]
    kind = "feed_id string, polled_at long, trip_id string, stop_id string, delay_seconds long, predicted_arrival long, type string"
    got = drained(stateful.diff_stream(through_files(spark, rows, kind, tmp_path, 3)), tmp_path, "diffed", len(rows))
    want = events.diff(spark.createDataFrame(rows, kind)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_reconciler_stream_equals_batch(spark, tmp_path):
    r = random.Random(15)
    kinds = [A] * 20 + ["SKIP_STOP", "TRIP_CANCELLED"]
    rows = []
    for i in range(400):
        k = r.choice(kinds)
        rows.append((i, "a", f"t{r.randrange(4)}", "" if k == "TRIP_CANCELLED" else f"s{r.randrange(3)}", "R", r.randrange(-300, 300), 100 + i - r.choice([0, 0, 9]), k))
    kind = "seq long, agency_id string, trip_id string, stop_id string, route_id string, delay_seconds int, observed_at long, type string"
    got = drained(stateful.reconcile_stream(through_files(spark, rows, kind, tmp_path, 4)), tmp_path, "reconciled", len(rows))
    want = state.changelog(spark.createDataFrame(rows, kind)).where("op <> 'delete'").select("seq", "op", "delay_seconds", "observed_at", "confidence", "update_count").collect()
    assert sorted((x["seq"], x["op"], x["delay_seconds"], x["observed_at"], x["confidence"], x["update_count"]) for x in got) == sorted(map(tuple, want))


def test_hours_are_corrected(spark, tmp_path):
    r = random.Random(16)
    rows = []
    for i in range(400):
        at = 10_000 + r.randrange(12_000)
        rows.append((i, at + r.choice([0, 5, 4000, 12_000]), "a", f"t{r.randrange(90)}_R.x", r.choice(["R", ""]), "s", r.choice([None, r.randrange(-50, 500)]), at // 9 * 9, r.choice([A, "SKIP_STOP"])))
    rows.sort(key=lambda x: (x[1], x[0]))
    kind = "delivery_id long, received_at long, agency_id string, trip_id string, route_id string, stop_id string, delay_seconds int, observed_at long, type string"
    store, emitted = spanes.HourStore(spark, f"{tmp_path}/store"), []
    stream = through_files(spark, rows, kind, tmp_path, 4)
    spanes.start(stream, store, lambda changed, b: emitted.append((b, [tuple(x) for x in changed.collect()])), f"{tmp_path}/cp").awaitTermination(240)
    want = {tuple(x) for x in panes.route_hours(spark.createDataFrame(rows, kind)).collect()}
    assert {tuple(x) for x in store.read().collect()} == want
    assert len(emitted) == 4 and {h[:3]: h for _, hs in emitted for h in hs} == {h[:3]: h for h in want}
    again = store.apply(spark.createDataFrame(rows[300:], kind), 3)  # the last batch once more
    assert {tuple(x) for x in store.read().collect()} == want and again.count() > 0


def test_corrected_hours_after_a_restart(spark, tmp_path):
    kind = "delivery_id long, received_at long, agency_id string, trip_id string, route_id string, stop_id string, delay_seconds int, observed_at long, type string"
    rows = [(i, 7200 + i, "a", f"t{i}", "R", "s", 10 * i, 7200, "ARRIVAL_DELAY") for i in range(4)]
    with pytest.raises(ValueError, match="no runs"):
        spanes.HourStore(spark, f"{tmp_path}/store").read()
    spanes.HourStore(spark, f"{tmp_path}/store").apply(spark.createDataFrame(rows[:2], kind), 0)
    again = spanes.HourStore(spark, f"{tmp_path}/store")
    want = [("a", "R", 2, 4, 60, 0, 30, 4, 0)]
    assert [tuple(x) for x in again.apply(spark.createDataFrame(rows[1:], kind), 1).collect()] == want == [tuple(x) for x in again.read().collect()]


def test_hours_over_many_batches_with_restarts(spark, tmp_path):
    """Runs are merged, old messages forgotten, the store opened anew for every batch, and some batches applied twice."""
    kind = "delivery_id long, received_at long, agency_id string, trip_id string, route_id string, stop_id string, delay_seconds int, observed_at long, type string"
    r, rows = random.Random(17), []
    for i in range(360):
        at = 600 * (i // 2) + r.randrange(600)
        rows.append((i, at + r.choice([0, 5, 4000, 12_000]), "a", f"t{i}_R.x", r.choice(["R", "Q"]), "s", r.randrange(-50, 500), at, A))
    rows += [(1000 + x[0], x[1] + 500, *x[2:]) for x in rows[::5]]  # delivered again within the time that is kept
    rows.sort(key=lambda x: (x[1], x[0]))
    whole = spark.createDataFrame(rows, kind)
    for b in range(9):
        store = spanes.HourStore(spark, f"{tmp_path}/store", every=3, keep=1800)
        part = spark.createDataFrame(rows[48 * b : 48 * b + 48], kind)
        for _ in range(2 if b in (2, 5, 7) else 1):
            changed = {tuple(x) for x in store.apply(part, b).collect()}
        now = {tuple(x) for x in store.read().collect()}
        assert changed <= now and len(changed) < len(now) + (b == 0)
    assert now == {tuple(x) for x in panes.route_hours(whole).collect()}
    assert store._runs() == ["00000000-00000007", "00000008-00000008"] and len(store.seen.names()) == 2
    assert store.seen.read().count() < 200


def test_alert_stream(spark, tmp_path):
    rows = [("A", "L", "S1"), ("B", "G", "S2"), ("L", "B", "S3")]
    kind = "from_route_id string, to_route_id string, station_id string"
    got = drained(transfers.alerts(through_files(spark, rows, kind, tmp_path, 2), ["L"], ["S2"]), tmp_path, "alerted")
    assert len(got) == 3
    with pytest.raises(AssertionError):
        assert len(drained(transfers.alerts(through_files(spark, rows, kind, tmp_path / "b", 1), ["G"]), tmp_path / "b", "alerted2")) == 3


# --- feed --------------------------------------------------------------------------------------------------------------


def num(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def msg(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, int):
            out += num(number << 3) + num(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += num(number << 3 | 2) + num(len(value)) + value
    return out


def message(stamp=1_700_000_000):
    trip = msg((1, "x9_A..up"), (5, ""))
    stops = [msg((4, "S1"), (2, msg((1, -30), (2, 1_700_000_600)))), msg((4, "S2"), (3, msg((2, 1_700_000_900)))), msg((4, "S3"), (5, 1))]
    update = msg((1, trip), *((2, s) for s in stops))
    gone = msg((1, msg((1, "x_B.."), (4, 3))))
    return msg((1, msg((1, "2.0"), (3, stamp))), (2, msg((1, "e1"), (3, update))), (2, msg((1, "e2"), (3, gone))), (2, msg((1, "e3"), (4, b"vehicle"))))


def test_decode():
    rows = feed.decode(message(), "f", 4, 99)
    assert rows[0] == ("f", 4, 1_700_000_000, ("x9_A..up", "", "SCHEDULED"),
                       [("S1", "SCHEDULED", (-30, 1_700_000_600), None), ("S2", "SCHEDULED", None, (None, 1_700_000_900)), ("S3", "SKIPPED", None, None)])
    assert rows[1][3] == ("x_B..", "", "CANCELED") and len(rows) == 2
    assert feed.decode(msg((1, msg((1, "2.0")))), "f", 0, 99) == []
    with pytest.raises(ValueError):
        feed.decode(message()[:-3], "f", 0, 0)


def test_feed_source(spark, tmp_path):
    (tmp_path / "a.pb").write_bytes(message())
    (tmp_path / "bad.pb").write_bytes(b"\xff\xff")
    spark.dataSource.register(feed.FeedSource)
    option = '{"a": "file://%s/a.pb", "bad": "file://%s/bad.pb", "gone": "file://%s/none.pb"}' % ((tmp_path,) * 3)
    batch = spark.read.format("railtide_feed").option("feeds", option).load()
    got = {r["stop_id"]: (r["type"], r["delay_seconds"], r["route_id"]) for r in events.normalize(batch, "ag").collect()}
    assert got == {"S1": (A, -30, "A"), "S2": ("DEPARTURE_DELAY", 0, "A"), "S3": ("SKIP_STOP", 0, "A"), "": ("TRIP_CANCELLED", 0, "B")}
    stream = spark.readStream.format("railtide_feed").option("feeds", option).load()
    q = events.normalize(stream, "ag").writeStream.format("memory").queryName("polled").option("checkpointLocation", f"{tmp_path}/cp").start()
    for _ in range(100):
        if (spark.sql("SELECT count(*) c FROM polled").first()["c"] or 0) >= 8:
            break
        time.sleep(0.3)
    q.stop()
    assert spark.sql("SELECT count(DISTINCT poll_no) FROM polled").first()[0] >= 2


def test_topics(spark, tmp_path):
    d = spark.createDataFrame([("ag", "t", "R", "s", 5, 1, 2, 3, A), ("ag", "t", "Q", "s", 6, 1, 2, 3, A)], schema.DELAY_EVENT)
    topics.write(d, "delay-events", folder=str(tmp_path))
    assert not topics.create(spark, "delay-events", folder=str(tmp_path)) and topics.create(spark, "network-predictions", 3, folder=str(tmp_path))
    assert topics.partition_count(spark, "delay-events", str(tmp_path)) == topics.PARTITIONS and topics.partition_count(spark, "network-predictions", str(tmp_path)) == 3
    topics.write(d, "delay-events", folder=str(tmp_path))  # a key stays in its partition
    assert len(list((tmp_path / "delay-events").glob("partition=*"))) in (1, 2)
    m = topics.messages(d, "route_id")
    bad = m.unionByName(spark.createDataFrame([("R", "not json"), ("R", None)], "key string, value string"))
    assert topics.decoded(bad, schema.DELAY_EVENT).count() == 2
    assert drained(topics.read_stream(spark, "delay-events", schema.DELAY_EVENT, folder=str(tmp_path)), tmp_path / "x", "from_topic")
    assert topics.has_kafka(spark) in (True, False)


def test_policy():
    c = policy.CatchUp()
    assert [c.update(x) for x in (1000, 1001, 500, 100, 99, 1000)] == [False, True, True, True, False, False]
    assert policy.total_lag({0: 3, 1: 4}) == 7
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert policy.retry(flaky, sleep=waits.append) == "ok" and waits == [0.2, 0.4]
    with pytest.raises(ZeroDivisionError):
        policy.retry(lambda: 1 / 0, sleep=waits.append)
