import random
import threading
import urllib.request

from pyspark.sql import functions as F
from railtide.operators.store import KeyedStore
from railtide.streaming.alerts import AlertHub
from railtide.streaming.metrics import Metrics, MetricsListener, counted
from railtide.streaming.policy import Shedder

KIND = "who string, what string, x int, at long"


def held(df):
    return {} if df is None else {(r["who"], r["what"]): r["x"] for r in df.collect()}


def test_store_against_a_dictionary(spark, tmp_path):
    r, want = random.Random(21), {}
    for k in range(9):
        s = KeyedStore(spark, f"{tmp_path}/s", ["who", "what"], ["x", "at"], ttl=50, every=4)  # opened anew each time
        keys = {(r.choice(["a", "ab", "b", None]), r.choice(["s", "t"])) for _ in range(4)}
        rows = [(*key, 10 * k, 10 * k) for key in keys]
        for _ in range(1 + k % 2):
            s.put(spark.createDataFrame(rows, KIND), "at", f"{k}")
        want.update({key: (10 * k, 10 * k) for key in keys})
        if k == 5:
            s.remove(spark.createDataFrame([("a", "s")], "who string, what string"), 51, "gone")
            want.pop(("a", "s"), None)
        now = 10 * k + 5
        alive = {key: x for key, (x, at) in want.items() if now - at <= 50}
        assert held(s.read(now)) == alive
        assert held(s.scan("who", "a", now)) == {key: x for key, x in alive.items() if (key[0] or "").startswith("a")}
        assert held(s.get(now, who=None, what="t")) == {key: x for key, x in alive.items() if key == (None, "t")}
    taken = s.take(F.col("x") <= 60, 100, "take")
    assert held(taken).items() <= {key: x for key, (x, _) in want.items() if x <= 60}.items() and min(held(s.read(85)).values()) > 60
    assert KeyedStore(spark, f"{tmp_path}/none", ["who"], ["x"]).read() is None and len(s.runs.names()) <= 6


def test_metrics_text_and_server(spark, tmp_path):
    m = Metrics(buckets=(0.1, 1.0))
    m.add("polls", 2, feed='a"b')
    m.add("polls", 3, feed='a"b')
    m.set("lag", 7)
    for v in (0.05, 0.1, 0.5, 3):
        m.observe("seconds", v)
    text = m.text()
    assert 'railtide_polls{feed="a\\"b"} 5' in text and "railtide_lag 7" in text and "# TYPE railtide_seconds histogram" in text
    assert [x for x in text.split("\n") if "seconds_" in x] == [
        'railtide_seconds_bucket{le="0.1"} 2', 'railtide_seconds_bucket{le="1.0"} 3', 'railtide_seconds_bucket{le="+Inf"} 4', "railtide_seconds_sum 3.65", "railtide_seconds_count 4"]
    server = m.serve()
    assert urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/metrics", timeout=5).read().decode() == text
    server.shutdown()


def test_counts_by_the_way_of_a_stream(spark, tmp_path):
    m = Metrics()
    listener = MetricsListener(m)
    spark.streams.addListener(listener)
    try:
        spark.range(10).write.parquet(f"{tmp_path}/in")
        s = counted(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), "seen", even=F.count_if(F.col("id") % 2 == 0), total=F.count(F.lit(1)))
        s.writeStream.format("noop").queryName("q").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)
        for _ in range(50):
            if m.value("seen_total") == 10:
                break
            threading.Event().wait(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert m.value("seen_even") == 5 and m.value("input_rows", query="q") == 10


def test_alerts_reach_those_who_want_them(spark):
    hub = AlertHub()
    every, line, place, small = hub.subscribe(), hub.subscribe(["K"]), hub.subscribe(stations=["north"]), hub.subscribe(size=1)
    d = spark.createDataFrame([("K", "M", "south"), ("M", "N", "north"), ("M", "N", "east")], "from_route_id string, to_route_id string, station_id string")
    assert hub.publish(d) == (6, 2)
    assert [len(s.drain()) for s in (every, line, place, small)] == [3, 1, 1, 1] and small.dropped == 2
    hub.leave(every)
    hub.leave(small)
    assert hub.publish(d) == (2, 0) and AlertHub().publish(d) == (0, 0)


def test_shedding():
    gate, s = threading.Event(), Shedder(2)
    assert [s.run(gate.wait) for _ in range(4)] == [True, True, False, False] and (s.ran, s.shed) == (2, 2)
    gate.set()
    for _ in range(50):
        if s.run(lambda: None):
            break
        threading.Event().wait(0.05)
    assert s.ran == 3
