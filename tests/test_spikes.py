import math
import random

import numpy as np
from railtide.operators import spikes

EVENTS = ("delivery_id long, received_at long, agency_id string, trip_id string, route_id string, stop_id string, "
          "delay_seconds int, observed_at long, type string")
STATES = "state_id long, agency_id string, trip_id string, route_id string, stop_id string, delay_seconds int, observed_at long, confidence double"


def brute_spikes(rows, fence=6.0):
    by = {}
    for i, s, x in rows:
        if x is not None:
            by.setdefault(s, []).append(x)
    out = set()
    for i, s, x in rows:
        if x is None:
            continue
        q1, q3 = np.percentile(by[s], [25, 75])
        if x > q3 + fence * (q3 - q1) or x < q1 - fence * (q3 - q1):
            out.add(i)
    return out


def test_spikes_equal_fences(spark):
    r = random.Random(1)
    rows = []
    for i in range(6000):
        s = r.choice("aaaab")
        x = int(r.gauss(0, 40)) if r.random() < 0.97 else r.choice([400, -300, 250, 5000, 2**31 - 1, -(2**31)])
        rows.append((i, s, 1000 + r.randrange(90_000), None if r.random() < 0.01 else x))
    for k in range(40):  # a source whose outlying readings stand in a row, where fine details are zero
        rows.append((10_000 + k, "c", 5000 + k, 900 if 10 <= k < 19 else k % 3))
    rows += [(20_000, "d", 1, 7), (20_001, "e", None, 5), (20_002, "e", None, 5), (20_003, "e", 1, 6)]
    df = spark.createDataFrame(rows, "id long, src string, at long, x int")
    got = {x[0] for x in spikes.wavelet_spikes(df, "id", "src", "at", "x", chunk_seconds=7200).select("row_id").collect()}
    assert got == brute_spikes([(i, s, x) for i, s, _, x in rows])


def test_exact_quantiles(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.choice([r.randrange(-50, 50), r.randrange(-(2**31), 2**31)])) for _ in range(999)] + [("one", 5), ("none", None)]
    got = {x["src"]: x for x in spikes.exact_quantiles(spark.createDataFrame(rows, "s string, v int"), "s", "v", {"q1": 0.25, "q3": 0.75}).collect()}
    for s in "ab":
        want = np.percentile([v for k, v in rows if k == s], [25, 75])
        assert math.isclose(got[s]["q1"], want[0]) and math.isclose(got[s]["q3"], want[1])
    assert (got["one"]["n"], got["one"]["q1"]) == (1, 5.0) and "none" not in got


def event(i, at, x, trip="T_A.", kind="ARRIVAL_DELAY", received=None, stop="S", route="A"):
    return (i, at if received is None else received, "ag", trip, route, stop, x, at, kind)


def found(spark, events, states=()):
    got = spikes.implausible_readings(spark.createDataFrame(list(events), EVENTS), spark.createDataFrame(list(states), STATES))
    return {tuple(r) for r in got.collect()}


def test_frozen_runs_over_chunks(spark):
    at = [spikes.CHUNK_SECONDS * 3 + 600 * k for k in range(-5, 5)]
    ev = [event(i, t, 77) for i, t in enumerate(at)]  # ten equal values across a chunk border
    ev += [event(50, at[0], 77, trip=" T_A. ", received=10**9)]  # a later copy, blanks around the id
    ev += [event(100 + k, 1000 + k, 5, trip="U_A.") for k in range(7)] + [event(107, 1007, 6, trip="U_A.")]  # seven only
    ev += [event(200 + k, 1000 + k, 0, trip="V_A.") for k in range(12)]  # zero is no frozen value
    ev += [event(300 + k, 1000 + k, 9 if k != 4 else None, trip="W_A.") for k in range(9)]  # a null is no measurement
    ev += [event(400 + k, 1000 + k, 9, trip="X_A.", kind="SKIP_STOP") for k in range(9)]
    ev += [event(1000 + k, 100 + k, (k * 37) % 101, trip=f"Y{k}_A.") for k in range(200)]
    got = {r[1] for r in found(spark, ev)}
    assert got == {*range(10), 50, *(300 + k for k in range(9) if k != 4)}


def test_bounds_confidence_and_empty(spark):
    assert found(spark, []) == set()
    s = [(1, "a", "t", "r", "s", 43_200, 1, 0.5), (2, "a", "t", "r", "s", 43_199, 1, 1.0), (3, "a", "t", "r", "s", None, 1, float("nan")),
         (4, "a", "t", "r", "s", -43_200, 1, None), (5, "a", "t", "r", "s", 43_100, 1, 0.49), (6, "a", "t", "r", "s", None, None, 1.01)]
    got = found(spark, [], s)
    assert got == {("delay_state", 1, "delay_seconds"), ("delay_state", 4, "delay_seconds"), ("delay_state", 3, "confidence"),
                   ("delay_state", 5, "confidence"), ("delay_state", 6, "confidence")}


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(k, "s", k, k % 5 if k < 50 else 9000, "x", 1.0) for k in range(51)], "id long, src string, at long, x int, chunk string, q1 double")
    assert [r["row_id"] for r in spikes.wavelet_spikes(df, "id", "src", "at", "x").collect()] == [50]
