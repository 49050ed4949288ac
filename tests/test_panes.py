import random

from railtide.operators import panes

EVENTS = ("delivery_id long, received_at long, agency_id string, trip_id string, route_id string, stop_id string, "
          "delay_seconds int, observed_at long, type string")
PRED = "id string, agency_id string, route_id string, station_id string, baseline_secs int, created_at long, expires_at long"


def sample(n=3000, seed=6):
    r = random.Random(seed)
    ev = []
    for i in range(n):
        at = 10_000 + r.randrange(20_000)
        rec = at + r.choice([0, 5, 60, 3000, 9000, 15_000])
        ev.append((i, rec, "a", f"t{r.randrange(900)}_R.x", r.choice(["R", "", "Q"]), r.choice(["s", "s", "u"]), r.choice([None, r.randrange(-100, 900), 2**31 - 1]),
                   at // 7 * 7, r.choice(["ARRIVAL_DELAY", "DEPARTURE_DELAY", "SKIP_STOP"])))
    ev += ev[:50]
    pr = []
    for i in range(150):
        c = 9000 + r.randrange(20_000)
        pr.append((f"p{i}", "a", r.choice("RQ"), r.choice("su"), r.choice([None, 0, 50, -5]), c, r.choice([0, c, c + 900, c + 3600, c + 7200])))
    return ev, pr + pr[:9]


def brute(ev, pr):
    first = {}
    for e in ev:
        k = (e[3].strip(), e[5].strip(), e[7])
        if k not in first or (e[1], e[0]) < (first[k][1], first[k][0]):
            first[k] = e
    late = {e[0] for e in first.values() if e[1] > (e[7] // 3600 + 1) * 3600 + 7200}
    ok = [e for e in first.values() if e[0] not in late and e[8] != "SKIP_STOP" and e[6] is not None]
    best = {}
    for i, a, r, s, base, c, x in pr:
        if x:
            own = [(e[1], e[6] - base if base is not None else 0) for e in ok if (e[4] or "R", e[5]) == (r, s) and c <= e[7] <= x]
            best[i] = (max([0, *(d for t, d in own if t <= x)]), max([0, *(d for _, d in own)]))
    return late, best, first


def test_against_brute_force(spark):
    ev, pr = sample()
    late, best, first = brute(ev, pr)
    e, p = spark.createDataFrame(ev, EVENTS), spark.createDataFrame(pr, PRED)
    got = panes.observed_maxima(panes.first_records(e), p).collect()
    assert len(got) == len(best) and {r[0]: (r[1], r[2]) for r in got} == best
    cases = {tuple(r) for r in panes.corrected_cases(e, p).collect()}
    assert cases == {("event", str(i)) for i in late} | {("prediction", i) for i, (a, b) in best.items() if b > a}
    hours = panes.route_hours(e).collect()
    assert sum(r["n"] + r["n_late"] for r in hours) == sum(x[8] != "SKIP_STOP" and x[6] is not None for x in first.values())
    assert any(r["n"] > r["n_first"] for r in hours)


def test_a_late_record_changes_one_pane(spark):
    ev, pr = sample(400, 7)
    windows = panes.prediction_windows(spark.createDataFrame(pr, PRED))

    def table(rows):
        t = panes.panes(panes.pane_points(panes.first_records(spark.createDataFrame(rows, EVENTS)), windows))
        return {tuple(r)[:9] for r in t.select("agency_id", "route", "stop_id", "hour", "pane", "n", "total", "low", "high").collect()}

    one = (9999, 12_400, "a", "new_R.x", "R", "s", 800, 12_345, "ARRIVAL_DELAY")
    assert len(table([*ev, one]) ^ table(ev)) in (1, 2)


def test_empty(spark):
    e, p = spark.createDataFrame([], EVENTS), spark.createDataFrame([], PRED)
    assert panes.corrected_cases(e, p).count() == 0 and panes.route_hours(e).count() == 0
    p = spark.createDataFrame([("x", "a", "R", "s", 5, 1, 10)], PRED)
    assert [tuple(r) for r in panes.observed_maxima(panes.first_records(e), p).collect()] == [("x", 0, 0)]
