import random

from railtide.operators import bitemporal as b


def test_against_brute_force(spark):
    r = random.Random(4)
    versions = []
    for i in range(150):
        lo = r.randrange(0, 60)
        versions.append((r.choice("aaab"), r.randrange(0, 40) * 86_400, lo, lo + r.randrange(-1, 30), f"v{i}"))
    versions += versions[:20] + [(None, 1, 1, 1, "x"), ("a", None, 1, 5, "y"), ("a", 5, None, 5, "z")]
    events = [(i, r.choice(["a", "b", "c", None]), r.choice([None, r.randrange(-100, 45 * 86_400)]), r.choice([None, r.randrange(-5, 100)])) for i in range(400)]
    v = spark.createDataFrame(versions, "e string, known long, lo int, hi int, name string")
    e = spark.createDataFrame(events, "id long, who string, at long, day int").selectExpr("*", "'clash' AS v0", "1 AS entity")
    rects = b.rectangles(v, "e", "known", ["name"], "lo", "hi")
    got = {x["id"]: x["name"] for x in b.locate(e, rects, "who", "at", ["name"], "day", valid_cell=7, known_cell=3 * 86_400).collect()}
    assert len(got) == len(events)
    for i, who, at, day in events:
        fit = [x for x in versions if None not in (who, at, day) and x[0] == who and None not in x and x[1] <= at and x[2] <= day <= x[3]]
        assert got[i] == (max(fit, key=lambda x: (x[1], x[4]))[4] if fit else None)
    # disjoint: no point of the plane is in two rectangles
    rs = [tuple(x) for x in rects.where("entity = 'b'").collect()]
    for x in rs:
        for y in rs:
            assert x == y or x[2] <= y[1] or y[2] <= x[1] or x[4] <= y[3] or y[4] <= x[3]


def test_later_knowledge_is_not_used(spark):
    ev = spark.createDataFrame([(1, " T ", 100_000), (2, "T", 300_000), (3, "U", 1), (4, None, 5), (5, "T", 90_000)], "delivery_id long, trip_id string, observed_at long")
    tr = spark.createDataFrame([("T", "A", 95_000), ("T", "B", 200_000), ("T", "B", 200_000)], "trip_id string, service_id string, published_at long")
    ca = spark.createDataFrame([("A", "19700101", "19700110", 0), ("A", "19700102", "19700103", 150_000), ("B", "19700104", "19700105", 0)],
                               "service_id string, start_date string, end_date string, published_at long")
    got = {r[0]: tuple(r)[1:] for r in b.events_as_known(ev, tr, ca).collect()}
    assert got == {1: ("A", "19700101", "B", ""), 2: ("B", "19700104", "B", "19700104"), 3: ("",) * 4, 4: ("",) * 4, 5: ("", "", "B", "")}


def test_wild_times_cost_no_cells(spark):
    """An event whose time is far off is located like others, and doesn't spread open rectangles over the time between."""
    v = spark.createDataFrame([("a", 1000, 3, 5, "x"), ("a", 90_000_000, 4, 9, "y")], "e string, known long, lo int, hi int, name string")
    e = spark.createDataFrame([(1, "a", 1 << 61, 4), (2, "a", -(1 << 61), 4), (3, "a", 5000, 2_000_000_000), (4, "a", 5000, 5)], "id long, who string, at long, day int")
    got = b.locate(e, b.rectangles(v, "e", "known", ["name"], "lo", "hi"), "who", "at", ["name"], "day").collect()
    assert {x["id"]: x["name"] for x in got} == {1: "y", 2: None, 3: None, 4: "x"}


def test_empty(spark):
    ev = spark.createDataFrame([], "delivery_id long, trip_id string, observed_at long")
    tr = spark.createDataFrame([], "trip_id string, service_id string, published_at long")
    ca = spark.createDataFrame([], "service_id string, start_date string, end_date string, published_at long")
    assert b.events_as_known(ev, tr, ca).count() == 0
    assert b.events_as_known(spark.createDataFrame([(1, "T", 5)], ev.schema), tr, ca).collect()[0][1] == ""
