import random

from railtide.operators.snapshots import snapshot_changes

SCHEMA = "feed string, snap int, trip string, stop string, d int, p long, type string"


def brute(rows):
    feeds = {}
    for f, n, t, s, d, p, _ in rows:
        if f is not None and n is not None:
            feeds.setdefault(f, {}).setdefault(n, {})[t.strip() if t else t, s] = (d, p)
    out = set()
    for f, snaps in feeds.items():
        order = sorted(snaps)
        for a, b in zip(order, order[1:]):
            old, new = snaps[a], snaps[b]
            out |= {(f, b, *k, "added") for k in new.keys() - old.keys()} | {(f, b, *k, "removed") for k in old.keys() - new.keys()}
            out |= {(f, b, *k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return out


def changes(spark, rows, **kw):
    from railtide.functions.ids import clean

    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), "feed", "snap", [("trip", clean("trip")), "stop"], ["d", "p"], **kw).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_random_snapshots(spark):
    r = random.Random(3)
    rows, live = [], {}
    for n in (1, 2, 4, 5, 9):
        for _ in range(30):
            live[f"t{r.randrange(60)}", f"s{r.randrange(3)}"] = (r.choice([None, 5, r.randrange(100)]), r.choice([None, 0, 10**10]))
        for k in r.sample(sorted(live), 5):
            del live[k]
        for f in ("f1", "f2"):
            for (t, s), (d, p) in live.items():
                rows += [(f, n, r.choice([t, f" {t} "]), s, d, p, r.choice("xy"))] * r.choice([1, 1, 2])
    r.shuffle(rows)
    assert changes(spark, rows) == brute(rows)
    assert changes(spark, rows, bits=9) == brute(rows)


def test_edges(spark):
    assert changes(spark, []) == set()
    rows = [("f", 1, "a", "s", None, 1, ""), ("f", 2, "a", "s", None, 1, "other type"), ("f", 3, "a", "s", 0, 1, ""), (None, 4, "a", "s", 1, 1, ""),
            ("f", None, "a", "s", 1, 1, ""), ("g", 7, "b", None, 1, 1, "")]
    assert changes(spark, rows) == {("f", 3, "a", "s", "changed")}
    rows = [("f", 1, None, "s", 1, 1, ""), ("f", 2, None, "s", 2, 1, ""), ("f", 2, "", "s", 2, 1, "")]
    assert changes(spark, rows) == {("f", 2, None, "s", "changed"), ("f", 2, "", "s", "added")}
