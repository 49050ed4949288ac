import math
import random

import numpy as np
import pytest
from railtide.llm import percentiles as p

QS = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99}


def check(values, q, got, allowed):
    """got must have a rank within allowed of ceil(q n); ties have a span of ranks."""
    v = np.sort(values)
    r = max(1, math.ceil(q * len(v) - 1e-9))
    low, high = np.searchsorted(v, got, "left") + 1, np.searchsorted(v, got, "right")
    assert low <= high and max(low - r, r - high, 0) <= allowed


@pytest.mark.parametrize("share", [0.05, 0.008, 0.001])
def test_merge_keeps_its_error(share):
    rng = np.random.default_rng(int(1 / share))
    parts = [np.sort(rng.choice([rng.normal(0, 5, n), rng.integers(0, 4, n).astype(float)])) for n in (1, 5, 400, 3000, 20_000)]
    all_values = np.concatenate(parts)
    level = [p.compress(p.exact(v), share) for v in parts]
    s = p.compress(p.merge([p.compress(p.merge(level[:3]), share), p.compress(p.merge(level[3:]), share)]), share)
    assert s[3] == len(all_values) and len(s[0]) <= 1 / (2 * share) + 3
    assert (np.diff(s[0]) >= 0).all() and s[0][0] == all_values.min() and s[0][-1] == all_values.max()
    assert p.rank_error(s) <= 3 * share * s[3]
    for r in range(1, s[3] + 1, 41):
        at, far = p.pick(s, np.array([r]))
        assert far[0] <= p.rank_error(s)
        check(all_values, r / s[3], s[0][at[0]], far[0])


@pytest.mark.parametrize("width", [5, 1024])
@pytest.mark.parametrize("rows", [300, 20_000])
def test_many_lists_of_one_group_stay_within_eps(width, rows, monkeypatch):
    monkeypatch.setattr(p, "WIDTH", width)
    eps, levels, count = 0.001, 2, 1500 if rows == 300 else 300
    share = p.level_share(eps, levels)
    rng = np.random.default_rng(rows)
    fold, kept = p.Fold(share), []
    for _ in range(count):
        v = np.sort(rng.normal(0, 1, rng.integers(rows // 2, rows)))
        kept.append(v)
        fold.add(p.compress(p.exact(v), share))
    s = fold.close()
    everything = np.sort(np.concatenate(kept))
    assert s[3] == len(everything) and p.rank_error(s) <= eps * s[3]
    ranks = np.linspace(1, s[3], 999).round().astype(np.int64)
    at, far = p.pick(s, ranks)
    true = np.searchsorted(everything, s[0][at]) + 1
    assert (far <= eps * s[3]).all() and (np.abs(true - ranks) <= far).all()


def test_many_flushes_per_task(spark, monkeypatch):
    monkeypatch.setattr(p, "WIDTH", 16)
    df = spark.range(60_000).selectExpr("id % 3 AS g", "pmod(xxhash64(id), 1000003) AS x").repartition(2)
    parts = [df.where(f"x % 100 = {k}") for k in range(100)]
    # a hundred stored summaries of each group are more than a task merges at once
    stored = [p.summaries(d, ["g"], "x", 0.01, levels=3) for d in parts[:40]]
    got = {r["g"]: r for r in p.percentiles(p.merge_summaries(stored, ["g"], 0.01, levels=3), ["g"], QS).collect()}
    rows = df.where("x % 100 < 40").toPandas()
    for g, part in rows.groupby("g"):
        assert got[g]["n"] == len(part) and got[g]["rank_error"] <= 0.01 * len(part)
        for name, q in QS.items():
            check(part["x"].to_numpy(float), q, got[g][name], got[g]["rank_error"])


def rows_of(n=20_000):
    r = random.Random(8)
    out = [(r.choice(["hot", "hot", "x", None]), r.choice([1, None]), r.choice([None, float("nan"), float(r.randrange(9)), r.gauss(0, 1e6)])) for _ in range(n)]
    return out + [("only null", 1, None), ("one", 1, 3.0), ("inf", 1, math.inf)]


def brute(rows):
    by = {}
    for g, h, v in rows:
        if v is not None and v == v:
            by.setdefault((g, h), []).append(float(v))
    return by


@pytest.mark.parametrize("eps", [0.0005, 0.02])
def test_grouped(spark, eps, monkeypatch):
    rows = rows_of()
    want = brute(rows)
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(7)
    got = p.grouped_percentiles(df, ["g", "h"], "x", QS, eps).collect()
    assert len(got) == len(want)
    for r in got:
        values = want[r["g"], r["h"]]
        assert r["n"] == len(values) and r["rank_error"] <= eps * len(values)
        for name, q in QS.items():
            check(values, q, r[name], r["rank_error"])


def test_days_apart_and_deep_merges(spark, monkeypatch):
    monkeypatch.setattr(p, "FAN_IN", 3)
    rows = [(g, k % 9, v) for k, (g, _, v) in enumerate(rows_of(6000))]
    df = spark.createDataFrame(rows, "g string, day int, x double").selectExpr("*", "1 AS lo", "'c' AS part")
    days = [p.summaries(df.where(f"day = {k}").repartition(11), ["g"], "x", 0.01, levels=8) for k in range(9)]
    got = {r["g"]: r for r in p.percentiles(p.merge_summaries(days, ["g"], 0.01, levels=8), ["g"], QS).collect()}
    want = {g: v for (g, _), v in brute([(g, None, v) for g, _, v in rows]).items()}
    assert set(got) == set(want)
    for g, values in want.items():
        assert got[g]["n"] == len(values) and got[g]["rank_error"] <= 0.01 * len(values)
        for name, q in QS.items():
            check(values, q, got[g][name], got[g]["rank_error"])


def test_no_keys_and_empty(spark):
    df = spark.createDataFrame([(float(x),) for x in range(100)], "x double")
    assert [tuple(r) for r in p.grouped_percentiles(df, [], "x", {"m": 0.5}).collect()] == [(100, 0, 49.0)]
    assert p.grouped_percentiles(df.limit(0), [], "x", {"m": 0.5}).count() == 0
    with pytest.raises(ValueError):
        p.summaries(df.withColumnRenamed("x", "n"), ["n"], "n")
