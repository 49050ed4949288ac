import random

from railtide.operators import messages as m

SCHEMA = "delivery_id long, received_at long, trip_id string, stop_id string, observed_at long, bucket string"


def rows_of(n=800):
    r = random.Random(5)
    out = []
    for i in range(n):
        t = r.choice(["hot"] * 3 + [f"t{r.randrange(40)}", None])
        out.append((i, r.choice([None, r.randrange(50)]), r.choice([t, t and f" {t}\t"]), r.choice(["s", None]), 1 if t == "hot" else r.choice([1, 2, None]), "clash"))
    return out


def brute(rows):
    first = {}
    for i, rec, t, s, at, _ in rows:
        k, o = (t and t.strip(), s, at), (rec is not None, rec or 0, i)
        first[k] = min(first.get(k, o), o)
    return {r[0] for r in rows} - {o[2] for o in first.values()}


def test_repeated(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    got = [x[0] for x in m.repeated_deliveries(df, batches=3).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert m.repeated_deliveries(df.limit(0)).count() == 0


def test_upserts_are_idempotent_and_compaction_keeps_all(spark, tmp_path):
    rows = rows_of(300)
    store = m.MessageStore(spark, f"{tmp_path}/store", ["trip_id", "stop_id", "observed_at"], ["received_at", "delivery_id"])
    a, b = spark.createDataFrame(rows[:200], SCHEMA), spark.createDataFrame(rows[150:], SCHEMA)
    store.upsert(a, "1")
    store.upsert(b, "2")
    before = {tuple(x) for x in store.read().collect()}
    store.upsert(a, "1")  # the batch delivered again
    assert {tuple(x) for x in store.read().collect()} == before and [n[:4] for n in store.names()] == ["b-1-", "b-2-"]
    assert store.compact() == 2 and store.compact() == 1
    assert {tuple(x) for x in store.read().collect()} == before
    store.upsert(b, "2")  # and again after compaction
    assert {tuple(x) for x in store.read().collect()} == before
    got = store._runs([n for n in store.names() if n.startswith("m-")])
    assert got.groupBy("trip_id", "stop_id", "observed_at").count().where("count > 1").count() == 0


def test_compaction_reads_buckets_without_a_shuffle(spark, tmp_path):
    rows = rows_of(500)
    df = spark.createDataFrame(rows, SCHEMA)
    ids, order = ["trip_id", "stop_id", "observed_at"], ["received_at", "delivery_id"]
    store = m.MessageStore(spark, f"{tmp_path}/store", ids, order, rows=20 * m.BUCKET_ROWS)
    for k in range(3):
        store.upsert(df.where(f"delivery_id % 3 = {k}"), str(k))
    with m._settings(spark, **{"autoBucketedScan.enabled": "false"}):
        merged = store._merged(store.names(), "railtide_test_runs")
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort " not in plan and f"SelectedBucketsCount: {store.buckets} out of {store.buckets}" in plan
        assert merged.rdd.getNumPartitions() == store.buckets and store.buckets % 4 == 0 and store.buckets >= 20
        got = {tuple(x) for x in merged.select(*store.columns).collect()}
    spark.sql("DROP TABLE railtide_test_runs")
    assert got == {tuple(x) for x in store.read().collect()} == {tuple(x) for x in m.first_of(df, ids, order, []).collect()}
    again = m.MessageStore(spark, f"{tmp_path}/store", ids, order)  # a store opened later keeps its buckets
    assert again.buckets == store.buckets and again.compact() == 3
    assert {tuple(x) for x in again.read().collect()} == got


def test_merge_tells_equal_hashes_apart():
    import pyarrow as pa

    one = pa.record_batch({"__hash": [1, 5, 5, 9], "id": ["a", "b", "c", None], "o": [3, None, 7, 1]}, schema=pa.schema([("__hash", pa.int64()), ("id", pa.string()), ("o", pa.int64())]))
    two = pa.record_batch({"__hash": [5, 5, 7, 9], "id": ["b", "c", "d", None], "o": [2**60, 2**60 + 1, 1, None]}, schema=one.schema)
    out = [r for b in m.merger(["id"], ["o"], [])(iter([one, two])) for r in b.to_pylist()]
    assert [(r["id"], r["o"]) for r in out] == [("a", 3), ("b", None), ("c", 7), ("d", 1), (None, None)]
    assert list(m.merger(["id"], ["o"], [])(iter([]))) == []
