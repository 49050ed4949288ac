"""Grids of rectangles beyond their bound aren't sent to every executor through the driver."""

from pyspark.sql import functions as F

from railtide.operators import bitemporal


def test_a_large_grid_is_not_broadcast(spark):
    n = 150_000  # about 14 MB of values: below the general bound, above that of grids
    rects = spark.range(n).select(F.concat(F.lit("trip"), "id").alias("entity"), F.lit(0).alias("v0"), F.lit(1).alias("v1"), F.lit(10).cast("long").alias("k0"),
                                  F.lit(20).cast("long").alias("k1"), F.concat(F.lit("service"), F.col("id") % 7).alias("a"))
    e = spark.createDataFrame([("trip0", 10), ("trip8", 19), ("trip8", 20), ("none", 15), (f"trip{n - 1}", 15)], "entity string, at long")
    plan = lambda r: bitemporal.locate(e, r, "entity", "at", ["a"])
    of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    large = plan(rects)
    assert "broadcast" not in of(large) and "broadcast" in of(plan(rects.limit(100)))
    want = {("trip0", 10, "service0"), ("trip8", 19, "service1"), ("trip8", 20, None), ("none", 15, None), (f"trip{n - 1}", 15, f"service{(n - 1) % 7}")}
    assert set(map(tuple, large.collect())) == want
