"""Event-time aggregates corrected by late records: stream slicing into panes at window-boundary granularity.

Panes are the non-overlapping slices between the boundaries of all windows of a key; hours cut panes too, so a busy key
spreads over its hours. An event changes exactly one pane. A pane keeps its count, sum, minimum and maximum and, as
revisions, the points in arrival order at which its maximum rose, so that what a window showed at any time can be
composed from its panes. A window is recomposed only from the panes it covers; with the cut-off for lateness, events
that come too late change nothing and are reported apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railtide.functions.ids import clean, is_measurement, route
from railtide.operators.messages import first_of

HOUR = 3600
LATENESS = 7200


def cut_off(at: str | Column, lateness: int = LATENESS) -> Column:
    """The last second at which a record of that time still counts: end of its hour plus the lateness allowed."""
    at = F.col(at) if isinstance(at, str) else at
    return (F.floor(at / HOUR) + 1) * HOUR + F.lit(lateness)


def first_records(events: DataFrame) -> DataFrame:
    """Each message's first delivery with key columns, ``late`` (came after the cut-off) and ``measured``."""
    rows = events.select(
        clean("trip_id").alias("trip_id"), clean("stop_id").alias("stop_id"), "observed_at", "received_at", "delivery_id",
        clean("agency_id").alias("agency_id"), route().alias("route"), "delay_seconds", is_measurement().alias("measured"))
    first = first_of(rows, ["trip_id", "stop_id", "observed_at"], ["received_at", "delivery_id"], ["agency_id", "route", "delay_seconds", "measured"])
    return first.withColumn("late", F.coalesce(F.col("received_at") > cut_off("observed_at"), F.lit(False)))


def pane_points(records: DataFrame, windows: DataFrame) -> DataFrame:
    """Measured on-time records with the start of the pane they fall in.

    ``windows`` has agency_id, route, stop_id, from_at, to_at (inclusive). Records with a null time have no pane.
    """
    key = ["agency_id", "route", "stop_id", "hour"]
    # an unset stop reads as '', so that no condition on it reaches below the records, whose shuffle others may share
    ev = records.where("measured and not late and observed_at is not null").select(
        "agency_id", "route", F.coalesce("stop_id", F.lit("")).alias("stop_id"), F.coalesce(F.floor(F.col("observed_at") / HOUR), F.lit(0)).alias("hour"), F.col("observed_at").alias("t"),
        F.lit(1).alias("kind"), "delay_seconds", "received_at", "delivery_id")
    bounds = windows.select("agency_id", "route", "stop_id", F.explode(F.array(F.col("from_at"), F.col("to_at") + 1)).alias("t")).distinct()
    bounds = bounds.select("agency_id", "route", "stop_id", F.floor(F.col("t") / HOUR).alias("hour"), "t", F.lit(0).alias("kind"))
    w = Window.partitionBy(*key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ev.unionByName(bounds, allowMissingColumns=True)
        .withColumn("pane", F.coalesce(F.last(F.when(F.col("kind") == 0, F.col("t")), ignorenulls=True).over(w), F.col("hour") * HOUR))
        .where("kind = 1").drop("kind")
    )


def panes(points: DataFrame) -> DataFrame:
    """One row per pane: n, total, low, high and the revisions (received_at, high) at which its maximum rose."""
    key = ["agency_id", "route", "stop_id", "hour", "pane"]
    seen = Window.partitionBy(*key).orderBy("received_at", "delivery_id")
    before = F.max("delay_seconds").over(seen.rowsBetween(Window.unboundedPreceding, -1))
    rose = before.isNull() | (F.col("delay_seconds") > before)
    return (
        points.withColumn("rose", rose).groupBy(*key).agg(
            F.count("*").alias("n"), F.sum(F.col("delay_seconds").cast("long")).alias("total"), F.min("delay_seconds").alias("low"),
            F.max("delay_seconds").alias("high"),
            F.collect_list(F.when(F.col("rose"), F.struct("received_at", F.col("delay_seconds").alias("high")))).alias("revisions"))
    )


def window_maxima(pane_table: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window id: ``high`` over its panes and ``high_first``, what it was when the window closed (to_at)."""
    w = windows.withColumn("hour", F.explode(F.sequence(F.floor(F.col("from_at") / HOUR), F.floor(F.col("to_at") / HOUR))))
    in_time = F.array_max(F.transform("revisions", lambda r: F.when(r["received_at"] <= F.col("to_at"), r["high"])))
    hit = w.join(pane_table.select("agency_id", "route", "stop_id", "hour", "pane", "high", "revisions"), ["agency_id", "route", "stop_id", "hour"])
    hit = hit.where((F.col("pane") >= F.col("from_at")) & (F.col("pane") <= F.col("to_at")))
    return hit.groupBy("id").agg(F.max("high").alias("high"), F.max(in_time).alias("high_first"))


def prediction_windows(predictions: DataFrame) -> DataFrame:
    """Distinct predictions with an end; the window [created_at, expires_at] of agency, route and station."""
    return predictions.where("expires_at <> 0 and created_at is not null and expires_at >= created_at").select(
        "id", clean("agency_id").alias("agency_id"), clean("route_id").alias("route"), clean("station_id").alias("stop_id"),
        F.col("created_at").alias("from_at"), F.col("expires_at").alias("to_at"), "baseline_secs").distinct()


def observed_maxima(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, observed_first, observed_final) of every prediction with an end: largest of 0 and delay - baseline.

    observed_first counts what had been received by expires_at, observed_final also what came later but before its
    cut-off. A null baseline gives 0. Repeated predictions come out once.
    """
    windows = prediction_windows(predictions)
    m = window_maxima(panes(pane_points(records, windows)), windows)
    over = lambda x: F.greatest(F.lit(0), F.coalesce(F.col(x).cast("long") - F.col("baseline_secs"), F.lit(0))).alias
    return windows.select("id", "baseline_secs").join(m, "id", "left").select("id", over("high_first")("observed_first"), over("high")("observed_final"))


def route_hours(events: DataFrame) -> DataFrame:
    """Delays per agency, route and hour of observed_at, corrected for records received up to the cut-off.

    n, total, low and high are final; n_first is the count when the hour ended, so n > n_first tells a corrected hour;
    n_late counts records that came too late and are in none of the others. Hours with late records only have n = 0.
    """
    r = first_records(events).where("measured and observed_at is not null")
    hour = F.floor(F.col("observed_at") / HOUR)
    ok = ~F.col("late")
    x = F.when(ok, F.col("delay_seconds"))
    return r.groupBy("agency_id", "route", hour.alias("hour")).agg(
        F.count(x).alias("n"), F.sum(x.cast("long")).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.count(F.when(ok & (F.col("received_at") < (hour + 1) * HOUR), 1)).alias("n_first"), F.count(F.when(F.col("late"), 1)).alias("n_late"))


def corrected_cases(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """(case_kind, case_id): records that came too late, and predictions whose maximum was corrected."""
    # the same condition on both uses lets them share one shuffle; without a time a record is neither late nor in a pane
    records = first_records(events).where("observed_at is not null")
    late = records.where("late").select(F.lit("event").alias("case_kind"), F.col("delivery_id").cast("string").alias("case_id"))
    moved = observed_maxima(records, predictions).where("observed_final > observed_first")
    return late.unionByName(moved.select(F.lit("prediction").alias("case_kind"), F.col("id").alias("case_id")))
