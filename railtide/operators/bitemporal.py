"""Attributes as known at event time: disjoint bitemporal rectangles, a grid over them, and point location.

A version row says that ``attributes`` hold on the valid days [valid_from, valid_to] and has been known since
``known_from``. Per entity the plane of valid day x recorded second is split into disjoint rectangles, in each of which
one version is current: the newest one known that covers the day. Every rectangle is indexed by the grid cells it
touches and an event is located through its one cell, so the join is on (entity, cell) and the residual condition keeps
at most one rectangle. Nothing known after the event can match, since its recorded time starts later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railtide.functions.ids import clean
from railtide.session import broadcast_if_small, cut

FOREVER = 1 << 62
DAY = 86_400
#: Grid cells: valid days and recorded seconds per cell.
VALID_CELL = 32
KNOWN_CELL = 14 * DAY
#: A grid is broadcast up to this many bytes of values: a look-up of events takes four, and the driver holds each of them as
#: rows, as a hash table and in blocks.
GRID_BYTES = 8 << 20


def rectangles(versions: DataFrame, entity: str, known_from: str, attributes: list[str],
               valid_from: str | None = None, valid_to: str | None = None) -> DataFrame:
    """(entity, v0, v1, k0, k1, attributes): disjoint regions [v0, v1) x [k0, k1), one current version in each.

    Valid bounds are whole day numbers, both inclusive; without them a version holds on all days. Rows repeated
    exactly count once. Rows with a null entity, known_from or bound, or with valid_to before valid_from, never hold.
    Versions of one entity that begin at the same second and overlap: the one with the greatest attributes is current.
    Empty input gives no rectangles.
    """
    rows = versions.select(F.col(entity).alias("entity"), F.col(known_from).cast("long").alias("k0"), F.struct(*attributes).alias("attr"),
                           *([F.col(valid_from).cast("int").alias("lo"), (F.col(valid_to).cast("int") + 1).alias("hi")] if valid_from else
                             [F.lit(0).alias("lo"), F.lit(1).alias("hi")]))
    rows = rows.where("entity is not null and k0 is not null and lo is not null and hi > lo").distinct()
    if valid_from:
        # elementary valid intervals between the bounds of an entity's versions
        by = Window.partitionBy("entity").orderBy("v0")
        cuts = rows.select("entity", F.explode(F.array("lo", "hi")).alias("v0")).distinct()
        strips = cuts.withColumn("v1", F.lead("v0").over(by)).where("v1 is not null")
        held = strips.join(rows, (strips.entity == rows.entity) & (rows.lo <= strips.v0) & (rows.hi >= strips.v1)).select(strips.entity, "v0", "v1", "k0", "attr")
    else:
        held = rows.select("entity", F.lit(0).alias("v0"), F.lit(1).alias("v1"), "k0", "attr")
    # one version per second: of equal times the greatest
    held = held.groupBy("entity", "v0", "v1", "k0").agg(F.max("attr").alias("attr"))
    order = Window.partitionBy("entity", "v0").orderBy("k0")
    new = held.withColumn("prev", F.lag("attr").over(order)).where(~F.col("attr").eqNullSafe(F.col("prev")))
    out = new.withColumn("k1", F.coalesce(F.lead("k0").over(order), F.lit(FOREVER)))
    # strips that lie side by side with the same version over the same recorded span become one rectangle
    side = Window.partitionBy("entity", "k0", "k1", "attr").orderBy("v0")
    out = out.withColumn("gap", F.when(F.lag("v1").over(side).eqNullSafe(F.col("v0")), 0).otherwise(1)).withColumn("g", F.sum("gap").over(side))
    out = out.groupBy("entity", "k0", "k1", "attr", "g").agg(F.min("v0").alias("v0"), F.max("v1").alias("v1"))
    return out.select("entity", "v0", "v1", "k0", "k1", "attr.*")


def span_of(events: DataFrame, known_at: str, valid_day: str | None = None) -> tuple[int, int, int, int]:
    """Smallest and largest recorded second and valid day of the events; zeros where there are none."""
    day = F.col(valid_day) if valid_day else F.lit(0)
    row = events.agg(F.min(known_at), F.max(known_at), F.min(day), F.max(day)).first()
    return tuple(0 if x is None else int(x) for x in row)


def locate(events: DataFrame, rects: DataFrame, entity: str, known_at: str, attributes: list[str], valid_day: str | None = None,
           span: tuple[int, int, int, int] | None = None, valid_cell: int = VALID_CELL, known_cell: int = KNOWN_CELL) -> DataFrame:
    """events with the attributes of the rectangle that holds (valid_day, known_at); null where none does.

    Every event comes out once, with all its columns. Events with a null entity, time or day get nulls. Rectangles are
    indexed only where the span of the events and that of the rectangles' own bounds meet: beyond the last bound nothing
    changes, so events out there look into the last cell, and neither an open end nor an event with a wild time costs
    cells. Pass ``span`` of the events where it is known. A grid proven small is broadcast; otherwise both sides are
    placed by (entity, cell) and adaptive execution splits skewed cells.
    """
    first_k, last_k, lo_v, hi_v = span or span_of(events, known_at, valid_day)
    low_k, high_k, low_v, high_v = (0 if x is None else int(x) for x in rects.agg(F.min("k0"), F.max("k0"), F.min("v0"), F.max("v1") - 1).first())
    last_k, hi_v = min(last_k, high_k), min(hi_v, high_v)
    first_k, lo_v = min(max(first_k, low_k), last_k), min(max(lo_v, low_v), hi_v)
    span = {"a": first_k, "b": last_k}
    within = lambda c, first, last: F.least(F.greatest(F.col(c), F.lit(first)), F.lit(last))
    cells = lambda low, high, size, first, last: F.sequence(
        F.floor(F.greatest(low, F.lit(first)) / size), F.floor(F.least(high - 1, F.lit(last)) / size))
    grid = rects.where((F.col("k0") <= span["b"]) & (F.col("k1") > span["a"]))
    if valid_day:
        grid = grid.where((F.col("v0") <= hi_v) & (F.col("v1") > lo_v)).withColumn("vc", F.explode(cells(F.col("v0"), F.col("v1"), valid_cell, lo_v, hi_v)))
    else:
        grid = grid.withColumn("vc", F.lit(0).cast("long"))
    grid = grid.withColumn("kc", F.explode(cells(F.col("k0"), F.col("k1"), known_cell, span["a"], span["b"])))
    grid = grid.select(*(F.col(c).alias(f"__{c}") for c in ("entity", "vc", "kc", "v0", "v1", "k0", "k1")), F.struct(*attributes).alias("__a"))
    grid = broadcast_if_small(grid, GRID_BYTES)
    e = events.withColumn("__vcell", F.floor(F.when(F.col(valid_day).isNotNull(), within(valid_day, lo_v, hi_v)) / valid_cell) if valid_day else F.lit(0).cast("long"))
    e = e.withColumn("__kcell", F.floor(F.when(F.col(known_at).isNotNull(), within(known_at, first_k, last_k)) / known_cell))
    on = (F.col(entity) == F.col("__entity")) & (F.col("__vcell") == F.col("__vc")) & (F.col("__kcell") == F.col("__kc"))
    on &= (F.col(known_at) >= F.col("__k0")) & (F.col(known_at) < F.col("__k1"))
    if valid_day:
        on &= (F.col(valid_day) >= F.col("__v0")) & (F.col(valid_day) < F.col("__v1"))
    out = e.join(grid, on, "left")
    return out.select(*(F.col(c) for c in events.columns), *(F.col(f"__a.{a}").alias(a) for a in attributes))


def day_number(text) -> object:
    """Days since 1970 of a YYYYMMDD string; null where it is no date."""
    return F.unix_date(F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def events_as_known(events: DataFrame, trips: DataFrame, calendar: DataFrame) -> DataFrame:
    """delivery_id with the service and calendar start as known at observed_at and as all rows say now.

    Columns service_id, start_date, now_service_id, now_start_date; '' where nothing holds. Times of day are UTC.
    """
    t = trips.select(clean("trip_id").alias("trip"), clean("service_id").alias("service_id"), "published_at")
    c = calendar.select(
        clean("service_id").alias("service"), F.col("start_date"), day_number(F.col("start_date")).alias("d0"),
        day_number(F.col("end_date")).alias("d1"), "published_at")
    e = events.select("delivery_id", clean("trip_id").alias("trip"), F.col("observed_at").alias("at"))
    e = e.withColumn("day", F.floor(F.col("at") / DAY).cast("int"))
    e = e.withColumn("later", F.lit(FOREVER - 1))
    trip_rects = cut(rectangles(t, "trip", "published_at", ["service_id"]))
    day_rects = cut(rectangles(c, "service", "published_at", ["start_date"], "d0", "d1"))
    a, b, d0, d1 = span_of(e, "at", "day")
    then, now = (a, b, d0, d1), (FOREVER - 1, FOREVER - 1, d0, d1)
    out = locate(e, trip_rects, "trip", "at", ["service_id"], span=then)
    out = locate(out, day_rects, "service_id", "at", ["start_date"], "day", then)
    last = lambda r, x: r.withColumnRenamed(x, f"now_{x}")
    out = locate(out, last(trip_rects, "service_id"), "trip", "later", ["now_service_id"], span=now)
    out = locate(out, last(day_rects, "start_date"), "now_service_id", "later", ["now_start_date"], "day", now)
    said = lambda x: F.coalesce(F.col(x), F.lit("")).alias(x)
    return out.select("delivery_id", *(said(x) for x in ("service_id", "start_date", "now_service_id", "now_start_date")))
