"""Static timetable from a folder of CSV files: tolerant scans, typed tables, the service day and its index."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railtide import schema
from railtide.functions.time import service_seconds
from railtide.session import stored
from railtide.sources import csvscan


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a CSV file (or a folder of files with the same header) as strings, found by trimmed header name.

    Quotes are taken leniently (see csvscan), short rows are padded with '', a byte-order mark is dropped, a column that
    the file doesn't have reads as ''. Repeated header rows are left out. A missing file is an error. ``_row`` orders the
    rows as they stand in their file.
    """
    rows = csvscan.records(spark, path)
    head = rows.where("split = 0").orderBy("file", "line_no").select(csvscan.fields("value").alias("f"), "value").first()
    names = [] if head is None else [c.strip() for c in head["f"]]
    at = {c: k for k, c in reversed(list(enumerate(names)))}
    if head is not None:
        rows = rows.where(F.col("value") != head["value"])
    rows = rows.withColumn("__f", csvscan.fields("value"))
    picked = [F.coalesce(F.get("__f", F.lit(at[c])), F.lit("")).alias(c) if c in at else F.lit("").alias(c) for c in columns]
    return rows.select(*picked, F.struct("file", "split", "line_no").alias("_row"))


def whole(c: str) -> Column:
    """A whole number, 0 where it can't be read."""
    return F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c)


def real(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)


def last_of(df: DataFrame, key: str) -> DataFrame:
    """Of rows with one id the last of the file stands."""
    w = Window.partitionBy(key).orderBy(F.desc("_row"))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_row")


def read_stops(spark: SparkSession, folder: str) -> DataFrame:
    d = scan(spark, f"{folder}/stops.txt", ["stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station"])
    return last_of(d.select("stop_id", "stop_name", real("stop_lat"), real("stop_lon"), whole("location_type"), "parent_station", "_row"), "stop_id")


def read_routes(spark: SparkSession, folder: str) -> DataFrame:
    d = scan(spark, f"{folder}/routes.txt", ["route_id", "route_short_name", "route_long_name", "route_color"])
    return last_of(d.toDF("route_id", "short_name", "long_name", "color", "_row"), "route_id")


def read_trips(spark: SparkSession, folder: str) -> DataFrame:
    d = scan(spark, f"{folder}/trips.txt", ["trip_id", "route_id", "service_id", "direction_id"])
    return last_of(d.select("trip_id", "route_id", "service_id", whole("direction_id"), "_row"), "trip_id")


def typed_stop_times(d: DataFrame) -> DataFrame:
    """Rows with a readable arrival; an unreadable departure takes the arrival."""
    arrival = service_seconds("arrival_time")
    return d.where(arrival.isNotNull()).select(
        "trip_id", "stop_id", arrival.alias("arrival_secs"), F.coalesce(service_seconds("departure_time"), arrival).alias("departure_secs"),
        whole("stop_sequence"))


def read_stop_times(spark: SparkSession, folder: str) -> DataFrame:
    return typed_stop_times(scan(spark, f"{folder}/stop_times.txt", ["trip_id", "stop_id", "arrival_time", "departure_time", "stop_sequence"]))


def read_transfers(spark: SparkSession, folder: str) -> DataFrame:
    d = scan(spark, f"{folder}/transfers.txt", ["from_stop_id", "to_stop_id", "transfer_type", "min_transfer_time"])
    return d.select("from_stop_id", "to_stop_id", whole("transfer_type"), whole("min_transfer_time"))


def read_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, f"{folder}/calendar.txt", ["service_id", *schema.DAYS, "start_date", "end_date"]).drop("_row")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_calendar_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Exceptions in file order; none where there is no such file."""
    path = f"{folder}/calendar_dates.txt"
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema.CALENDAR_DATES}, _row struct<file: string, split: long, line_no: long>")
    return scan(spark, path, ["service_id", "date", "exception_type"])


def agency_timezone(spark: SparkSession, folder: str) -> str:
    """Time zone of the first agency row; '' where file or column is missing."""
    path = f"{folder}/agency.txt"
    if not exists(spark, path):
        return ""
    row = scan(spark, path, ["agency_timezone"]).orderBy("_row").first()
    return row["agency_timezone"].strip() if row else ""


def valid_timezone(name: str, fallback: str = "UTC") -> str:
    import zoneinfo

    try:
        return zoneinfo.ZoneInfo(name).key if name else fallback
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        return fallback


def active_services(calendar: DataFrame, day: dt.date, exceptions: DataFrame | None = None) -> DataFrame:
    """service_id of the services that run on a day: by period and weekday, then exceptions added (1) or removed (2).

    Of several exceptions of a service on the day the last in file order (``_row``) stands.
    """
    text, weekday = day.strftime("%Y%m%d"), schema.DAYS[day.weekday()]
    base = calendar.where((F.col("start_date") <= text) & (F.col("end_date") >= text) & (F.col(weekday) == "1")).select("service_id").distinct()
    if exceptions is None:
        return base
    last = exceptions.where((F.col("date") == text) & F.col("exception_type").isin("1", "2")).groupBy("service_id").agg(F.max_by("exception_type", "_row").alias("kind"))
    added = last.where("kind = '1'").select("service_id")
    return base.unionByName(added).distinct().join(last.where("kind = '2'"), "service_id", "left_anti")


@dataclass
class Timetable:
    """The tables of one service day. ``departures`` is the index that every lookup works on."""

    stops: DataFrame
    routes: DataFrame
    trips: DataFrame
    transfers: DataFrame
    departures: DataFrame
    tz: str = "UTC"
    made: dict[str, DataFrame] = field(default_factory=dict, compare=False)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What several look-ups derive from the timetable, worked out the first time."""
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]


def stations(stops: DataFrame) -> DataFrame:
    """(stop_id, station): the parent station, or the stop itself where it has none."""
    return stops.select("stop_id", F.when(F.coalesce(F.col("parent_station"), F.lit("")) == "", F.col("stop_id")).otherwise(F.col("parent_station")).alias("station"))


def with_station(df: DataFrame, stops: DataFrame, stop: str = "stop_id", out: str = "station") -> DataFrame:
    """df with the parent station of a stop column; unknown stops stand for themselves."""
    s = stations(stops).select(F.col("stop_id").alias("__of"), F.col("station").alias("__up"))
    return df.join(s, F.col(stop) == F.col("__of"), "left").withColumn(out, F.coalesce("__up", F.col(stop))).drop("__of", "__up")


def departures(stop_times: DataFrame, active_trips: DataFrame, stops: DataFrame) -> DataFrame:
    """Active stop_times with route, direction and parent station."""
    t = active_trips.select("trip_id", "route_id", "direction_id")
    return with_station(stop_times.join(t, "trip_id"), stops)


def normalized_transfers(transfers: DataFrame, stops: DataFrame) -> DataFrame:
    """(from_station, to_station, transfer_type, min_transfer_time) without impossible transfers (type 3); repeats are kept."""
    possible = transfers.where("transfer_type <> 3")
    ends = with_station(with_station(possible, stops, "from_stop_id", "from_station"), stops, "to_stop_id", "to_station")
    return ends.select("from_station", "to_station", "transfer_type", "min_transfer_time")


def build(stops: DataFrame, routes: DataFrame, trips: DataFrame, stop_times: DataFrame, transfers: DataFrame, services: DataFrame, tz: str = "UTC",
          materialize: bool = True) -> Timetable:
    """The service day's timetable. The departures, which lookups use again and again, are written to the shared folder once."""
    active = trips.join(services, "service_id", "left_semi")
    keep = stored if materialize else (lambda df: df)
    return Timetable(stops, routes, trips, normalized_transfers(transfers, stops), keep(departures(stop_times, active, stops)), tz)


def load(spark: SparkSession, folder: str, day: dt.date) -> Timetable:
    """The timetable of a day from a folder of CSV files; all but calendar_dates and agency must exist."""
    services = active_services(read_calendar(spark, folder), day, read_calendar_dates(spark, folder))
    return build(read_stops(spark, folder), read_routes(spark, folder), read_trips(spark, folder), read_stop_times(spark, folder),
                 read_transfers(spark, folder), services, valid_timezone(agency_timezone(spark, folder)))
