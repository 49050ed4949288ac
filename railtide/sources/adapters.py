"""The star-schema test tables seen as a timetable: one SQL text per view, the same for Spark and DuckDB.

Suppliers are stops and nations their parent stations, orders are trips and line items their stop times; nations of one
region are linked by transfers, and the events table becomes a stream of delay events: each event stands at stop time
event_id % count + 1 in order of trip and sequence, so none is lost. The stop times are numbered within blocks of trips
whose ids begin alike, after the number of stop times in earlier blocks. Curly names stand for tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from railtide.session import broadcast_if_small, stored
from railtide.sources.gtfs import Timetable, build
from railtide.sources.tables import table

AGENCY = "ag"

VIEWS = {
    "g_stops": """SELECT concat('S', CAST(s_suppkey AS STRING)) AS stop_id, s_name AS stop_name, CAST(s_nationkey AS DOUBLE) AS stop_lat,
  CAST(0 AS DOUBLE) AS stop_lon, CAST(0 AS INT) AS location_type, concat('N', CAST(s_nationkey AS STRING)) AS parent_station FROM {supplier}
UNION ALL SELECT concat('N', CAST(n_nationkey AS STRING)), n_name, CAST(n_nationkey AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS INT), '' FROM {nation}""",
    "g_routes": """SELECT DISTINCT concat('R', substr(o_orderpriority, 1, 1)) AS route_id, substr(o_orderpriority, 1, 1) AS short_name,
  o_orderpriority AS long_name, '' AS color FROM {orders}""",
    "g_trips": """SELECT concat('W', o_orderstatus, '_', lpad(CAST(o_orderkey AS STRING), 9, '0'), '_R', substr(o_orderpriority, 1, 1), '..', CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'S' END) AS trip_id,
  concat('R', substr(o_orderpriority, 1, 1)) AS route_id, o_orderstatus AS service_id, CAST(o_orderkey % 2 AS INT) AS direction_id, o_orderkey FROM {orders}""",
    "g_stop_times": """SELECT t.trip_id, concat('S', CAST(l.s AS STRING)) AS stop_id, CAST(17980 + (l.l_orderkey * 7919) % 68400 + l.l_linenumber * 120 AS INT) AS arrival_secs,
  CAST(18000 + (l.l_orderkey * 7919) % 68400 + l.l_linenumber * 120 AS INT) AS departure_secs, CAST(l.l_linenumber AS INT) AS stop_sequence
FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l JOIN {g_trips} t ON t.o_orderkey = l.l_orderkey""",
    "g_transfers": """SELECT CASE WHEN (a.n_nationkey + b.n_nationkey) % 2 = 0 AND f.s IS NOT NULL THEN concat('S', CAST(f.s AS STRING)) ELSE concat('N', CAST(a.n_nationkey AS STRING)) END AS from_stop_id,
  concat('N', CAST(b.n_nationkey AS STRING)) AS to_stop_id, CAST(CASE WHEN (a.n_nationkey * b.n_nationkey) % 7 = 3 THEN 3 ELSE 2 END AS INT) AS transfer_type,
  CAST(60 * ((a.n_nationkey + b.n_nationkey) % 4) AS INT) AS min_transfer_time
FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s FROM {supplier} GROUP BY s_nationkey) f ON f.s_nationkey = a.n_nationkey""",
    "g_stop_rows": """SELECT s.trip_id, s.stop_id, s.departure_secs, b.before + row_number() OVER (PARTITION BY b.block ORDER BY s.trip_id, s.stop_sequence) AS n
FROM (SELECT block, CAST(sum(stops) OVER (ORDER BY block) - stops AS BIGINT) AS before FROM (SELECT substr(trip_id, 1, 9) AS block, count(*) AS stops FROM {g_stop_times} GROUP BY 1)) b
JOIN {g_stop_times} s ON substr(s.trip_id, 1, 9) = b.block""",
    "g_events": """SELECT e.event_id AS seq, 'ag' AS agency_id, t.trip_id, t.route_id, s.stop_id, CAST(floor(e.value * 3) - 120 AS INT) AS delay_seconds, e.at AS observed_at,
  e.at - e.at % 86400 + s.departure_secs AS scheduled_arrival, e.at - e.at % 86400 + s.departure_secs + CAST(floor(e.value * 3) - 120 AS BIGINT) AS predicted_arrival,
  CASE e.event_type WHEN 'click' THEN 'DEPARTURE_DELAY' WHEN 'signup' THEN 'SKIP_STOP' WHEN 'error' THEN 'TRIP_CANCELLED' ELSE 'ARRIVAL_DELAY' END AS type
FROM (SELECT event_id, value, event_type, CAST(floor({epoch}) AS BIGINT) AS at, event_id % (SELECT count(*) FROM {g_stop_times}) + 1 AS n FROM {events}) e
JOIN {g_stop_rows} s ON s.n = e.n JOIN {g_trips} t ON t.trip_id = s.trip_id""",
    "g_predictions": """SELECT seq, 'ag' AS agency_id, CASE WHEN seq % 3 = 0 THEN trip_id WHEN seq % 3 = 1 THEN substr(trip_id, 4) ELSE concat(trip_id, 'X') END AS trip_id,
  CASE WHEN seq % 2 = 0 THEN route_id ELSE '' END AS route_id, CASE WHEN seq % 5 = 0 THEN concat('N', CAST(seq % 25 AS STRING)) ELSE stop_id END AS stop_id,
  CAST(CASE WHEN seq % 4 = 3 THEN delay_seconds ELSE 0 END AS INT) AS delay_seconds, observed_at,
  CASE WHEN seq % 4 = 3 THEN scheduled_arrival ELSE 0 END AS scheduled_arrival, CASE WHEN seq % 13 = 0 THEN 0 ELSE predicted_arrival END AS predicted_arrival, type FROM {g_events}""",
}
BASE = ("supplier", "nation", "orders", "lineitem", "events")


def duckdb_with() -> str:
    """WITH clause that defines the views for DuckDB."""
    names = {**{b: b for b in BASE}, **{v: v for v in VIEWS}, "epoch": "epoch(ts)"}
    return "WITH " + ", ".join(f"{v} AS ({sql.format(**names)})" for v, sql in VIEWS.items())


class Adapter:
    """The views as DataFrames over one data folder, each planned when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made, self._timetable, self._kept = spark, folder, {}, None, set()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                self._made[name] = table(self.spark, self.folder, name)
                if name == "lineitem":  # placed once for its grouping and the join with its orders
                    self._made[name] = self._made[name].repartition("l_orderkey")
            else:
                sql = VIEWS[name]
                used = {n: self[n] for n in (*BASE, *VIEWS) if "{" + n + "}" in sql}
                self._made[name] = self.spark.sql(sql.replace("{epoch}", "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000"), **used)
                if name == "g_stops":
                    self._made[name] = broadcast_if_small(self._made[name])
        return self._made[name]

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A step that several parts of a query read, computed and written to the shared folder the first time."""
        if name not in self._made:
            self._made[name] = stored(make())
        return self._made[name]

    def keep(self, view: str) -> None:
        """Compute a view once; what is planned from here on, other views included, reads it from the shared folder."""
        if view not in self._kept:
            self._made[view] = stored(self[view])
            self._kept.add(view)

    def services(self) -> DataFrame:
        return self.spark.createDataFrame([("F",), ("O",)], "service_id string")

    def timetable(self) -> Timetable:
        if self._timetable is None:
            self._timetable = self._build()
        return self._timetable

    def _build(self) -> Timetable:
        return build(self["g_stops"], self["g_routes"], self["g_trips"].drop("o_orderkey"), self["g_stop_times"], self["g_transfers"], self.services())
