"""Registered queries pN_ of the core operators, and the same results as plain DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtide.functions import sqltext as q
from railtide.functions.ids import clean
from railtide.operators import bitemporal, messages, panes, rejects, snapshots, spikes
from railtide.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, folder, "delay_events"), table(spark, folder, "delay_state"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_changes(
        table(spark, folder, "delay_snapshots"), "feed_id", "snapshot_no",
        [("trip_id", clean("trip_id")), ("stop_id", clean("stop_id"))], ["delay_seconds", "predicted_arrival"])


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.parse_records(table(spark, folder, "raw_lines"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejects(_parsed(spark, folder))


def p4_stop_times(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.stop_times_of(_parsed(spark, folder))


def p4_stops(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.stops_of(_parsed(spark, folder))


def p5_known(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivery with the service and calendar period known and valid at its observed_at."""
    known = bitemporal.events_as_known(*(table(spark, folder, t) for t in ("delay_events", "trips", "calendar")))
    return known.select("delivery_id", "service_id", "start_date")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    known = bitemporal.events_as_known(*(table(spark, folder, t) for t in ("delay_events", "trips", "calendar")))
    differs = (F.col("service_id") != F.col("now_service_id")) | (F.col("start_date") != F.col("now_start_date"))
    return known.where(differs).select("delivery_id", "service_id", "start_date")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return messages.repeated_deliveries(table(spark, folder, "delay_events"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return panes.corrected_cases(table(spark, folder, "delay_events"), table(spark, folder, "pending_predictions"))


def p7_route_hours(spark: SparkSession, folder: str) -> DataFrame:
    return panes.route_hours(table(spark, folder, "delay_events"))


def p7_observed_max(spark: SparkSession, folder: str) -> DataFrame:
    records = panes.first_records(table(spark, folder, "delay_events"))
    return panes.observed_maxima(records, table(spark, folder, "pending_predictions"))


QUERIES = {f.__name__: f for f in (
    p1_found, p3_found, p4_found, p4_stop_times, p4_stops, p5_found, p5_known, p6_found, p7_found, p7_route_hours, p7_observed_max)}

_MSG = f"SELECT *, {q.clean('trip_id')} AS t, {q.clean('stop_id')} AS s, {q.clean('agency_id')} AS a, {q.route()} AS r FROM delay_events"
_FIRST = f"""SELECT *, {q.MEASUREMENT} AS measured, received_at > (observed_at // 3600 + 1) * 3600 + 7200 AS late
  FROM (SELECT *, row_number() OVER (PARTITION BY t, s, observed_at ORDER BY received_at, delivery_id) AS rn FROM ({_MSG})) WHERE rn = 1"""
_WINDOWS = f"""SELECT DISTINCT id, {q.clean('agency_id')} AS a, {q.clean('route_id')} AS r, {q.clean('station_id')} AS s, created_at, expires_at, baseline_secs
  FROM pending_predictions WHERE expires_at <> 0"""
_MAXIMA = f"""SELECT w.id, max(greatest(0, coalesce(CASE WHEN f.received_at <= w.expires_at THEN f.delay_seconds::BIGINT - w.baseline_secs END, 0))) AS observed_first,
  max(greatest(0, coalesce(f.delay_seconds::BIGINT - w.baseline_secs, 0))) AS observed_final
  FROM ({_WINDOWS}) w LEFT JOIN (SELECT * FROM ({_FIRST}) WHERE measured AND NOT late) f
  ON f.a = w.a AND f.r = w.r AND f.s = w.s AND f.observed_at BETWEEN w.created_at AND w.expires_at GROUP BY w.id"""

_FENCE = """SELECT table_name, row_id FROM (SELECT *, quantile_cont(x, 0.25) OVER (PARTITION BY table_name, a, r) AS q1,
  quantile_cont(x, 0.75) OVER (PARTITION BY table_name, a, r) AS q3 FROM readings)
  WHERE abs(x) >= 43200 OR x > q3 + 6 * (q3 - q1) OR x < q1 - 6 * (q3 - q1)"""
P1 = f"""WITH readings AS (
  SELECT 'delay_events' AS table_name, delivery_id AS row_id, a, r, delay_seconds::BIGINT AS x FROM ({_MSG}) WHERE {q.MEASUREMENT}
  UNION ALL SELECT 'delay_state', state_id, {q.clean('agency_id')}, {q.route()}, delay_seconds::BIGINT FROM delay_state WHERE delay_seconds IS NOT NULL),
msgs AS (SELECT t, s, observed_at, delay_seconds AS x FROM ({_FIRST}) WHERE measured),
marked AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY t ORDER BY observed_at, s) THEN 0 ELSE 1 END AS st FROM msgs),
runs AS (SELECT *, sum(st) OVER (PARTITION BY t ORDER BY observed_at, s) AS run FROM marked),
frozen AS (SELECT *, count(*) OVER (PARTITION BY t, run) AS n FROM runs)
SELECT DISTINCT table_name, row_id, 'delay_seconds' AS field FROM ({_FENCE})
UNION SELECT 'delay_events', delivery_id, 'delay_seconds' FROM ({_MSG}) m JOIN frozen f ON m.t = f.t AND m.s = f.s AND m.observed_at = f.observed_at
  WHERE f.n >= 8 AND f.x <> 0
UNION SELECT 'delay_state', state_id, 'confidence' FROM delay_state WHERE confidence IS NOT NULL AND NOT (confidence >= 0.5 AND confidence <= 1.0 AND NOT isnan(confidence))"""

P3 = f"""WITH r AS (SELECT DISTINCT feed_id AS f, snapshot_no AS n, {q.clean('trip_id')} AS t, {q.clean('stop_id')} AS s, delay_seconds AS d, predicted_arrival AS p FROM delay_snapshots),
pairs AS (SELECT f, n, lag(n) OVER (PARTITION BY f ORDER BY n) AS b FROM (SELECT DISTINCT f, n FROM r)),
cur AS (SELECT r.*, pairs.b FROM r JOIN pairs USING (f, n) WHERE b IS NOT NULL),
old AS (SELECT r.f, r.t, r.s, r.d, r.p, pairs.n FROM r JOIN pairs ON r.f = pairs.f AND r.n = pairs.b)
SELECT coalesce(cur.f, old.f) AS feed_id, coalesce(cur.n, old.n) AS snapshot_no, coalesce(cur.t, old.t) AS trip_id, coalesce(cur.s, old.s) AS stop_id,
  CASE WHEN old.f IS NULL THEN 'added' WHEN cur.f IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur FULL JOIN old ON cur.f = old.f AND cur.n = old.n AND cur.t = old.t AND cur.s = old.s
WHERE old.f IS NULL OR cur.f IS NULL OR cur.d IS DISTINCT FROM old.d OR cur.p IS DISTINCT FROM old.p"""

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_BODY = "regexp_replace(regexp_replace(line, '^﻿', ''), '\\r$', '')"
_RECORDS = f"""SELECT line_id, file_name, {_BODY} AS body, regexp_full_match({_BODY}, '{_FIELD}(?:,{_FIELD})*') AS whole FROM raw_lines"""
# inner doubled quotes become U+0001 before the outer ones go; commas of quoted fields are kept out of the split as U+0002
_SPLIT = f"""SELECT line_id, file_name, whole, CASE WHEN whole THEN
  [CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN regexp_extract_all(',' || body, ',({_FIELD})', 1)] END AS f FROM ({_RECORDS})"""


def _trim(x: str) -> str:
    return q.clean(x)


_TIME_OK = "regexp_full_match({0}, '([0-9]|[0-3][0-9]|4[0-7]):[0-5][0-9]:[0-5][0-9]')"
_REASONED = f"""SELECT *, CASE WHEN NOT whole THEN 'quoting'
  WHEN len(f) <> (CASE WHEN file_name = 'stops.txt' THEN 6 ELSE 5 END) THEN 'column_count'
  WHEN file_name = 'stops.txt' THEN CASE WHEN regexp_full_match({_trim('f[3]')}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)') AND abs(try_cast({_trim('f[3]')} AS DOUBLE)) <= 90 THEN NULL ELSE 'invalid_value' END
  WHEN {_TIME_OK.format(_trim('f[2]'))} AND regexp_full_match({_trim('f[5]')}, '[0-9]+') THEN NULL ELSE 'invalid_value' END AS reason FROM ({_SPLIT})"""
_SECS = "(try_cast(split_part({0}, ':', 1) AS INT) * 3600 + try_cast(split_part({0}, ':', 2) AS INT) * 60 + try_cast(split_part({0}, ':', 3) AS INT))"
_ARR, _DEP = _SECS.format(_trim("f[2]")), _SECS.format(_trim("f[3]"))

_KNOWN = f"""SELECT e.delivery_id, coalesce(e.service_id, '') AS service_id, coalesce(c.start_date, '') AS start_date, e.t, e.day
FROM (SELECT m.*, v.service_id, strftime(to_timestamp(m.observed_at) AT TIME ZONE 'UTC', '%Y%m%d') AS day FROM ({_MSG}) m
  ASOF LEFT JOIN (SELECT DISTINCT {q.clean('trip_id')} AS t, service_id, published_at FROM trips) v ON m.t = v.t AND m.observed_at >= v.published_at) e
LEFT JOIN LATERAL (SELECT start_date FROM calendar c WHERE c.service_id = e.service_id AND c.published_at <= e.observed_at
  AND e.day BETWEEN c.start_date AND c.end_date ORDER BY published_at DESC, start_date DESC LIMIT 1) c ON TRUE"""
_NOW = f"""SELECT d.t, d.day, coalesce(d.service_id, '') AS service_id, coalesce(c.start_date, '') AS start_date
FROM (SELECT x.t, x.day, v.service_id FROM (SELECT DISTINCT t, day FROM k) x
  LEFT JOIN (SELECT {q.clean('trip_id')} AS t, arg_max(service_id, published_at) AS service_id FROM trips GROUP BY 1) v USING (t)) d
LEFT JOIN LATERAL (SELECT start_date FROM calendar c WHERE c.service_id = d.service_id AND d.day BETWEEN c.start_date AND c.end_date
  ORDER BY published_at DESC, start_date DESC LIMIT 1) c ON TRUE"""

ORACLE = {
    "p1_found": P1,
    "p3_found": P3,
    "p4_found": f"SELECT line_id, reason FROM ({_REASONED}) WHERE reason IS NOT NULL",
    "p4_stop_times": f"""SELECT line_id, {_trim('f[1]')} AS trip_id, {_ARR}::INT AS arrival_secs, coalesce({_DEP}, {_ARR})::INT AS departure_secs,
  {_trim('f[4]')} AS stop_id, {_trim('f[5]')}::BIGINT AS stop_sequence FROM ({_REASONED}) WHERE reason IS NULL AND file_name = 'stop_times.txt'""",
    "p4_stops": f"""SELECT line_id, {_trim('f[1]')} AS stop_id, f[2] AS stop_name, {_trim('f[3]')}::DOUBLE AS stop_lat,
  coalesce(try_cast({_trim('f[4]')} AS DOUBLE), 0) AS stop_lon, coalesce(try_cast({_trim('f[5]')} AS INT), 0)::INT AS location_type,
  {_trim('f[6]')} AS parent_station FROM ({_REASONED}) WHERE reason IS NULL AND file_name = 'stops.txt'""",
    "p5_known": f"SELECT delivery_id, service_id, start_date FROM ({_KNOWN})",
    "p5_found": f"""WITH k AS ({_KNOWN}), n AS ({_NOW}) SELECT k.delivery_id, k.service_id, k.start_date FROM k JOIN n ON k.t = n.t AND k.day = n.day
  WHERE k.service_id <> n.service_id OR k.start_date <> n.start_date""",
    "p6_found": f"SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY t, s, observed_at ORDER BY received_at, delivery_id) AS rn FROM ({_MSG})) WHERE rn > 1",
    "p7_found": f"""SELECT 'event' AS case_kind, delivery_id::VARCHAR AS case_id FROM ({_FIRST}) WHERE late
  UNION ALL SELECT 'prediction', id FROM ({_MAXIMA}) WHERE observed_final > observed_first""",
    "p7_route_hours": f"""SELECT a AS agency_id, r AS route, observed_at // 3600 AS hour, count(*) FILTER (NOT late) AS n,
  sum(delay_seconds) FILTER (NOT late)::BIGINT AS total, min(delay_seconds) FILTER (NOT late) AS low, max(delay_seconds) FILTER (NOT late) AS high,
  count(*) FILTER (NOT late AND received_at < (observed_at // 3600 + 1) * 3600) AS n_first, count(*) FILTER (late) AS n_late
  FROM ({_FIRST}) WHERE measured GROUP BY 1, 2, 3""",
    "p7_observed_max": f"SELECT * FROM ({_MAXIMA})",
}
