"""The transit queries as DuckDB SQL."""

from __future__ import annotations

from railtide.functions import sqltext as q
from railtide.plans.transit import NOW_NS, ODD_NAME
from railtide.sources.adapters import duckdb_with

_STATION = "coalesce(nullif(p.parent_station, ''), {0})"
_VIEWS = duckdb_with() + """,
st AS (SELECT stop_id, CASE WHEN parent_station = '' THEN stop_id ELSE parent_station END AS station FROM g_stops),
dep AS (SELECT s.trip_id, s.stop_id, s.arrival_secs, s.departure_secs, s.stop_sequence, t.route_id, t.direction_id, coalesce(st.station, s.stop_id) AS station
  FROM g_stop_times s JOIN g_trips t USING (trip_id) LEFT JOIN st USING (stop_id) WHERE t.service_id IN ('F', 'O')),
tr AS (SELECT coalesce(a.station, from_stop_id) AS from_station, coalesce(b.station, to_stop_id) AS to_station, transfer_type, min_transfer_time
  FROM g_transfers LEFT JOIN st a ON a.stop_id = from_stop_id LEFT JOIN st b ON b.stop_id = to_stop_id WHERE transfer_type <> 3),
probe AS (SELECT e.seq, e.route_id, t.direction_id, coalesce(st.station, e.stop_id) AS station, (e.observed_at % 86400)::INT AS tod
  FROM g_events e JOIN g_trips t USING (trip_id) LEFT JOIN st ON st.stop_id = e.stop_id),
gap AS (SELECT *, departure_secs // 3600 AS hour, lead(departure_secs) OVER (PARTITION BY route_id, direction_id, station ORDER BY departure_secs) - departure_secs AS gap FROM dep),
hw AS (SELECT route_id, direction_id, station, hour::INT AS hour, median(gap)::DOUBLE AS headway, count(*) AS gaps FROM gap WHERE gap > 0 AND gap <= 10800 AND hour <= 27 GROUP BY ALL)"""

_FAR = "abs(x::BIGINT - d::BIGINT) > 120 AND c < 3"
_STEP = f"CASE WHEN {_FAR} THEN round(0.7::DOUBLE * x + 0.3::DOUBLE * d)::INT ELSE x END"


def _changelog(source: str) -> str:
    """CTEs ending in chg: a step-by-step fold of each key's segment by recursion, independent of the window form."""
    return f"""ev0 AS ({source}),
ev1 AS (SELECT *, count(*) FILTER (type = 'TRIP_CANCELLED') OVER (PARTITION BY a, t ORDER BY seq) AS cn, count(*) FILTER (type = 'SKIP_STOP') OVER (PARTITION BY a, t, s ORDER BY seq) AS sn
  FROM ev0 WHERE delay_seconds IS NOT NULL AND observed_at IS NOT NULL),
ev2 AS (SELECT *, row_number() OVER (PARTITION BY a, t, s, cn, sn ORDER BY seq) AS n FROM ev1 WHERE type NOT IN ('TRIP_CANCELLED', 'SKIP_STOP')),
chg AS (
  SELECT a, t, s, cn, sn, n, seq, 'upsert' AS op, delay_seconds AS d, observed_at AS o, 0.5::DOUBLE AS conf, 1 AS c FROM ev2 WHERE n = 1
  UNION ALL
  SELECT a, t, s, cn, sn, n, seq, CASE WHEN late THEN 'drop' ELSE 'upsert' END, CASE WHEN late THEN d ELSE {_STEP} END, CASE WHEN late THEN o ELSE xo END,
    CASE WHEN late THEN conf WHEN abs(x::BIGINT - d::BIGINT) <= 30 THEN least(1.0::DOUBLE, conf + 0.1::DOUBLE) ELSE 0.5::DOUBLE END, CASE WHEN late THEN c ELSE c + 1 END
  FROM (SELECT e.a, e.t, e.s, e.cn, e.sn, e.n, e.seq, e.delay_seconds AS x, e.observed_at AS xo, k.d, k.o, k.conf, k.c, e.observed_at < k.o AS late
    FROM chg k JOIN ev2 e ON e.a = k.a AND e.t = k.t AND e.s = k.s AND e.cn = k.cn AND e.sn = k.sn AND e.n = k.n + 1))"""


_TTL = f"""WITH RECURSIVE ev0 AS (@EV), ev1 AS (SELECT *, count(*) FILTER (type = 'TRIP_CANCELLED') OVER (PARTITION BY a, t ORDER BY seq) AS cn, count(*) FILTER (type = 'SKIP_STOP') OVER (PARTITION BY a, t, s ORDER BY seq) AS sn
  FROM ev0 WHERE delay_seconds IS NOT NULL AND observed_at IS NOT NULL),
ev2 AS (SELECT *, row_number() OVER (PARTITION BY a, t, s, cn, sn ORDER BY seq) AS n FROM ev1 WHERE type NOT IN ('TRIP_CANCELLED', 'SKIP_STOP')),
chg AS (
  SELECT a, t, s, cn, sn, n, seq, 'upsert' AS op, delay_seconds AS d, observed_at AS o, 0.5::DOUBLE AS conf, 1 AS c, received_at AS w FROM ev2 WHERE n = 1
  UNION ALL
  SELECT a, t, s, cn, sn, n, seq, CASE WHEN late THEN 'drop' ELSE 'upsert' END, CASE WHEN lost THEN x WHEN late THEN d ELSE {_STEP} END, CASE WHEN late THEN o ELSE xo END,
    CASE WHEN lost THEN 0.5::DOUBLE WHEN late THEN conf WHEN abs(x::BIGINT - d::BIGINT) <= 30 THEN least(1.0::DOUBLE, conf + 0.1::DOUBLE) ELSE 0.5::DOUBLE END,
    CASE WHEN lost THEN 1 WHEN late THEN c ELSE c + 1 END, CASE WHEN late THEN w ELSE arrived END
  FROM (SELECT e.a, e.t, e.s, e.cn, e.sn, e.n, e.seq, e.delay_seconds AS x, e.observed_at AS xo, e.received_at AS arrived, k.d, k.o, k.conf, k.c, k.w,
    e.received_at - k.w > 7200 AS lost, e.received_at - k.w <= 7200 AND e.observed_at < k.o AS late
    FROM chg k JOIN ev2 e ON e.a = k.a AND e.t = k.t AND e.s = k.s AND e.cn = k.cn AND e.sn = k.sn AND e.n = k.n + 1))
SELECT seq, op, CASE WHEN op = 'upsert' THEN d END AS delay_seconds, CASE WHEN op = 'upsert' THEN o END AS observed_at,
  CASE WHEN op = 'upsert' THEN conf END AS confidence, CASE WHEN op = 'upsert' THEN c END::INT AS update_count FROM chg"""

_CUR = """cur AS (SELECT a, t, s, d, o, conf, c, seq FROM (SELECT *, row_number() OVER (PARTITION BY a, t, s ORDER BY n_all DESC) AS rn FROM (
  SELECT chg.*, seq AS n_all FROM chg WHERE op = 'upsert')) x
  WHERE rn = 1 AND cn = coalesce((SELECT max(cn) FROM ev1 y WHERE y.a = x.a AND y.t = x.t), 0) AND sn = coalesce((SELECT max(sn) FROM ev1 z WHERE z.a = x.a AND z.t = x.t AND z.s = x.s), 0))"""

_EV = f"""SELECT delivery_id AS seq, {q.clean('agency_id')} AS a, {q.clean('trip_id')} AS t, {q.clean('stop_id')} AS s, {q.route()} AS r, delay_seconds, observed_at, received_at, type FROM delay_events"""
_GEV = "SELECT seq, agency_id AS a, trip_id AS t, stop_id AS s, route_id AS r, delay_seconds, observed_at, type FROM g_events"
_RECURSIVE = _VIEWS.replace("WITH ", "WITH RECURSIVE ", 1)
_GSTATE = f"{_RECURSIVE}, {_changelog(_GEV)}, {_CUR}, gst AS (SELECT cur.*, g_trips.route_id FROM cur JOIN g_trips ON g_trips.trip_id = cur.t)"
_LIVE = """live AS (SELECT route_id, coalesce(st.station, s) AS station, max(d) AS delay FROM gst LEFT JOIN st ON st.stop_id = gst.s WHERE d > 60 GROUP BY 1, 2)"""
_STATE = f"SELECT *, {q.route()} AS r, {q.clean('trip_id')} AS t FROM delay_state WHERE delay_seconds IS NOT NULL"

_ASOF = "LEFT JOIN LATERAL (SELECT departure_secs AS dep, trip_id, stop_id, direction_id FROM dep WHERE dep.station = {0} AND dep.route_id = {1} AND dep.departure_secs >= {2} ORDER BY departure_secs, trip_id, stop_sequence LIMIT 1) {3} ON TRUE"

_IMPACTS = f"""late AS (SELECT e.*, coalesce(st.station, e.stop_id) AS from_station,
    (CASE WHEN e.scheduled_arrival % 86400 = 0 OR e.scheduled_arrival = 0 THEN e.observed_at ELSE e.scheduled_arrival END % 86400)::INT AS tod
  FROM g_events e LEFT JOIN st ON st.stop_id = e.stop_id WHERE e.delay_seconds > 0 AND e.type IN ('ARRIVAL_DELAY', 'DEPARTURE_DELAY')),
ras AS (SELECT DISTINCT station, route_id FROM dep),
cand AS (SELECT l.*, tr.to_station, ras.route_id AS to_route, CASE WHEN min_transfer_time <= 0 THEN 120 ELSE min_transfer_time END AS m
  FROM late l JOIN tr ON tr.from_station = l.from_station JOIN ras ON ras.station = tr.to_station AND ras.route_id <> l.route_id),
sd AS (SELECT DISTINCT station, route_id, departure_secs FROM dep),
f1 AS (SELECT c.*, sd.departure_secs AS raw FROM cand c ASOF LEFT JOIN sd ON sd.station = c.to_station AND sd.route_id = c.to_route AND sd.departure_secs >= c.tod),
f2 AS (SELECT f1.*, sd.departure_secs AS wrap FROM f1 ASOF LEFT JOIN sd ON sd.station = f1.to_station AND sd.route_id = f1.to_route AND sd.departure_secs >= f1.tod + 86400),
f3 AS (SELECT *, CASE WHEN tod < 14400 AND wrap IS NOT NULL AND (raw IS NULL OR wrap - 86400 < raw) THEN tod + 86400 ELSE tod END AS eff FROM f2),
one AS (SELECT station, route_id, departure_secs, arg_min(struct_pack(t := trip_id, s := stop_id), (trip_id, stop_sequence)) AS x FROM dep GROUP BY 1, 2, 3),
f4 AS (SELECT f3.*, one.departure_secs AS dep, one.x.t AS ct, one.x.s AS cs FROM f3 ASOF JOIN one ON one.station = f3.to_station AND one.route_id = f3.to_route AND one.departure_secs >= f3.eff + f3.m),
ups AS (SELECT * FROM chg WHERE op = 'upsert'),
f5 AS (SELECT f4.*, u.d AS cd, u.cn AS ucn, u.sn AS usn FROM f4 ASOF LEFT JOIN ups u ON u.a = f4.agency_id AND u.t = f4.ct AND u.s = f4.cs AND u.seq <= f4.seq),
f6 AS (SELECT f5.*, CASE WHEN ucn = (SELECT count(*) FROM ev0 y WHERE y.a = f5.agency_id AND y.t = f5.ct AND y.type = 'TRIP_CANCELLED' AND y.seq <= f5.seq)
    AND usn = (SELECT count(*) FROM ev0 z WHERE z.a = f5.agency_id AND z.t = f5.ct AND z.s = f5.cs AND z.type = 'SKIP_STOP' AND z.seq <= f5.seq) THEN cd END AS conn FROM f5),
f7 AS (SELECT *, dep - eff AS original, dep - eff - delay_seconds + coalesce(conn, 0) AS remaining, eff + delay_seconds + m AS catch FROM f6),
f8 AS (SELECT f7.*, v.departure_secs AS vdep, v.x.t AS vtrip, CASE WHEN remaining < m THEN 'BROKEN' WHEN remaining < m + 60 THEN 'AT_RISK' END AS level
  FROM f7 ASOF LEFT JOIN one v ON v.station = f7.to_station AND v.route_id = f7.to_route AND v.departure_secs >= f7.catch),
imp AS (SELECT seq, trip_id AS from_trip_id, route_id AS from_route_id, to_route AS to_route_id, stop_id AS from_stop_id, to_station AS station_id, delay_seconds AS source_delay_seconds,
  original::INT AS original_transfer_margin_seconds, remaining::INT AS remaining_margin_seconds, level, observed_at AS detected_at,
  CASE WHEN level = 'BROKEN' THEN coalesce(vtrip, '') ELSE '' END AS next_viable_trip_id,
  (CASE WHEN level = 'BROKEN' THEN coalesce(greatest(0, vdep - dep), 0) ELSE 0 END)::INT AS additional_wait_seconds,
  (CASE WHEN level = 'BROKEN' THEN dep ELSE 0 END)::INT AS sched_connection_departure_secs, (CASE WHEN level = 'BROKEN' THEN catch ELSE 0 END)::INT AS earliest_catch_secs
  FROM f8 WHERE level IS NOT NULL)"""
_XFER = f"{_RECURSIVE}, {_changelog(_GEV)}, {_IMPACTS}"

_R5 = "concat('R', (ascii(substr({0}, 2, 1)) % 5 + 1)::VARCHAR)"
_N25 = "concat('N', (ascii({0}) % 25)::VARCHAR)"
_EST = f"""{_RECURSIVE}, {_changelog(_GEV)}, {_CUR}, gst AS (SELECT cur.*, g_trips.route_id FROM cur JOIN g_trips ON g_trips.trip_id = cur.t), {_LIVE}, {_IMPACTS},
brk AS (SELECT DISTINCT ON (impact_id) *, concat_ws(':', seq, to_route_id, station_id, earliest_catch_secs) AS impact_id FROM imp WHERE level = 'BROKEN'),
dirs AS (SELECT brk.*, coalesce(g_trips.direction_id, 0) AS direction_id, (detected_at % 86400)::INT AS tod, ((detected_at % 86400) // 3600)::INT AS hour FROM brk LEFT JOIN g_trips ON g_trips.trip_id = next_viable_trip_id),
avgs AS (SELECT {_R5.format('from_route')} AS f, {_R5.format('to_route')} AS r, {_N25.format('station')} AS s, hour AS h, avg(downstream_impact) AS av, count(*) AS n
  FROM history WHERE downstream_impact IS NOT NULL AND hour IS NOT NULL GROUP BY ALL),
hws AS (SELECT d.*, coalesce(h1.headway, h2.headway) AS headway, live.delay AS live, avgs.av, coalesce(avgs.n, 0) AS n FROM dirs d
  LEFT JOIN hw h1 ON h1.route_id = d.to_route_id AND h1.direction_id = d.direction_id AND h1.station = d.station_id AND h1.hour = d.hour
  LEFT JOIN hw h2 ON h2.route_id = d.to_route_id AND h2.direction_id = d.direction_id AND h2.station = d.station_id AND d.hour < 4 AND h2.hour = d.hour + 24
  LEFT JOIN live ON live.route_id = d.to_route_id AND live.station = d.station_id
  LEFT JOIN avgs ON f = d.from_route_id AND r = d.to_route_id AND s = d.station_id AND h = d.hour),
base0 AS (SELECT *, greatest(additional_wait_seconds::DOUBLE, coalesce(headway / 2, 0)) AS b0 FROM hws),
base1 AS (SELECT *, CASE WHEN b0 <= 0 THEN source_delay_seconds * 0.15::DOUBLE * 0.3::DOUBLE ELSE b0 END + CASE WHEN coalesce(live, 0) > 0 THEN least(live::DOUBLE, coalesce(headway, 900)) ELSE 0 END AS b FROM base0),
est AS (SELECT *, CASE WHEN from_route_id = to_route_id THEN source_delay_seconds ELSE
  round(n::DOUBLE / (n + 10) * coalesce(av, 0) + (1 - n::DOUBLE / (n + 10)) * b)::INT END AS initial_delay FROM base1),
lastseq AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence DESC, departure_secs DESC, stop_id DESC) AS l FROM dep),
firsts AS (SELECT *, row_number() OVER (PARTITION BY route_id, direction_id, station ORDER BY departure_secs, trip_id, stop_sequence) AS p FROM lastseq WHERE l > 1),
down AS (SELECT f.route_id, f.direction_id, f.station, row_number() OVER (PARTITION BY f.route_id, f.direction_id, f.station ORDER BY d.stop_sequence, d.departure_secs, d.stop_id)::INT AS position, d.stop_id, d.station AS next_station
  FROM firsts f JOIN dep d ON d.trip_id = f.trip_id AND d.stop_sequence > f.stop_sequence WHERE f.p = 1),
seeds AS (SELECT e.impact_id, d.position, e.to_route_id AS route_id, d.stop_id, d.next_station AS station, e.initial_delay + (d.position - 1) AS delay, e.hour,
  CASE WHEN d.position = 1 THEN 1.0::DOUBLE ELSE pow(0.7::DOUBLE, d.position) END AS confidence, e.initial_delay
  FROM est e JOIN down d ON d.route_id = e.to_route_id AND d.direction_id = e.direction_id AND d.station = e.station_id
  WHERE d.position = 1 OR (pow(0.7::DOUBLE, d.position) >= 0.2 AND e.initial_delay + 1 >= 15))"""

_SAV = f"""sav AS (SELECT {_R5.format('route')} AS r, {_N25.format('station')} AS s, hour AS h, avg(observed) AS av, count(*) AS n
  FROM stop_history WHERE observed IS NOT NULL AND hour IS NOT NULL GROUP BY ALL)"""
_NO_SAV = "sav AS (SELECT NULL::VARCHAR AS r, NULL::VARCHAR AS s, NULL::INT AS h, NULL::DOUBLE AS av, 0::BIGINT AS n WHERE FALSE)"


def _seeded(stops: str, route: str, delay: str, conf: str, hops: str, kind: str) -> str:
    """Queue items of a run of stops: the first keeps delay and confidence, later ones while both stay above their limits."""
    blend = f"CASE WHEN x.n >= 5 THEN round(x.n::DOUBLE / (x.n + 10) * x.av + (1 - x.n::DOUBLE / (x.n + 10)) * ({delay} + k - 1))::INT ELSE ({delay} + k - 1)::INT END"
    return f"""list_filter(list_transform({stops}, lambda x, k: struct_pack(d := -CASE WHEN k = 1 THEN ({delay})::INT ELSE {blend} END, h := {hops}, c := -CASE WHEN k = 1 THEN {conf} ELSE {conf} * pow(0.7::DOUBLE, k) END,
    r := {route}, s := x.s, kind := '{kind}', ok := k = 1 OR ({conf} * pow(0.7::DOUBLE, k) >= 0.2 AND {delay} + 1 >= 15))), lambda x: x.ok)"""


def _walk(source: str, averages: str = _NO_SAV) -> str:
    """CTEs ending in walk: the best-first search, one step of all searches per round of the recursion, with the open items and
    the places seen as lists. ``source`` has impact_id, route, station, way, start, tod."""
    item = "STRUCT(d INT, h INT, c DOUBLE, r VARCHAR, s VARCHAR, kind VARCHAR, ok BOOLEAN)"
    return f"""{averages},
down_l AS (SELECT route_id, direction_id, station, hour, list(struct_pack(s := next_station, av := coalesce(sav.av, 0), n := coalesce(sav.n, 0)) ORDER BY position) AS stops
  FROM down CROSS JOIN (SELECT unnest(range(24))::INT AS hour) LEFT JOIN sav ON sav.r = route_id AND sav.s = next_station AND sav.h = hour GROUP BY ALL),
tr_l AS (SELECT from_station, list(struct_pack(s := to_station, r := ras.route_id, least := CASE WHEN min_transfer_time <= 0 THEN 120 ELSE min_transfer_time END + coalesce(live.delay, 0))) AS onward
  FROM tr JOIN (SELECT DISTINCT station, route_id FROM dep) ras ON ras.station = tr.to_station LEFT JOIN live ON live.route_id = ras.route_id AND live.station = tr.to_station GROUP BY 1),
dep_l AS (SELECT route_id, station, list(struct_pack(t := departure_secs, way := direction_id) ORDER BY departure_secs, trip_id) AS deps FROM dep GROUP BY 1, 2),
src AS ({source}),
wk AS (
  SELECT impact_id, tod, coalesce({_seeded('stops', 'route', 'start', '1.0::DOUBLE', '1', 'dwell_increase')}, []::{item}[]) AS queue, []::STRUCT(r VARCHAR, s VARCHAR)[] AS seen, 0 AS n, NULL::{item} AS found
  FROM src LEFT JOIN down_l ON route_id = route AND direction_id = way AND down_l.station = src.station AND hour = (tod // 3600) % 24
  UNION ALL
  SELECT impact_id, tod, list_concat(rest, CASE WHEN go AND less >= 0.2 AND later >= 15 THEN
      list_transform(list_filter(onward, lambda x: x.r <> top.r AND -top.d >= x.least AND NOT list_contains(seen, struct_pack(r := x.r, s := x.s))),
        lambda x: struct_pack(d := -later, h := top.h + 1, c := -less, r := x.r, s := x.s, kind := 'cascade_transfer', ok := TRUE)) END,
    CASE WHEN go AND top.kind = 'cascade_transfer' THEN {_seeded('stops', 'top.r', '-top.d', '-top.c', 'top.h', 'cascade_dwell')} END),
    CASE WHEN fresh THEN list_append(seen, struct_pack(r := top.r, s := top.s)) ELSE seen END, n + fresh::INT, CASE WHEN fresh THEN top END
  FROM (SELECT w.*, tr_l.onward, down_l.stops FROM (
    SELECT p.*, fresh AND top.h < 5 AND -top.d >= 15 AS go, -top.c * 0.7::DOUBLE AS less, trunc(-top.d * 0.3::DOUBLE)::INT AS later,
      CASE WHEN tod < 14400 AND wrap IS NOT NULL AND (raw IS NULL OR wrap.t - 86400 < raw.t) THEN wrap.way ELSE raw.way END AS way
    FROM (SELECT q.*, NOT list_contains(seen, struct_pack(r := top.r, s := top.s)) AS fresh, list_filter(deps, lambda x: x.t >= tod)[1] AS raw, list_filter(deps, lambda x: x.t >= tod + 86400)[1] AS wrap
      FROM (SELECT impact_id, tod, seen, n, sorted[1] AS top, sorted[2:] AS rest FROM (SELECT *, list_sort(queue) AS sorted FROM wk WHERE len(queue) > 0 AND n < 100)) q
      LEFT JOIN dep_l ON dep_l.route_id = q.top.r AND dep_l.station = q.top.s) p) w
    LEFT JOIN tr_l ON tr_l.from_station = w.top.s
    LEFT JOIN down_l ON down_l.route_id = w.top.r AND down_l.direction_id = w.way AND down_l.station = w.top.s AND down_l.hour = (w.tod // 3600) % 24)),
walk AS (SELECT impact_id, n - 1 AS position, found.r AS route_id, found.s AS stop_id, -found.d AS predicted_additional_delay, (-found.c)::FLOAT AS confidence, found.h AS hops_from_source, found.kind AS impact_type
  FROM wk WHERE found IS NOT NULL)"""


_BROKEN_SRC = "SELECT impact_id, to_route_id AS route, station_id AS station, direction_id AS way, initial_delay AS start, tod FROM est"
_STATE_SRC = """SELECT concat_ws(':', gst.a, gst.t, gst.s) AS impact_id, t.route_id AS route, coalesce(st.station, gst.s) AS station, coalesce(t.direction_id, 0) AS way, gst.d AS start, (gst.o % 86400)::INT AS tod
  FROM gst JOIN g_trips t ON t.trip_id = gst.t LEFT JOIN st ON st.stop_id = gst.s"""
_TRACKED = f"""{_EST}, {_walk(_BROKEN_SRC)},
own AS (SELECT w.*, e.from_route_id, e.to_route_id, e.station_id AS source_station, CASE WHEN t.trip_id IS NULL THEN -1 ELSE t.direction_id END AS dirn, e.source_delay_seconds, e.sched_connection_departure_secs, e.earliest_catch_secs,
  e.detected_at, w.hops_from_source = 1 AND w.route_id = e.to_route_id AS mine FROM walk w JOIN est e USING (impact_id) LEFT JOIN g_trips t ON t.trip_id = e.next_viable_trip_id),
prime AS (SELECT *, mine AND row_number() OVER (PARTITION BY impact_id ORDER BY mine DESC, predicted_additional_delay, position) = 1 AS is_primary FROM own),
kept AS (SELECT *, row_number() OVER (PARTITION BY impact_id ORDER BY is_primary DESC, position) AS k FROM prime WHERE is_primary OR confidence::DOUBLE >= 0.3),
first3 AS (SELECT impact_id, route_id FROM (SELECT impact_id, route_id, row_number() OVER (PARTITION BY impact_id ORDER BY first_at) AS k FROM (SELECT impact_id, route_id, min(position) AS first_at FROM walk GROUP BY 1, 2)) WHERE k <= 3),
bs AS (SELECT route_id, coalesce(st.station, s) AS station, max(d) AS baseline FROM gst LEFT JOIN st ON st.stop_id = gst.s WHERE d > 0 GROUP BY 1, 2)"""


_WAITS = f"""{_EST}, pp AS (SELECT *, (seq % 3 - 1)::INT AS dirn FROM brk),
  c AS (SELECT pp.impact_id, pp.dirn, pp.sched_connection_departure_secs AS sc, pp.earliest_catch_secs AS ec, d.departure_secs AS dep, d.trip_id, d.direction_id, d.station,
    row_number() OVER (PARTITION BY pp.impact_id ORDER BY d.departure_secs, d.trip_id, d.stop_sequence) AS n
    FROM pp JOIN dep d ON d.station = pp.station_id AND d.route_id = pp.to_route_id AND d.departure_secs BETWEEN pp.sched_connection_departure_secs AND pp.sched_connection_departure_secs + 90000),
  fs AS (SELECT trip_id, station, arg_min(stop_id, stop_sequence) AS stop_id FROM dep GROUP BY 1, 2),
  w AS (SELECT c.*, c.dep + coalesce(cur.d, 0) AS real FROM c JOIN fs ON fs.trip_id = c.trip_id AND fs.station = c.station LEFT JOIN cur ON cur.t = c.trip_id AND cur.s = fs.stop_id
    WHERE n <= 10 AND dep <= ec + 1800 AND (dirn < 0 OR direction_id = dirn)),
real AS (SELECT impact_id AS id, arg_min(greatest(0, real - sc), n)::INT AS wait FROM w WHERE real >= ec GROUP BY 1)"""

_DIFF = f"""WITH RECURSIVE rows0 AS (SELECT feed_id, taken_at AS polled, {q.clean('trip_id')} AS t, stop_id AS s, coalesce(delay_seconds, 0)::BIGINT AS d, coalesce(predicted_arrival, 0)::BIGINT AS p, type AS k FROM delay_snapshots),
polls AS (SELECT feed_id, polled, lag(polled) OVER (PARTITION BY feed_id ORDER BY polled) AS prev FROM (SELECT DISTINCT feed_id, polled FROM rows0)),
rows1 AS (SELECT r.*, polls.prev FROM rows0 r JOIN polls USING (feed_id, polled)),
per AS (SELECT feed_id, t, s, polled, any_value(prev) AS prev, list(struct_pack(d := d, p := p, k := k) ORDER BY d, p, k) AS xs, row_number() OVER (PARTITION BY feed_id, t, s ORDER BY polled) AS n FROM rows1 GROUP BY feed_id, t, s, polled),
fold AS (
  SELECT feed_id, t, s, polled, n, xs AS out, xs[-1] AS last FROM per WHERE n = 1
  UNION ALL
  SELECT feed_id, t, s, polled, n, o, coalesce(o[-1], last) FROM (SELECT p.feed_id, p.t, p.s, p.polled, p.n, f.last,
    list_filter(p.xs, lambda x: coalesce(p.prev - f.polled > 1800, FALSE) OR x.k <> f.last.k OR abs(x.d - f.last.d) > 15 OR abs(x.p - f.last.p) > 15) AS o
    FROM fold f JOIN per p ON f.feed_id = p.feed_id AND f.t = p.t AND f.s = p.s AND f.n = p.n - 1))
SELECT feed_id, polled AS polled_at, t AS trip_id, s AS stop_id, x.d AS delay_seconds, x.p AS predicted_arrival, x.k AS type FROM (SELECT feed_id, polled, t, s, unnest(out) AS x FROM fold)"""
_GONE = "coalesce(predicted_arrival % 97 = 0, FALSE)"
_NORMAL = f"""WITH r AS (SELECT *, min({_GONE}::INT) OVER (PARTITION BY feed_id, taken_at, agency_id, trip_id) AS c, {q.route_from_trip('trip_id')} AS route, coalesce(predicted_arrival % 7 = 0, FALSE) AS skip,
  delay_seconds IS NOT NULL OR coalesce(predicted_arrival, 0) <> 0 AS usable, coalesce(predicted_arrival, 0) AS p FROM delay_snapshots)
SELECT feed_id, taken_at AS poll_no, agency_id, trip_id, route AS route_id, taken_at AS observed_at, stop_id, (CASE WHEN skip THEN 0 ELSE coalesce(delay_seconds, 0) END)::INT AS delay_seconds,
  CASE WHEN delay_seconds IS NOT NULL AND p > 0 THEN p - delay_seconds ELSE 0 END::BIGINT AS scheduled_arrival, p::BIGINT AS predicted_arrival,
  CASE WHEN skip THEN 'SKIP_STOP' WHEN type = 'ARRIVAL_DELAY' THEN 'ARRIVAL_DELAY' ELSE 'DEPARTURE_DELAY' END AS type FROM r WHERE c = 0 AND (skip OR usable)
UNION ALL SELECT DISTINCT feed_id, taken_at, agency_id, trip_id, route, taken_at, '', 0, 0::BIGINT, 0::BIGINT, 'TRIP_CANCELLED' FROM r WHERE c = 1"""

_RESOLVED = f"""{_VIEWS}, ids AS (SELECT DISTINCT trip_id FROM dep),
suf AS (SELECT substr(trip_id, instr(trip_id, '_') + 1) AS sx, min(trip_id) AS id FROM ids WHERE instr(trip_id, '_') > 0 AND instr(trip_id, '_') < length(trip_id) GROUP BY 1 HAVING count(*) = 1),
res AS (SELECT p.*, coalesce(ids.trip_id, suf.id) AS sid, coalesce(st.station, p.stop_id) AS station FROM g_predictions p LEFT JOIN ids ON ids.trip_id = p.trip_id LEFT JOIN suf ON suf.sx = p.trip_id LEFT JOIN st ON st.stop_id = p.stop_id),
sch AS (SELECT * FROM (SELECT res.*, d.stop_id AS ds, d.arrival_secs AS da, d.departure_secs AS dd, row_number() OVER (PARTITION BY seq ORDER BY (d.stop_id = res.stop_id) DESC, d.stop_sequence) AS rn
  FROM res LEFT JOIN dep d ON d.trip_id = res.sid AND d.station = res.station) WHERE rn = 1)"""

_SWEPT = """SELECT *, coalesce(observed_max, 0)::BIGINT AS seen, coalesce(predicted_secs, 0)::BIGINT AS said, abs(coalesce(predicted_secs, 0)::BIGINT - coalesce(observed_max, 0)) AS abs_error,
  CASE WHEN coalesce(observed_max, 0) >= 15 AND coalesce(observed_max, 0) >= 0.5 * coalesce(predicted_secs, 0) THEN 'verified' ELSE 'falsified' END AS outcome
  FROM (SELECT DISTINCT * FROM pending_predictions WHERE expires_at <> 0)"""
_BUCKET = "CASE WHEN confidence < 0.4 THEN '0.2-0.4' WHEN confidence < 0.6 THEN '0.4-0.6' WHEN confidence < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END"
_SINCE = NOW_NS - 10 * 86_400 * 1_000_000_000
_SERVICES = "SELECT DISTINCT service_id FROM calendar WHERE start_date <= '20240110' AND end_date >= '20240110' AND wednesday = '1'"

ORACLE = {
    "active_services": _SERVICES,
    "gtfs_stops": f"{_VIEWS} SELECT * REPLACE ({ODD_NAME.format(newline='chr(10)')} AS stop_name) FROM g_stops",
    "gtfs_stop_times": f"""{_VIEWS} SELECT trip_id, stop_id, arrival_secs, CASE WHEN arrival_secs % 53 = 1 THEN arrival_secs ELSE departure_secs END AS departure_secs, stop_sequence
  FROM g_stop_times WHERE arrival_secs % 53 <> 0""",
    "calendar_exceptions": f"""WITH x AS (SELECT DISTINCT service_id, start_date, end_date, published_at FROM calendar),
d AS (SELECT *, CASE WHEN ascii(right(service_id, 1)) % 3 > 0 THEN '20240110' ELSE start_date END AS date, right(start_date, 2)::INT % 4 AS kind FROM x),
l AS (SELECT service_id, kind FROM d WHERE date = '20240110' AND kind IN (1, 2) QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY published_at DESC, end_date DESC, start_date DESC) = 1)
SELECT service_id FROM ({_SERVICES} UNION SELECT service_id FROM l WHERE kind = 1) WHERE service_id NOT IN (SELECT service_id FROM l WHERE kind = 2)""",
    "active_trips": f"SELECT DISTINCT trip_id FROM trips WHERE service_id IN ({_SERVICES})",
    "stop_parent": f"{_VIEWS} SELECT stop_id, station FROM st",
    "routes_at_stop": f"{_VIEWS} SELECT DISTINCT station, route_id FROM dep",
    "graph_stats": f"{_VIEWS} SELECT (SELECT count(*) FROM g_stops) AS total_stops, (SELECT count(*) FROM g_stops WHERE location_type = 1) AS parent_stops, (SELECT count(*) FROM g_routes) AS total_routes, (SELECT count(*) FROM tr) AS transfer_pairs",
    "transfers_normalized": f"{_VIEWS} SELECT * FROM tr",
    "headway_index": f"{_VIEWS} SELECT * FROM hw",
    "headway_lookup": f"""{_VIEWS} SELECT p.seq, coalesce(a.headway, b.headway) AS headway FROM probe p
  LEFT JOIN hw a ON a.route_id = p.route_id AND a.direction_id = p.direction_id AND a.station = p.station AND a.hour = p.tod // 3600
  LEFT JOIN hw b ON b.route_id = p.route_id AND b.direction_id = p.direction_id AND b.station = p.station AND p.tod < 14400 AND b.hour = p.tod // 3600 + 24""",
    "next_departures_n": f"""{_VIEWS} SELECT seq, (n - 1)::INT AS n, trip_id, dep FROM (SELECT p.seq, d.trip_id, d.departure_secs AS dep,
  row_number() OVER (PARTITION BY p.seq ORDER BY d.departure_secs, d.trip_id, d.stop_sequence) AS n FROM probe p JOIN dep d ON d.station = p.station AND d.route_id = p.route_id AND d.departure_secs >= p.tod) WHERE n <= 3""",
    "next_departure_overnight": f"""{_VIEWS}, one AS (SELECT station, route_id, departure_secs, min(struct_pack(t := trip_id, n := stop_sequence)) AS x FROM dep GROUP BY 1, 2, 3),
  a AS (SELECT p.*, one.departure_secs AS raw, one.x.t AS rt FROM probe p ASOF LEFT JOIN one ON one.station = p.station AND one.route_id = p.route_id AND one.departure_secs >= p.tod),
  b AS (SELECT a.*, one.departure_secs AS wrap, one.x.t AS wt FROM a ASOF LEFT JOIN one ON one.station = a.station AND one.route_id = a.route_id AND one.departure_secs >= a.tod + 86400),
  c AS (SELECT *, tod < 14400 AND wrap IS NOT NULL AND (raw IS NULL OR wrap - 86400 < raw) AS w FROM b)
  SELECT seq, CASE WHEN w THEN tod + 86400 ELSE tod END::INT AS effective_tod, CASE WHEN w THEN wt ELSE rt END AS trip_id FROM c""",
    "resolve_trip": f"{_RESOLVED} SELECT seq, trip_id, sid AS static_trip_id FROM res",
    "scheduled_stop_time": f"{_RESOLVED} SELECT seq, ds AS sched_stop_id, da AS arrival_secs, dd AS departure_secs FROM sch",
    "downstream_stops": f"{_EST} SELECT route_id, direction_id, station, position, stop_id, next_station FROM down",
    "service_time_parse": """SELECT line_id, CASE WHEN regexp_full_match(x, '[+-]?[0-9]+:[+-]?[0-9]+:[+-]?[0-9]+') THEN try_cast(split_part(x, ':', 1) AS INT) * 3600 + try_cast(split_part(x, ':', 2) AS INT) * 60 + try_cast(split_part(x, ':', 3) AS INT) END::INT AS secs
  FROM (SELECT line_id, trim(split_part(line, ',', 2)) AS x FROM raw_lines WHERE file_name = 'stop_times.txt')""",
    "route_of_trip": f"""SELECT trip_id, {q.route_from_trip('trip_id')} AS route_id, CASE WHEN instr(trip_id, '_') > 0 AND instr(trip_id, '_') < length(trip_id) THEN substr(trip_id, instr(trip_id, '_') + 1) END AS suffix,
  CASE WHEN length(trip_id) > 12 THEN concat(substr(trip_id, 1, 11), '…') ELSE trip_id END AS short_id FROM (SELECT DISTINCT {q.clean('trip_id')} AS trip_id FROM delay_events)""",
    "confidence_buckets": f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM delay_state GROUP BY 1",
    "normalize_events": _NORMAL,
    "diff_events": _DIFF,
    "enrich_delay": f"""{_RESOLVED}, x AS (SELECT *, delay_seconds = 0 AND scheduled_arrival = 0 AND predicted_arrival <> 0 AND type IN ('ARRIVAL_DELAY', 'DEPARTURE_DELAY') AS need,
    CASE WHEN type = 'DEPARTURE_DELAY' THEN coalesce(nullif(dd, 0), nullif(da, 0)) ELSE coalesce(nullif(da, 0), nullif(dd, 0)) END AS sched FROM sch),
  y AS (SELECT *, predicted_arrival % 86400 - sched AS raw FROM x),
  z AS (SELECT y.*, CASE WHEN need THEN (SELECT r FROM (VALUES (1, raw), (2, raw - 86400), (3, raw + 86400)) v(n, r) ORDER BY abs(r), n LIMIT 1) END AS d FROM y)
  SELECT seq, coalesce(d, delay_seconds)::INT AS delay_seconds, CASE WHEN d IS NOT NULL THEN predicted_arrival - d ELSE scheduled_arrival END AS scheduled_arrival, CASE WHEN need THEN d IS NOT NULL END AS enriched FROM z""",
    "state_changelog": f"""WITH RECURSIVE {_changelog(_EV)} SELECT seq, op, CASE WHEN op = 'upsert' THEN d END AS delay_seconds, CASE WHEN op = 'upsert' THEN o END AS observed_at,
  CASE WHEN op = 'upsert' THEN conf END AS confidence, CASE WHEN op = 'upsert' THEN c END::INT AS update_count FROM chg""",
    "state_changelog_whole": f"""WITH RECURSIVE {_changelog(_EV)} SELECT seq, a AS agency_id, t AS trip_id, s AS stop_id, op, CASE WHEN op = 'upsert' THEN d END AS delay_seconds,
  CASE WHEN op = 'upsert' THEN o END AS observed_at, CASE WHEN op = 'upsert' THEN conf END AS confidence, CASE WHEN op = 'upsert' THEN c END::INT AS update_count FROM chg
UNION ALL SELECT seq, a, t, s, 'delete', NULL, NULL, NULL, NULL FROM ev1 WHERE type IN ('TRIP_CANCELLED', 'SKIP_STOP')""",
    "delay_state_current": f"WITH RECURSIVE {_changelog(_EV)}, {_CUR} SELECT cur.a AS agency_id, cur.t AS trip_id, cur.s AS stop_id, ev0.r AS route_id, d AS delay_seconds, o AS observed_at, conf AS confidence, c::INT AS update_count FROM cur JOIN ev0 USING (seq)",
    "state_with_ttl": _TTL.replace("@EV", _EV),
    "active_delays": f"SELECT state_id, r AS route_id, delay_seconds FROM ({_STATE}) WHERE abs(delay_seconds::BIGINT) > 60",
    "delay_stats": "SELECT count(*) AS active, avg(abs(delay_seconds::BIGINT)) AS mean_abs, max(abs(delay_seconds::BIGINT)) AS max_abs FROM delay_state WHERE abs(delay_seconds::BIGINT) > 60",
    "top5_per_route": f"""SELECT r AS route_id, n::INT AS position, t AS trip_id, stop_id, delay_seconds, greatest(0, k - 5) AS more FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY delay_seconds DESC, t, stop_id) AS n,
  count(*) OVER (PARTITION BY r) AS k FROM ({_STATE}) WHERE abs(delay_seconds::BIGINT) > 60) WHERE n <= 5""",
    "live_max": f"SELECT r AS route_id, stop_id AS station, max(delay_seconds) AS delay FROM ({_STATE}) WHERE delay_seconds > 60 GROUP BY 1, 2",
    "network_state": f"""{_GSTATE} SELECT gst.route_id, count(*) AS stops, string_agg(concat_ws('|', t, s, coalesce(nullif(x.stop_name, ''), y.stop_name, s), d::VARCHAR, round(conf * 1000000)::BIGINT::VARCHAR, o::VARCHAR), ';' ORDER BY t, s) AS delays
  FROM gst LEFT JOIN g_stops x ON x.stop_id = s LEFT JOIN g_stops y ON y.stop_id = x.parent_station WHERE abs(d) > 60 GROUP BY 1""",
    "route_delays": f"""{_GSTATE} SELECT gst.route_id, t AS trip_id, s AS stop_id, coalesce(nullif(x.stop_name, ''), s) AS stop_name, d AS delay_seconds, conf AS confidence, o AS observed_at FROM gst LEFT JOIN g_stops x ON x.stop_id = s""",
    "transfer_impacts": f"{_XFER} SELECT * FROM imp",
    "broken_transfers_by_station": f"{_XFER} SELECT station_id, to_route_id, count(*) AS broken, sum(additional_wait_seconds)::BIGINT AS total_wait, max(additional_wait_seconds) AS max_wait FROM imp WHERE level = 'BROKEN' GROUP BY 1, 2",
    "alerts_filtered": f"{_XFER} SELECT * FROM imp WHERE from_route_id = 'R1' OR to_route_id = 'R1' OR station_id IN ('N3', 'N7')",
    "initial_delay_estimate": f"{_EST} SELECT impact_id, direction_id, hour, initial_delay FROM est",
    "dwell_seed": f"{_EST} SELECT impact_id, position, route_id, stop_id, station, delay::INT AS delay, confidence FROM seeds",
    "per_stop_blend": f"""{_EST}, sav AS (SELECT {_R5.format('route')} AS r, {_N25.format('station')} AS s, hour AS h, avg(observed) AS av, count(*) AS n FROM stop_history WHERE observed IS NOT NULL AND hour IS NOT NULL GROUP BY ALL)
  SELECT impact_id, position, route_id, stop_id, station, (CASE WHEN position = 1 OR coalesce(n, 0) < 5 THEN delay ELSE round(n::DOUBLE / (n + 10) * av + (1 - n::DOUBLE / (n + 10)) * delay) END)::INT AS delay, confidence
  FROM seeds LEFT JOIN sav ON r = route_id AND s = station AND h = hour""",
    "first_hop_cascade": f"""{_EST} SELECT impact_id, position, to_station, ras.route_id AS to_route_id, trunc(seeds.delay * 0.3::DOUBLE)::INT AS new_delay, confidence * 0.7::DOUBLE AS new_confidence
  FROM seeds JOIN tr ON tr.from_station = seeds.station JOIN ras ON ras.station = tr.to_station AND ras.route_id <> seeds.route_id LEFT JOIN live ON live.route_id = ras.route_id AND live.station = tr.to_station
  WHERE seeds.delay >= CASE WHEN min_transfer_time <= 0 THEN 120 ELSE min_transfer_time END + coalesce(live.delay, 0) AND confidence * 0.7::DOUBLE >= 0.2 AND trunc(seeds.delay * 0.3::DOUBLE) >= 15""",
    "cascade_walk": f"{_EST}, {_walk(_BROKEN_SRC)} SELECT * FROM walk",
    "cascade_walk_averages": f"{_EST}, {_walk(_BROKEN_SRC, _SAV)} SELECT * FROM walk",
    "blast_radius": f"""{_EST}, {_walk(_STATE_SRC + " WHERE EXISTS (SELECT 1 FROM dep WHERE dep.station = coalesce(st.station, gst.s) AND dep.route_id = gst.route_id)")} SELECT * FROM walk""",
    "predict_impact": f"{_EST}, {_walk(_STATE_SRC + ' ORDER BY gst.d DESC, gst.t, gst.s LIMIT 1')} SELECT * FROM walk",
    "track_predictions": f"""{_TRACKED} SELECT concat_ws(':', from_route_id, kept.route_id, stop_id, kept.impact_id, position) AS id, 'ag' AS agency_id, from_route_id AS from_route, kept.route_id, stop_id AS station_id, source_station,
  CASE WHEN kept.route_id = to_route_id THEN dirn ELSE -1 END::INT AS direction, source_delay_seconds AS source_delay_secs, predicted_additional_delay AS predicted_secs,
  coalesce(CASE WHEN first3.impact_id IS NOT NULL THEN bs.baseline END, 0)::INT AS baseline_secs, sched_connection_departure_secs AS sched_conn_dep_secs, earliest_catch_secs, confidence::DOUBLE AS confidence,
  hops_from_source AS hops, ((detected_at % 86400) // 3600)::INT AS hour, is_primary, detected_at AS created_at, detected_at + 1800 AS expires_at, 0 AS observed_max, FALSE AS matched
  FROM kept LEFT JOIN first3 USING (impact_id, route_id) LEFT JOIN bs ON bs.route_id = kept.route_id AND bs.station = kept.stop_id WHERE k <= 20""",
    "baseline_delays": f"""{_EST}, rk AS (SELECT impact_id, route_id, dense_rank() OVER (PARTITION BY impact_id ORDER BY min(position)) AS n FROM seeds GROUP BY impact_id, route_id),
  bs AS (SELECT route_id, coalesce(st.station, s) AS station, max(d) AS baseline FROM gst LEFT JOIN st ON st.stop_id = gst.s WHERE d > 0 GROUP BY 1, 2)
  SELECT DISTINCT seeds.impact_id, seeds.route_id, seeds.station, bs.baseline FROM seeds JOIN rk ON rk.impact_id = seeds.impact_id AND rk.route_id = seeds.route_id AND rk.n <= 3 JOIN bs ON bs.route_id = seeds.route_id AND bs.station = seeds.station""",
    "match_predictions": f"""WITH dirs AS (SELECT {q.clean('trip_id')} AS t, arg_max(direction_id, published_at) AS dir FROM trips GROUP BY 1),
  p AS (SELECT DISTINCT id, agency_id, route_id, station_id, direction, baseline_secs, created_at, expires_at FROM pending_predictions),
  e AS (SELECT ev.*, dirs.dir FROM ({_EV}) ev LEFT JOIN dirs USING (t) WHERE {q.MEASUREMENT})
  SELECT p.id, coalesce(max(greatest(0, e.delay_seconds::BIGINT - coalesce(p.baseline_secs, 0))), 0)::BIGINT AS observed_max, count(e.t) > 0 AS matched
  FROM p LEFT JOIN e ON e.a = p.agency_id AND e.r = p.route_id AND e.s = p.station_id AND e.observed_at BETWEEN p.created_at AND p.expires_at AND (coalesce(p.direction, -1) < 0 OR e.dir IS NULL OR e.dir = p.direction) GROUP BY p.id""",
    "realized_wait": f"{_WAITS} SELECT * FROM real",
    "sweep_waits": f"""{_WAITS}, z AS (SELECT brk.impact_id AS id, additional_wait_seconds AS said, coalesce(r.wait, 0)::BIGINT AS seen FROM brk LEFT JOIN real r ON r.id = brk.impact_id)
  SELECT id, CASE WHEN seen >= 15 AND seen >= said * 0.5 THEN 'verified' ELSE 'falsified' END AS outcome, abs(said - seen)::BIGINT AS abs_error, seen AS observed_max FROM z""",
    "sweep_outcomes": f"SELECT id, outcome, abs_error, seen AS observed_max FROM ({_SWEPT})",
    "eval_metrics": f"""SELECT {_BUCKET} AS bucket, outcome, count(*) AS finalized, sum(abs_error::HUGEINT * abs_error)::DOUBLE AS squared_error, sqrt(sum(abs_error::HUGEINT * abs_error)::DOUBLE / count(*)) AS rmse,
  {', '.join(f'count(*) FILTER (abs_error <= {b}) AS le_{b}' for b in (5, 15, 30, 60, 120, 300, 600, 1200))} FROM ({_SWEPT}) GROUP BY 1, 2""",
    "learned_history": f"""SELECT from_route, route_id AS to_route, CASE WHEN coalesce(source_station, '') = '' THEN station_id ELSE source_station END AS station, hour, source_delay_secs AS source_delay, seen::INT AS downstream_impact, 0::BIGINT AS "at"
  FROM ({_SWEPT}) WHERE is_primary""",
    "learned_stop_history": f"""SELECT route_id AS route, station_id AS station, hour, seen::INT AS observed, 0::BIGINT AS "at" FROM ({_SWEPT}) WHERE NOT is_primary""",
    "history_average": f"SELECT from_route, to_route, station, hour, avg(downstream_impact) AS average, count(downstream_impact) AS n FROM history WHERE \"at\" >= {_SINCE} GROUP BY ALL HAVING count(downstream_impact) > 0",
    "stop_history_average": f"SELECT route, station, hour, avg(observed) AS average, count(observed) AS n FROM stop_history WHERE \"at\" >= {_SINCE} GROUP BY ALL HAVING count(observed) > 0",
    "transfer_reliability": "SELECT station, hour, from_route, to_route, avg(downstream_impact) AS avg_delay, count(*) AS n, 0.0::FLOAT AS reliability_pct FROM history WHERE downstream_impact IS NOT NULL GROUP BY ALL",
}
