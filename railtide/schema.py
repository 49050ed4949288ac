"""Spark schemas of the timetable, the event streams and the learned tables."""

STOPS = "stop_id string, stop_name string, stop_lat double, stop_lon double, location_type int, parent_station string"
ROUTES = "route_id string, short_name string, long_name string, color string"
TRIPS = "trip_id string, route_id string, service_id string, direction_id int"
STOP_TIMES = "trip_id string, stop_id string, arrival_secs int, departure_secs int, stop_sequence int"
TRANSFERS = "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int"
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
CALENDAR = "service_id string, " + ", ".join(f"{d} string" for d in DAYS) + ", start_date string, end_date string"
CALENDAR_DATES = "service_id string, date string, exception_type string"
STOP_TIME_EVENT = "struct<delay: int, time: long>"
TRIP_UPDATE = (
    "trip struct<trip_id: string, route_id: string, schedule_relationship: string>, "
    f"stop_time_update array<struct<stop_id: string, schedule_relationship: string, arrival: {STOP_TIME_EVENT}, departure: {STOP_TIME_EVENT}>>"
)
FEED = f"feed_id string, poll_no long, observed_at long, {TRIP_UPDATE}"
DELAY_EVENT = ("agency_id string, trip_id string, route_id string, stop_id string, delay_seconds int, observed_at long, "
               "scheduled_arrival long, predicted_arrival long, type string")
DELAY_STATE = ("agency_id string, trip_id string, route_id string, stop_id string, delay_seconds int, observed_at long, "
               "confidence double, update_count int")
IMPACT = ("from_trip_id string, from_route_id string, to_route_id string, station_id string, source_delay_seconds int, "
          "original_transfer_margin_seconds int, remaining_margin_seconds int, level string, detected_at long, next_viable_trip_id string, "
          "additional_wait_seconds int, sched_connection_departure_secs int, earliest_catch_secs int")
DOWNSTREAM = "impact_id string, position int, route_id string, stop_id string, predicted_additional_delay int, confidence float, hops_from_source int, impact_type string"
PENDING = ("id string, agency_id string, from_route string, route_id string, station_id string, source_station string, direction int, "
           "source_delay_secs int, predicted_secs int, baseline_secs int, sched_conn_dep_secs int, earliest_catch_secs int, confidence double, "
           "hops int, hour int, is_primary boolean, created_at long, expires_at long, observed_max int, matched boolean")
HISTORY = "from_route string, to_route string, station string, hour int, source_delay int, downstream_impact int, at long"
STOP_HISTORY = "route string, station string, hour int, observed int, at long"
