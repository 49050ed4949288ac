"""Columns for ids and routes as every operator compares them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
MEASURED = ("ARRIVAL_DELAY", "DEPARTURE_DELAY")


def clean(c: str | Column) -> Column:
    """The id without surrounding blanks; null stays null."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def route_from_trip(trip: str | Column) -> Column:
    """Text after the first '_' up to the next '.'; without an inner '_' the id itself."""
    t = F.col(trip) if isinstance(trip, str) else trip
    at = F.instr(t, "_")
    return F.when((at == 0) | (at == F.length(t)), t).otherwise(
        F.substring_index(F.substr(t, at + 1), ".", 1)
    )


def route(route_id: str | Column = "route_id", trip: str | Column = "trip_id") -> Column:
    """route_id, or where it is unset the route written in the trip id."""
    own = F.coalesce(clean(route_id), F.lit(""))
    return F.when(own == "", route_from_trip(clean(trip))).otherwise(own)


def is_measurement(type_col: str = "type", delay_col: str = "delay_seconds") -> Column:
    return F.col(type_col).isin(*MEASURED) & F.col(delay_col).isNotNull()
