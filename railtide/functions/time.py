"""Time-of-day columns: seconds of a service day may exceed 86400."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def service_seconds(text: str | Column) -> Column:
    """Seconds of an HH:MM:SS string, hours beyond 24 allowed; null unless it has exactly three whole-number parts."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    p = F.split(t, ":")
    whole = t.rlike(r"^[+-]?[0-9]+:[+-]?[0-9]+:[+-]?[0-9]+$")
    return F.when(whole, F.get(p, F.lit(0)).try_cast("int") * 3600 + F.get(p, F.lit(1)).try_cast("int") * 60 + F.get(p, F.lit(2)).try_cast("int"))


def seconds_of_day(unix: str | Column, tz: str = "UTC") -> Column:
    """Wall-clock seconds since midnight in the agency's time zone."""
    u = F.col(unix) if isinstance(unix, str) else unix
    if tz == "UTC":
        return F.pmod(u, F.lit(DAY)).cast("int")
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.timestamp_seconds(u).cast("timestamp_ntz"))
    return (F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)).cast("int")


def clock(unix: str | Column, tz: str = "UTC") -> Column:
    """seconds_of_day where the time is set; 0 stays 0 (unset)."""
    u = F.col(unix) if isinstance(unix, str) else unix
    return F.when(F.coalesce(u, F.lit(0)) == 0, F.lit(0)).otherwise(seconds_of_day(u, tz)).cast("int")


def hour_of(secs: str | Column) -> Column:
    """Hour bucket 0 to 23 of seconds of a day."""
    s = F.col(secs) if isinstance(secs, str) else secs
    return F.pmod(F.floor(s / 3600), F.lit(24)).cast("int")


def confidence_bucket(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < 0.4, "0.2-0.4").when(c < 0.6, "0.4-0.6").when(c < 0.8, "0.6-0.8").otherwise("0.8-1.0")


def shorten(text: str | Column, most: int) -> Column:
    """The text, or its first most - 1 characters and an ellipsis."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)
