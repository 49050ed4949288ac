"""Real-time feed source: trip updates of protobuf feed messages, read from URLs or files as batch or stream.

The messages are decoded from the wire format directly, so no generated classes are needed. Each poll of a feed gives
its trip updates in the layout of schema.FEED; observed_at is the message's own time, else the time of the poll. A poll
that fails (no answer within ten seconds, a status other than 200, an undecodable message) is left out.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from railtide import schema

TIMEOUT = 10
# Field numbers and enumerations of the public real-time feed format.
HEADER, ENTITY = 1, 2
HEADER_TIME = 3
ENTITY_TRIP_UPDATE = 3
UPDATE_TRIP, UPDATE_STOP = 1, 2
TRIP_ID, TRIP_RELATIONSHIP, TRIP_ROUTE = 1, 4, 5
STOP_ARRIVAL, STOP_DEPARTURE, STOP_ID, STOP_RELATIONSHIP = 2, 3, 4, 5
EVENT_DELAY, EVENT_TIME = 1, 2
TRIP_RELATIONSHIPS = {0: "SCHEDULED", 1: "ADDED", 2: "UNSCHEDULED", 3: "CANCELED"}
STOP_RELATIONSHIPS = {0: "SCHEDULED", 1: "SKIPPED", 2: "NO_DATA"}


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("cut-off number")
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: whole numbers, or the bytes of strings and inner messages."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + n], "little"), at + n
        else:
            raise ValueError(f"wire type {kind}")
        if at > len(data):
            raise ValueError("cut-off field")
        yield tag >> 3, value


def signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def _event(data: bytes | None) -> dict | None:
    if data is None:
        return None
    got = dict(fields(data))
    return {"delay": signed(got[EVENT_DELAY], 32) if EVENT_DELAY in got else None, "time": signed(got[EVENT_TIME], 64) if EVENT_TIME in got else None}


def _text(x: bytes | None) -> str:
    return (x or b"").decode("utf-8", "replace")


def decode(data: bytes, feed_id: str, poll_no: int, now: int) -> list[tuple]:
    """Rows of schema.FEED from one feed message; ValueError if it can't be decoded."""
    observed, updates = 0, []
    for number, value in fields(data):
        if number == HEADER:
            observed = dict(fields(value)).get(HEADER_TIME, 0)
        elif number == ENTITY:
            updates += [v for n, v in fields(value) if n == ENTITY_TRIP_UPDATE]
    out = []
    for u in updates:
        trip, stops = None, []
        for number, value in fields(u):
            if number == UPDATE_TRIP:
                t = dict(fields(value))
                trip = (_text(t.get(TRIP_ID)), _text(t.get(TRIP_ROUTE)), TRIP_RELATIONSHIPS.get(t.get(TRIP_RELATIONSHIP, 0), "SCHEDULED"))
            elif number == UPDATE_STOP:
                s = dict(fields(value))
                a, d = _event(s.get(STOP_ARRIVAL)), _event(s.get(STOP_DEPARTURE))
                stops.append((_text(s.get(STOP_ID)), STOP_RELATIONSHIPS.get(s.get(STOP_RELATIONSHIP, 0), "SCHEDULED"), a and (a["delay"], a["time"]), d and (d["delay"], d["time"])))
        out.append((feed_id, poll_no, observed or now, trip, stops))
    return out


def fetch(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=TIMEOUT) as r:  # noqa: S310 - the urls are configured
        if getattr(r, "status", 200) not in (200, None):
            raise OSError(f"status {r.status}")
        return r.read()


def poll(feed_id: str, url: str, poll_no: int) -> list[tuple]:
    """The updates of one poll; a poll that fails is one row without a trip, so that failures can be counted."""
    now = int(time.time())
    try:
        return decode(fetch(url), feed_id, poll_no, now)
    except (OSError, ValueError):
        return [(feed_id, poll_no, now, None, None)]


def failures(feed: DataFrame) -> DataFrame:
    """(feed_id, poll_no, observed_at) of polls that failed."""
    return feed.where("trip is null and stop_time_update is null").select("feed_id", "poll_no", "observed_at")


class FeedSource(DataSource):
    """format("railtide_feed") with option feeds: a JSON object of feed id to URL."""

    @classmethod
    def name(cls) -> str:
        return "railtide_feed"

    def schema(self) -> str:
        return schema.FEED

    def reader(self, schema):  # noqa: ARG002
        return FeedReader(json.loads(self.options["feeds"]))

    def streamReader(self, schema):  # noqa: ARG002, N802
        return FeedStream(json.loads(self.options["feeds"]))


class FeedReader(DataSourceReader):
    def __init__(self, feeds: dict[str, str]):
        self.feeds = feeds

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((k, v)) for k, v in sorted(self.feeds.items())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from poll(*partition.value, 0)


class FeedStream(DataSourceStreamReader):
    """One poll of every feed per micro-batch, each in its own task. The offset is the time of the poll in milliseconds, so
    a restarted stream goes on. A poll can't be repeated: a lost one is polled anew, and the differ drops what is known."""

    def __init__(self, feeds: dict[str, str]):
        self.feeds = feeds

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def latestOffset(self, *_) -> dict:  # noqa: N802
        return {"poll": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:  # noqa: ARG002
        return [InputPartition((k, v, end["poll"])) for k, v in sorted(self.feeds.items())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from poll(*partition.value)
