"""Fan-out of transfer impacts to subscribers, each with its own filter and a bounded buffer that drops when full."""

from __future__ import annotations

import queue
import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

BUFFER = 64


@dataclass(eq=False)
class Subscriber:
    """Impacts that touch one of the routes or stations, or all where neither is given."""

    routes: frozenset[str] = frozenset()
    stations: frozenset[str] = frozenset()
    size: int = BUFFER
    dropped: int = 0
    waiting: queue.Queue = field(init=False)

    def __post_init__(self) -> None:
        self.waiting = queue.Queue(self.size)

    def wants(self, impact: Row) -> bool:
        if not self.routes and not self.stations:
            return True
        return impact["from_route_id"] in self.routes or impact["to_route_id"] in self.routes or impact["station_id"] in self.stations

    def offer(self, impact: Row) -> bool:
        try:
            self.waiting.put_nowait(impact)
            return True
        except queue.Full:
            self.dropped += 1
            return False

    def drain(self) -> list[Row]:
        out = []
        while not self.waiting.empty():
            out.append(self.waiting.get_nowait())
        return out


class AlertHub:
    """The subscribers of a running stream; impacts of a micro-batch pass through the driver one by one, never held."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._subscribers: list[Subscriber] = []

    def subscribe(self, routes: list[str] = (), stations: list[str] = (), size: int = BUFFER) -> Subscriber:
        s = Subscriber(frozenset(routes), frozenset(stations), size)
        with self._lock:
            self._subscribers.append(s)
        return s

    def leave(self, subscriber: Subscriber) -> None:
        with self._lock:
            self._subscribers = [s for s in self._subscribers if s is not subscriber]

    def publish(self, impacts: DataFrame) -> tuple[int, int]:
        """(delivered, dropped) over all subscribers. Only impacts that some subscriber wants come to the driver."""
        from pyspark.sql import functions as F

        with self._lock:
            now = list(self._subscribers)
        if not now:
            return 0, 0
        if all(s.routes or s.stations for s in now):
            routes, stations = sorted({r for s in now for r in s.routes}), sorted({x for s in now for x in s.stations})
            impacts = impacts.where(F.col("from_route_id").isin(routes) | F.col("to_route_id").isin(routes) | F.col("station_id").isin(stations))
        sent = lost = 0
        for impact in impacts.toLocalIterator():
            for s in now:
                if s.wants(impact):
                    ok = s.offer(impact)
                    sent, lost = sent + ok, lost + (not ok)
        return sent, lost
