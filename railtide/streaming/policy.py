"""Operating policy of streams: catch-up mode, load shedding, retries, throughput and lag."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

ENTER, LEAVE = 1000, 100


class CatchUp:
    """Whether to skip detection and cascades: on above 1000 messages of lag, off again below 100."""

    def __init__(self, enter: int = ENTER, leave: int = LEAVE):
        self.enter, self.leave, self.on = enter, leave, False

    def update(self, lag: int) -> bool:
        if lag > self.enter:
            self.on = True
        elif lag < self.leave:
            self.on = False
        return self.on


class Shedder:
    """Room for so many cascades at a time; what comes while all places are taken is shed, and counted."""

    def __init__(self, places: int = 32):
        self._free = threading.BoundedSemaphore(places)
        self._lock = threading.Lock()
        self.ran = self.shed = 0

    def run(self, work: Callable, *args) -> bool:
        """Start work on a thread of its own if there is a place; False where it was shed."""
        if not self._free.acquire(blocking=False):
            with self._lock:
                self.shed += 1
            return False

        def held() -> None:
            try:
                work(*args)
            finally:
                self._free.release()

        with self._lock:
            self.ran += 1
        threading.Thread(target=held, daemon=True).start()
        return True


def total_lag(lags: dict[object, int]) -> int:
    return sum(lags.values())


def retry(f: Callable, attempts: int = 3, base: float = 0.2, sleep: Callable[[float], None] = time.sleep):
    """Call until it succeeds, waiting 200 ms and then twice as long each time; the last error is raised."""
    for k in range(attempts):
        try:
            return f()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(base * 2**k)


class Throughput(StreamingQueryListener):
    """Rows seen per query, as totals and since the last report, and batch durations."""

    def __init__(self) -> None:
        self.total: dict[str, int] = {}
        self.reported: dict[str, int] = {}
        self.durations: dict[str, list[int]] = {}
        self.began = time.monotonic()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.total.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.total[str(p.id)] = self.total.get(str(p.id), 0) + int(p.numInputRows)
        self.durations.setdefault(str(p.id), []).append(int(p.batchDuration))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def report(self) -> dict[str, tuple[int, int, float]]:
        """Query id to rows in total, rows since the last report, and rows a second."""
        took = max(1e-9, time.monotonic() - self.began)
        out = {q: (n, n - self.reported.get(q, 0), n / took) for q, n in self.total.items()}
        self.reported = dict(self.total)
        return out
