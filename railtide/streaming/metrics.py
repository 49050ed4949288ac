"""Run-time metrics: counters, gauges and histograms by label, as text for a scraper, fed by streaming listeners."""

from __future__ import annotations

import threading
from bisect import bisect_left
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQueryListener

#: Upper bounds in seconds of the usual latency histogram.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


class Metrics:
    """A registry. Names and labels are made by use; all methods may be called from any thread of the driver."""

    def __init__(self, prefix: str = "railtide_", buckets: tuple[float, ...] = BUCKETS):
        self.prefix, self.buckets = prefix, buckets
        self._lock = threading.Lock()
        self._values: dict[tuple[str, str], dict[tuple, float]] = {}
        self._histograms: dict[str, dict[tuple, list[float]]] = {}

    def add(self, name: str, by: float = 1, **labels: str) -> None:
        with self._lock:
            at = self._values.setdefault((name, "counter"), {})
            key = tuple(sorted(labels.items()))
            at[key] = at.get(key, 0) + by

    def set(self, name: str, value: float, **labels: str) -> None:
        with self._lock:
            self._values.setdefault((name, "gauge"), {})[tuple(sorted(labels.items()))] = value

    def observe(self, name: str, value: float, **labels: str) -> None:
        with self._lock:
            h = self._histograms.setdefault(name, {}).setdefault(tuple(sorted(labels.items())), [0.0] * (len(self.buckets) + 3))
            h[bisect_left(self.buckets, value)] += 1
            h[-2] += 1
            h[-1] += value

    def value(self, name: str, **labels: str) -> float:
        with self._lock:
            key = tuple(sorted(labels.items()))
            return next((v[key] for (n, _), v in self._values.items() if n == name and key in v), 0)

    def text(self) -> str:
        """The exposition format: a TYPE line per name and one line per label set; buckets are cumulative."""
        out = []
        with self._lock:
            for (name, kind), values in sorted(self._values.items()):
                out.append(f"# TYPE {self.prefix}{name} {kind}")
                out += [f"{self.prefix}{name}{_labels(k)} {v:g}" for k, v in sorted(values.items())]
            for name, series in sorted(self._histograms.items()):
                out.append(f"# TYPE {self.prefix}{name} histogram")
                for k, h in sorted(series.items()):
                    upto = 0.0
                    for bound, n in zip([*map(str, self.buckets), "+Inf"], h):
                        upto += n
                        out.append(f"{self.prefix}{name}_bucket{_labels((*k, ('le', bound)))} {upto:g}")
                    out += [f"{self.prefix}{name}_sum{_labels(k)} {h[-1]:g}", f"{self.prefix}{name}_count{_labels(k)} {h[-2]:g}"]
        return "\n".join(out) + "\n"

    def serve(self, port: int = 0) -> ThreadingHTTPServer:
        """Serve the text at /metrics from the driver; port 0 takes a free one."""
        metrics = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                body = metrics.text().encode() if self.path == "/metrics" else b""
                self.send_response(200 if body else 404)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_) -> None:
                pass

        server = ThreadingHTTPServer(("", port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server


def _labels(pairs: tuple) -> str:
    quoted = (str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") for _, v in pairs)
    return "{" + ",".join(f'{k}="{v}"' for (k, _), v in zip(pairs, quoted)) + "}" if pairs else ""


def counted(df: DataFrame, name: str, **counts: Column) -> DataFrame:
    """df with sums computed by the way in the executors (one pass, no extra job), reported under a name."""
    return df.observe(name, *(c.alias(k) for k, c in counts.items()))


class MetricsListener(StreamingQueryListener):
    """Feeds a registry: rows and batch durations per query, and everything that ``counted`` reports, as counters."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.metrics.add("queries_started", query=event.name or str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        query = p.name or str(p.id)
        self.metrics.add("input_rows", p.numInputRows, query=query)
        self.metrics.observe("batch_seconds", p.batchDuration / 1000, query=query)
        for name, row in (p.observedMetrics or {}).items():
            for k, v in row.asDict().items():
                self.metrics.add(f"{name}_{k}", v or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.metrics.add("queries_failed")
