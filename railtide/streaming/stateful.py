"""Stateful stream operators: the differ and the reconciled state, each keyed so that one task owns a key's state.

Both use applyInPandasWithState: a key's state travels with its rows of a micro-batch, once in and once out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from railtide.operators.events import THRESHOLD, UNSEEN
from railtide.operators.state import CLOSE, EARLY, JUMP, TTL

DIFF_OUT = "feed_id string, polled_at long, trip_id string, stop_id string, delay_seconds long, predicted_arrival long, type string"
DIFF_STATE = "delay long, predicted long, type string, seen long"
STATE_OUT = "seq long, agency_id string, trip_id string, stop_id string, op string, delay_seconds int, observed_at long, confidence double, update_count int"
STATE_STATE = "stops string"


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _gather(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch in order; their number is bounded by the trigger's limit."""
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


def _diff(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held = state.get if state.exists else None
    out = []
    for at, poll in _gather(rows, ["polled_at", "delay_seconds", "predicted_arrival", "type"]).groupby("polled_at", sort=True):
        base = held if held is None or at - held[3] <= UNSEEN else None
        for r in poll.itertuples(index=False):
            d, p = int(r.delay_seconds), int(r.predicted_arrival)
            if base is None or base[2] != r.type or abs(base[0] - d) > THRESHOLD or abs(base[1] - p) > THRESHOLD:
                out.append((key[0], int(at), key[1], key[2], d, p, r.type))
                held = (d, p, r.type, int(at))
        held = (*held[:3], int(at))
    state.update(held)
    state.setTimeoutDuration(UNSEEN * 1000)
    yield pd.DataFrame(out, columns=_names(DIFF_OUT))


def _reconcile(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    now = state.getCurrentProcessingTimeMs() // 1000
    stops = json.loads(state.get[0]) if state.exists else {}
    stops = {s: v for s, v in stops.items() if now - v[4] <= TTL}
    out = []
    for r in _gather(rows, ["seq"]).itertuples(index=False):
        if r.type == "TRIP_CANCELLED":
            stops = {}
            continue
        if r.type == "SKIP_STOP":
            stops.pop(r.stop_id, None)
            continue
        if pd.isna(r.delay_seconds) or pd.isna(r.observed_at):
            continue
        x, at = int(r.delay_seconds), int(r.observed_at)
        new = (x, at, 0.5, 1)
        if r.stop_id in stops:
            d, seen, conf, n, _ = stops[r.stop_id]
            if at < seen:
                out.append((int(r.seq), *key, r.stop_id, "drop", None, None, None, None))
                continue
            v = x * 0.7 + d * 0.3
            kept = int(abs(v) + 0.5) * (1 if v >= 0 else -1) if abs(x - d) > JUMP and n < EARLY else x
            new = (kept, at, min(1.0, conf + 0.1) if abs(x - d) <= CLOSE else 0.5, n + 1)
        stops[r.stop_id] = (*new, now)
        out.append((int(r.seq), *key, r.stop_id, "upsert", *new))
    state.update((json.dumps(stops),))
    state.setTimeoutDuration(TTL * 1000)
    b = pd.DataFrame(out, columns=_names(STATE_OUT))
    yield b.astype({"delay_seconds": "Int32", "observed_at": "Int64", "update_count": "Int32"})


def diff_stream(polls: DataFrame) -> DataFrame:
    """What moved by more than 15 s against what was last published; keys unseen for 30 minutes are forgotten.

    ``polls``: feed_id, polled_at, trip_id, stop_id, delay_seconds, predicted_arrival, type (no nulls in the numbers).
    """
    return polls.groupBy("feed_id", "trip_id", "stop_id").applyInPandasWithState(_diff, DIFF_OUT, DIFF_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def reconcile_stream(events: DataFrame) -> DataFrame:
    """The changelog of stored delays: out-of-order events dropped, jumps smoothed, entries expired two hours after they
    were last written. A cancelled trip clears all its stops, which is why the key is the trip.

    ``events``: seq, agency_id, trip_id, stop_id, delay_seconds, observed_at, type.
    """
    return events.groupBy("agency_id", "trip_id").applyInPandasWithState(_reconcile, STATE_OUT, STATE_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
