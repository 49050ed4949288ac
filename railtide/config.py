"""Configuration record: feeds, polling, topics and propagation parameters, with defaults for what is absent or zero."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Propagation:
    """Parameters of the delay cascade."""

    base_dwell: float = 30.0
    elasticity: float = 0.3
    load: float = 0.15
    decay: float = 0.7
    min_confidence: float = 0.2
    min_delay: int = 15
    max_depth: int = 5
    max_impacts: int = 100
    per_stop_min: int = 5
    shrink: int = 10
    min_transfer: int = 120

    @classmethod
    def of(cls, given: dict | None) -> "Propagation":
        """Absent, null and zero values take the default."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (given or {}).items() if k in known and v})


@dataclass(frozen=True)
class Feed:
    name: str
    url: str
    poll_interval: float = 15.0
    routes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    agency_id: str = ""
    feeds: tuple[Feed, ...] = ()
    polling_default_interval: float = 15.0
    kafka_brokers: tuple[str, ...] = ()
    kafka_topic: str = "delay-events"
    propagation: Propagation = field(default_factory=Propagation)


def seconds(text: str | float | int | None) -> float:
    """A duration such as 15s, 500ms, 2m or 1h in seconds; bare numbers are seconds; nothing is 0."""
    if text is None or text == "":
        return 0.0
    if isinstance(text, (int, float)):
        return float(text)
    for unit, scale in (("ms", 0.001), ("s", 1), ("m", 60), ("h", 3600)):
        if text.endswith(unit):
            return float(text[: -len(unit)]) * scale
    return float(text)


def load(path: str) -> Config:
    """Read a YAML file. A missing or malformed file is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    every = seconds(raw.get("polling_default_interval")) or 15.0
    feeds = tuple(
        Feed(x.get("name", ""), x.get("url", ""), seconds(x.get("poll_interval")) or every, tuple(x.get("routes") or ()))
        for x in raw.get("feeds") or ())
    return Config(raw.get("agency_id", ""), feeds, every, tuple(raw.get("kafka_brokers") or ()), raw.get("kafka_topic") or "delay-events",
                  Propagation.of(raw.get("propagation")))
