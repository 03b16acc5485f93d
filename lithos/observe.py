"""Metrics: snapshots of a world, their differences, and Prometheus text."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import types as T

from lithos.world import World

_BYTES = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.LongType: 8, T.DoubleType: 8}


def width(kind: T.DataType) -> int:
    """Bytes of a value, about; 16 for what has no fixed width."""
    if isinstance(kind, T.StructType):
        return sum(width(f.dataType) for f in kind.fields)
    return _BYTES.get(type(kind), 16)


@dataclass
class MetricsSnapshot:
    entities: int
    archetypes: int
    components: int
    tick: int
    spawned: int
    despawned: int
    wal_seq: int
    wal_bytes: int
    by_archetype: dict[str, tuple[int, int]]
    at: float = field(default_factory=time.time)

    @staticmethod
    def capture(world: World, wal=None) -> MetricsSnapshot:
        counts = {r[0]: r[1] for r in world.counts().collect()}  # a row for each archetype
        by = {a.name: (counts.get(a.name, 0), counts.get(a.name, 0) * (8 + sum(width(world.types[c]) for c in a.components))) for a in world.archetypes.values()}
        return MetricsSnapshot(
            sum(n for n, _ in by.values()), len(by), len(world.types), world.tick, world.spawned, world.despawned, wal.next_seq if wal else 0, wal.bytes() if wal else 0, by
        )


@dataclass
class MetricsDiff:
    entity_delta: int
    churn: int
    tick_delta: int
    archetype_delta: int
    wal_seq_delta: int
    wal_bytes_delta: int
    seconds: float
    largest: list[tuple[str, int]]

    @staticmethod
    def compute(old: MetricsSnapshot, new: MetricsSnapshot) -> MetricsDiff:
        top = sorted(((k, n) for k, (n, _) in new.by_archetype.items()), key=lambda x: (-x[1], x[0]))[:5]
        return MetricsDiff(
            new.entities - old.entities, new.spawned - old.spawned + new.despawned - old.despawned, new.tick - old.tick, new.archetypes - old.archetypes,
            new.wal_seq - old.wal_seq, new.wal_bytes - old.wal_bytes, new.at - old.at, top,
        )


class PrometheusExporter:
    """Gauges of the last snapshot and of its difference to the one before."""

    def __init__(self, prefix: str = "lithos"):
        self.prefix = prefix
        self._last: MetricsSnapshot | None = None
        self._diff: MetricsDiff | None = None

    def update(self, snapshot: MetricsSnapshot) -> None:
        self._diff = MetricsDiff.compute(self._last, snapshot) if self._last else None
        self._last = snapshot

    def render(self) -> str:
        s, d, out = self._last, self._diff, []
        if s is None:
            return ""

        def gauge(name: str, text: str, *values: tuple[str, float]) -> None:
            out.extend([f"# HELP {self.prefix}_{name} {text}", f"# TYPE {self.prefix}_{name} gauge"])
            out.extend(f"{self.prefix}_{name}{labels} {value}" for labels, value in values)

        gauge("entities", "Live entities", ("", s.entities))
        gauge("archetypes", "Archetypes", ("", s.archetypes))
        gauge("components", "Registered components", ("", s.components))
        gauge("tick", "Change tick", ("", s.tick))
        gauge("spawned", "Entities spawned", ("", s.spawned))
        gauge("despawned", "Entities despawned", ("", s.despawned))
        gauge("wal_seq", "Next log record", ("", s.wal_seq))
        gauge("wal_bytes", "Bytes since the last checkpoint", ("", s.wal_bytes))
        gauge("entity_delta", "Entities since the last snapshot", ("", d.entity_delta if d else 0))
        gauge("churn", "Spawns and despawns since the last snapshot", ("", d.churn if d else 0))
        gauge("tick_delta", "Ticks since the last snapshot", ("", d.tick_delta if d else 0))
        gauge("archetype_delta", "Archetypes since the last snapshot", ("", d.archetype_delta if d else 0))
        gauge("wal_seq_delta", "Log records since the last snapshot", ("", d.wal_seq_delta if d else 0))
        quoted = {k: k.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") for k in s.by_archetype}
        gauge("archetype_entities", "Live entities of an archetype", *((f'{{archetype="{quoted[k]}"}}', n) for k, (n, _) in sorted(s.by_archetype.items())))
        gauge("archetype_bytes", "Bytes of an archetype, about", *((f'{{archetype="{quoted[k]}"}}', b) for k, (_, b) in sorted(s.by_archetype.items())))
        return "\n".join(out) + "\n"
