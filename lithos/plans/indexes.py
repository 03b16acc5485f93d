"""Secondary indexes. An index is a written copy of ``(value, entity_id)`` for each
archetype, laid out for its kind: sorted ranges prune row groups by their
statistics, hashed files have bloom filters. A plan reads candidates from it and
checks them against the scan, so answers are exact."""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.errors import FormatError, UnregisteredComponent
from lithos.lineage import shared_folder
from lithos.sources import storage
from lithos.world import ID, World


@dataclass(frozen=True)
class Indexed:
    """Proof that a component has an index of a kind."""

    component: str
    kind: str


class SpatialIndex(Protocol):
    """A user's index: what it can serve, at what cost, and its candidates."""

    def supports(self, predicate: Any) -> float | None: ...

    def candidates(self, predicate: Any) -> DataFrame: ...


class ValueIndex:
    """Ordered (btree) or hashed multimap from values to entities."""

    def __init__(self, world: World, component: str, kind: str):
        if component not in world.types:
            raise UnregisteredComponent(component)
        self.world, self.component, self.kind = world, component, kind
        self.tick = 0
        self._parts: dict[Any, DataFrame] = {}
        self.rebuild()

    @property
    def witness(self) -> Indexed:
        return Indexed(self.component, self.kind)

    @property
    def frame(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, self._parts.values())

    def rebuild(self) -> None:
        self._parts = {}
        self.tick = -1
        self.update()

    def _sources(self) -> dict[Any, tuple[DataFrame, bool]]:
        """Rows by archetype, and whether they were written since."""
        if self.component in self.world.sparse:
            return {None: (self.world.iter_sparse(self.component).select("value", ID), True)}
        of = lambda a: a.frame.select(F.col(self.component).alias("value"), ID)
        found = {k: (of(a), self.world.changed(a, [self.component], self.tick)) for k, a in self.world.archetypes.items() if self.component in a.components}
        return found or {None: (self.world.scan([self.component]).select(F.col(self.component).alias("value"), ID), False)}

    def stale(self) -> bool:
        """Whether an archetype was written, came or went since."""
        now = self._sources()
        return set(now) != set(self._parts) or any(changed for _, changed in now.values())

    def update(self) -> bool:
        """Write anew what changed since, archetype by archetype; whether anything
        did."""
        now, old = self._sources(), self._parts
        wanted = [k for k, (_, changed) in now.items() if changed or k not in old]
        if not wanted and set(now) == set(old):
            return False
        self._parts = {k: self._write(rows) if k in wanted else old[k] for k, (rows, _) in now.items()}
        self.tick = self.world.tick
        return True

    def _write(self, rows: DataFrame) -> DataFrame:
        spark = self.world.spark
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        laid = rows.repartitionByRange("value").sortWithinPartitions("value") if self.kind == "btree" else rows.repartition("value")
        writer = laid.write
        if self.kind == "hash":
            writer = writer.option("parquet.bloom.filter.enabled#value", "true")
        writer.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def gather(self, predicate: Any) -> DataFrame:
        """Candidates of a predicate on the component."""
        rows = self.frame.select(F.col("value").alias(self.component), ID)
        return rows.where(predicate.test(self.world)).select(ID)

    def get(self, value: Any) -> DataFrame:
        return self.frame.where(F.col("value") == F.lit(value)).select(ID)

    def range(self, low: Any = None, high: Any = None) -> DataFrame:
        """Entities with ``low <= value < high``; hashed indexes have no order."""
        if self.kind != "btree":
            raise TypeError("a hash index has no ranges")
        test: Column = F.lit(True)
        if low is not None:
            test = test & (F.col("value") >= low)
        if high is not None:
            test = test & (F.col("value") < high)
        return self.frame.where(test).select(ID)

    def valid(self, ids: DataFrame) -> DataFrame:
        """Those that are alive and still have the component."""
        return ids.join(self.world.scan([self.component]).select(ID), ID, "left_semi")

    def contains(self, value: Any) -> bool:
        return not self.get(value).isEmpty()

    def __len__(self) -> int:
        return self.frame.select("value").distinct().count()

    def save(self, path: str) -> None:
        spark = self.world.spark
        writer = self.frame.write.mode("overwrite")
        if self.kind == "hash":
            writer = writer.option("parquet.bloom.filter.enabled#value", "true")
        writer.parquet(f"{path}.tmp/data")
        storage.write_text(spark, f"{path}.tmp/manifest.json", json.dumps({"component": self.component, "kind": self.kind, "type": self.world.types[self.component].json()}))
        storage.replace(spark, f"{path}.tmp", path)


def load_index(world: World, path: str, component: str, kind: str, tick: int) -> ValueIndex:
    """An index saved before; ``tick`` is the world's tick it was in step with."""
    storage.settled(world.spark, path)
    m = json.loads(storage.read_text(world.spark, f"{path}/manifest.json"))
    if (m["component"], m["kind"]) != (component, kind) or m["type"] != world.types[component].json():
        raise FormatError(f"{path} holds a {m['kind']} index of {m['component']}")
    out = ValueIndex.__new__(ValueIndex)
    out.world, out.component, out.kind, out.tick = world, component, kind, tick
    # One part for all archetypes: the next update lays it out by archetype.
    out._parts = {"saved": world.spark.read.parquet(f"{path}/data")}
    return out
