"""Mutation logs: buffered ops, their order, and folding a log to a state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.errors import AlreadyPlaced, DeadEntity, LithosError, UnregisteredComponent
from lithos.world import World


@dataclass(frozen=True)
class Mutation:
    """spawn, despawn, insert, remove, sparse_insert or sparse_remove."""

    op: str
    entity: int
    values: tuple[tuple[str, Any], ...] = ()


class ChangeSet:
    """Ops in order; used alone or as a transaction's buffer."""

    def __init__(self) -> None:
        self.ops: list[Mutation] = []

    def spawn(self, entity: int, **values: Any) -> None:
        self.ops.append(Mutation("spawn", entity, tuple(values.items())))

    def despawn(self, entity: int) -> None:
        self.ops.append(Mutation("despawn", entity))

    def insert(self, entity: int, **values: Any) -> None:
        self.ops.append(Mutation("insert", entity, tuple(values.items())))

    def remove(self, entity: int, component: str) -> None:
        self.ops.append(Mutation("remove", entity, ((component, None),)))

    def sparse_insert(self, entity: int, component: str, value: Any) -> None:
        self.ops.append(Mutation("sparse_insert", entity, ((component, value),)))

    def sparse_remove(self, entity: int, component: str) -> None:
        self.ops.append(Mutation("sparse_remove", entity, ((component, None),)))

    def __iter__(self) -> Iterator[Mutation]:
        return iter(self.ops)

    def __len__(self) -> int:
        return len(self.ops)

    def apply(self, world: World) -> None:
        """In order, as one step: what every entity ends as is found on the
        driver, where the ops are, and each archetype is edited once. An op on a
        dead entity, or a spawn of a live one, is an error; the ops before it are
        applied."""
        if not self.ops:
            return
        found = world.locate({m.entity for m in self.ops})
        states = {e: _State(found.get(e)) for e in {m.entity for m in self.ops}}
        sparse: dict[str, dict[int, tuple[Any, ...]]] = {}
        failure: Exception | None = None
        for m in self.ops:
            try:
                self._step(world, m, states[m.entity], sparse)
            except LithosError as e:
                failure = e
                break
        world.settle({e: s for e, s in states.items() if s.touched}, sparse)
        if failure is not None:
            raise failure

    @staticmethod
    def _step(world: World, m: Mutation, s: _State, sparse: dict[str, dict[int, tuple[Any, ...]]]) -> None:
        values = dict(m.values)
        if m.op == "spawn":
            if s.alive:
                raise AlreadyPlaced(str(m.entity))
            world.admit(values)
            world.allocator.observe(m.entity)
            s.alive, s.born, s.components, s.values = True, True, frozenset(values), values
        elif not s.alive:
            raise DeadEntity(str(m.entity))
        elif m.op == "despawn":
            s.alive, s.components, s.values = False, frozenset(), {}
            world.allocator.free(m.entity)
            world.despawned += 1
            for name in {*world.sparse, *sparse}:
                sparse.setdefault(name, {})[m.entity] = ()
        elif m.op == "insert":
            world.known(values)
            s.components, s.values = s.components | set(values), {**s.values, **values}
        elif m.op == "sparse_insert":
            ((name, value),) = m.values
            if name not in world.sparse_types:
                raise UnregisteredComponent(name)
            sparse.setdefault(name, {})[m.entity] = (value,)
            return
        else:
            name = m.values[0][0]
            if name in world.sparse or name in sparse:
                sparse.setdefault(name, {})[m.entity] = ()
                return
            s.components = s.components - {name}
            s.values = {k: v for k, v in s.values.items() if k != name}
        s.touched = True


class _State:
    """What an entity is after some ops. ``origin`` is the archetype that has its
    row; a row of its own is made if it was born since."""

    def __init__(self, origin: tuple[str, frozenset[str]] | None):
        self.origin, self.alive, self.born, self.touched = origin, origin is not None, False, False
        self.components: frozenset[str] = origin[1] if origin else frozenset()
        self.values: dict[str, Any] = {}


class CommandBuffer(ChangeSet):
    """Deferred ops, applied and emptied together."""

    def flush(self, world: World) -> None:
        done = ChangeSet()
        done.ops, self.ops = self.ops, []
        done.apply(world)


def fold_last(log: DataFrame, entity: str, order: list[str], op: str, despawn: str) -> DataFrame:
    """State after replay where every record sets the whole entity: the last one
    wins, and entities whose last record despawns them are gone. One partially
    aggregated pass: no window, so a hot entity costs no sort."""
    rest = [c for c in log.columns if c != entity]
    last = log.groupBy(entity).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l"))
    return last.select(entity, *[F.col("_l")[c].alias(c) for c in rest]).where(F.col(op) != despawn)


def fold(log: DataFrame) -> DataFrame:
    """``seq, ord, op, entity_id, component, payload`` to the surviving
    ``entity_id, component, payload``: records up to an entity's last spawn or
    despawn are cut off, then the last writer of each component wins."""
    at = F.struct("seq", "ord")
    ends = log.groupBy("entity_id").agg(
        F.max(F.when(F.col("op") == "despawn", at)).alias("_gone"), F.max(F.when(F.col("op") == "spawn", at)).alias("_born")
    )
    live = log.where("op <> 'despawn' AND component IS NOT NULL").join(ends, "entity_id").where((F.col("_gone").isNull() | (at > F.col("_gone"))) & (F.col("_born").isNull() | (at >= F.col("_born")) | (F.col("_gone").isNull())))
    last = live.groupBy("entity_id", "component").agg(F.max_by(F.struct("op", "payload"), at).alias("_l"))
    return last.where("_l.op NOT IN ('remove', 'sparse_remove')").select("entity_id", "component", F.col("_l.payload").alias("payload"))
