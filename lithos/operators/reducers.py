"""Reducers: registered functions with declared access, and retention."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.errors import AccessViolation, UnregisteredComponent, WrongKind
from lithos.operators.transactions import Access, Tx
from lithos.world import ID, Term, World, terms_of

#: What a reducer is given: one entity to read or write, a spawner, a query to
#: read or to write through a buffer or in place, or everything by name.
TRANSACTIONAL = ("entity_ref", "entity_mut", "spawner", "query_writer")
SCHEDULED = ("query_ref", "query_mut")
KINDS = (*TRANSACTIONAL, *SCHEDULED, "dynamic")


@dataclass
class Reducer:
    name: str
    kind: str
    body: Callable[..., Any]
    terms: tuple[Term, ...]
    access: Access
    last_read: int = 0


class QueryWriter:
    """Reads the state before, buffers whole-column writes: in a transaction
    into it, else until `commit`."""

    def __init__(self, world: World, reducer: Reducer, tx: Tx | None = None):
        self.world, self.reducer, self.tx = world, reducer, tx
        self.frame = tx.scan(reducer.terms, reducer.last_read) if tx else world.scan(reducer.terms, reducer.last_read)
        self.iterated = False
        self._writes: list[DataFrame] = []

    def rows(self) -> DataFrame:
        self.iterated = True
        return self.frame

    def set(self, values: DataFrame) -> None:
        """``entity_id`` and the components to write."""
        extra = {c for c in values.columns if c != ID} - self.reducer.access.writes
        if extra:
            raise AccessViolation(f"{self.reducer.name} did not declare {', '.join(sorted(extra))}")
        if self.tx:
            self.tx.write_frame(values)
        else:
            self._writes.append(values)

    def modify(self, **columns) -> None:
        """Each component from an expression over the state before."""
        rows = self.rows()
        self.set(rows.select(ID, *[e.alias(c) for c, e in columns.items()]))

    def commit(self) -> None:
        for values in self._writes:
            self.world.insert_batch(values)
        self._writes = []


class ReducerRegistry:
    """Named reducers of one world's components."""

    def __init__(self) -> None:
        self._by_name: dict[str, Reducer] = {}

    def register(self, name: str, kind: str, body: Callable[..., Any], *terms: str | Term, reads: tuple[str, ...] = (), writes: tuple[str, ...] = (), despawns: bool = False) -> str:
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        if name in self._by_name:
            raise ValueError(f"{name} is registered")
        ts = terms_of(terms)
        seen = frozenset(reads) | {t.component for t in ts if t.kind != "mut"}
        wrote = frozenset(writes) | {t.component for t in ts if t.kind == "mut"}
        self._by_name[name] = Reducer(name, kind, body, ts, Access(seen, wrote, despawns))
        return name

    def __getitem__(self, name: str) -> Reducer:
        return self._by_name[name]

    def names(self) -> list[str]:
        return list(self._by_name)

    def access(self, name: str) -> Access:
        return self._by_name[name].access

    def call(self, strategy, world: World, name: str, **args: Any) -> Any:
        """In a transaction of the strategy. The read tick moves only after
        success, and for a query writer only if it looked at its rows."""
        r = self._of_kind(world, name, TRANSACTIONAL, "call")
        looked = []

        def body(tx: Tx) -> Any:
            looked.clear()
            if r.kind != "query_writer":
                looked.append(True)
                return r.body(DynamicCtx(tx, r.access), **args)
            w = QueryWriter(world, r, tx)
            out = r.body(w, **args)
            looked.extend([True] * w.iterated)
            return out

        out = strategy.transact(world, body, r.access)
        if looked:
            r.last_read = world.tick
        return out

    def run(self, world: World, name: str, **args: Any) -> Any:
        """As a scheduler does: on whole columns, without a transaction."""
        r = self._of_kind(world, name, SCHEDULED, "run")
        if r.kind == "query_ref":
            out = r.body(world.scan(r.terms, r.last_read), **args)
            r.last_read = world.tick
            return out
        w = QueryWriter(world, r)
        out = r.body(w, **args)
        w.commit()
        if w.iterated:
            r.last_read = world.tick
        return out

    def dynamic_call(self, strategy, world: World, name: str, **args: Any) -> Any:
        """Access is checked by name when it happens."""
        r = self._of_kind(world, name, ("dynamic",), "dynamic_call")
        out = strategy.transact(world, lambda tx: r.body(DynamicCtx(tx, r.access), **args), r.access)
        r.last_read = world.tick
        return out

    def _of_kind(self, world: World, name: str, kinds: tuple[str, ...], how: str) -> Reducer:
        r = self._by_name[name]
        if r.kind not in kinds:
            raise WrongKind(f"{name} is {r.kind}; {how} takes {', '.join(kinds)}")
        self._known(world, r)
        return r

    def _known(self, world: World, r: Reducer) -> None:
        missing = [t.component for t in r.terms if t.component not in world.types]
        if missing:
            raise UnregisteredComponent(", ".join(missing))


class DynamicCtx:
    """A transaction that refuses undeclared components."""

    def __init__(self, tx: Tx, access: Access):
        self._tx, self._access = tx, access

    def _may(self, component: str, write: bool) -> None:
        if component not in self._access.writes and (write or component not in self._access.reads):
            raise AccessViolation(component)

    def read(self, entity: int, component: str) -> Any:
        self._may(component, False)
        return self._tx.read(entity, component)

    def write(self, entity: int, **values: Any) -> None:
        for c in values:
            self._may(c, True)
        self._tx.write(entity, **values)

    def remove(self, entity: int, component: str) -> None:
        self._may(component, True)
        self._tx.remove(entity, component)

    def spawn(self, **values: Any) -> int:
        return self._tx.spawn(**values)

    def despawn(self, entity: int) -> None:
        if not self._access.despawns:
            raise AccessViolation("despawn")
        self._tx.despawn(entity)

    def query(self, *terms: str | Term) -> DataFrame:
        for t in terms_of(terms):
            self._may(t.component, False)
        return self._tx.query(*terms)


def countdown(rows: DataFrame, expiry: str, runs: int = 1) -> DataFrame:
    """State after so many retention runs: each subtracts one and removes what
    reaches 0, so 0 and 1 both go on the next run."""
    return rows.withColumn(expiry, F.greatest(F.col(expiry) - runs, F.lit(0))).where(F.col(expiry) > 0)


def run_retention(world: World, expiry: str = "Expiry") -> int:
    """One run over the world; how many entities went. Those without the
    component stay."""
    gone = world.scan([expiry]).where(F.col(expiry) <= 1).select(ID)
    n = world.despawn(gone)
    rest = world.scan([expiry])
    if not rest.isEmpty():
        world.insert_batch(rest.select(ID, (F.col(expiry) - 1).cast(world.types[expiry]).alias(expiry)))
    return n
