"""The world: entities as rows, components as columns, one frame for each
component set, and the ticks at which its columns were written last.

Frames are lazy; only catalogs, ticks and single-row edits live on the driver.
``compact`` cuts the lineage that edits build up."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.entity import EntityAllocator
from lithos.errors import DeadEntity, PoolExhausted, UnregisteredComponent
from lithos.lineage import cut

ID = "entity_id"


@dataclass(frozen=True)
class Term:
    """One term of a query. ``kind`` is with, opt, changed, mut or entity."""

    component: str
    kind: str = "with"

    @property
    def required(self) -> bool:
        return self.kind in ("with", "changed", "mut")


def With(name: str) -> Term:  # noqa: N802
    return Term(name)


def Opt(name: str) -> Term:  # noqa: N802
    return Term(name, "opt")


def Changed(name: str) -> Term:  # noqa: N802
    return Term(name, "changed")


def Mut(name: str) -> Term:  # noqa: N802
    return Term(name, "mut")


def terms_of(terms: Iterable[str | Term]) -> tuple[Term, ...]:
    return tuple(t if isinstance(t, Term) else Term(t) for t in terms)


@dataclass
class Archetype:
    """All entities with exactly these components."""

    components: frozenset[str]
    frame: DataFrame
    name: str
    ticks: dict[str, int] = field(default_factory=dict)


@dataclass
class WorldStats:
    archetypes: int
    entities: int
    components: int
    tick: int


class World:
    """Catalog of archetypes over one Spark session."""

    def __init__(self, spark: SparkSession, memory_budget: int | None = None):
        self.spark = spark
        self.id = uuid.uuid4().hex
        self.tick = 0
        self.types: dict[str, T.DataType] = {}
        self.archetypes: dict[tuple[str, frozenset[str]], Archetype] = {}
        self.sparse: dict[str, DataFrame] = {}
        self.sparse_types: dict[str, T.DataType] = {}
        self.allocator = EntityAllocator()
        self.memory_budget = memory_budget
        self.spawned = self.despawned = 0
        self._read_ticks: dict[tuple[Term, ...], int] = {}
        self._rows_budgeted = 0

    # ------------------------------------------------------------- catalog

    def advance(self) -> int:
        self.tick += 1
        return self.tick

    def register(self, name: str, kind: T.DataType | str) -> None:
        kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
        if self.types.setdefault(name, kind) != kind:
            raise UnregisteredComponent(f"{name} is registered as {self.types[name].simpleString()}")

    def add_table(self, name: str, df: DataFrame, key: str, components: Mapping[str, str | Column] | None = None) -> Archetype:
        """A table as an archetype of its own: its key is the entity id, its
        columns, or the expressions given, are the components."""
        columns = {c: F.col(c) for c in df.columns if c != key} if components is None else {k: F.col(v) if isinstance(v, str) else v for k, v in components.items()}
        frame = df.select(F.col(key).cast("long").alias(ID), *[c.alias(k) for k, c in columns.items()])
        for f in frame.schema.fields[1:]:
            self.register(f.name, f.dataType)
        return self._put(frozenset(columns), frame, name)

    def _put(self, components: frozenset[str], frame: DataFrame, table: str = "") -> Archetype:
        now = self.advance()
        key = (table, components)
        frame = frame.select(ID, *sorted(components))
        if key in self.archetypes:
            a = self.archetypes[key]
            a.frame = a.frame.unionByName(frame)
        else:
            a = self.archetypes[key] = Archetype(components, frame, table or "+".join(sorted(components)) or "()")
        a.ticks |= dict.fromkeys(components, now)
        return a

    def touch(self, archetype: Archetype, components: Iterable[str]) -> None:
        archetype.ticks |= dict.fromkeys(components, self.advance())

    def compact(self) -> None:
        """Cut the lineage of every archetype and sparse component."""
        for a in self.archetypes.values():
            a.frame = cut(a.frame)
        self.sparse = {k: cut(v) for k, v in self.sparse.items()}

    # --------------------------------------------------------------- scans

    def matches(self, required: Iterable[str], exact: bool = False) -> list[Archetype]:
        need = frozenset(required)
        return [a for a in self.archetypes.values() if (a.components == need if exact else need <= a.components)]

    def changed(self, archetype: Archetype, components: Iterable[str], since: int) -> bool:
        """Whether every one of the components was written after ``since``."""
        return all(archetype.ticks.get(c, 0) > since for c in components)

    def scan(self, terms: Iterable[str | Term], since: int = 0, exact: bool = False, extra: Iterable[str] = ()) -> DataFrame:
        """Rows of the archetypes that have the required components: id,
        archetype and the terms' columns. ``Changed`` terms drop whole archetypes
        by their ticks, on the driver. ``extra`` columns may be absent."""
        terms = terms_of(terms)
        required = [t.component for t in terms if t.required and t.kind != "entity"]
        sparse = [c for c in required if c in self.sparse]
        found = self.matches([c for c in required if c not in self.sparse], exact)
        found = [a for a in found if self.changed(a, [t.component for t in terms if t.kind == "changed"], since)]
        columns = list(dict.fromkeys([t.component for t in terms if t.kind != "entity"] + list(extra)))
        parts = [self._part(a, [c for c in columns if c not in self.sparse]) for a in found]
        out = functools.reduce(DataFrame.unionByName, parts) if parts else self._empty([c for c in columns if c not in self.sparse])
        for c in columns:
            if c in self.sparse:
                out = out.join(self.sparse[c].withColumnRenamed("value", c), ID, "inner" if c in sparse else "left")
        return out.select(ID, "archetype", *columns)

    def _part(self, a: Archetype, columns: list[str]) -> DataFrame:
        cols = [F.col(c) if c in a.components else F.lit(None).cast(self.types.get(c, T.NullType())).alias(c) for c in columns]
        return a.frame.select(ID, F.lit(a.name).alias("archetype"), *cols)

    def _empty(self, columns: list[str]) -> DataFrame:
        fields = [T.StructField(ID, T.LongType()), T.StructField("archetype", T.StringType())]
        return self.spark.createDataFrame([], T.StructType(fields + [T.StructField(c, self.types.get(c, T.NullType())) for c in columns]))

    def query(self, *terms: str | Term) -> DataFrame:
        """All matching rows; marks mutable columns written, and what was read as
        seen (the query's own writes included)."""
        ts = terms_of(terms)
        out = self.scan(ts, self._read_ticks.get(ts, 0))
        writes = [t.component for t in ts if t.kind == "mut"]
        if writes:
            for a in self.matches([t.component for t in ts if t.required]):
                self.touch(a, writes)
        self._read_ticks[ts] = self.tick
        return out

    def has_changed(self, *terms: str | Term) -> bool:
        """Whether the query would see a change; false before its first run."""
        ts = terms_of(terms)
        if ts not in self._read_ticks:
            return False
        watched = [t.component for t in ts if t.kind == "changed"]
        return any(self.changed(a, watched, self._read_ticks[ts]) for a in self.matches([t.component for t in ts if t.required]))

    def advance_query_tick(self, *terms: str | Term) -> None:
        self._read_ticks[terms_of(terms)] = self.tick

    def query_tick_info(self, *terms: str | Term) -> tuple[int, int]:
        """Last read tick of the query, and the current tick."""
        return self._read_ticks.get(terms_of(terms), 0), self.tick

    def query_table(self, *components: str) -> DataFrame:
        """Rows with exactly these components."""
        return self.scan(components, exact=True)

    def query_changed_since(self, component: str, tick: int) -> DataFrame:
        return self.scan([Changed(component)], since=tick)

    def query_flat(self, *components: str) -> DataFrame:
        """``entity_id`` and the components, structs flattened."""
        cols: list[Column | str] = [ID]
        for c in components:
            cols.append(f"{c}.*" if isinstance(self.types.get(c), T.StructType) else c)
        return self.scan(components).select(*cols)

    def query_arrow(self, *components: str):
        """As an Arrow table on the driver, for results that fit there."""
        return self.query_flat(*components).toArrow()

    def entities(self) -> DataFrame:
        parts = [a.frame.select(ID) for a in self.archetypes.values()]
        return functools.reduce(DataFrame.union, parts) if parts else self._empty([]).select(ID)

    def is_alive(self, entity: int) -> bool:
        return not self.entities().where(F.col(ID) == entity).isEmpty()

    def iter_sparse(self, component: str) -> DataFrame:
        if component not in self.sparse:
            return self.spark.createDataFrame([], T.StructType([T.StructField(ID, T.LongType()), T.StructField("value", self.sparse_types.get(component, T.NullType()))]))
        return self.sparse[component]

    # ------------------------------------------------------------- lookups

    def get(self, entity: int, component: str) -> Any:
        """The value, or None if the entity is dead or lacks the component."""
        frame = self.iter_sparse(component).withColumnRenamed("value", component) if component in self.sparse else self.scan([component])
        row = frame.where(F.col(ID) == entity).select(component).first()
        return None if row is None else row[0]

    def has(self, entity: int, component: str) -> bool:
        if component in self.sparse:
            return not self.sparse[component].where(F.col(ID) == entity).isEmpty()
        return not self.scan([component]).where(F.col(ID) == entity).isEmpty()

    def get_batch(self, requests: DataFrame, component: str, unique: bool = False) -> DataFrame:
        """``pos, entity_id`` to ``pos, value``: order and duplicates are kept,
        missing values are null. With ``unique`` later duplicates are null too,
        as for mutable access."""
        values = self.scan([component]).select(F.col(ID), F.col(component).alias("value"))
        out = requests.join(values, ID, "left")
        if unique:
            firsts = requests.groupBy(ID).agg(F.min("pos").alias("_first"))
            out = out.join(firsts, ID).withColumn("value", F.when(F.col("pos") == F.col("_first"), F.col("value")))
        return out.select("pos", "value")

    def _holding(self, ids: DataFrame) -> list[tuple[tuple[str, frozenset[str]], Archetype]]:
        """The archetypes that hold any of the ids: one job, a row for each."""
        items = list(self.archetypes.items())
        parts = [a.frame.select(ID, F.lit(k).alias("_k")) for k, (_, a) in enumerate(items)]
        if not parts:
            return []
        hit = functools.reduce(DataFrame.union, parts).join(ids.select(ID), ID, "left_semi").select("_k").distinct().collect()
        return [items[k] for k in sorted(r[0] for r in hit)]

    def locate(self, ids: Iterable[int]) -> dict[int, tuple[str, frozenset[str]]]:
        """The archetype of each listed id that is alive: one job, at most a row
        for each id."""
        items = list(self.archetypes.items())
        wanted = self._ids(ids)
        if not items:
            return {}
        # As large as the caller's list.
        parts = [a.frame.select(ID, F.lit(k).alias("_k")).join(F.broadcast(wanted), ID, "left_semi") for k, (_, a) in enumerate(items)]
        return {r[0]: items[r[1]][0] for r in functools.reduce(DataFrame.union, parts).collect()}

    # ----------------------------------------------------------- mutations

    def _budget(self, rows: int) -> None:
        if self.memory_budget is None:
            return
        width = 8 * (1 + len(self.types))
        if (self._rows_budgeted + rows) * width > self.memory_budget:
            raise PoolExhausted(f"{rows} rows exceed the budget of {self.memory_budget} bytes")
        self._rows_budgeted += rows

    def _local(self, rows: list[dict[str, Any]], components: Iterable[str]) -> DataFrame:
        names = sorted(components)
        unknown = [c for c in names if c not in self.types]
        if unknown:
            raise UnregisteredComponent(", ".join(unknown))
        schema = T.StructType([T.StructField(ID, T.LongType()), *[T.StructField(c, self.types[c]) for c in names]])
        return self.spark.createDataFrame([(r[ID], *[r[c] for c in names]) for r in rows], schema)

    def known(self, components: Iterable[str]) -> None:
        missing = [c for c in sorted(components) if c not in self.types]
        if missing:
            raise UnregisteredComponent(", ".join(missing))

    def admit(self, components: Iterable[str]) -> None:
        """Room and types for one more entity."""
        self.known(components)
        self._budget(1)
        self.spawned += 1

    def settle(self, states: Mapping[int, Any], sparse: Mapping[str, Mapping[int, tuple[Any, ...]]]) -> None:
        """Bring the listed entities to their states (see `ChangeSet.apply`):
        every archetype is edited once, and sparse values are set, or removed
        where empty."""
        by_origin: dict[tuple[str, frozenset[str]], dict[int, Any]] = {}
        born: dict[frozenset[str], list[dict[str, Any]]] = {}
        for e, s in states.items():
            if s.origin is not None:
                by_origin.setdefault(s.origin, {})[e] = s
            if s.born and s.alive:
                born.setdefault(s.components, []).append({ID: e, **s.values})
        for key, mine in by_origin.items():
            self._edit(key, mine)
        for components, rows in born.items():
            self._put(components, self._local(rows, components))
        for name, values in sparse.items():
            frame = self.iter_sparse(name).join(F.broadcast(self._ids(values)), ID, "left_anti")  # as large as the change set
            new = {e: v[0] for e, v in values.items() if v}
            self.sparse[name] = frame
            if new:
                self.insert_sparse(name, new, self.sparse_types[name])

    def _edit(self, key: tuple[str, frozenset[str]], mine: Mapping[int, Any]) -> None:
        a, (table, old) = self.archetypes[key], key
        stays = {e: s for e, s in mine.items() if not s.born and s.alive}
        moves: dict[tuple[frozenset[str], frozenset[str]], list[dict[str, Any]]] = {}
        for e, s in stays.items():
            if s.components != old:
                moves.setdefault((s.components, frozenset(s.values)), []).append({ID: e, **s.values})
        moved = []
        for (components, written), rows in moves.items():
            new = self._local(rows, written).select(ID, *[F.col(c).alias(f"_new_{c}") for c in sorted(written)])
            both = a.frame.join(F.broadcast(new), ID)  # as large as the change set
            moved.append((components, cut(both.select(ID, *[F.col(f"_new_{c}" if c in written else c).alias(c) for c in sorted(components)]))))
        leave = [e for e, s in mine.items() if e not in stays or s.components != old]
        if leave:
            a.frame = a.frame.join(F.broadcast(self._ids(leave)), ID, "left_anti")
            self.touch(a, a.components)
        updates = {e: s.values for e, s in stays.items() if s.components == old and s.values}
        if updates:
            written = sorted({c for v in updates.values() for c in v})
            # A value in a struct, so that a null that is set differs from none.
            schema = T.StructType([T.StructField(ID, T.LongType()), *[T.StructField(f"_new_{c}", T.StructType([T.StructField("v", self.types[c])])) for c in written]])
            new = self.spark.createDataFrame([(e, *[(v[c],) if c in v else None for c in written]) for e, v in updates.items()], schema)
            both = a.frame.join(F.broadcast(new), ID, "left")
            a.frame = both.select(ID, *[F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.v")).otherwise(F.col(c)).alias(c) if c in written else F.col(c) for c in sorted(a.components)])
            self.touch(a, written)
        for components, rows in moved:
            self._put(components, rows, table)

    def spawn(self, entity: int | None = None, **components: Any) -> int:
        self._budget(1)
        entity = self.allocator.allocate() if entity is None else entity
        self._put(frozenset(components), self._local([{ID: entity, **components}], components))
        self.spawned += 1
        return entity

    def try_spawn(self, **components: Any) -> int | None:
        try:
            return self.spawn(**components)
        except PoolExhausted:
            return None

    def spawn_batch(self, df: DataFrame) -> DataFrame:
        """A row for each new entity; columns are components. Ids are dense: the
        partitions' row counts, a row for each, make the offsets."""
        for f in df.schema.fields:
            self.register(f.name, f.dataType)
        rows = cut(df.withColumn("_m", F.monotonically_increasing_id()))
        part = F.shiftright("_m", 33)
        sizes = rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
        self._budget(sum(r.n for r in sizes))
        first = self.allocator.reserve(sum(r.n for r in sizes))
        starts = {}
        for r in sizes:
            starts[r.p] = first
            first += r.n
        if not starts:
            return rows.select(F.lit(0).cast("long").alias(ID)).limit(0)
        table = self.spark.createDataFrame(list(starts.items()), "_p bigint, _start bigint")
        # One row for each partition.
        out = rows.join(F.broadcast(table), part == F.col("_p")).withColumn(ID, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        self._put(frozenset(df.columns), out.drop("_m", "_p", "_start"))
        self.spawned += sum(r.n for r in sizes)
        return out.select(ID)

    def _ids(self, ids: Iterable[int] | DataFrame) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids.select(F.col(ids.columns[0]).cast("long").alias(ID)).distinct()
        return self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"{ID} bigint")

    def despawn(self, ids: int | Iterable[int] | DataFrame) -> int:
        """Remove entities, dead ones and repeats ignored; how many went. Indexes
        of single despawns are used again; those of frames are not."""
        single = [ids] if isinstance(ids, int) else list(ids) if not isinstance(ids, DataFrame) else None
        gone = self._ids(single if single is not None else ids)
        live = cut(self.entities().join(gone, ID, "left_semi"))
        n = live.count()
        if n:
            for _, a in self._holding(live):
                a.frame = a.frame.join(live, ID, "left_anti")
                self.touch(a, a.components)
            self.sparse = {k: v.join(live, ID, "left_anti") for k, v in self.sparse.items()}
            if single is not None:
                for r in live.collect():  # at most the ids that the caller listed
                    self.allocator.free(r[0])
        self.despawned += n
        return n

    def insert(self, entity: int, **components: Any) -> None:
        """Set components; the entity moves to the archetype it now belongs to."""
        self.insert_batch(self._local([{ID: entity, **components}], components), strict=True)

    def insert_batch(self, values: DataFrame, strict: bool = False) -> None:
        """``entity_id`` and component columns, one row for an entity. Unknown
        entities are an error if ``strict``, otherwise ignored."""
        new = [c for c in values.columns if c != ID]
        for f in values.schema.fields:
            if f.name != ID:
                self.register(f.name, f.dataType)
        values = cut(values)
        if strict and not values.join(self.entities(), ID, "left_anti").isEmpty():
            raise DeadEntity("insert into an entity that isn't alive")
        for key, a in self._holding(values):
            both = a.frame.join(values.select(ID, *[F.col(c).alias(f"_new_{c}") for c in new]), ID)
            if set(new) <= a.components:
                marks = values.select(ID, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in new])
                a.frame = a.frame.join(marks, ID, "left").select(
                    ID, *[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in sorted(a.components)]
                )
                self.touch(a, new)
            else:
                moved = both.select(ID, *[c for c in sorted(a.components) if c not in new], *[F.col(f"_new_{c}").alias(c) for c in new])
                moved = cut(moved)
                a.frame = a.frame.join(moved.select(ID), ID, "left_anti")
                self.touch(a, a.components)
                self._put(a.components | set(new), moved, key[0])

    def remove(self, entity: int, component: str) -> Any:
        """Drop a component; its old value, or None."""
        old = self.get(entity, component)
        if component in self.sparse:
            self.sparse[component] = self.sparse[component].where(F.col(ID) != entity)
            return old
        for key, a in list(self.archetypes.items()):
            if component in a.components:
                mine = cut(a.frame.where(F.col(ID) == entity))
                if not mine.isEmpty():
                    a.frame = a.frame.where(F.col(ID) != entity)
                    self.touch(a, a.components)
                    self._put(a.components - {component}, mine.drop(component), key[0])
        return old

    def insert_sparse(self, component: str, values: DataFrame | Mapping[int, Any], kind: T.DataType | str | None = None) -> None:
        """Upsert into a sparse component: ``entity_id, value``."""
        if not isinstance(values, DataFrame):
            kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind or self.sparse_types[component]
            values = self.spark.createDataFrame(list(values.items()), T.StructType([T.StructField(ID, T.LongType()), T.StructField("value", kind)]))
        self.sparse_types[component] = values.schema["value"].dataType
        self.types.setdefault(component, values.schema["value"].dataType)
        old = self.sparse.get(component)
        self.sparse[component] = values if old is None else old.join(values.select(ID), ID, "left_anti").unionByName(values)
        self.advance()

    def write_column(self, component: str, values: DataFrame) -> None:
        """Scatter values of a dense component; every entity must have it."""
        missing = values.join(self.scan([component]).select(ID), ID, "left_anti")
        if not missing.isEmpty():
            raise DeadEntity(f"entities without {component}")
        self.insert_batch(values.select(ID, F.col("value").alias(component)))

    # --------------------------------------------------------------- stats

    def entity_count(self) -> int:
        return self.entities().count()

    def archetype_count(self) -> int:
        return len(self.archetypes)

    def counts(self) -> DataFrame:
        """Rows of every archetype, in one job."""
        parts = [a.frame.select(F.lit(a.name).alias("archetype")) for a in self.archetypes.values()]
        if not parts:
            return self.spark.createDataFrame([], "archetype string, entity_count bigint")
        return functools.reduce(DataFrame.union, parts).groupBy("archetype").agg(F.count(F.lit(1)).alias("entity_count"))

    def stats(self) -> WorldStats:
        return WorldStats(len(self.archetypes), self.entity_count(), len(self.types), self.tick)
