"""Write-ahead log: one Parquet folder for each committed change set, named by
its sequence number; a folder appears by a rename, so a torn write is no record."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.errors import CursorBehind, FormatError
from lithos.operators.changeset import ChangeSet, Mutation, fold
from lithos.sources import storage
from lithos.world import ID, World

#: Records that one replay job reads, and ops that are applied together.
REPLAY_RECORDS, REPLAY_ROWS = 1_000, 50_000
SCHEMA = "seq bigint, ord int, op string, entity_id bigint, component string, payload string"


class Wal:
    """Append, replay and prune. ``limit_bytes`` is when a checkpoint is due."""

    def __init__(self, spark: SparkSession, path: str, limit_bytes: int = 64 << 20, on_checkpoint: Callable[[World, Wal], None] | None = None):
        self.spark, self.path, self.limit_bytes, self.on_checkpoint = spark, path, limit_bytes, on_checkpoint
        records = self.records()
        self.next_seq = records[-1] + 1 if records else self._meta().get("next_seq", 0)
        self.acknowledged = self._meta().get("acknowledged", 0)

    def _meta(self) -> dict[str, Any]:
        at = f"{self.path}/_meta.json"
        return json.loads(storage.read_text(self.spark, at)) if storage.settled(self.spark, at) else {}

    def _put_meta(self) -> None:
        storage.write_text(self.spark, f"{self.path}/_meta.tmp", json.dumps({"next_seq": self.next_seq, "acknowledged": self.acknowledged}))
        storage.replace(self.spark, f"{self.path}/_meta.tmp", f"{self.path}/_meta.json")

    def records(self) -> list[int]:
        """Sequence numbers of the complete records."""
        return sorted(int(n[4:]) for n in storage.listing(self.spark, self.path) if n.startswith("seq=") and n[4:].isdigit())

    def append(self, changes: ChangeSet, world: World, frames: Sequence[DataFrame] = ()) -> int:
        """One record: the ops, then frames of ``entity_id`` and components as
        inserts, which are written where they are and not gathered."""
        rows = []
        for ord_, m in enumerate(changes):
            for name, value in m.values or ((None, None),):
                kind = None if name is None else (world.sparse_types if m.op.startswith("sparse") else world.types)[name]
                rows.append((self.next_seq, ord_, m.op, m.entity, name, None if name is None else json.dumps({"t": kind.jsonValue(), "v": _plain(value)})))
        parts = [self.spark.createDataFrame(rows, SCHEMA).coalesce(1)] if rows or not frames else []
        for k, f in enumerate(frames):
            for c in [c for c in f.columns if c != ID]:
                value = F.when(F.col(c).isNull(), F.lit('"v":null}')).otherwise(F.expr(f"substring(to_json(struct(`{c}` AS v)), 2)"))
                payload = F.concat(F.lit('{"t":' + json.dumps(f.schema[c].dataType.jsonValue()) + ","), value)
                parts.append(f.select(F.lit(self.next_seq).cast("long").alias("seq"), F.lit(len(changes) + k).alias("ord"), F.lit("insert").alias("op"), ID, F.lit(c).alias("component"), payload.alias("payload")))
        tmp = f"{self.path}/_tmp-{self.next_seq}"
        functools.reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(tmp)
        storage.replace(self.spark, tmp, f"{self.path}/seq={self.next_seq}")
        self.next_seq += 1
        return self.next_seq - 1

    def frame(self, from_seq: int = 0) -> DataFrame:
        """All records from a sequence number on."""
        names = [f"{self.path}/seq={n}" for n in self.records() if n >= from_seq]
        return self.spark.read.schema(SCHEMA).parquet(*names) if names else self.spark.createDataFrame([], SCHEMA)

    def state(self, from_seq: int = 0) -> DataFrame:
        """``entity_id, component, payload`` that the records end in, folded where
        they are: for logs of entities that the driver need not see."""
        return fold(self.frame(from_seq))

    def replay(self, world: World, from_seq: int = 0) -> int:
        """Apply the records in order, many as one change set; the last number
        seen, or -1. On an error the world is to be thrown away."""
        numbers = [n for n in self.records() if n >= from_seq]
        for at in range(0, len(numbers), REPLAY_RECORDS):
            some = numbers[at : at + REPLAY_RECORDS]
            rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/seq={n}" for n in some]).orderBy("seq", "ord", "entity_id")
            # One batch of rows on the driver at a time.
            for changes in decoded(rows.toLocalIterator(), REPLAY_ROWS):
                changes.apply(world)
        return numbers[-1] if numbers else -1

    def batches(self, from_seq: int = 0, limit: int | None = None):
        """``(seq, change set)`` of each record, one at a time on the driver."""
        for n in [n for n in self.records() if n >= from_seq][:limit]:
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/seq={n}").orderBy("ord", "entity_id").collect()
            yield n, decode(rows)

    def checkpoint_needed(self) -> bool:
        return self.bytes() >= self.limit_bytes

    def bytes(self) -> int:
        return sum(storage.size(self.spark, f"{self.path}/seq={n}") for n in self.records() if n >= self.acknowledged)

    def acknowledge_snapshot(self, seq: int) -> None:
        """Records up to ``seq`` are in a snapshot."""
        self.acknowledged = seq + 1
        self._put_meta()

    def delete_before(self, seq: int) -> int:
        gone = [n for n in self.records() if n < seq]
        for n in gone:
            storage.delete(self.spark, f"{self.path}/seq={n}")
        self._put_meta()
        return len(gone)


def _plain(value: Any) -> Any:
    return value.asDict(recursive=True) if hasattr(value, "asDict") else list(value) if isinstance(value, tuple) else value


def decode(rows) -> ChangeSet:
    """Ops of rows that are in order."""
    return next(decoded(rows, None), ChangeSet())


def decoded(rows: Iterable[Any], most: int | None) -> Iterator[ChangeSet]:
    """Change sets of about ``most`` ops, all in one without it."""
    out, last = ChangeSet(), None
    for r in rows:
        values: tuple = ()
        if r.component is not None:
            p = json.loads(r.payload)
            values = ((r.component, _typed(p.get("v"), T._parse_datatype_json_value(p["t"]))),)
        here = (r.seq, r.ord, r.entity_id)
        if here == last:
            m = out.ops[-1]
            out.ops[-1] = Mutation(m.op, m.entity, m.values + values)
            continue
        if most is not None and len(out) >= most:
            yield out
            out = ChangeSet()
        out.ops.append(Mutation(r.op, r.entity_id, values))
        last = here
    if len(out):
        yield out


def _typed(v: Any, kind: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_typed(v.get(f.name) if isinstance(v, dict) else v[i], f.dataType) for i, f in enumerate(kind.fields))
    if isinstance(kind, T.ArrayType):
        return [_typed(x, kind.elementType) for x in v]
    return float(v) if isinstance(kind, (T.FloatType, T.DoubleType)) else v


class WalCursor:
    """A tailing reader for replication."""

    def __init__(self, wal: Wal, next_seq: int = 0):
        self.wal, self.next_seq = wal, next_seq

    def next_batch(self, limit: int) -> ReplicationBatch | None:
        kept = self.wal.records()
        if kept and kept[0] > self.next_seq or not kept and self.wal.next_seq > self.next_seq:
            raise CursorBehind(f"{self.next_seq} is gone")
        found = list(self.wal.batches(self.next_seq, limit))
        if not found:
            return None
        self.next_seq = found[-1][0] + 1
        return ReplicationBatch(found)


class ReplicationBatch:
    """Records with the types of their components."""

    def __init__(self, records: list[tuple[int, ChangeSet]]):
        self.records = records

    def apply(self, world: World) -> int:
        """Record by record: one that fails leaves the earlier ones applied."""
        last = -1
        for seq, changes in self.records:
            for m in changes:
                for name, _ in m.values:
                    if name not in world.types and name not in world.sparse_types:
                        raise FormatError(f"{name} isn't registered here")
            changes.apply(world)
            last = seq
        return last
