"""Checkpoints and recovery: a snapshot takes the place of the log before it."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from lithos.sources import snapshot, storage
from lithos.sources.wal import Wal
from lithos.world import World


class AutoCheckpoint:
    """Use as a log's ``on_checkpoint``. A failure leaves the log as it is."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, world: World, wal: Wal) -> bool:
        try:
            snapshot.save(world, self.path)
        except Exception:  # best effort: the log still has everything
            return False
        wal.acknowledge_snapshot(wal.next_seq - 1)
        wal.delete_before(wal.acknowledged)
        return True


def recover(spark: SparkSession, path: str, wal: Wal, fresh: World) -> World:
    """The last snapshot, or ``fresh``, with the rest of the log replayed."""
    world = snapshot.load(spark, path) if storage.settled(spark, path) and storage.exists(spark, f"{path}/manifest.json") else fresh
    wal.replay(world, wal.acknowledged)
    return world


class BlobStore(Protocol):
    """Where blob keys point; the engine never holds the bytes."""

    def on_orphaned(self, keys: DataFrame) -> None: ...


def release(dead: DataFrame, live: DataFrame, key: str, store: BlobStore) -> None:
    """Hand over the keys that only dead rows hold."""
    store.on_orphaned(snapshot.orphans(dead, live, key))
