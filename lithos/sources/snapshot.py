"""Whole-world snapshots: a Parquet folder for each archetype and sparse
component, and a manifest; written beside, then renamed."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.errors import FormatError
from lithos.sources import storage
from lithos.world import ID, Archetype, World


def save(world: World, path: str) -> None:
    spark, tmp = world.spark, f"{path}.tmp"
    storage.delete(spark, tmp)
    manifest = {
        "tick": world.tick,
        "next_index": world.allocator.next_index,
        "free": [[i, world.allocator._generation[i]] for i in world.allocator._free],
        "types": {k: v.jsonValue() for k, v in world.types.items()},
        "archetypes": [],
        "sparse": {},
    }
    for k, ((table, components), a) in enumerate(world.archetypes.items()):
        a.frame.write.parquet(f"{tmp}/a{k}")
        manifest["archetypes"].append({"table": table, "name": a.name, "components": sorted(components), "ticks": a.ticks, "folder": f"a{k}"})
    for k, (name, frame) in enumerate(world.sparse.items()):
        frame.write.parquet(f"{tmp}/s{k}")
        manifest["sparse"][name] = f"s{k}"
    storage.write_text(spark, f"{tmp}/manifest.json", json.dumps(manifest))
    storage.replace(spark, tmp, path)


def load(spark: SparkSession, path: str, expected: dict[str, T.DataType] | None = None) -> World:
    """The world as saved. Components are found by name; those that the caller
    expects must have the same type."""
    storage.settled(spark, path)
    m = json.loads(storage.read_text(spark, f"{path}/manifest.json"))
    world = World(spark)
    world.types = {k: T._parse_datatype_json_value(v) for k, v in m["types"].items()}
    remap(world.types, expected or {})
    for a in m["archetypes"]:
        frame = spark.read.parquet(f"{path}/{a['folder']}").select(ID, *a["components"])
        for c in a["components"]:
            if frame.schema[c].dataType != world.types[c]:
                raise FormatError(f"{c} is stored as {frame.schema[c].dataType.simpleString()}")
        key = (a["table"], frozenset(a["components"]))
        world.archetypes[key] = Archetype(key[1], frame, a["name"], {k: int(v) for k, v in a["ticks"].items()})
    for name, folder in m["sparse"].items():
        world.sparse[name] = spark.read.parquet(f"{path}/{folder}")
        world.sparse_types[name] = world.sparse[name].schema["value"].dataType
    world.tick, world.allocator.next_index = m["tick"], m["next_index"]
    for i, g in m["free"]:
        world.allocator._free.append(i)
        world.allocator._generation[i] = g
    return world


def remap(stored: dict[str, T.DataType], local: dict[str, T.DataType]) -> dict[str, str]:
    """Stored to local names; a type that differs is an error."""
    for k, v in local.items():
        if k in stored and stored[k] != v:
            raise FormatError(f"{k} is {stored[k].simpleString()}, not {v.simpleString()}")
    return {k: k for k in stored if k in local or not local}


def orphans(dead, live, key: str):
    """Distinct keys that only dead rows hold."""
    return dead.select(key).where(F.col(key).isNotNull()).distinct().join(live.select(key), key, "left_anti")
