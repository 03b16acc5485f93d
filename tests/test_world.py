"""Spawning, lookups, migration, sparse components, ids."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lithos import entity, errors
from lithos.components import COMPONENTS, register_all
from lithos.world import Mut, World


@given(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
@settings(max_examples=50, deadline=None)
def test_ids_round_trip(g, i):
    e = entity.pack(g, i)
    assert -(2**63) <= e < 2**63 and entity.generation_of(e) == g and entity.index_of(e) == i


def test_id_columns(spark):
    row = spark.createDataFrame([(entity.pack(7, 9),)], "e bigint").select(entity.index_column(__import__("pyspark").sql.functions.col("e")), entity.generation_column(__import__("pyspark").sql.functions.col("e"))).first()
    assert tuple(row) == (9, 7)


@pytest.fixture
def world(spark):
    w = World(spark)
    for name, kind in {"A": "int", "B": "string", "P": "struct<x:float,y:float>"}.items():
        w.register(name, kind)
    return w


def test_spawn_get_despawn_reuse(world):
    e = world.spawn(A=1, B="x")
    assert world.get(e, "A") == 1 and world.has(e, "B") and world.get(e, "P") is None
    assert world.despawn([e, e, 999]) == 1 and world.despawn(e) == 0
    assert world.get(e, "A") is None
    again = world.spawn(A=2)
    assert entity.index_of(again) == entity.index_of(e) and entity.generation_of(again) == 1
    assert world.get(e, "A") is None and world.get(again, "A") == 2


def test_insert_overwrites_or_migrates(world):
    a, b = world.spawn(A=1), world.spawn(A=2)
    world.insert(a, A=5)
    world.insert(b, B="moved")
    assert world.get(a, "A") == 5 and world.get(b, "A") == 2 and world.get(b, "B") == "moved"
    assert world.query_table("A").count() == 1 and world.query_table("A", "B").count() == 1
    assert world.remove(b, "B") == "moved" and world.query_table("A").count() == 2
    with pytest.raises(errors.DeadEntity):
        world.insert(12345, A=1)


def test_sparse_components_go_with_the_entity(world):
    a, b = world.spawn(A=1), world.spawn(A=2)
    world.insert_sparse("S", {a: 10, b: 20}, "int")
    world.insert_sparse("S", {a: 11})
    assert world.get(a, "S") == 11 and world.iter_sparse("S").count() == 2
    assert world.scan(["A", "S"]).count() == 2
    world.despawn(b)
    assert world.iter_sparse("S").count() == 1
    assert world.iter_sparse("T").count() == 0


def test_get_batch_keeps_order_and_duplicates(spark, world):
    a, b = world.spawn(A=1), world.spawn(A=2)
    asks = spark.createDataFrame([(0, b), (1, b), (2, 77), (3, a)], "pos int, entity_id bigint")
    assert [r.value for r in world.get_batch(asks, "A").orderBy("pos").collect()] == [2, 2, None, 1]
    assert [r.value for r in world.get_batch(asks, "A", unique=True).orderBy("pos").collect()] == [2, None, None, 1]


def test_batches_columns_and_budget(spark):
    w = World(spark, memory_budget=400)
    ids = [r[0] for r in w.spawn_batch(spark.range(20).selectExpr("cast(id as int) A")).collect()]
    assert sorted(ids) == list(range(20))
    with pytest.raises(errors.PoolExhausted):
        w.spawn_batch(spark.range(20).selectExpr("cast(id as int) A"))
    assert w.try_spawn(A=1) is not None
    w.write_column("A", spark.createDataFrame([(3, 100)], "entity_id bigint, value int"))
    assert w.get(3, "A") == 100
    with pytest.raises(errors.DeadEntity):
        w.write_column("A", spark.createDataFrame([(300, 1)], "entity_id bigint, value int"))
    w.compact()
    assert w.stats().entities == 21 and w.archetype_count() == 1


def test_queries_tick_what_they_write(world):
    world.spawn(A=1)
    before = world.tick
    world.query(Mut("A"))
    assert world.query_changed_since("A", before).count() == 1
    assert world.query_changed_since("A", world.tick).count() == 0
    assert world.query_tick_info(Mut("A")) == (world.tick, world.tick)


def test_python_components_are_flattened(spark):
    w = World(spark)
    register_all(w)
    assert len(COMPONENTS) == 11
    w.spawn(Position=(1.0, 2.0), Velocity=(3.0, 4.0))
    assert w.query_flat("Position", "Velocity").columns == ["entity_id", "pos_x", "pos_y", "vel_x", "vel_y"]
    assert w.query_arrow("Position").num_rows == 1
    with pytest.raises(errors.UnregisteredComponent):
        w.register("Position", "int")
