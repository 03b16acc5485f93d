"""Change sets, log folding, transactions, reducers, retention."""

import pytest
from pyspark.sql import functions as F

from lithos import errors
from lithos.operators import changeset, reducers
from lithos.operators.transactions import Access, Optimistic, Pessimistic, Sequential, colour
from lithos.world import Mut, World


@pytest.fixture
def world(spark):
    w = World(spark)
    w.register("Health", "int")
    w.register("Name", "string")
    for i in range(3):
        w.spawn(Health=10 * i)
    return w


def test_changeset_applies_in_order_and_keeps_the_prefix(world):
    c = changeset.ChangeSet()
    c.insert(0, Health=1)
    c.despawn(1)
    c.insert(1, Health=5)
    c.insert(2, Health=7)
    with pytest.raises(errors.DeadEntity):
        c.apply(world)
    assert world.get(0, "Health") == 1 and world.get(2, "Health") == 20 and not world.is_alive(1)
    again = changeset.ChangeSet()
    again.spawn(0, Health=3)
    with pytest.raises(errors.AlreadyPlaced):
        again.apply(world)
    b = changeset.CommandBuffer()
    b.insert(2, Name="x")
    b.flush(world)
    assert len(b) == 0 and world.get(2, "Name") == "x"


def test_fold(spark):
    log = spark.createDataFrame(
        [(0, 0, "spawn", 1, "A", "1"), (1, 0, "insert", 1, "A", "2"), (2, 0, "insert", 1, "B", "9"), (3, 0, "remove", 1, "B", None),
         (0, 1, "spawn", 2, "A", "1"), (4, 0, "despawn", 2, None, None), (5, 0, "spawn", 3, "A", "1"), (6, 0, "despawn", 3, None, None), (7, 0, "spawn", 3, "A", "8")],
        "seq bigint, ord int, op string, entity_id bigint, component string, payload string",
    )
    assert sorted(map(tuple, changeset.fold(log).collect())) == [(1, "A", "2"), (3, "A", "8")]


def test_access_and_colouring():
    read, write, reap = Access(frozenset("a")), Access(writes=frozenset("a")), Access(despawns=True)
    assert not read.conflicts_with(read) and read.conflicts_with(write) and write.conflicts_with(write)
    assert reap.conflicts_with(read) and reap.conflicts_with(reap) and not reap.conflicts_with(Access())
    assert read.merge(write) == Access(frozenset("a"), frozenset("a"))
    assert colour({"r": read, "s": read, "w": write}) == [["r", "s"], ["w"]]


def test_transactions_buffer_and_conflict(world):
    def body(tx):
        tx.write(0, Health=99)
        assert tx.read(0, "Health") == 0
        return tx.spawn(Health=1)

    e = Sequential().transact(world, body)
    assert world.get(0, "Health") == 99 and world.get(e, "Health") == 1
    tries = []

    def disturbed(tx):
        tries.append(1)
        tx.read(0, "Health")
        if len(tries) < 3:
            world.insert(2, Health=len(tries))
        tx.write(0, Health=5)

    Optimistic(3).transact(world, disturbed)
    assert len(tries) == 3 and world.get(0, "Health") == 5
    tries.clear()
    with pytest.raises(errors.Conflict):
        Optimistic(2).transact(world, disturbed)
    p = Pessimistic(2)
    access = Access(writes=frozenset({"Health"}))
    assert p._acquire(access)
    with pytest.raises(errors.Conflict):
        p.transact(world, lambda tx: None, access)
    p._release(access)
    p.transact(world, lambda tx: tx.write(0, Health=6), access)
    assert world.get(0, "Health") == 6


def test_reducers(world):
    r = reducers.ReducerRegistry()
    r.register("heal", "query_mut", lambda w, amount: w.modify(Health=F.col("Health") + amount), Mut("Health"))
    r.register("count", "query_ref", lambda rows: rows.count(), "Health")
    r.register("hit", "entity_mut", lambda tx, e: tx.write(e, Health=tx.read(e, "Health") - 1), reads=("Health",), writes=("Health",))
    r.register("bad", "dynamic", lambda tx: tx.write(0, Name="x"), reads=("Health",))
    with pytest.raises(ValueError):
        r.register("heal", "query_ref", lambda rows: None)
    r.run(world, "heal", amount=5)
    assert r.run(world, "count") == 3 and world.get(0, "Health") == 5
    for wrong in (lambda: r.call(Sequential(), world, "heal", amount=1), lambda: r.run(world, "hit", e=0), lambda: r.call(Sequential(), world, "bad"), lambda: r.dynamic_call(Sequential(), world, "hit", e=0)):
        with pytest.raises(errors.WrongKind):
            wrong()
    r.call(Optimistic(), world, "hit", e=0)
    assert world.get(0, "Health") == 4
    with pytest.raises(errors.AccessViolation):
        r.dynamic_call(Sequential(), world, "bad")


def test_query_writers_are_transactions(world):
    r = reducers.ReducerRegistry()
    tries = []

    def body(w, amount):
        tries.append(1)
        w.modify(Health=F.col("Health") + amount)
        if len(tries) < 3:
            world.insert(1, Health=100 * len(tries))

    r.register("heal", "query_writer", body, Mut("Health"))
    r.call(Optimistic(3), world, "heal", amount=1)
    assert len(tries) == 3 and [world.get(i, "Health") for i in range(3)] == [1, 201, 21]
    tries.clear()
    with pytest.raises(errors.Conflict):
        r.call(Optimistic(2), world, "heal", amount=1)
    p = Pessimistic(2)
    reap = Access(despawns=True)
    assert p._acquire(reap) and not p._acquire(Access(reads=frozenset({"Health"})))
    p._release(reap)
    tries += [1, 1]
    r.call(p, world, "heal", amount=1)
    assert world.get(0, "Health") == 2 and p._held == {}


@pytest.mark.parametrize("seed", range(3))
def test_change_sets_against_op_by_op(spark, seed):
    """Random ops, applied together and one by one."""
    import random

    rng = random.Random(seed)

    def make():
        w = World(spark)
        w.register("A", "int")
        w.register("B", "string")
        w.sparse_types["S"] = w.types["A"]
        w.types["S"] = w.types["A"]
        w.spawn(0, A=1)
        w.spawn(1, A=2, B="x")
        w.spawn(2)
        for i in range(3):
            w.allocator.observe(i)
        return w

    alive, ops = {0, 1, 2}, changeset.ChangeSet()
    for _ in range(14):
        e = rng.choice(sorted(alive)) if alive and rng.random() < 0.8 else rng.randrange(3, 6)
        if e not in alive:
            ops.spawn(e, **rng.choice([{}, {"A": 5}, {"A": 6, "B": None}]))
            alive.add(e)
            continue
        what = rng.randrange(5)
        if what == 0:
            ops.despawn(e)
            alive.discard(e)
        elif what == 1:
            ops.insert(e, **rng.choice([{"A": rng.randrange(9)}, {"B": "y"}, {"A": None, "B": "z"}]))
        elif what == 2:
            ops.remove(e, rng.choice("AB"))
        elif what == 3:
            ops.sparse_insert(e, "S", rng.randrange(9))
        else:
            ops.sparse_remove(e, "S")
    together, single = make(), make()
    ops.apply(together)
    for m in ops:
        one = changeset.ChangeSet()
        one.ops = [m]
        one.apply(single)
    state = lambda w: sorted((tuple(sorted(a.components)), tuple(r)) for a in w.archetypes.values() for r in a.frame.collect())
    assert repr(state(together)) == repr(state(single))
    sparse = lambda w: sorted(map(tuple, w.iter_sparse("S").collect()))
    assert sparse(together) == sparse(single)


def test_many_ops_take_few_jobs(world):
    c = changeset.ChangeSet()
    for i in range(1000):
        c.spawn(10 + i, Health=i)
    for i in range(1000):
        c.insert(10 + i, Health=-i)
    tracker = world.spark.sparkContext.statusTracker()
    world.spark.sparkContext.setJobGroup("many", "many")
    c.apply(world)
    jobs = len(tracker.getJobIdsForGroup("many"))
    world.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 4 and world.get(1009, "Health") == -999 and world.entity_count() == 1003


def test_retention(spark):
    w = World(spark)
    w.register("Expiry", "int")
    w.register("Keep", "int")
    for n in (0, 1, 2, 5):
        w.spawn(Expiry=n)
    w.spawn(Keep=1)
    assert reducers.run_retention(w) == 2
    assert sorted(r.Expiry for r in w.scan(["Expiry"]).collect()) == [1, 4] and w.entity_count() == 3
