"""Scans, joins, aggregates, plan API, subscriptions."""

import math

import pytest
from pyspark.sql import types as T

from lithos import errors
from lithos.operators.changes import DebouncePolicy, HashDebounce, MaterializedView, debounce
from lithos.plans.aggregates import AggregateExpr as A
from lithos.plans.indexes import Indexed, load_index
from lithos.plans.planner import Constraint, QueryPlanner, TablePlanner
from lithos.plans.predicates import Predicate as P
from lithos.world import Changed, Opt, World


@pytest.fixture
def teams(spark):
    """Ten with a score, the first six with a team too."""
    w = World(spark)
    w.spawn_batch(spark.createDataFrame([(i, i % 5) for i in range(6)], "Score int, Team int"))
    w.spawn_batch(spark.createDataFrame([(i,) for i in range(6, 10)], "Score int"))
    return w


def test_presence_and_optional(teams):
    assert teams.scan(["Score"]).count() == 10
    assert teams.scan(["Score", "Team"]).count() == 6
    assert teams.scan(["Score", Opt("Team")]).where("Team IS NULL").count() == 4
    assert teams.query_table("Score").count() == 4
    assert teams.scan(["Nothing"]).count() == 0


def test_inner_join_is_eliminated_and_left_join_is_nothing(teams):
    p = QueryPlanner(teams)
    inner = p.scan("Score").join("Team").build()
    assert sorted(inner.execute_collect()) == list(range(6))
    assert [w.kind for w in inner.warnings] == ["JoinEliminated"]
    left = p.scan("Score").join("Team", kind="left").build()
    assert len(left.execute_collect()) == 10
    assert "left" in left.explain()


def test_reference_joins(spark):
    w = World(spark)
    w.register("Name", "string")
    w.register("Score", "int")
    w.register("Parent", "bigint")
    named, plain, gone = w.spawn(Name="a"), w.spawn(Score=1), w.spawn(Name="b")
    kids = [w.spawn(Parent=named), w.spawn(Parent=named), w.spawn(Parent=plain), w.spawn(Parent=gone)]
    w.despawn(gone)
    p = QueryPlanner(w)
    assert sorted(p.scan("Parent").er_join("Parent", "Name").build().execute_collect()) == kids[:2]
    assert sorted(p.scan("Parent").er_join("Parent", "Name", kind="left").build().execute_collect()) == kids
    with pytest.raises(errors.UnregisteredComponent):
        p.scan("Parent").er_join("Owner", "Name")
    with pytest.raises(errors.BuilderOrder):
        p.scan("Parent").with_right_estimate(3)


def test_aggregates_nan_empty_and_absent(spark, teams):
    nan = World(spark)
    nan.spawn_batch(spark.createDataFrame([(1.0,), (math.nan,), (3.0,)], "V double"))
    scan = QueryPlanner(nan).scan("V")
    for a in (A.count(), A.sum("V"), A.min("V"), A.max("V"), A.avg("V")):
        scan.aggregate(a)
    r = scan.build().aggregate()
    assert r.get_by_label("COUNT(*)") == 3
    assert all(math.isnan(v) for k, v in r if k != "COUNT(*)")
    empty = QueryPlanner(teams).scan("Score").filter(P.eq("Score", 99))
    for a in (A.count(), A.sum("Score"), A.min("Score"), A.max("Score"), A.avg("Score")):
        empty.aggregate(a)
    values = [v for _, v in empty.build().aggregate()]
    assert values[:2] == [0, 0] and all(math.isnan(v) for v in values[2:])
    absent = QueryPlanner(teams).scan("Score").aggregate(A.count()).aggregate(A.sum("Team")).aggregate(A.sum("Team")).build()
    assert [v for _, v in absent.aggregate()] == [10, 10, 10]
    assert any(w.kind == "DuplicateAggregateLabel" for w in absent.warnings)
    assert str(absent.aggregate()).startswith("COUNT(*): 10.00")


def test_predicates(spark, teams):
    p = QueryPlanner(teams)

    def ids(pred):
        return sorted(p.scan("Score").filter(pred).build().execute_collect())

    assert ids(P.range("Score", 2, 5)) == [2, 3, 4]
    assert ids(P.range("Score", 2, 5, low_open=True, high_open=False)) == [3, 4, 5]
    assert ids(P.range("Score", None, 1, high_open=False)) == [0, 1]
    assert ids(P.custom_column("Score", "even", 0.5, lambda c: c % 2 == 0)) == [0, 2, 4, 6, 8]
    assert P.eq("Score", 1).with_selectivity(math.nan).selectivity == 1
    assert P.eq("Score", 1).with_selectivity(7).selectivity == 1
    for bad in (lambda: P.within("Score", (), 1), lambda: P.within("Score", (0,), -1), lambda: P.within("Score", (0,), math.inf), lambda: P.intersects("Score", (1,), (0,)), lambda: P.intersects("Score", (1,), (1, 2))):
        with pytest.raises(errors.InvalidPredicate):
            bad()
    w = World(spark)
    w.spawn_batch(spark.createDataFrame([(0.5,), (math.nan,)], "V double"))
    with pytest.raises(errors.InvalidPredicate):
        QueryPlanner(w).scan("V").filter(P.range("V", 0, 1)).build().execute_collect()
    assert QueryPlanner(w).scan("V").filter(P.custom_column("V", "big", 0.5, lambda c: c > 0)).build().execute_collect() == [0]


def test_warnings_cost_and_constraints(teams):
    p = QueryPlanner(teams)
    bare = p.scan("Score").filter(P.eq("Score", 3)).build()
    assert [w.kind for w in bare.warnings] == ["MissingIndex"]
    p.add_hash_index("Score")
    hashed = p.scan("Score").filter(P.range("Score", 1, 3)).build()
    assert [w.kind for w in hashed.warnings] == ["IndexKindMismatch"]
    found = p.scan("Score").filter(P.eq("Score", 3)).build()
    assert "IndexGather hash" in found.explain() and found.cheaper(bare) is found
    assert found.execute_collect() == [3]
    assert p.scan("Score").build().validate_constraints(Constraint.exactly_one()) == ["exactly one"]
    assert p.scan("Score").build().validate_constraints(Constraint.between(9, 10), Constraint.at_least(2), Constraint.at_most(10)) == []
    with pytest.raises(errors.WorldMismatch):
        bare.execute_collect(World(teams.spark))


def test_changed_is_by_archetype(teams):
    plan = QueryPlanner(teams).scan(Changed("Score")).build()
    assert len(plan.execute_collect_raw()) == 10 and len(plan.execute_collect_raw()) == 10
    assert len(plan.execute_collect()) == 10 and plan.execute_collect() == []
    teams.insert(0, Score=100)
    assert sorted(plan.execute_collect()) == list(range(6))
    assert not teams.has_changed(Changed("Score"))
    teams.query(Changed("Score"))
    teams.insert(7, Score=1)
    assert teams.has_changed(Changed("Score"))
    teams.advance_query_tick(Changed("Score"))
    assert not teams.has_changed(Changed("Score"))


def test_view_keeps_the_last_delta_only(teams):
    view = MaterializedView(QueryPlanner(teams).scan(Changed("Score")).build())
    assert view.entities().count() == 0
    view.refresh(teams)
    assert view.entities().count() == 10
    view.refresh(teams)
    assert view.entities().count() == 0
    view.set_policy(DebouncePolicy(3))
    assert [view.refresh(teams) for _ in range(7)] == [True, False, False, True, False, False, True]
    with pytest.raises(errors.WorldMismatch):
        view.refresh(World(teams.spark))


def test_subscriptions_collect_all_errors(teams):
    p = QueryPlanner(teams)
    hashed = p.add_hash_index("Team")
    with pytest.raises(errors.SubscriptionError) as e:
        p.subscribe("Score").where_eq(Indexed("Score", "btree"), 1).where_range(Indexed("Team", "hash"), 0, 2).build()
    assert len(e.value.reasons) == 3
    plan = p.subscribe(Changed("Score")).where_eq(hashed, 1).build()
    assert plan.execute_collect() == [1] and plan.execute_collect() == []


def test_debounce(spark):
    d = HashDebounce()
    assert [d.check(1, "a"), d.check(1, "a"), d.check(1, "b"), d.check(2, "a")] == [True, False, True, True]
    d.remove(1)
    assert d.check(1, "b") and len(d) == 2
    d.retain({2})
    assert len(d) == 1
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "a"), (2, 0, None)], "e int, t int, v string")
    assert sorted((r.e, r.t) for r in debounce(rows, "e", "v", ["t"]).collect()) == [(1, 0), (1, 2), (1, 4), (2, 0)]


def test_batched_columns_and_streams(teams):
    plan = QueryPlanner(teams).scan("Score").build()
    with pytest.raises(errors.ComponentMismatch):
        plan.batched("Nothing")
    assert sorted((r.Score, r.Team) for r in plan.batched("Score", Opt("Team")).collect() if r.Team is not None)[-1] == (5, 0)
    with pytest.raises(Exception, match="ComponentMismatch"):
        plan.batched("Team").collect()
    seen = []
    plan.execute_stream(seen.append)
    assert sorted(seen) == list(range(10))
    out = plan.chunks(lambda batches: (b.select(["Score"]) for b in batches), "Score int", "Score")
    assert out.count() == 10


def test_indexes_and_tables(spark, teams, tmp_path):
    p = QueryPlanner(teams)
    p.add_btree_index("Score")
    index = p.indexes["Score"]["btree"]
    assert sorted(r[0] for r in index.range(2, 4).collect()) == [2, 3] and index.contains(9) and len(index) == 10
    assert not index.update()
    index.save(str(tmp_path / "i"))
    assert load_index(teams, str(tmp_path / "i"), "Score", "btree", teams.tick).get(3).collect()[0][0] == 3
    with pytest.raises(errors.FormatError):
        load_index(teams, str(tmp_path / "i"), "Score", "hash", 0)
    teams.insert(9, Score=2)
    assert index.update() and sorted(r[0] for r in index.get(2).collect()) == [2, 9]
    schema = T.StructType([T.StructField("Score", T.IntegerType(), metadata={"index": "btree"}), T.StructField("Team", T.IntegerType(), metadata={"index": "hash"})])
    t = TablePlanner(p, schema)
    assert sorted(t.where_range("Score", 3, 5).build().execute_collect()) == [3, 4]
    assert t.where_eq("Team", 4).build().execute_collect() == [4]
    with pytest.raises(TypeError):
        t.btree("Team")
