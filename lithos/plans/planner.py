"""The query planner: a builder over component sets that ends in one frame.

Joins are set filters: a plan returns entities, never multiplied rows. An inner
join on the same entity only widens the required components and disappears; a
left join changes nothing and disappears; an inner entity-reference join is a
left semi join; a left one is not even built. Everything else is Catalyst's."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.errors import BuilderOrder, ComponentMismatch, SubscriptionError, UnregisteredComponent, WorldMismatch
from lithos.plans.aggregates import AggregateExpr, AggregateResult
from lithos.plans.indexes import Indexed, ValueIndex
from lithos.plans.predicates import Predicate
from lithos.world import ID, Term, World, terms_of

#: Costs for a row: scan, index lookup base, hash build, probe, pair, filter
#: with and without a branch, aggregate.
SCAN, INDEX, BUILD, PROBE, PAIR, FILTER, BRANCH, FLAT, AGGREGATE = 1.0, 5.0, 2.0, 1.5, 1.0, 0.5, 0.85, 0.5, 0.1
#: Factors of a scan, a nested loop, an entity-reference join's rows and probes.
SCAN_FACTOR, NESTED_FACTOR, REF_ROWS, REF_PROBE = 0.9, 0.95, 0.5, 1.2
#: Rows from which a left join counts as a hash join.
HASH_ROWS = 64
#: Right sides of fewer estimated rows are hinted for broadcast.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Cost:
    rows: float
    cpu: float


@dataclass
class Node:
    """Logical tree, for explain and cost."""

    text: str
    cost: Cost
    children: list[Node] = field(default_factory=list)

    def lines(self, depth: int = 0) -> Iterable[str]:
        yield f"{'  ' * depth}{self.text} [rows={self.cost.rows:.0f} cpu={self.cost.cpu:.1f}]"
        for c in self.children:
            yield from c.lines(depth + 1)


@dataclass(frozen=True)
class PlanWarning:
    """MissingIndex, IndexKindMismatch, SpatialIndexDeclined, UnindexedJoin,
    DuplicateAggregateLabel or JoinEliminated."""

    kind: str
    text: str


@dataclass(frozen=True)
class Constraint:
    """Bounds on the estimated number of rows."""

    low: float
    high: float
    text: str

    @staticmethod
    def exactly_one() -> Constraint:
        return Constraint(1, 1, "exactly one")

    @staticmethod
    def at_most(n: int) -> Constraint:
        return Constraint(0, n, f"at most {n}")

    @staticmethod
    def at_least(n: int) -> Constraint:
        return Constraint(n, math.inf, f"at least {n}")

    @staticmethod
    def between(a: int, b: int) -> Constraint:
        return Constraint(a, b, f"between {a} and {b}")


@dataclass
class _Join:
    terms: tuple[Term, ...]
    kind: str
    reference: str | None = None
    estimate: float | None = None


class QueryPlanner:
    """Plans against one world; statistics are counts by archetype, taken once
    and only if an estimate is asked for."""

    def __init__(self, world: World, indexes: Iterable[ValueIndex] = ()):
        self.world = world
        self.indexes: dict[str, dict[str, Any]] = {}
        self.spatial: dict[str, Any] = {}
        self._counts: dict[str, int] | None = None
        for i in indexes:
            self.add_index(i)

    def add_index(self, index: ValueIndex) -> Indexed:
        if index.component not in self.world.types:
            raise UnregisteredComponent(index.component)
        self.indexes.setdefault(index.component, {})[index.kind] = index
        return index.witness

    def add_btree_index(self, component: str) -> Indexed:
        return self.add_index(ValueIndex(self.world, component, "btree"))

    def add_hash_index(self, component: str) -> Indexed:
        return self.add_index(ValueIndex(self.world, component, "hash"))

    def add_spatial_index(self, component: str, index: Any) -> None:
        if component not in self.world.types:
            raise UnregisteredComponent(component)
        self.spatial[component] = index

    def rows_with(self, components: Iterable[str]) -> float:
        """Least number of rows that any of the components has."""
        if self._counts is None:
            self._counts = {r[0]: r[1] for r in self.world.counts().collect()}  # a row for each archetype
        return float(min((sum(self._counts.get(a.name, 0) for a in self.world.matches([c])) for c in components), default=sum(self._counts.values())))

    def scan(self, *terms: str | Term) -> ScanBuilder:
        return ScanBuilder(self, terms_of(terms), None)

    def scan_with_estimate(self, rows: float, *terms: str | Term) -> ScanBuilder:
        return ScanBuilder(self, terms_of(terms), float(rows))

    def subscribe(self, *terms: str | Term) -> SubscriptionBuilder:
        return SubscriptionBuilder(self, terms_of(terms))


class ScanBuilder:
    """Collects the parts of a plan; ``build`` puts them together."""

    def __init__(self, planner: QueryPlanner, terms: tuple[Term, ...], estimate: float | None):
        self.planner, self.terms, self.estimate = planner, terms, estimate
        self.predicates: list[Predicate] = []
        self.joins: list[_Join] = []
        self.aggregates: list[AggregateExpr] = []

    def filter(self, predicate: Predicate) -> ScanBuilder:
        self.predicates.append(predicate)
        return self

    def join(self, *terms: str | Term, kind: str = "inner") -> ScanBuilder:
        self.joins.append(_Join(terms_of(terms), kind))
        return self

    def er_join(self, reference: str, *terms: str | Term, kind: str = "inner") -> ScanBuilder:
        """Through a component that holds another entity's id. The right side is
        what that entity must have."""
        if reference not in self.planner.world.types:
            raise UnregisteredComponent(reference)
        self.joins.append(_Join(terms_of(terms), kind, reference))
        return self

    def with_right_estimate(self, rows: float) -> ScanBuilder:
        if not self.joins:
            raise BuilderOrder("an estimate needs a join before it")
        self.joins[-1].estimate = float(rows)
        return self

    def aggregate(self, expr: AggregateExpr) -> ScanBuilder:
        self.aggregates.append(expr)
        return self

    def build(self) -> QueryPlan:
        planner, warnings = self.planner, []
        terms = list(self.terms)
        for j in self.joins:
            if j.reference is None and j.kind == "inner":
                terms += [t for t in j.terms if t not in terms]
                warnings.append(PlanWarning("JoinEliminated", "inner join on " + ", ".join(t.component for t in j.terms)))
        required = [t.component for t in terms if t.required]
        rows = self.estimate if self.estimate is not None else planner.rows_with(required)
        node, rest, gather = self._driver(rows, required, warnings)
        for p in rest:
            c = node.cost
            node = Node(f"Filter {p.text}", Cost(c.rows * p.selectivity, c.cpu + c.rows * FILTER * (BRANCH if p.kind == "custom" else FLAT)), [node])
        for j in [j for j in self.joins if j.reference is None and j.kind == "left"]:
            node = self._left(node, j)
        for j in [j for j in self.joins if j.reference is not None]:
            node = self._reference(node, j, warnings)
        labels = [a.label for a in self.aggregates]
        for label in dict.fromkeys(x for x in labels if labels.count(x) > 1):
            warnings.append(PlanWarning("DuplicateAggregateLabel", label))
        if self.aggregates:
            node = Node("Aggregate " + ", ".join(labels), Cost(1, node.cost.cpu + AGGREGATE * node.cost.rows * len(labels)), [node])
        return QueryPlan(planner.world, tuple(terms), self, node, warnings, gather)

    def _driver(self, rows: float, required: list[str], warnings: list[PlanWarning]) -> tuple[Node, list[Predicate], tuple[Any, Predicate] | None]:
        """The cheapest way in, the predicates left after it (most selective
        first), and the index that serves the other one."""
        planner, choices = self.planner, []
        for p in self.predicates:
            kinds = planner.indexes.get(p.component, {})
            if p.indexable:
                usable = [k for k in ("btree", "hash") if k in kinds and (p.kind == "eq" or k == "btree")]
                if usable:
                    n = max(rows * p.selectivity, 1)
                    choices.append((INDEX + n, 1, Node(f"IndexGather {usable[0]} {p.text}", Cost(n, INDEX + n)), p))
                else:
                    warnings.append(PlanWarning("IndexKindMismatch" if kinds else "MissingIndex", p.text))
            elif p.spatial and p.component in planner.spatial:
                cost = planner.spatial[p.component].supports(p)
                if cost is None:
                    warnings.append(PlanWarning("SpatialIndexDeclined", p.text))
                else:
                    choices.append((float(cost), 0, Node(f"SpatialGather {p.text}", Cost(max(rows * p.selectivity, 1), float(cost))), p))
        order = sorted(self.predicates, key=lambda p: p.selectivity)
        if choices:
            _, _, node, used = min(choices, key=lambda c: c[:2])
            index = planner.spatial[used.component] if used.spatial else planner.indexes[used.component][node.text.split()[1]]
            return node, [p for p in order if p is not used], (index, used)
        return Node("Scan " + ", ".join(required or ["*"]), Cost(rows, rows * SCAN * SCAN_FACTOR)), order, None

    def _left(self, node: Node, j: _Join) -> Node:
        left = node.cost
        right = j.estimate if j.estimate is not None else self.planner.rows_with([t.component for t in j.terms if t.required])
        child = Node("Scan " + ", ".join(t.component for t in j.terms), Cost(right, right * SCAN * SCAN_FACTOR))
        rows = max(math.sqrt(left.rows * right), 1)
        if max(left.rows, right) >= HASH_ROWS:
            return Node("HashJoin left", Cost(rows, left.cpu + child.cost.cpu + right * BUILD + left.rows * PROBE), [node, child])
        return Node("NestedLoopJoin left", Cost(rows, left.cpu + child.cost.cpu + left.rows * right * PAIR * NESTED_FACTOR), [node, child])

    def _reference(self, node: Node, j: _Join, warnings: list[PlanWarning]) -> Node:
        left = node.cost
        if j.kind == "left":
            return Node(f"ReferenceJoin left {j.reference}", left, [node])
        right = j.estimate if j.estimate is not None else self.planner.rows_with([t.component for t in j.terms if t.required])
        if j.reference not in self.planner.indexes:
            warnings.append(PlanWarning("UnindexedJoin", j.reference))
        child = Node("Scan " + ", ".join(t.component for t in j.terms), Cost(right, right))
        return Node(f"ReferenceJoin inner {j.reference}", Cost(left.rows * REF_ROWS, left.cpu + right + REF_PROBE * left.rows), [node, child])


class QueryPlan:
    """A built plan. Executing it collects ids; ``entities`` and ``rows`` stay
    lazy frames."""

    def __init__(self, world: World, terms: tuple[Term, ...], builder: ScanBuilder, root: Node, warnings: list[PlanWarning], gather: tuple[Any, Predicate] | None = None):
        self.world, self.terms, self.root, self.warnings, self.gather = world, terms, root, warnings, gather
        self.world_id = world.id
        self._builder = builder
        self.last_read = 0

    @property
    def cost(self) -> Cost:
        return self.root.cost

    @property
    def has_aggregates(self) -> bool:
        return bool(self._builder.aggregates)

    def _check(self, world: World | None) -> None:
        if world is not None and world.id != self.world_id:
            raise WorldMismatch("the plan belongs to another world")

    def rows(self, *columns: str) -> DataFrame:
        """The result entities with the columns named, unread columns pruned."""
        b, world = self._builder, self.world
        extra = list(dict.fromkeys([*columns, *(p.component for p in b.predicates), *(c for p in b.predicates for c in p.needs), *(j.reference for j in b.joins if j.reference and j.kind == "inner"), *(a.component for a in b.aggregates if a.component)]))
        df = world.scan(self.terms, self.last_read, extra=extra)
        if self.gather is not None:
            # Candidates of the index, checked again below. A value index that
            # isn't in step with the world might lack some, so it is left out.
            index, used = self.gather
            if used.spatial:
                df = df.join(index.candidates(used).select(ID), ID, "left_semi")
            elif not index.stale():
                df = df.join(index.gather(used), ID, "left_semi")
        for p in b.predicates:
            if p.kind == "semi":
                df = df.where(F.col(p.component).isNotNull())
                df = df.join(p.test(world).select(F.col(ID).alias("_other")), F.col(p.component) == F.col("_other"), "left_semi")
            else:
                df = df.where(F.col(p.component).isNotNull() & p.test(world))
        for j in b.joins:
            if j.reference is not None and j.kind == "inner":
                right = world.scan(j.terms, self.last_read).select(F.col(ID).alias("_target"))
                # A hint from the user's estimate only; otherwise statistics decide.
                right = F.broadcast(right) if j.estimate is not None and j.estimate < BROADCAST_ROWS else right
                df = df.join(right, F.col(j.reference) == F.col("_target"), "left_semi")
        return df

    def entities(self) -> DataFrame:
        return self.rows().select(ID)

    def _advance(self) -> None:
        self.last_read = self.world.tick

    def execute_collect(self, world: World | None = None) -> list[int]:
        """Ids on the driver; what was read counts as seen."""
        self._check(world)
        out = [r[0] for r in self.entities().collect()]
        self._advance()
        return out

    def execute_collect_raw(self, world: World | None = None) -> list[int]:
        self._check(world)
        return [r[0] for r in self.entities().collect()]

    def execute_stream(self, visit: Callable[[int], None], world: World | None = None) -> None:
        """One id at a time, a partition in memory at most."""
        self.execute_stream_raw(visit, world)
        self._advance()

    def execute_stream_raw(self, visit: Callable[[int], None], world: World | None = None) -> None:
        self._check(world)
        for r in self.entities().toLocalIterator():
            visit(r[0])

    def batched(self, *terms: str | Term) -> DataFrame:
        """Result entities with fetched columns. A required component that a
        result lacks is an error when the frame is run."""
        ts = terms_of(terms)
        missing = [t.component for t in ts if t.component not in self.world.types]
        if missing:
            raise ComponentMismatch(", ".join(missing))
        df = self.rows(*(t.component for t in ts))
        for t in ts:
            if t.required:
                name = t.component
                df = df.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"ComponentMismatch: {name}"))))
        return df.select(ID, "archetype", *[t.component for t in ts])

    def chunks(self, function, schema: str, *terms: str | Term) -> DataFrame:
        """Arrow batches of the fetched columns through ``function``."""
        return self.batched(*terms).mapInArrow(function, schema)

    def aggregate(self, world: World | None = None) -> AggregateResult:
        out = self.aggregate_raw(world)
        self._advance()
        return out

    def aggregate_raw(self, world: World | None = None) -> AggregateResult:
        self._check(world)
        row = self.aggregate_frame().first()
        return AggregateResult([a.label for a in self._builder.aggregates], list(row))

    def aggregate_frame(self, *names: str) -> DataFrame:
        """One row, one column for each aggregate, in call order."""
        aggs = self._builder.aggregates
        names = names or tuple(f"a{i}" for i in range(len(aggs)))
        return self.rows().agg(*[a.column().alias(n) for a, n in zip(aggs, names, strict=True)])

    def explain(self, physical: bool = False) -> str:
        text = "\n".join([*self.root.lines(), *(f"! {w.kind}: {w.text}" for w in self.warnings)])
        if physical:
            text += "\n" + self.entities()._jdf.queryExecution().explainString(self.world.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return text

    def validate_constraints(self, *constraints: Constraint) -> list[str]:
        """Those that the estimate breaks by more than a half."""
        rows = self.cost.rows
        return [c.text for c in constraints if rows < c.low - 0.5 or rows > c.high + 0.5]

    def cheaper(self, other: QueryPlan) -> QueryPlan:
        return other if other.cost.cpu < self.cost.cpu else self


class SubscriptionBuilder:
    """A plan of changes whose every predicate has an index of its kind."""

    def __init__(self, planner: QueryPlanner, terms: tuple[Term, ...]):
        self.planner, self.terms = planner, terms
        self.parts: list[tuple[Indexed, Predicate]] = []

    def where_eq(self, witness: Indexed, value: Any) -> SubscriptionBuilder:
        self.parts.append((witness, Predicate.eq(witness.component, value)))
        return self

    def where_range(self, witness: Indexed, low: Any = None, high: Any = None, **kw: Any) -> SubscriptionBuilder:
        self.parts.append((witness, Predicate.range(witness.component, low, high, **kw)))
        return self

    def build(self) -> QueryPlan:
        reasons = []
        if not any(t.kind == "changed" for t in self.terms):
            reasons.append("a subscription needs a Changed term")
        for w, p in self.parts:
            kinds = self.planner.indexes.get(w.component, {})
            if w.kind not in kinds:
                reasons.append(f"{w.component} has no {w.kind} index in this planner")
            elif p.kind == "range" and "btree" not in kinds:
                reasons.append(f"a range of {w.component} needs a btree index")
            elif p.kind == "range" and w.kind != "btree":
                reasons.append(f"the witness of a range of {w.component} is a {w.kind} index")
        if reasons:
            raise SubscriptionError(reasons)
        scan = self.planner.scan(*self.terms)
        for _, p in self.parts:
            scan.filter(p)
        return scan.build()


class TablePlanner:
    """A planner for one declared table, whose schema says what is indexed
    (``metadata={"index": "btree" | "hash"}``)."""

    def __init__(self, planner: QueryPlanner, schema):
        self.planner, self.schema = planner, schema

    def _index(self, field: str, kinds: tuple[str, ...]) -> Indexed:
        declared = self.schema[field].metadata.get("index")
        if declared not in kinds:
            raise TypeError(f"{field} is declared with {declared or 'no'} index, not {' or '.join(kinds)}")
        if declared not in self.planner.indexes.get(field, {}):
            self.planner.add_index(ValueIndex(self.planner.world, field, declared))
        return Indexed(field, declared)

    def btree(self, field: str) -> Indexed:
        return self._index(field, ("btree",))

    def hash(self, field: str) -> Indexed:
        return self._index(field, ("hash",))

    def scan(self) -> ScanBuilder:
        return self.planner.scan(*self.schema.names)

    def where_eq(self, field: str, value: Any) -> ScanBuilder:
        self._index(field, ("btree", "hash"))
        return self.scan().filter(Predicate.eq(field, value))

    def where_range(self, field: str, low: Any = None, high: Any = None, **kw: Any) -> ScanBuilder:
        self._index(field, ("btree",))
        return self.scan().filter(Predicate.range(field, low, high, **kw))
