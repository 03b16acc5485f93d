"""Change detection beyond ticks: debouncing and materialized views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithos.errors import WorldMismatch
from lithos.plans.planner import QueryPlan
from lithos.world import ID, World


def changed_archetypes(rows: DataFrame, archetype: str, tick: str, since) -> DataFrame:
    """Every row of the archetypes in which any row is newer than ``since``: one
    partially aggregated pass finds them, and a semi join keeps them."""
    newer = rows.groupBy(archetype).agg(F.max(tick).alias("_last")).where(F.col("_last") > since)
    return rows.join(newer.select(archetype), archetype, "left_semi")


def changed_rows(rows: DataFrame, tick: str, since) -> DataFrame:
    """Only the newer rows: an extension, finer than the archetype."""
    return rows.where(F.col(tick) > since)


def debounce(rows: DataFrame, entity: str, value: str, order: list[str]) -> DataFrame:
    """Rows that are the first of their entity, or whose value differs from the
    one before. A null is a value."""
    w = Window.partitionBy(entity).orderBy(*order)
    seen = rows.withColumn("_prev", F.lag(F.struct(value)).over(w))
    return seen.where("_prev IS NULL OR NOT (_prev.`%s` <=> `%s`)" % (value, value)).drop("_prev")


class HashDebounce:
    """Driver-side debounce of single values, as a subscription's filter."""

    def __init__(self) -> None:
        self._last: dict[int, int] = {}

    def check(self, entity: int, value) -> bool:
        """True at first sight or when the value differs from the last one."""
        h = hash(value)
        changed = self._last.get(entity) != h or entity not in self._last
        self._last[entity] = h
        return changed

    def remove(self, entity: int) -> None:
        self._last.pop(entity, None)

    def retain(self, live: set[int]) -> None:
        self._last = {k: v for k, v in self._last.items() if k in live}

    def __len__(self) -> int:
        return len(self._last)


@dataclass(frozen=True)
class DebouncePolicy:
    """Refresh on every call, or on the first and then each ``every``-th."""

    every: int = 1


class MaterializedView:
    """The plan's last result, replaced at each refresh, never merged: a plan of
    changes leaves only the last delta, and nothing if nothing changed."""

    def __init__(self, plan: QueryPlan, policy: DebouncePolicy = DebouncePolicy()):
        self.plan, self.policy = plan, policy
        self._frame: DataFrame | None = None
        self._calls = 0

    def set_policy(self, policy: DebouncePolicy) -> None:
        self.policy, self._calls = policy, 0

    def invalidate(self) -> None:
        """The next refresh runs, whatever the policy says."""
        self._calls = 0

    def refresh(self, world: World) -> bool:
        """Whether the plan ran. The world is checked even if it didn't."""
        if world.id != self.plan.world_id:
            raise WorldMismatch("the view belongs to another world")
        run = self._calls % max(1, self.policy.every) == 0
        self._calls += 1
        if run:
            new = self.plan.entities().persist()
            new.count()
            if self._frame is not None:
                self._frame.unpersist()
            self._frame = new
            self.plan._advance()
        return run

    def entities(self) -> DataFrame:
        if self._frame is None:
            return self.plan.world.entities().limit(0).select(ID)
        return self._frame
