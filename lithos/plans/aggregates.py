"""Scalar aggregates over a whole plan, in doubles.

Counts see every entity; the others skip entities without the component. Empty:
count and sum are 0, the others NaN. A NaN makes min, max, sum and avg NaN."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AggregateExpr:
    """``value`` maps the component's column to a number."""

    op: str
    label: str
    component: str | None = None
    value: Callable[[Column], Column] | None = None

    @staticmethod
    def count() -> AggregateExpr:
        return AggregateExpr("count", "COUNT(*)")

    @staticmethod
    def _of(op: str, component: str, name: str | None, value) -> AggregateExpr:
        return AggregateExpr(op, f"{op.upper()}({name or component})", component, value)

    @staticmethod
    def sum(component: str, name: str | None = None, value=None) -> AggregateExpr:
        return AggregateExpr._of("sum", component, name, value)

    @staticmethod
    def min(component: str, name: str | None = None, value=None) -> AggregateExpr:
        return AggregateExpr._of("min", component, name, value)

    @staticmethod
    def max(component: str, name: str | None = None, value=None) -> AggregateExpr:
        return AggregateExpr._of("max", component, name, value)

    @staticmethod
    def avg(component: str, name: str | None = None, value=None) -> AggregateExpr:
        return AggregateExpr._of("avg", component, name, value)

    def column(self) -> Column:
        if self.op == "count":
            return F.count(F.lit(1)).cast("double")
        c = F.col(self.component)
        x = (self.value(c) if self.value else c).cast("double")
        nan = F.lit(math.nan)
        if self.op == "sum":
            return F.coalesce(F.sum(x), F.lit(0.0))
        if self.op == "min":  # the built-in takes NaN for the largest value
            return F.when(F.max(F.isnan(x)), nan).otherwise(F.coalesce(F.min(x), nan))
        return F.coalesce({"max": F.max, "avg": F.avg}[self.op](x), nan)


class AggregateResult:
    """Values in call order; of equal labels the first is found by label."""

    def __init__(self, labels: list[str], values: list[float]):
        self.labels, self.values = labels, values

    def get(self, i: int) -> float | None:
        return self.values[i] if 0 <= i < len(self.values) else None

    def get_by_label(self, label: str) -> float | None:
        return self.values[self.labels.index(label)] if label in self.labels else None

    def __iter__(self) -> Iterator[tuple[str, float]]:
        return iter(zip(self.labels, self.values, strict=True))

    def __len__(self) -> int:
        return len(self.values)

    def __str__(self) -> str:
        return ", ".join(f"{k}: {v:.2f}" for k, v in self)
