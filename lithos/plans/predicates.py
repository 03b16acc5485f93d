"""Predicates: column expressions with a selectivity and, where an index can
serve them, what it must support. All predicates of a scan hold together."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.errors import InvalidPredicate

#: Selectivities assumed for equality, ranges and spatial predicates.
EQ_SELECTIVITY, RANGE_SELECTIVITY, SPATIAL_SELECTIVITY = 0.01, 0.1, 0.1


@dataclass(frozen=True)
class Predicate:
    """``test(world)`` gives the condition on the scan's columns."""

    component: str
    kind: str
    text: str
    test: Callable[[Any], Column]
    selectivity: float
    needs: tuple[str, ...] = ()

    def with_selectivity(self, s: float) -> Predicate:
        """The same, with an estimate clamped to 0..1 (NaN: 1)."""
        return replace(self, selectivity=1.0 if math.isnan(s) else min(max(s, 0.0), 1.0))

    # ------------------------------------------------------- constructors

    @staticmethod
    def eq(component: str, value: Any) -> Predicate:
        def test(world) -> Column:
            c = F.col(component)
            if isinstance(value, float) and math.isnan(value):
                return F.lit(False)  # NaN equals nothing
            return c == F.lit(value)

        return Predicate(component, "eq", f"{component} = {value!r}", test, EQ_SELECTIVITY)

    @staticmethod
    def range(component: str, low: Any = None, high: Any = None, *, low_open: bool = False, high_open: bool = True) -> Predicate:
        """Bounds may be included, excluded or absent. Floats have no total
        order, so they have no ranges; use ``custom_column``."""

        def test(world) -> Column:
            if isinstance(world.types.get(component), (T.FloatType, T.DoubleType)):
                raise InvalidPredicate(f"{component} is a float; ranges need a total order")
            c, out = F.col(component), F.col(component).isNotNull()
            if low is not None:
                out = out & ((c > low) if low_open else (c >= low))
            if high is not None:
                out = out & ((c < high) if high_open else (c <= high))
            return out

        left = "(-inf" if low is None else ("(" if low_open else "[") + repr(low)
        right = "inf)" if high is None else repr(high) + (")" if high_open else "]")
        return Predicate(component, "range", f"{component} in {left}, {right}", test, RANGE_SELECTIVITY)

    @staticmethod
    def custom(component: str, text: str, selectivity: float, test: Callable[[Any], Column], needs: tuple[str, ...] = ()) -> Predicate:
        """Any condition; it may read other components (``needs``)."""
        return Predicate(component, "custom", text, test, 1.0, needs).with_selectivity(selectivity)

    @staticmethod
    def custom_column(component: str, text: str, selectivity: float, test: Callable[[Column], Column]) -> Predicate:
        """A condition on one column; NaN passes none that compares."""

        def run(world) -> Column:
            c = F.col(component)
            ok = test(c)
            return ok & ~F.isnan(c) if isinstance(world.types.get(component), (T.FloatType, T.DoubleType)) else ok

        return Predicate(component, "custom_column", text, run, 1.0).with_selectivity(selectivity)

    @staticmethod
    def semi(component: str, text: str, selectivity: float, other: Callable[[Any], Any]) -> Predicate:
        """A test that looks at other entities: keep rows whose component is
        among the ids of ``other(world)``, a frame with a column ``entity_id``.
        It becomes a semi join."""
        p = Predicate(component, "semi", text, lambda world: other(world), 1.0)
        return p.with_selectivity(selectivity)

    @staticmethod
    def within(component: str, center: tuple[float, ...], radius: float, coordinates: Callable[[Column], list[Column]] | None = None) -> Predicate:
        """Inclusive distance from a point."""
        if not center or not math.isfinite(radius) or radius < 0:
            raise InvalidPredicate("within needs a center and a finite radius of at least 0")

        def test(world) -> Column:
            xs = _coordinates(world, component, len(center), coordinates)
            box = _all([x.between(c - radius, c + radius) for x, c in zip(xs, center, strict=True)])
            return box & (_sum([(x - F.lit(c)) * (x - F.lit(c)) for x, c in zip(xs, center, strict=True)]) <= F.lit(radius * radius))

        return Predicate(component, "within", f"{component} within {radius} of {center}", test, SPATIAL_SELECTIVITY)

    @staticmethod
    def intersects(component: str, low: tuple[float, ...], high: tuple[float, ...], coordinates: Callable[[Column], list[Column]] | None = None) -> Predicate:
        """Inclusive box."""
        if not low or len(low) != len(high) or any(not a <= b for a, b in zip(low, high, strict=True)):
            raise InvalidPredicate("intersects needs equal, non-zero dimensions with low <= high")

        def test(world) -> Column:
            xs = _coordinates(world, component, len(low), coordinates)
            return _all([x.between(a, b) for x, a, b in zip(xs, low, high, strict=True)])

        return Predicate(component, "intersects", f"{component} intersects {low}..{high}", test, SPATIAL_SELECTIVITY)

    @property
    def spatial(self) -> bool:
        return self.kind in ("within", "intersects")

    @property
    def indexable(self) -> bool:
        return self.kind in ("eq", "range")


def _coordinates(world, component: str, n: int, given) -> list[Column]:
    """The first ``n`` coordinates of a struct, array or scalar, as doubles."""
    c, kind = F.col(component), world.types.get(component)
    if given is not None:
        xs = given(c)
    elif isinstance(kind, T.StructType):
        xs = [c[f] for f in kind.names[:n]]
    elif isinstance(kind, T.ArrayType):
        xs = [F.get(c, F.lit(i)) for i in range(n)]
    else:
        xs = [c]
    return [x.cast("double") for x in xs]


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out
