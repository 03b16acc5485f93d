"""The simulation steps as named reducers over the shipped components."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.components import COMPONENTS
from lithos.operators import kernels
from lithos.operators.reducers import QueryWriter, ReducerRegistry
from lithos.world import ID, Mut, Term

#: Reducer: the step, the components it reads, and those it writes.
STEPS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], tuple[str, ...]]] = {
    "boids_forces": (kernels.boids_forces, ("Position", "Velocity"), ("Acceleration",)),
    "boids_integrate": (kernels.boids_integrate, ("Acceleration",), ("Position", "Velocity")),
    "gravity": (kernels.gravity, ("Mass",), ("Position", "Velocity")),
    "life_step": (kernels.life_step, (), ("CellState",)),
    "movement": (kernels.movement, ("Heading",), ("Position",)),
    "worm_move": (kernels.worm_move, ("Heading", "Energy"), ("Position",)),
    "worm_metabolism": (kernels.worm_metabolism, (), ("Energy", "WormSize")),
}


def _body(step: Callable[..., DataFrame], terms: tuple[str, ...], writes: tuple[str, ...]) -> Callable[..., None]:
    def run(writer: QueryWriter, **args: Any) -> None:
        rows = writer.rows()
        flat = rows.select(ID, *[f"{c}.*" for c in terms])
        if step is kernels.life_step and flat.count() != args["width"] * args["height"]:
            raise ValueError("the cells don't fill the grid")
        out = step(flat, **args)
        packed = [F.expr(f"named_struct({', '.join(f"'{n}', `{n}`" for n in _fields(c))})").cast(COMPONENTS[c]).alias(c) for c in writes]
        writer.set(out.select(ID, *packed))

    return run


def _fields(component: str) -> list[str]:
    return [f.split(":")[0] for f in COMPONENTS[component].removeprefix("struct<").removesuffix(">").split(",")]


def register_builtin(registry: ReducerRegistry) -> list[str]:
    """Register all steps; their names. ``life_step`` numbers its cells by id."""
    for name, (step, reads, writes) in STEPS.items():
        own = () if name == "boids_forces" else writes
        terms = (*reads, *own)
        registry.register(name, "query_mut", _body(step, terms, writes), *[Term(c) for c in reads], *[Mut(c) for c in own], writes=writes)
    return list(STEPS)
