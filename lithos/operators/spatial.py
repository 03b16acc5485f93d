"""Radius search on a torus by a grid: points meet through the cells of a
neighbourhood, an equi-join, and the exact distance decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions.torus import shortest, wrap


class SpatialGrid:
    """Cells of at least ``cell_size`` that divide the world evenly, so that no
    cell is narrower than the rest."""

    def __init__(self, world_size: float, cell_size: float):
        if not (world_size > 0 and cell_size > 0):
            raise ValueError("sizes are positive")
        self.world_size = float(world_size)
        self.cells = max(1, int(world_size // cell_size))
        self.width = self.world_size / self.cells
        self.points: DataFrame | None = None
        self.payload: tuple[str, ...] = ()

    def cell(self, x: Column) -> Column:
        return F.least(F.floor(wrap(x, self.world_size) / self.width), F.lit(self.cells - 1)).cast("long")

    def _offsets(self, radius: float) -> list[tuple[int, int]]:
        """Distinct cell offsets that a radius reaches; all cells at most."""
        reach = math.ceil(radius / self.width)
        if 2 * reach + 1 >= self.cells:
            return [(i, j) for i in range(self.cells) for j in range(self.cells)]
        apart = lambda i: max(abs(i) - 1, 0) * self.width
        steps = range(-reach, reach + 1)
        return [(i, j) for i in steps for j in steps if math.hypot(apart(i), apart(j)) <= radius]

    def rebuild(self, points: DataFrame, entity: str = "entity_id", x: str = "x", y: str = "y", payload: tuple[str, ...] = ()) -> None:
        """``payload`` columns travel with the points: `neighbours` gives those
        of the other point."""
        self.payload = payload
        self.points = points.select(F.col(entity).alias("entity_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *payload)

    def query_radius(self, x: float, y: float, radius: float) -> DataFrame:
        """Ids within an inclusive distance of one point: a filter, no join."""
        dx, dy = shortest(F.lit(float(x)), wrap(F.col("x"), self.world_size), self.world_size), shortest(F.lit(float(y)), wrap(F.col("y"), self.world_size), self.world_size)
        return self.points.where(dx * dx + dy * dy <= radius * radius).select("entity_id")

    def neighbours(self, radius: float) -> DataFrame:
        """``entity_id, other, dx, dy, d2`` and the other's payload for every
        ordered pair within the radius. A cell's points meet through its
        neighbourhood only."""
        s = self.world_size
        home = self.points.withColumns({"cx": self.cell(F.col("x")), "cy": self.cell(F.col("y")), "x": wrap(F.col("x"), s), "y": wrap(F.col("y"), s)})
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in self._offsets(radius)])
        asks = home.drop(*self.payload).withColumn("o", F.explode(around)).select(
            "entity_id", "x", "y", F.pmod(F.col("cx") + F.col("o.i"), F.lit(self.cells)).alias("cx"), F.pmod(F.col("cy") + F.col("o.j"), F.lit(self.cells)).alias("cy")
        )
        there = home.select(F.col("entity_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy", *self.payload)
        pairs = asks.join(there, ["cx", "cy"]).where("entity_id <> other")
        pairs = pairs.withColumns({"dx": shortest(F.col("x"), F.col("ox"), s), "dy": shortest(F.col("y"), F.col("oy"), s)})
        pairs = pairs.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
        return pairs.where(F.col("d2") <= radius * radius).select("entity_id", "other", "dx", "dy", "d2", *self.payload)
