"""Simulation steps over component frames. Each is one pass of expressions, or
one grid join and a grouped sum; callers cut the lineage every few steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions.torus import clamp, wrap
from lithos.operators.spatial import SpatialGrid
from lithos.world import ID


def _limit(x: str, y: str, most: float) -> tuple[Column, Column]:
    """A vector, shortened to a length."""
    n = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    k = F.when(n > most, F.lit(float(most)) / n).otherwise(1.0)
    return F.col(x) * k, F.col(y) * k


def _places(rows: DataFrame, **sums: Column) -> DataFrame:
    """One row for each distinct position: ``place, n`` and sums over what stands
    there. Forces depend on positions alone, so rows that coincide act and are
    acted on as one, and pairs are of places, not of rows."""
    place = F.struct("pos_x", "pos_y")
    return rows.where("pos_x IS NOT NULL AND pos_y IS NOT NULL").groupBy("pos_x", "pos_y").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()]).withColumn("place", place)


def _at_place(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with what was found for their position, if anything."""
    found = found.withColumns({"_px": F.col("entity_id.pos_x"), "_py": F.col("entity_id.pos_y")}).drop("entity_id")
    return rows.join(found, (F.col("pos_x") == F.col("_px")) & (F.col("pos_y") == F.col("_py")), "left").drop("_px", "_py")


def boids_forces(rows: DataFrame, *, world_size: float = 500.0, separation_radius: float = 25.0, alignment_radius: float = 50.0, cohesion_radius: float = 50.0, separation_weight: float = 1.5, alignment_weight: float = 1.0, cohesion_weight: float = 1.0, max_force: float = 0.5) -> DataFrame:
    """``acc_x, acc_y`` of every boid from its neighbours within the radii."""
    reach = max(separation_radius, alignment_radius, cohesion_radius)
    grid = SpatialGrid(world_size, reach / 2)
    places = _places(rows, ovx=F.col("vel_x"), ovy=F.col("vel_y"), ovn=F.when(F.col("vel_x").isNotNull() & F.col("vel_y").isNotNull(), 1))
    grid.rebuild(places, "place", "pos_x", "pos_y", ("n", "ovx", "ovy", "ovn"))
    near = grid.neighbours(reach).where("d2 >= 1e-6").withColumn("d", F.sqrt("d2"))
    sep, ali, coh = (F.col("d") < r for r in (separation_radius, alignment_radius, cohesion_radius))

    def mean(when: Column, value: Column, weight: str) -> Column:
        return F.sum(F.when(when, value)) / F.sum(F.when(when, F.col(weight)))

    n = F.col("n")
    means = near.groupBy(ID).agg(
        mean(sep, -F.col("dx") / F.col("d2") * n, "n").alias("sx"), mean(sep, -F.col("dy") / F.col("d2") * n, "n").alias("sy"),
        mean(ali, F.col("ovx"), "ovn").alias("ax"), mean(ali, F.col("ovy"), "ovn").alias("ay"),
        mean(coh, F.col("dx") * n, "n").alias("cx"), mean(coh, F.col("dy") * n, "n").alias("cy"),
    )
    out = _at_place(rows, means)
    zero = F.lit(0.0)
    for axis in "xy":
        force = (
            F.coalesce(F.col(f"s{axis}"), zero) * separation_weight
            + F.coalesce(F.col(f"a{axis}") - F.col(f"vel_{axis}"), zero) * alignment_weight
            + F.coalesce(F.col(f"c{axis}"), zero) * cohesion_weight
        )
        out = out.withColumn(f"_f{axis}", force)
    fx, fy = _limit("_fx", "_fy", max_force)
    return out.select(ID, "pos_x", "pos_y", "vel_x", "vel_y", fx.alias("acc_x"), fy.alias("acc_y"))


def boids_integrate(rows: DataFrame, *, dt: float = 1.0, max_speed: float = 4.0, world_size: float = 500.0) -> DataFrame:
    """Velocity from acceleration, at most ``max_speed``; position from it."""
    out = rows.withColumns({"_vx": F.col("vel_x") + F.col("acc_x") * dt, "_vy": F.col("vel_y") + F.col("acc_y") * dt})
    vx, vy = _limit("_vx", "_vy", max_speed)
    out = out.withColumns({"vel_x": vx, "vel_y": vy}).drop("_vx", "_vy")
    return out.withColumns({f"pos_{a}": wrap(F.col(f"pos_{a}") + F.col(f"vel_{a}") * dt, world_size) for a in "xy"})


def gravity(rows: DataFrame, *, g: float = 1.0, softening: float = 1.0, dt: float = 0.1, world_size: float = 500.0) -> DataFrame:
    """Every body pulls every other along the shortest way, by the softened
    distance in both the force and its direction. Bodies of one place pull as
    one. The places are their own stated set against all, so this is n * n by
    definition: each meets all cells of the grid, dealt by cell, and sums are
    partial."""
    grid = SpatialGrid(world_size, world_size / 8)
    grid.rebuild(_places(rows, pull=F.col("mass")), "place", "pos_x", "pos_y", ("pull",))
    pairs = grid.neighbours(world_size)  # beyond the farthest point of a torus
    soft = F.col("d2") + softening * softening
    force = F.col("pull") * g / (soft * F.sqrt(soft))
    sums = pairs.where("d2 > 0").groupBy(ID).agg(F.sum(force * F.col("dx")).alias("gx"), F.sum(force * F.col("dy")).alias("gy"))
    out = _at_place(rows, sums)
    out = out.withColumns({f"vel_{a}": F.col(f"vel_{a}") + F.coalesce(F.col(f"g{a}"), F.lit(0.0)) * dt for a in "xy"})
    return out.withColumns({f"pos_{a}": wrap(F.col(f"pos_{a}") + F.col(f"vel_{a}") * dt, world_size) for a in "xy"}).drop("gx", "gy")


def life_step(cells: DataFrame, width: int, height: int) -> DataFrame:
    """``entity_id`` (row-major cell number) and ``alive`` one generation on, on
    a torus. Only live cells speak to their neighbours."""
    x, y = F.col(ID) % width, F.floor(F.col(ID) / width)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
    told = cells.where("alive").withColumn("o", F.explode(around)).select(
        (F.pmod(y + F.col("o.j"), F.lit(height)) * width + F.pmod(x + F.col("o.i"), F.lit(width))).cast("long").alias(ID)
    )
    counts = told.groupBy(ID).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return cells.join(counts, ID, "left").select(ID, ((n == 3) | (F.col("alive") & (n == 2))).alias("alive"))


def movement(rows: DataFrame, *, dt: float = 1.0, world_size: float = 500.0) -> DataFrame:
    """A step along the heading."""
    return rows.withColumns({"pos_x": wrap(F.col("pos_x") + F.cos("heading") * dt, world_size), "pos_y": wrap(F.col("pos_y") + F.sin("heading") * dt, world_size)})


def worm_move(rows: DataFrame, *, speed: float = 1.0, dt: float = 1.0, world_size: float = 500.0) -> DataFrame:
    """Slower with less energy."""
    step = clamp(F.col("energy") / 100.0, 0.1, 1.0) * (speed * dt)
    return rows.withColumns({"pos_x": wrap(F.col("pos_x") + F.cos("heading") * step, world_size), "pos_y": wrap(F.col("pos_y") + F.sin("heading") * step, world_size)})


def worm_metabolism(rows: DataFrame, *, rate: float = 1.0, dt: float = 1.0) -> DataFrame:
    """Energy drains; below 20 the worm shrinks, to 0.5 at least."""
    energy = F.greatest(F.col("energy") - rate * dt, F.lit(0))
    size = F.when(energy < 20, F.greatest(F.col("worm_size") - 0.1 * dt, F.lit(0.5))).otherwise(F.col("worm_size"))
    return rows.withColumns({"energy": energy, "worm_size": size})


# Fixed values of the circuit: a 555 astable timer drives a source resistor, an
# inductor and a loaded filter capacitor, and a unity-gain follower reads the
# filter. Ohms, farads, henries, volts, volts a second.
TIMER_R1, TIMER_R2, TIMER_C = 10e3, 10e3, 10e-9
DRIVE_DROP, DRIVE_LOW = 1.5, 0.2
SOURCE_R, LOAD_R, COIL_L, INPUT_C, FILTER_C = 1e3, 10e3, 10e-3, 1e-10, 100e-9
GAIN, SLEW, HEADROOM = 200_000.0, 0.5e6, 2.0


def circuit(parameters: DataFrame, steps: int = 1000, sample_every: int = 20) -> DataFrame:
    """Waveforms ``sim, time, v_555, v_filter, v_opamp``, one row for every
    ``sample_every`` steps of each parameter set (``sim, vcc, dt``). A set is a
    serial integration; the sets of a batch advance together as vectors, and
    batches run in parallel. Null or non-positive values are an error."""
    if sample_every < 1:
        raise ValueError("sample_every is at least 1")
    names = ["sim", "time", "v_555", "v_filter", "v_opamp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim, vcc, dt = (batch.column(i).to_numpy(zero_copy_only=False).astype(t) for i, t in enumerate((np.int64, float, float)))
            if not (np.isfinite(vcc) & np.isfinite(dt) & (vcc > 0) & (dt > 0)).all():
                raise ValueError("vcc and dt are finite and positive")
            charge, v_in, v_filter, v_out, coil = (np.zeros(len(sim)) for _ in range(5))
            high = np.ones(len(sim), dtype=bool)
            for k in range(1, steps + 1):
                # The timer's capacitor, held at the threshold that turns it.
                charge = charge + np.where(high, (vcc - charge) / (TIMER_R1 + TIMER_R2), -charge / TIMER_R2) * dt / TIMER_C
                top, low = high & (charge >= 2 * vcc / 3), ~high & (charge <= vcc / 3)
                charge = np.where(top, 2 * vcc / 3, np.where(low, vcc / 3, charge))
                high = (high & ~top) | low
                drive = np.where(high, vcc - DRIVE_DROP, DRIVE_LOW)
                # Currents from the voltages before, then the coil, then the nodes.
                source, load = (drive - v_in) / SOURCE_R, v_filter / LOAD_R
                coil = coil + (v_in - v_filter) / COIL_L * dt
                v_in, v_filter = v_in + (source - coil) / INPUT_C * dt, v_filter + (coil - load) / FILTER_C * dt
                most = vcc - HEADROOM
                wish = np.clip(GAIN * (v_filter - v_out), -most, most)
                v_out = v_out + np.clip(wish - v_out, -SLEW * dt, SLEW * dt)
                if k % sample_every == 0:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sim, k * dt, drive, v_filter, v_out)], names=names)

    source = parameters.select(F.col("sim").cast("long").alias("sim"), F.col("vcc").cast("double").alias("vcc"), F.col("dt").cast("double").alias("dt"))
    return source.mapInArrow(run, "sim bigint, time double, v_555 double, v_filter double, v_opamp double")
