"""Simulation steps against plain Python, and the grid against all pairs."""

import math

import numpy as np
import pytest

from lithos.operators import kernels
from lithos.operators.spatial import SpatialGrid


def wrapped(d, s):
    return d - s if d > s / 2 else d + s if d < -s / 2 else d


@pytest.mark.parametrize(("size", "cell", "radius"), [(8, 2, 4), (10, 3, 3), (100, 7, 20), (100, 60, 30)])
def test_grid_finds_every_pair_once(spark, size, cell, radius):
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, size, (60, 2)))]
    grid = SpatialGrid(size, cell)
    grid.rebuild(spark.createDataFrame(pts, "entity_id bigint, x double, y double"))
    got = [(r.entity_id, r.other) for r in grid.neighbours(radius).collect()]
    want = {(a, b) for a, ax, ay in pts for b, bx, by in pts if a != b and wrapped(bx - ax, size) ** 2 + wrapped(by - ay, size) ** 2 <= radius**2}
    assert len(got) == len(set(got)) and set(got) == want
    near = {r[0] for r in grid.query_radius(pts[0][1], pts[0][2], radius).collect()}
    assert near == {b for a, b in want if a == 0} | {0}
    with pytest.raises(ValueError):
        SpatialGrid(0, 1)


def test_life_blinker_and_torus(spark):
    alive = {(2, 1), (2, 2), (2, 3)}
    cells = spark.createDataFrame([(y * 5 + x, (x, y) in alive) for y in range(5) for x in range(5)], "entity_id bigint, alive boolean")
    one = kernels.life_step(cells, 5, 5)
    assert {r[0] for r in one.where("alive").collect()} == {2 * 5 + x for x in (1, 2, 3)}
    two = kernels.life_step(one, 5, 5)
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, cells.collect()))


def test_boids_two_bodies(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0, 1.0, 0.0), (2, 499.0, 5.0, 0.0, 1.0), (3, 250.0, 250.0, 0.0, 0.0)], "entity_id bigint, pos_x double, pos_y double, vel_x double, vel_y double")
    out = {r.entity_id: r for r in kernels.boids_forces(rows, max_force=100).collect()}
    # The way from 1 to 2 is -2 across the edge.
    assert out[1].acc_x == pytest.approx(1.5 * 0.5 - 1 - 2) and out[1].acc_y == pytest.approx(1.0)
    assert out[3].acc_x == 0
    moved = {r.entity_id: r for r in kernels.boids_integrate(kernels.boids_forces(rows)).collect()}
    assert math.hypot(moved[1].vel_x - 1, moved[1].vel_y) == pytest.approx(0.5)


def test_gravity_is_mutual(spark):
    rows = spark.createDataFrame([(1, 10.0, 10.0, 0.0, 0.0, 2.0), (2, 20.0, 10.0, 0.0, 0.0, 1.0), (3, 300.0, 400.0, 0.0, 0.0, 1.0)], "entity_id bigint, pos_x double, pos_y double, vel_x double, vel_y double, mass double")
    got = {r.entity_id: r for r in kernels.gravity(rows, g=3.0, softening=1.0, dt=1.0).collect()}
    dx, dy = wrapped(300 - 20.0, 500), wrapped(400 - 10.0, 500)
    far = 3 / (dx * dx + dy * dy + 1) ** 1.5  # softened in force and direction
    assert got[2].vel_x == pytest.approx(-3 * 2 * 10 / 101**1.5 + far * dx)


def _forces(boids, reach=50.0, close=25.0):
    out = {}
    for i, x, y, vx, vy in boids:
        sums = {"s": [0.0, 0.0, 0], "a": [0.0, 0.0, 0], "c": [0.0, 0.0, 0]}
        for j, ox, oy, ovx, ovy in boids:
            dx, dy = wrapped(ox - x, 500), wrapped(oy - y, 500)
            d2 = dx * dx + dy * dy
            if i == j or d2 < 1e-6:
                continue
            for k, radius, v in (("s", close, (-dx / d2, -dy / d2)), ("a", reach, (ovx, ovy)), ("c", reach, (dx, dy))):
                if math.sqrt(d2) < radius:
                    sums[k] = [sums[k][0] + v[0], sums[k][1] + v[1], sums[k][2] + 1]
        m = {k: (v[0] / v[2], v[1] / v[2]) if v[2] else None for k, v in sums.items()}
        out[i] = [1.5 * (m["s"][a] if m["s"] else 0) + (m["a"][a] - (vx, vy)[a] if m["a"] else 0) + (m["c"][a] if m["c"] else 0) for a in (0, 1)]
    return out


def test_boids_against_all_pairs(spark):
    """Places that several boids share, some a hair apart, and the torus' edge."""
    rng = np.random.default_rng(5)
    spots = rng.uniform(0, 500, (25, 2)).round(1).tolist() + [[0.0, 499.9], [499.9, 0.0], [100.0, 100.0], [100.0005, 100.0]]
    boids = [(i, *spots[rng.integers(len(spots))], *rng.normal(size=2).tolist()) for i in range(150)]
    rows = spark.createDataFrame(boids, "entity_id bigint, pos_x double, pos_y double, vel_x double, vel_y double")
    got = {r.entity_id: r for r in kernels.boids_forces(rows, max_force=1e9).collect()}
    want = _forces(boids)
    assert len(got) == 150
    for i, f in want.items():
        assert got[i].acc_x == pytest.approx(f[0], abs=1e-9) and got[i].acc_y == pytest.approx(f[1], abs=1e-9)


def test_worms(spark):
    rows = spark.createDataFrame([(1, 499.5, 0.0, 0.0, 50.0, 1.0), (2, 0.0, 0.0, math.pi, 1.0, 0.55)], "entity_id bigint, pos_x double, pos_y double, heading double, energy double, worm_size double")
    moved = {r.entity_id: r for r in kernels.worm_move(rows, speed=2.0).collect()}
    assert moved[1].pos_x == pytest.approx(0.5) and moved[2].pos_x == pytest.approx(499.8)
    fed = {r.entity_id: r for r in kernels.worm_metabolism(rows, rate=2).collect()}
    assert fed[1].energy == 48 and fed[1].worm_size == 1 and fed[2].energy == 0 and fed[2].worm_size == pytest.approx(0.5)


def _waveform(vcc, dt, steps, every):
    """One circuit in plain numbers: node voltages by name, currents summed."""
    cap, high, coil, out = 0.0, True, 0.0, 0.0
    v = {"in": 0.0, "filter": 0.0}
    for k in range(1, steps + 1):
        if high:
            cap += (vcc - cap) / 20e3 * dt / 10e-9
            if cap >= vcc * 2 / 3:
                cap, high = vcc * 2 / 3, False
        else:
            cap -= cap / 10e3 * dt / 10e-9
            if cap <= vcc / 3:
                cap, high = vcc / 3, True
        drive = vcc - 1.5 if high else 0.2
        current = {"in": (drive - v["in"]) / 1e3, "filter": -v["filter"] / 10e3}
        coil += (v["in"] - v["filter"]) / 10e-3 * dt
        current["in"] -= coil
        current["filter"] += coil
        v["in"] += current["in"] / 1e-10 * dt
        v["filter"] += current["filter"] / 100e-9 * dt
        ideal = max(min(200_000 * (v["filter"] - out), vcc - 2), 2 - vcc)
        out = ideal if abs(ideal - out) <= 0.5e6 * dt else out + math.copysign(0.5e6 * dt, ideal - out)
        if k % every == 0:
            yield k * dt, drive, v["filter"], out


def test_circuit_against_plain_numbers(spark):
    sets = spark.createDataFrame([(1, 12.0, 1e-7), (2, 5.0, 1e-7), (3, 9.0, 5e-8)], "sim int, vcc double, dt double")
    got = {}
    for r in kernels.circuit(sets, 6000).orderBy("sim", "time").collect():
        got.setdefault(r.sim, []).append(tuple(r)[1:])
    for sim, vcc, dt in ((1, 12.0, 1e-7), (2, 5.0, 1e-7), (3, 9.0, 5e-8)):
        want = list(_waveform(vcc, dt, 6000, 20))
        assert len(got[sim]) == 300 and np.allclose(got[sim], want, rtol=1e-6, atol=1e-9)
        assert {w[1] for w in want} == {vcc - 1.5, 0.2}
    with pytest.raises(Exception, match="finite and positive"):
        kernels.circuit(spark.createDataFrame([(1, -1.0, 1e-7)], "sim int, vcc double, dt double")).collect()


def test_builtin_reducers(spark):
    from lithos.components import register_all
    from lithos.operators.builtin import register_builtin
    from lithos.operators.reducers import ReducerRegistry
    from lithos.world import World

    w, r = World(spark), ReducerRegistry()
    register_all(w)
    assert len(register_builtin(r)) == 7
    boid = w.spawn(Position=(1.0, 1.0), Velocity=(1.0, 0.0), Acceleration=(0.5, 0.0))
    worm = w.spawn(Position=(0.0, 0.0), Heading=(0.0,), Energy=(100.0,), WormSize=(1.0,))
    r.run(w, "boids_integrate", dt=2.0)
    assert w.get(boid, "Position").pos_x == pytest.approx(5.0)
    r.run(w, "boids_forces")
    r.run(w, "worm_move", speed=3.0)
    r.run(w, "worm_metabolism", rate=90.0)
    assert w.get(worm, "Position").pos_x == pytest.approx(3.0) and w.get(worm, "WormSize").worm_size == pytest.approx(0.9)
    cells = World(spark)
    register_all(cells)
    for i in range(9):
        cells.spawn(CellState=(i < 3,))
    with pytest.raises(ValueError):
        r.run(cells, "life_step", width=2, height=3)
    r.run(cells, "life_step", width=3, height=3)
    assert cells.scan(["CellState"]).where("CellState.alive").count() == 9
