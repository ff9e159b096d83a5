"""The relaxation of the surface solver against small numpy versions, and what the registered query asks for."""

import random

import numpy as np
import pytest

from cloudframe.operators import iso
from cloudframe.plans import catalog


def cells(n=120, side=8):
    rng = random.Random(4)
    places = rng.sample([(x, y, z) for x in range(side) for y in range(side) for z in range(side)], n)
    return {p: rng.uniform(-5, 5) for p in places}


def red_black(load, h, iterations):
    """Whole-array half sweeps over a dense grid with a mask."""
    shape = tuple(max(p[a] for p in load) + 3 for a in range(3))
    here, b, value = np.zeros(shape, bool), np.zeros(shape), np.zeros(shape)
    for p, v in load.items():
        q = tuple(c + 1 for c in p)
        here[q], b[q] = True, v * h * h
    around = lambda x: sum(np.roll(x, d, a) for a in range(3) for d in (-1, 1))
    number = around(here.astype(float))
    color = (np.indices(shape) - 1).sum(axis=0) % 2
    for _ in range(iterations):
        for half in (0, 1):
            new = (around(value) - b) / np.maximum(number, 1)
            value = np.where(here & (color == half) & (number > 0), new, value)
    return {p: value[tuple(c + 1 for c in p)] for p in load}


@pytest.mark.parametrize("iterations", [1, 4])
def test_red_black_joins(spark, iterations):
    load, h = cells(), 0.25
    df = spark.createDataFrame([(*p, v) for p, v in load.items()], "ix long, iy long, iz long, divergence double").repartition(3)
    got = {(r.ix, r.iy, r.iz): r.value for r in iso.poisson_solve(df, h, 7, iterations).collect()}
    want = red_black(load, h, iterations)
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def one_by_one(load, h, iterations, depth):
    """Sweeps over the cells in the order in which an octree is walked, child by child."""
    def key(p):
        return sum((p[a] >> bit & 1) << (3 * bit + a) for bit in range(depth) for a in range(3))

    value = dict.fromkeys(load, 0.0)
    steps = [(d * (a == 0), d * (a == 1), d * (a == 2)) for a in range(3) for d in (-1, 1)]
    for _ in range(iterations):
        for p in sorted(load, key=key):
            near = [value[q] for s in steps if (q := tuple(c + d for c, d in zip(p, s, strict=True))) in value]
            if near:
                total = 0.0
                for v in near:  # sum() of Python would make up for rounding
                    total += v
                value[p] = (total - h * h * load[p]) / len(near)
    return value


@pytest.mark.parametrize("depth,n,iterations,block,halo", [(4, 1500, 5, 5, 3), (5, 2500, 30, 32, 8), (6, 4000, 3, 16, 16), (4, 1, 3, 32, 8)])
def test_sweeps_in_order_to_the_bit(spark, monkeypatch, depth, n, iterations, block, halo):
    monkeypatch.setattr(iso, "BLOCK", block)
    monkeypatch.setattr(iso, "HALO", halo)
    load, h = cells(n, 2**depth), 0.25
    df = spark.createDataFrame([(*p, v) for p, v in load.items()], "ix long, iy long, iz long, divergence double").repartition(3)
    got = {(r.ix, r.iy, r.iz): r.value for r in iso.poisson_solve(df, h, depth, iterations, in_order=True).collect()}
    assert got == one_by_one(load, h, iterations, depth)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    load = cells(1500, 16)
    df = spark.createDataFrame([(*p, v) for p, v in load.items()], "ix long, iy long, iz long, divergence double")
    monkeypatch.setattr(iso, "BLOCK", 6)
    monkeypatch.setattr(iso, "HALO", 5)
    want = red_black(load, 0.5, 6)
    got = {(r.ix, r.iy, r.iz): r.value for r in iso.poisson_solve(df, 0.5, 4, 6).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    none = iso.poisson_solve(df.limit(0), 0.5, 4, 2, in_order=True)
    assert none.collect() == []


def test_sweeps_in_order_settle_at_the_same_values(spark):
    load = {(x, y, z): 1.0 if x == 0 else -1.0 for x in range(2) for y in range(2) for z in range(2)}  # the loads sum to zero
    df = spark.createDataFrame([(*p, v) for p, v in load.items()], "ix long, iy long, iz long, divergence double")
    got = {(r.ix, r.iy, r.iz): r.value for r in iso.poisson_solve(df, 1.0, 3, 60, in_order=True).collect()}
    want = red_black(load, 1.0, 60)
    shift = got[0, 0, 0] - want[0, 0, 0]
    assert all(abs(got[p] - want[p] - shift) < 1e-6 for p in want)


def test_registered_query_takes_the_distributed_path(spark, monkeypatch):
    asked = {}

    def recorded(cells, h, depth, iterations=30, in_order=False):
        asked.update(depth=depth, iterations=iterations, in_order=in_order)
        raise InterruptedError

    monkeypatch.setattr(iso, "poisson_solve", recorded)
    with pytest.raises(InterruptedError):
        catalog.queries()["poisson_surface"](spark, "/root/testdata/sf0.001")
    assert asked == {"depth": 6, "iterations": 30, "in_order": False}
