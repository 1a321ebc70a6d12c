"""Projection of trajectories: limits, nearness, continuity, gaps and rows that can't be repaired."""

import math
import time

import numpy as np
import pytest

from tracklens.operators import feasible
from tracklens.operators.feasible import Limits

LIMITS = Limits(0.1, 12.0, 9.5, 20.0)
FREE = np.array([[np.nan, np.nan]])


def wild(n, t, seed=1, noise=0.4):
    rng = np.random.default_rng(seed)
    speed = rng.normal(scale=6, size=(n, 1, 2)) + np.cumsum(rng.normal(scale=0.5, size=(n, t, 2)), 1)
    return np.cumsum(speed * 0.1, 1) + rng.normal(scale=noise, size=(n, t, 2)) * (np.arange(n) % 3 > 0)[:, None, None]


def slow_excess(p, valid, v0, lim):
    """Every limit frame by frame; 0 or less if all are kept."""
    worst, dt = -1.0, lim.dt
    for k in range(len(p)):
        seen = {}
        for order, most in ((1, lim.speed), (2, lim.acceleration), (3, lim.jerk)):
            if k >= order and all(valid[k - order : k + 1]):
                d = sum((-1) ** j * math.comb(order, j) * p[k - j] for j in range(order + 1)) / dt**order
                seen[order] = math.hypot(*d) / most - 1
        worst = max([worst, *seen.values()])
    if len(p) > 1 and valid[0] and valid[1] and np.isfinite(v0).all():
        worst = max(worst, math.hypot(*((p[1] - p[0]) / dt - v0)) / dt / lim.acceleration - 1)
    return worst


def clip_loop(p, dt, speed, acceleration, rounds=300):
    for _ in range(rounds):
        v = np.diff(p, axis=0) / dt
        new = v * np.minimum(1, speed / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
        for k in range(1, len(new)):
            d = new[k] - new[k - 1]
            n = np.linalg.norm(d)
            if n > acceleration * dt:
                new[k] = new[k - 1] + d * (acceleration * dt / n)
        p = np.vstack([p[:1], p[:1] + np.cumsum(new * dt, axis=0)])
    return p


def test_limits_hold_and_good_ones_stay():
    p, valid = wild(60, 50), np.ones((60, 50), bool)
    v0 = np.where(np.arange(60)[:, None] % 2, (p[:, 1] - p[:, 0]) / 0.1 * 0.5, np.nan)
    v0 = v0 / np.maximum(1, np.linalg.norm(v0, axis=1, keepdims=True) / 11)
    out, within = feasible.project(p, valid, v0, LIMITS)
    assert within.all() and (out[:, 0] == p[:, 0]).all()
    assert max(slow_excess(out[i], valid[i], v0[i], LIMITS) for i in range(60)) <= 1e-6
    again, _ = feasible.project(out, valid, v0, Limits(0.1, 12.001, 9.501, 20.01))
    assert np.array_equal(again, out)
    line = np.arange(50)[None, :, None] * np.array([0.1, 0.05])
    assert np.array_equal(feasible.project(line, np.ones((1, 50), bool), FREE, LIMITS)[0], line)


def test_nothing_within_limits_is_nearer():
    """The closest point x of a convex set has (p - x)(g - x) <= 0 for every g in it; checked against many such g."""
    p, valid = wild(12, 40, 5), np.ones((12, 40), bool)
    none = np.full((12, 2), np.nan)
    out, within = feasible.project(p, valid, none, LIMITS, rounds=4000)
    assert within.all()
    rng = np.random.default_rng(8)
    for _ in range(40):
        g, ok = feasible.project(out + rng.normal(scale=rng.choice([0.01, 0.1, 1.0]), size=out.shape) * (np.arange(40) > 0)[:, None], valid, none, LIMITS)
        gap = ((p - out) * (g - out)).sum((1, 2)) / (np.linalg.norm(p - out, axis=(1, 2)) * np.linalg.norm(g - out, axis=(1, 2)) + 1e-9)
        assert ok.all() and gap.max() < 0.02


def test_nearer_than_clipping():
    p, valid = wild(30, 30, 3), np.ones((30, 30), bool)
    out, within = feasible.project(p, valid, np.full((30, 2), np.nan), Limits(0.1, 8.0, 20.0, 1e9))
    clipped = np.array([clip_loop(q, 0.1, 8.0, 20.0) for q in p])
    moved = lambda x: np.linalg.norm(x - p, axis=2).mean(1)
    changed = moved(clipped) > 1e-9
    assert within.all() and changed.sum() > 15 and (moved(out) <= moved(clipped) + 1e-9).all() and moved(out)[changed].mean() < 0.8 * moved(clipped)[changed].mean()


def plain_rounds(p, pinned, ops, shift, radii, rounds):
    """The rounds of _near with one sum over frames for each operator."""
    t = p.shape[1]
    heavy = np.where(pinned[:, None], 1e8, 1.0) * (np.arange(t) == 0) + (np.arange(t) > 0)
    solve = [np.linalg.inv(np.diag(h) + feasible.STEP * sum(o.T @ o for o in ops)) for h in heavy]
    x = p.copy()
    z = [feasible._clamped(np.einsum("kt,ntc->nkc", o, x) - s, r) for o, s, r in zip(ops, shift, radii, strict=True)]
    u = [np.zeros_like(v) for v in z]
    for _ in range(rounds):
        right = heavy[..., None] * p + feasible.STEP * sum(np.einsum("kt,nkc->ntc", o, v + s - w) for o, v, w, s in zip(ops, z, u, shift, strict=True))
        x = np.einsum("nst,ntc->nsc", np.array(solve), right)
        for k, (o, s, r) in enumerate(zip(ops, shift, radii, strict=True)):
            d = np.einsum("kt,ntc->nkc", o, x) - s
            z[k] = feasible._clamped(d + u[k], r)
            u[k] += d - z[k]
    return x


def test_rounds_are_matrix_products(monkeypatch):
    """The same positions as plain rounds (some first frames pinned, some not, blocks of trajectories), in less than a third of the time."""
    p, valid = wild(300, 32, 4, 2.0), np.ones((300, 32), bool)
    valid[::7, 0] = False
    v0 = np.where(np.arange(300)[:, None] % 2, 1.0, np.nan) * np.ones((300, 2))
    near, took = feasible._near, [0.0, 0.0]

    def both(*a):
        began = time.process_time()
        x = near(*a)
        half = time.process_time()
        y = plain_rounds(*a)
        took[0] += half - began
        took[1] += time.process_time() - half
        assert np.abs(x - y).max() < 1e-6
        return x

    monkeypatch.setattr(feasible, "_near", both)
    _, within = feasible.project(p, valid, v0, LIMITS, rounds=60)
    assert within.any() and 3 * took[0] < took[1]


def test_gaps_lengths_and_what_cannot_be_repaired(spark):
    p = wild(9, 24, 7)
    rows = []
    for i in range(9):
        for k in range(24 - 2 * i):
            gap = i == 2 and 8 <= k < 12 or i == 3 and k < 2
            rows.append((i, k, None if gap else float(p[i, k, 0]), float(p[i, k, 1]), 40.0 if i == 4 else 1.0 if i == 5 else None, 0.0))
    rows += [(20, 0, 1.0, 2.0, None, None), (21, 0, None, None, None, None), (22, 0, 0.0, 0.0, None, None), (22, 1, 500.0, 0.0, None, None)]
    df = spark.createDataFrame(rows, "id long, k int, x double, y double, vx double, vy double").repartition(3)
    got = {}
    for r in feasible.project_trajectories(df, "id", "k", LIMITS, ["vx", "vy"]).collect():
        got.setdefault(r.id, {})[r.k] = r
    assert {i: len(v) for i, v in got.items()} == {**{i: 24 - 2 * i for i in range(9)}, 20: 1, 21: 1, 22: 2}
    for i in range(9):
        r = [got[i][k] for k in range(24 - 2 * i)]
        valid = [x.x is not None for x in r]
        q = np.array([(x.x if x.x is not None else 0.0, x.y if x.x is not None else 0.0) for x in r])
        v0 = np.array([1.0, 0.0]) if i == 5 else FREE[0]
        assert slow_excess(q, valid, v0, LIMITS) <= 1e-6 and {x.within for x in r} == {i != 4}
    assert [got[2][k].x for k in range(8, 12)] == [None] * 4 and got[2][9].y == p[2, 9, 1]
    assert (got[20][0].x, got[20][0].within, got[21][0].x, got[21][0].within) == (1.0, True, None, True)
    assert got[22][1].x == pytest.approx(1.2) and got[22][1].within
    assert feasible.project_trajectories(df.limit(0), "id", "k", LIMITS).count() == 0
