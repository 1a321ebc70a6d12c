"""Trajectories moved as little as possible until speed, acceleration and jerk are within limits.

The set of trajectories within limits is convex: every limit bounds the length of a difference of positions. A trajectory is
therefore projected on it: alternating directions (one solve with a fixed matrix for all trajectories of a batch, then every difference is
clamped to its disk) come near the closest one, and the last step goes from a trajectory that is surely within limits, the
straight line at the clamped first velocity, as far towards that point (and then towards the trajectory itself) as all limits
allow, which is a root of a quadratic for each of them. Trajectories are columns of padded arrays, so a batch is a few matrix products a round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS, STEP = 400, 8
BLOCK = 256  # trajectories of a matrix product
SLACK = 1e-9


@dataclass(frozen=True)
class Limits:
    """dt in seconds, then the most of speed, acceleration and jerk."""

    dt: float
    speed: float
    acceleration: float
    jerk: float

    @property
    def differences(self) -> list[float]:
        """The most of first, second and third differences of positions."""
        return [self.speed * self.dt, self.acceleration * self.dt**2, self.jerk * self.dt**3]


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1))


def _clamped(x: np.ndarray, most: np.ndarray | float) -> np.ndarray:
    """Vectors in their disks; an infinite radius leaves them alone."""
    return x * np.minimum(1.0, most / np.maximum(_length(x), 1e-300))[..., None]


def _radii(valid: np.ndarray, v0: np.ndarray, limits: Limits) -> list[np.ndarray]:
    """The radius of every difference: of positions, then that of the first step from the history's; infinite where a frame isn't valid."""
    out = []
    for k, most in enumerate(limits.differences, 1):
        n = valid.shape[1] - k
        whole = np.ones((len(valid), max(n, 0)), bool)
        for j in range(k + 1):
            whole &= valid[:, j : j + n] if n > 0 else whole
        out.append(np.where(whole, most, np.inf))
    begins = np.isfinite(v0).all(1)[:, None] & (valid[:, :1] & valid[:, 1:2] if valid.shape[1] > 1 else np.zeros((len(valid), 1), bool))
    out.append(np.where(begins, limits.differences[1], np.inf))
    return out


def _differences(x: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """First to third differences, and the first step less that of the history."""
    one = np.diff(x, axis=1)
    return [one, np.diff(x, 2, axis=1), np.diff(x, 3, axis=1), one[:, :1] - first[:, None] if x.shape[1] > 1 else np.zeros((len(x), 0, 2))]


def excess(x: np.ndarray, valid: np.ndarray, v0: np.ndarray, limits: Limits) -> np.ndarray:
    """By trajectory: the largest difference as a part of its limit, less 1; -1 without any limit."""
    first = np.where(np.isfinite(v0), v0, 0.0) * limits.dt
    parts = [np.max(_length(d) / r, axis=1, initial=0.0) for d, r in zip(_differences(x, first), _radii(valid, v0, limits), strict=True)]
    return np.max(parts, axis=0) - 1


def _near(p: np.ndarray, pinned: np.ndarray, ops: list[np.ndarray], shift: list[np.ndarray], radii: list[np.ndarray], rounds: int) -> np.ndarray:
    """Positions near p with ops (differences by frames) less shift within radii; first frames stay where pinned.

    All differences are rows of one matrix and the coordinates of all trajectories its columns, so a round is three matrix products.
    """
    n, t, _ = p.shape
    o, most = np.concatenate(ops), np.concatenate(radii, 1).T
    s = np.concatenate([np.broadcast_to(x.transpose(1, 0, 2), (len(d), n, 2)) for d, x in zip(ops, shift, strict=True)])
    flat = lambda x: np.ascontiguousarray(x).reshape(len(x), -1)
    solve = np.linalg.inv(np.eye(t) + STEP * o.T @ o)
    # the first frame is held by a large weight in a solve of its own, for trajectories that have one
    heavy = np.eye(t)
    heavy[0, 0] = 1e8
    held = np.linalg.inv(heavy + STEP * o.T @ o)
    x = p.transpose(1, 0, 2).copy()
    weighted = x.copy()
    weighted[0, pinned] *= 1e8
    every, none = pinned.all(), not pinned.any()
    z = _clamped((o @ flat(x)).reshape(s.shape) - s, most)
    u = np.zeros_like(z)
    for _ in range(rounds):
        right = flat(weighted) + STEP * (o.T @ flat(z + s - u))
        new = ((solve if none else held) @ right).reshape(x.shape)
        if not (every or none):
            new = np.where(pinned[None, :, None], new, (solve @ right).reshape(x.shape))
        moved, x = np.abs(new - x).max(initial=0.0), new
        u += (o @ flat(x)).reshape(s.shape) - s
        z = _clamped(u, most)
        u -= z
        if moved < 1e-9:
            break
    return x.transpose(1, 0, 2)


def project(p: np.ndarray, valid: np.ndarray, v0: np.ndarray, limits: Limits, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(positions, whether they are within limits) of trajectories p (n, frames, 2) with valid frames and velocities v0 before the first frame.

    Only differences all of whose frames are valid count; frames that aren't stay. The first frame stays. A v0 that isn't finite is no limit; one that is
    faster than the limits allow to follow can't be repaired: such a trajectory goes as near as the limits without it allow and is told.
    """
    n, t, _ = p.shape
    before = np.maximum.accumulate(np.where(valid, np.arange(t), -1), axis=1)
    before = np.where(before < 0, valid.argmax(1)[:, None], before)
    p = np.take_along_axis(np.where(valid[..., None], p, 0.0), before[..., None], axis=1)  # frames that aren't valid stand where the last one stood
    fine = excess(p, valid, v0, limits) <= SLACK
    if fine.all() or t < 2:
        return p, fine
    known = np.isfinite(v0).all(1)
    first = np.where(known[:, None], np.where(np.isfinite(v0), v0, 0.0), 0.0) * limits.dt
    radii = _radii(valid, v0, limits)
    line = _clamped(first, limits.differences[0])
    away = _length(line - first) > limits.differences[1] * (1 + SLACK)  # no first step is slow enough and near enough to v0
    radii[3] = np.where(away[:, None], np.inf, radii[3])
    # a line through each first valid frame; frames before it and gaps have no limits across them
    start = np.where(valid.any(1), valid.argmax(1), 0)
    base = p[np.arange(n), start][:, None] + line[:, None] * (np.arange(t)[None, :, None] - start[:, None, None])
    pinned = valid[:, 0]
    ops = [np.diff(np.eye(t), k, axis=0) for k in (1, 2, 3) if t > k] + [np.diff(np.eye(t), axis=0)[:1]]
    radii = [r for k, r in zip((1, 2, 3, 1), radii, strict=True) if t > k]
    shift = [np.zeros((n, 1, 2))] * (len(ops) - 1) + [first[:, None]]
    x = p.copy()
    for begin in range(0, n, BLOCK):
        part = slice(begin, begin + BLOCK)
        x[part] = _near(p[part], pinned[part], ops, [s[part] if len(s) == n else s for s in shift], [r[part] for r in radii], rounds)
    x = np.where(valid[..., None], x, p)
    x[pinned, 0] = p[pinned, 0]
    def towards(base: np.ndarray, x: np.ndarray) -> np.ndarray:
        """As far from base, which is within limits, towards x as every limit allows."""
        step = np.ones(n)
        for o, s, r in zip(ops, shift, radii, strict=True):
            a, b = np.einsum("kt,ntc->nkc", o, base) - s, np.einsum("kt,ntc->nkc", o, x - base)
            with np.errstate(invalid="ignore", divide="ignore"):
                aa, ab, room = (b * b).sum(-1), (a * b).sum(-1), np.maximum(r * r - (a * a).sum(-1), 0.0)
                root = np.where(aa > 0, (-ab + np.sqrt(ab * ab + aa * room)) / aa, np.inf)
            step = np.minimum(step, np.where(np.isfinite(r), root, np.inf).min(axis=1, initial=1.0))
        return base + np.maximum(step, 0.0)[:, None, None] * (x - base)

    out = towards(towards(base, x), p)
    out = np.where(fine[:, None, None] | ~valid[..., None], p, out)
    out[pinned, 0] = p[pinned, 0]
    return out, excess(out, valid, v0, limits) <= 1e-6


def project_trajectories(df: DataFrame, key: str, order: str, limits: Limits, velocity: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """(key, order, x, y, within): each trajectory's frames moved into the limits; within tells whether all of it keeps them.

    Frames with a null position count as not valid and stay null. velocity: columns of the velocity before the first
    frame, equal on all rows of a key; where they are null the first velocity is free. A trajectory, which a contract keeps short, is one row of
    arrays; batches of them are worked on at once, however long each is.
    """
    v = [F.max(F.col(c).cast("double")) for c in velocity] or [F.lit(None).cast("double")] * 2
    frames = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))))
    rows = df.groupBy(key).agg(frames.alias("f"), v[0].alias("vx"), v[1].alias("vy"))
    rows = rows.select(key, F.transform("f", lambda s: s["o"]).alias("o"), F.transform("f", lambda s: s["x"]).alias("x"), F.transform("f", lambda s: s["y"]).alias("y"), "vx", "vy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            if not len(size):
                continue
            wide = int(size.max())
            place = np.arange(wide)[None, :] < size[:, None]
            p = np.full((len(size), wide, 2), np.nan)
            for c in (0, 1):
                p[place, c] = b.column(2 + c).flatten().to_numpy(zero_copy_only=False).astype(float)
            valid = np.isfinite(p).all(-1)
            v0 = np.stack([b.column(4 + c).to_numpy(zero_copy_only=False).astype(float) for c in (0, 1)], 1)
            got, within = project(np.where(valid[..., None], p, 0.0), valid, v0, limits)
            got = np.where(valid[..., None], got, p)
            back = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(got[place, c], pa.float64(), mask=np.isnan(got[place, c]))) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *back, pa.array(within)], names=[key, "o", "x", "y", "within"])

    f = rows.schema.fields
    schema = T.StructType([f[0], f[1], *T.StructType.fromDDL("x array<double>, y array<double>, within boolean").fields])
    out = rows.mapInArrow(run, schema)
    return out.select(key, "within", F.inline(F.arrays_zip("o", "x", "y"))).select(key, F.col("o").alias(order), "x", "y", "within")
