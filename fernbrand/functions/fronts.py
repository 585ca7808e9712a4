"""Geometry and motion of a closed fire front, with NumPy."""

from __future__ import annotations

import numpy as np


def circle(x: float, y: float, radius: float, n: int) -> np.ndarray:
    """A counter-clockwise ring of n vertices, shape (n, 2)."""
    turn = 2 * np.pi * np.arange(n) / n
    return np.stack([x + radius * np.cos(turn), y + radius * np.sin(turn)], 1)


def tangents(ring: np.ndarray) -> np.ndarray:
    """Unit central differences around the ring; zero where neighbours coincide."""
    change = np.roll(ring, -1, 0) - np.roll(ring, 1, 0)
    size = np.hypot(change[:, 0], change[:, 1])
    return change / np.where(size > 0, size, 1.0)[:, None]


#: Added to a speed that is divided by, so that a vertex that doesn't move (no rate, no tangent) gives 0.
STILL = 1e-15


def velocities(ring: np.ndarray, head: np.ndarray, back: np.ndarray, flank: np.ndarray, azimuth: np.ndarray) -> np.ndarray:
    """Motion of each vertex as part of an ellipse's envelope. ``azimuth`` in radians from north."""
    along, offset, across = (head + back) / 2, (head - back) / 2, flank
    t, cos, sin = tangents(ring), np.cos(azimuth), np.sin(azimuth)
    u, v = t[:, 0] * cos - t[:, 1] * sin, t[:, 0] * sin + t[:, 1] * cos
    size = np.sqrt((along * u) ** 2 + (across * v) ** 2) + STILL
    return np.stack([
        (across**2 * cos * v - along**2 * sin * u) / size + offset * sin, (-(across**2) * sin * v - along**2 * cos * u) / size + offset * cos,
    ], 1)


def turning_numbers(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """How often the ring turns around each point: edges that pass it upwards on its right, less those downwards.

    Only points within an edge's heights can count for it, so each edge meets just these.
    """
    after = np.roll(ring, -1, 0)
    (x, y), (x1, y1) = ring.T, after.T
    order = np.argsort(points[:, 1], kind="stable")
    heights = points[order, 1]
    # An edge counts for heights from its lower end on, to below its upper end.
    first, last = np.searchsorted(heights, np.minimum(y, y1)), np.searchsorted(heights, np.maximum(y, y1))
    n = last - first
    edge = np.repeat(np.arange(len(ring)), n)
    point = order[np.arange(len(edge)) + np.repeat(first - (np.cumsum(n) - n), n)]
    side = (x1[edge] - x[edge]) * (points[point, 1] - y[edge]) - (points[point, 0] - x[edge]) * (y1[edge] - y[edge])
    up = y1[edge] > y[edge]
    passes = np.where(up, side > 0, side < 0)
    return np.bincount(point[passes], np.where(up, 1, -1)[passes], len(points)).astype(int)


def active(ring: np.ndarray, step: float = 1.0) -> np.ndarray:
    """Vertices whose neighbourhood on the outer side isn't burned yet."""
    change = np.roll(ring, -1, 0) - np.roll(ring, 1, 0)
    normal = np.stack([change[:, 1], -change[:, 0]], 1)
    size = np.hypot(normal[:, 0], normal[:, 1])
    return turning_numbers(ring + step * normal / np.where(size == 0, 1.0, size)[:, None], ring) == 0


def area(ring: np.ndarray) -> float:
    after = np.roll(ring, -1, 0)
    return float(abs((ring[:, 0] * after[:, 1] - after[:, 0] * ring[:, 1]).sum()) / 2)


def perimeter(ring: np.ndarray) -> float:
    change = np.roll(ring, -1, 0) - ring
    return float(np.hypot(change[:, 0], change[:, 1]).sum())


def clip(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of a polygon in a box (west, south, east, north), one side of the box after another."""
    for axis, bound, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        out = []
        for p, q in zip(ring, np.roll(ring, -1, 0)):
            a, b = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if a >= 0:
                out.append(p)
            if (a >= 0) != (b >= 0):
                out.append(p + a / (a - b) * (q - p))
        ring = np.array(out).reshape(-1, 2)
    return ring


def bilinear(grid: np.ndarray, xs: np.ndarray, ys: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Values at points of a grid whose rows run from ``ys[0]`` to ``ys[-1]``; clamped to its edge."""
    rows, cols = grid.shape
    at = lambda v, axis, n: np.clip((v - axis[0]) / (axis[1] - axis[0]) if n > 1 else np.zeros_like(v), 0, max(n - 1 - 1e-6, 0))
    c, r = at(points[:, 0], xs, cols), at(points[:, 1], ys, rows)
    c0, r0 = np.floor(c).astype(int), np.floor(r).astype(int)
    c1, r1, dc, dr = np.minimum(c0 + 1, cols - 1), np.minimum(r0 + 1, rows - 1), c - np.floor(c), r - np.floor(r)
    return grid[r0, c0] * (1 - dc) * (1 - dr) + grid[r0, c1] * dc * (1 - dr) + grid[r1, c0] * (1 - dc) * dr + grid[r1, c1] * dc * dr


def grow(
    ring: np.ndarray, sample, first: int, steps: int, dt: float = 1.0, least: float = 0.01, every: int = 10, markers: bool = True, marker_step: float = 1.0, scale: float = 1.0
) -> tuple[list[tuple[float, np.ndarray]], np.ndarray, bool]:
    """Steps ``first`` to ``steps`` of a front: stored rings as (time, ring), the last ring, and whether it still spreads.

    ``sample(step, ring)`` gives head, back, flank and azimuth (radians); rates over ``scale`` are in
    units of the coordinates. Ends early once all of the front spreads slower than ``least``.
    """
    out = []
    for step in range(first, steps):
        head, back, flank, azimuth = sample(step, ring)
        if np.all(head < least):
            return out, ring, False
        move = velocities(ring, head / scale, back / scale, flank / scale, azimuth)
        ring = ring + dt * (move * active(ring, marker_step / scale)[:, None] if markers else move)
        if (step + 1) % every == 0:
            out.append(((step + 1) * dt, ring))
    return out, ring, True
