"""Sums over disks for one dense tile: horizontal strips sorted by x, whole spans from running sums, tests only at the ends of a span.

A strip at some height above a place is cut by the disk in a span.  What lies inside for every height of the strip comes from
two running sums, the rest is tested point by point, so the work for a place grows with the root of the density rather than with the density.
Sums are those of whole numbers and exact: running sums wrap around in 64 bits, their differences don't.
"""

from __future__ import annotations

import math

import numpy as np

#: Strips per radius at most; more only where there is nothing left to test.
MOST_STRIPS = 256
#: Whole numbers whose absolute sum in a tile reaches this are summed in parts of 32 bits.
WIDE = float(1 << 62)
_HALF = float(1 << 32)
#: Slack of the spans in parts of the largest radius; what lies within it is tested.
_SLACK = 1e-9


def count(places: int) -> int:
    """Strips per radius for a tile with so many places."""
    return min(MOST_STRIPS, max(1, round(math.sqrt(places / 36) / 2)))


def _columns(values: list[np.ndarray]) -> tuple[list[np.ndarray], list[tuple[int, ...]]]:
    """Columns of 64-bit whole numbers, and for each value the column or the parts of 32 bits, the lowest first, that stand for it."""
    out, of = [], []
    for v in values:
        first = len(out)
        while v.dtype.kind == "f" and np.abs(v).sum() >= WIDE:
            high = np.floor(v / _HALF)
            out.append((v - high * _HALF).astype(np.int64))
            v = high
        out.append(v.astype(np.int64))
        of.append(tuple(range(first, len(out))))
    return out, of


def disk_sums(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, values: list[np.ndarray], radii: list[float]) -> list[list[np.ndarray]]:
    """For each radius and each array of whole numbers (integers, or doubles), sums over the points ux, uy within it of x, y.

    Sums of doubles are doubles.  The border is judged as (x - ux)**2 + (y - uy)**2 <= r * r.
    """
    columns, of = _columns(values)
    most = radii[-1]
    n = count(len(ux))
    h, low = most / n, uy.min()
    strip = np.floor((uy - low) / h).astype(np.int64)
    order = np.lexsort((ux, strip))
    ux, uy, strip = ux[order], uy[order], strip[order]
    columns = [c[order] for c in columns]
    many = int(strip[-1]) + 1
    starts = np.searchsorted(strip, np.arange(many))
    filled = np.diff(np.append(starts, len(ux))) > 0
    bottom, top = np.full(many, np.inf), np.full(many, -np.inf)
    bottom[filled], top[filled] = np.minimum.reduceat(uy, starts[filled]), np.maximum.reduceat(uy, starts[filled])
    left = ux.min() - most
    wide = ux.max() - left + most
    key = strip * wide + (ux - left)
    running = [np.concatenate((np.zeros(1, np.int64), np.cumsum(c))) for c in columns]

    seat = np.lexsort((x, np.floor((y - low) / h)))
    x, y = x[seat], y[seat]
    own = np.floor((y - low) / h).astype(np.int64)
    found = []
    for r in radii:
        sums = [np.zeros(len(x), np.int64) for _ in columns]
        for j in range(-math.ceil(r / h) - 1, math.ceil(r / h) + 2):
            s = own + j
            some = np.flatnonzero((s >= 0) & (s < many))
            s = s[some]
            d0, d1 = bottom[s] - y[some], top[s] - y[some]
            near = np.maximum(np.maximum(d0, -d1), 0.0)
            keep = near <= r + most * _SLACK
            some, s, near, far = some[keep], s[keep], near[keep], np.maximum(np.abs(d0[keep]), np.abs(d1[keep]))
            if not len(some):
                continue
            px, py, base, slack = x[some], y[some], s * wide, most * _SLACK
            outer = np.sqrt(np.maximum(r * r - near * near, 0.0)) + slack + r * math.sqrt(2 * _SLACK) * (near > r * (1 - 1e-6))
            inner = np.sqrt(np.maximum(r * r - far * far, 0.0)) - slack - r * math.sqrt(2 * _SLACK) * (far > r * (1 - 1e-6))
            inner = np.where(far < r, inner, -1.0)
            at = lambda v, side: np.searchsorted(key, base + np.clip(v - left, 0.0, wide - most / 2), side)  # noqa: B023, E731
            a, b = at(px - outer, "left"), at(px + outer, "right")
            hold = inner > 0
            a2, b2 = np.where(hold, at(px - inner, "left"), b), np.where(hold, at(px + inner, "right"), b)
            for total, run in zip(sums, running, strict=True):
                total[some] += run[b2] - run[a2]
            for one, other in ((a, a2), (b2, b)):
                size = other - one
                cut = np.flatnonzero(size > 0)
                # parts of a bounded number of tests each
                ends = np.cumsum(size[cut])
                first = 0
                while first < len(cut):
                    last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 4_000_000, "right")))
                    part, first = cut[first:last], last
                    m = size[part]
                    end = np.cumsum(m)
                    begin = end - m
                    spot = np.arange(end[-1]) + np.repeat(one[part] - begin, m)
                    dx, dy = np.repeat(px[part], m) - ux[spot], np.repeat(py[part], m) - uy[spot]
                    inside = dx * dx + dy * dy <= r * r
                    for total, c in zip(sums, columns, strict=True):
                        run = np.concatenate((np.zeros(1, np.int64), np.cumsum(c[spot] * inside)))
                        total[some[part]] += run[end] - run[begin]
        back = np.empty(len(x), np.int64)
        back[seat] = np.arange(len(x))
        sums = [t[back] for t in sums]
        told = []
        for v, k in zip(values, of, strict=True):
            t = sums[k[-1]]
            for q in reversed(k[:-1]):
                t = t * _HALF + sums[q]
            told.append(t.astype(float) if v.dtype.kind == "f" else t)
        found.append(told)
    return found
