"""Polygons as column expressions and NumPy: membership, hulls, disks cut by polygons; UTM projection."""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 ellipsoid and UTM constants.
A, FLATTENING, K0, EASTING, NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def inside(ring: list[tuple[float, float]], x: str = "x", y: str = "y") -> Column:
    """Ray casting: crossings of the ring's edges to the right are odd."""
    px, py = F.col(x), F.col(y)
    n = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            crosses = ((F.lit(y1) > py) != (F.lit(y2) > py)) & (px < F.lit(float(x2 - x1)) * (py - F.lit(y1)) / F.lit(float(y2 - y1)) + F.lit(x1))
            n = n + F.when(crosses, 1).otherwise(0)
    return n % 2 == 1


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise corners (monotone chain)."""
    p = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p

    def chain(q):
        out: list = []
        for z in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (z[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (z[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(z)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hull_of(pts: DataFrame, x: str = "x", y: str = "y") -> np.ndarray:
    """Hull of all points: each partition gives the corners of its own hull, the driver joins these."""

    def run(frames):
        best = np.zeros((0, 2))
        for f in frames:
            best = convex_hull(np.concatenate((best, f[["x", "y"]].to_numpy(float))))
        yield pd.DataFrame(best, columns=["x", "y"])

    some = pts.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).mapInPandas(run, "x double, y double")
    return convex_hull(np.array([(r.x, r.y) for r in some.collect()]))


def _disk_edge(ax, ay, bx, by, r: float) -> np.ndarray:
    """Signed area that an edge, relative to the disk's centre, adds to the disk's part of a polygon."""
    dx, dy, r2 = bx - ax, by - ay, r * r
    dd = np.maximum(dx * dx + dy * dy, 1e-300)
    t0 = -(ax * dx + ay * dy) / dd
    half = np.sqrt(np.maximum(r2 - (ax * by - ay * bx) ** 2 / dd, 0) / dd)
    t1, t2 = np.clip(t0 - half, 0, 1), np.clip(t0 + half, 0, 1)
    cx, cy, ex, ey = ax + t1 * dx, ay + t1 * dy, ax + t2 * dx, ay + t2 * dy
    sector = lambda px, py, qx, qy: r2 / 2 * np.arctan2(px * qy - py * qx, px * qx + py * qy)
    return sector(ax, ay, cx, cy) + (cx * ey - cy * ex) / 2 + sector(ex, ey, bx, by)


def rings_share(x, y, r: float, rings) -> np.ndarray:
    """Share of each disk inside the rings together: outer ones run counter-clockwise, holes clockwise. Exact."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    total = np.zeros(len(x))
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, 0), strict=True):
            total += _disk_edge(x1 - x, y1 - y, x2 - x, y2 - y, r)
    return np.clip(total / (math.pi * r * r), 0, 1)


def disk_share(x, y, r: float, ring: np.ndarray) -> np.ndarray:
    """Share of each disk inside a simple polygon, exact: one signed term for each edge."""
    return rings_share(x, y, r, [oriented(ring)])


def box_share(x, y, r: float, x0, y0, size: float) -> np.ndarray:
    """Share of each disk inside its own square with the lower corner x0, y0."""
    a, b = np.asarray(x0, float) - np.asarray(x, float), np.asarray(y0, float) - np.asarray(y, float)
    corners = [(a, b), (a + size, b), (a + size, b + size), (a, b + size)]
    total = sum(_disk_edge(*p, *q, r) for p, q in zip(corners, [*corners[1:], corners[0]], strict=True))
    return np.clip(total / (math.pi * r * r), 0, 1)


def ring_area(ring: np.ndarray) -> float:
    x, y = np.asarray(ring, float).T
    return float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum() / 2)


def oriented(ring, hole: bool = False) -> np.ndarray:
    """The ring without a repeated last corner, counter-clockwise (a hole: clockwise)."""
    ring = np.asarray(ring, float)[:, :2]
    if len(ring) > 1 and (ring[0] == ring[-1]).all():
        ring = ring[:-1]
    return ring if (ring_area(ring) > 0) != hole else ring[::-1]


def polygons(spec) -> tuple[np.ndarray, ...]:
    """Oriented rings of a list of corners or of a GeoJSON Polygon, MultiPolygon, GeometryCollection or Feature."""
    if not isinstance(spec, dict):
        return (oriented(spec),)
    kind = spec["type"]
    if kind == "Feature":
        return polygons(spec["geometry"])
    if kind in ("GeometryCollection", "FeatureCollection"):
        return tuple(r for g in spec["geometries" if kind == "GeometryCollection" else "features"] for r in polygons(g))
    if kind not in ("Polygon", "MultiPolygon"):
        raise ValueError(f"{kind} is no area")
    parts = [spec["coordinates"]] if kind == "Polygon" else spec["coordinates"]
    return tuple(oriented(ring, i > 0) for part in parts for i, ring in enumerate(part))


def edges_of(rings) -> np.ndarray:
    """x1, y1, x2, y2 of every edge."""
    return np.concatenate([np.hstack((r, np.roll(r, -1, 0))) for r in rings])


class Strips:
    """Membership for many edges: each point meets the edges of its horizontal strip only."""

    def __init__(self, edges: np.ndarray):
        e = edges[edges[:, 1] != edges[:, 3]]
        self.low, self.n = e[:, [1, 3]].min(), max(1, min(4096, len(e)))
        self.high = max(1e-300, (e[:, [1, 3]].max() - self.low) / self.n)
        first, last = (np.clip(((f(e[:, 1], e[:, 3]) - self.low) / self.high).astype(int), 0, self.n - 1) for f in (np.minimum, np.maximum))
        strip = np.repeat(first, last - first + 1) + np.arange((last - first + 1).sum()) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
        order = np.argsort(strip, kind="stable")
        self.edges = np.repeat(e, last - first + 1, 0)[order]
        self.at = np.searchsorted(strip[order], np.arange(self.n + 1))

    def inside(self, x, y) -> np.ndarray:
        x, y = np.asarray(x, float), np.asarray(y, float)
        with np.errstate(invalid="ignore"):
            strip = np.nan_to_num((y - self.low) / self.high, nan=-1).clip(-1, self.n).astype(int)
        strip[(strip == self.n) & (y <= self.low + self.high * self.n)] = self.n - 1
        out, order = np.zeros(len(x), bool), np.argsort(strip, kind="stable")
        for k, rows in zip(*_runs(strip[order], order), strict=True):
            if 0 <= k < self.n:
                x1, y1, x2, y2 = self.edges[self.at[k] : self.at[k + 1]].T
                px, py = x[rows, None], y[rows, None]
                crosses = ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
                out[rows] = crosses.sum(1) % 2 == 1
        return out


def _runs(sorted_keys: np.ndarray, rows: np.ndarray) -> tuple[list, list]:
    at = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, int)
    return sorted_keys[at].tolist(), np.split(rows, at[1:]) if len(at) else []


def clipped_area(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> float:
    """Signed area of the part of a ring in a box: the ring is cut at the box's sides one after another."""
    p = np.asarray(ring, float)
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(p):
            return 0.0
        q = np.roll(p, -1, 0)
        d, e = sign * (p[:, axis] - bound), sign * (q[:, axis] - bound)
        cuts = (d < 0) != (e < 0)
        t = np.where(cuts, d / np.where(cuts, d - e, 1), 0)[:, None]
        both = np.stack((p, p + t * (q - p)), 1).reshape(-1, 2)
        p = both[np.stack((d >= 0, cuts), 1).ravel()]
    return ring_area(p) if len(p) else 0.0


def utm_zone(lon: float, lat: float) -> tuple[int, bool]:
    return math.floor((lon + 180) / 6) % 60 + 1, lat >= 0


def _series() -> tuple[float, list[float], list[float]]:
    n = FLATTENING / (2 - FLATTENING)
    a = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return a, alpha, beta


def utm(lon: str, lat: str, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Easting and northing of WGS84 degrees (Krueger series)."""
    a, alpha, _ = _series()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon) - F.lit(float(zone * 6 - 183)))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east, up = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + F.lit(c) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        up = up + F.lit(c) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    return F.lit(EASTING) + F.lit(K0 * a) * east, F.lit(0.0 if north else NORTHING) + F.lit(K0 * a) * up


def utm_inverse(east: str, north: str, zone: int, northern: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    a, _, beta = _series()
    e2 = FLATTENING * (2 - FLATTENING)
    xi = (F.col(north) - F.lit(0.0 if northern else NORTHING)) / F.lit(K0 * a)
    eta = (F.col(east) - F.lit(EASTING)) / F.lit(K0 * a)
    x1, e1 = xi, eta
    for j, c in enumerate(beta, 1):
        x1 = x1 - F.lit(c) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        e1 = e1 - F.lit(c) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(x1) / F.cosh(e1))
    phi, e = chi, math.sqrt(e2)
    for _ in range(4):  # fixed point of the conformal latitude
        phi = F.asin(F.tanh(F.atanh(F.sin(chi)) + F.lit(e) * F.atanh(F.lit(e) * F.sin(phi))))
    return F.lit(float(zone * 6 - 183)) + F.degrees(F.atan2(F.sinh(e1), F.cos(x1))), F.degrees(phi)


def utm_arrays(lon, lat, zone: int, north: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``utm`` of arrays, for the few points of an outline."""
    a, alpha, _ = _series()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float) - (zone * 6 - 183))
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    j = 2.0 * np.arange(1, len(alpha) + 1)
    east = eta + sum(c * np.cos(k * xi) * np.sinh(k * eta) for k, c in zip(j, alpha, strict=True))
    up = xi + sum(c * np.sin(k * xi) * np.cosh(k * eta) for k, c in zip(j, alpha, strict=True))
    return EASTING + K0 * a * east, (0.0 if north else NORTHING) + K0 * a * up


def degrees_arrays(east, north_of, zone: int, north: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude of arrays of eastings and northings."""
    a, _, beta = _series()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    xi, eta = (np.asarray(north_of, float) - (0.0 if north else NORTHING)) / (K0 * a), (np.asarray(east, float) - EASTING) / (K0 * a)
    j = 2.0 * np.arange(1, len(beta) + 1)
    x1 = xi - sum(c * np.sin(k * xi) * np.cosh(k * eta) for k, c in zip(j, beta, strict=True))
    e1 = eta - sum(c * np.cos(k * xi) * np.sinh(k * eta) for k, c in zip(j, beta, strict=True))
    chi = np.arcsin(np.sin(x1) / np.cosh(e1))
    phi = chi
    for _ in range(4):  # fixed point of the conformal latitude
        phi = np.arcsin(np.tanh(np.arctanh(np.sin(chi)) + e * np.arctanh(e * np.sin(phi))))
    return zone * 6 - 183 + np.degrees(np.arctan2(np.sinh(e1), np.cos(x1))), np.degrees(phi)


def local_bounds(bounds: tuple[float, float, float, float], zone: int, north: bool = True) -> tuple[float, float, float, float]:
    """Bounds in a zone of a box of degrees: of its corners, the middles of its sides and its centre."""
    lon, lat = np.meshgrid(np.linspace(bounds[0], bounds[2], 3), np.linspace(bounds[1], bounds[3], 3))
    x, y = utm_arrays(lon, lat, zone, north)
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())


def local_polygon(spec, zone: int, north: bool = True) -> dict:
    """A GeoJSON MultiPolygon in a zone of corners or a GeoJSON geometry in degrees; outer rings and holes stay apart."""
    parts: list[list] = []
    for ring in polygons(spec):
        told = [list(p) for p in np.stack(utm_arrays(*ring.T, zone, north), 1).tolist()]
        if ring_area(ring) > 0:
            parts.append([told])
        else:
            parts[-1].append(told)
    return {"type": "MultiPolygon", "coordinates": parts}


def wkt_in_degrees(wkt: Column, zone: int, north: bool = True) -> Column:
    """A WKT text in metres of a zone with its corners as degrees."""

    @F.pandas_udf("string")
    def moved(texts: pd.Series) -> pd.Series:
        number = r"[-+0-9.eE]+"

        def one(text):
            if text is None:
                return None
            points = re.findall(rf"({number}) ({number})", text)
            lon, lat = degrees_arrays([float(p[0]) for p in points], [float(p[1]) for p in points], zone, north)
            told = iter(zip(lon.tolist(), lat.tolist(), strict=True))
            return re.sub(rf"{number} {number}", lambda _: "{} {}".format(*next(told)), text)

        return texts.map(one)

    return moved(wkt)


#: Distinct points from which a concave hull is made, at most.
MOST_HULL_POINTS = 200_000


def concave_hull(points: np.ndarray, concavity: float = 2.0) -> np.ndarray:
    """Counter-clockwise corners of a hull that follows the points: the convex hull's edges are dug in.

    An edge gives way to the point nearest to it (seen from its ends) as long as the edge is longer than ``concavity`` times that
    point's distance to the nearer end and the new edges cross no other; long edges first.
    """
    p = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    ring = convex_hull(p)
    if len(ring) < 3 or len(p) == len(ring):
        return ring
    number = {tuple(x): i for i, x in enumerate(p.tolist())}
    order = [number[tuple(x)] for x in ring.tolist()]
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    free = np.ones(len(p), bool)
    free[order] = False
    queue = [(-math.dist(p[a], p[b]), a, b) for a, b in after.items()]
    heapq.heapify(queue)
    while queue:
        length, a, b = heapq.heappop(queue)
        if after.get(a) != b or not free.any():
            continue
        some = np.flatnonzero(free)
        ends = np.minimum(np.hypot(*(p[some] - p[a]).T), np.hypot(*(p[some] - p[b]).T))
        some = some[ends * concavity < -length]
        if not len(some):
            continue
        d = p[b] - p[a]
        t = np.clip(((p[some] - p[a]) @ d) / (d @ d), 0, 1)
        away = np.hypot(*(p[some] - p[a] - t[:, None] * d).T)
        starts = np.array([(i, j) for i, j in after.items() if i != a])
        for k in some[np.argsort(away, kind="stable")[:8]].tolist():
            if not (_cross(p[a], p[k], p[starts[:, 0]], p[starts[:, 1]]) | _cross(p[k], p[b], p[starts[:, 0]], p[starts[:, 1]])).any():
                after[a], after[k], free[k] = k, b, False
                for i, j in ((a, k), (k, b)):
                    heapq.heappush(queue, (-math.dist(p[i], p[j]), i, j))
                break
    out, at = [order[0]], after[order[0]]
    while at != order[0]:
        out.append(at)
        at = after[at]
    return p[out]


def _cross(a, b, c, d) -> np.ndarray:
    """Whether the segment a b properly crosses each of the segments c d."""
    side = lambda o, q, x: (q[..., 0] - o[..., 0]) * (x[..., 1] - o[..., 1]) - (q[..., 1] - o[..., 1]) * (x[..., 0] - o[..., 0])
    a, b = np.broadcast_to(a, c.shape), np.broadcast_to(b, c.shape)
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
