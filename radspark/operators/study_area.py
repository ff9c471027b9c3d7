"""Study areas: bounds for sampling, a plan that keeps the points inside (or outside), and the shares of disks inside."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radspark.functions.geometry import MOST_HULL_POINTS, Strips, box_share, clipped_area, concave_hull, convex_hull, edges_of, hull_of, inside, oriented, polygons, ring_area, rings_share
from radspark.operators.radius import within
from radspark.plans.grid import MOST_CELLS, Grid, build_grid

# Names of the methods and of their options.
METHODS = {
    "cells": "cells", "buff_cells": "cells", "buff_non_empty_cells": "cells", "buff_cells_min_pts": "cells", "buff_pts": "points", "buffer": "points",
    "convex": "convex", "concave": "concave", "bounding_box": "bbox", "bbox": "bbox", "grid": "grid",
}
ALIASES = {"m": "min_pts", "b": "buffer", "c": "concavity"}
# Area weights, their other names, and the coefficients of the logistic share.
WEIGHTS = ("exact", "logit", "flat", "binary")
OTHER = {"precise": "exact", "estimate": "logit"}
LOGIT = ((0.70628102, 0.57266908), (-0.21443453, 0.76899004))
#: Edges up to which membership is one column expression; beyond, a vectorised function looks at the edges of a point's strip.
PLAIN_EDGES = 64
#: Corners of a circle where a hull's buffer is made a polygon.
ROUND = 256


@dataclass(frozen=True)
class Area:
    """keep(points, wanted) gives the points inside (wanted) or outside. rings: outline, outer rings counter-clockwise and holes
    clockwise; or cells: a grid and a table of row, col whose squares make up the area; neither: no exact shares."""

    bounds: tuple[float, float, float, float]
    keep: Callable[[DataFrame, bool], DataFrame]
    rings: tuple[np.ndarray, ...] = ()
    cells: tuple[Grid, DataFrame] | None = None

    def inside(self, p: DataFrame) -> DataFrame:
        return self.keep(p, True)

    def minus(self, other: Area) -> Area:
        """The part of this area that isn't in the other. Its outline isn't known."""
        return Area(self.bounds, lambda p, wanted: other.keep(self.keep(p, True), False) if wanted else p.exceptAll(other.keep(self.keep(p, True), False)))


def parse_area(spec: str) -> tuple[str, dict[str, float]]:
    name, *options = [s.strip() for s in spec.split(",")]
    if name not in METHODS:
        raise ValueError(f"unknown study area {name!r}; known: {', '.join(METHODS)}")
    return METHODS[name], {ALIASES.get(k, k): float(v) for k, v in (o.split("=") for o in options)}


def _box(a, b, c, d) -> Area:
    found = F.col("x").between(a, c) & F.col("y").between(b, d)
    return Area((a, b, c, d), lambda p, wanted: p.where(found if wanted else ~found), (np.array([(a, b), (c, b), (c, d), (a, d)], float),))


def polygon_area(spec) -> Area:
    """spec: corners, or a GeoJSON geometry with parts and holes."""
    rings = polygons(spec)
    every = np.concatenate(rings)
    bounds = (*map(float, every.min(0)), *map(float, every.max(0)))
    if len(every) <= PLAIN_EDGES:
        found = reduce(lambda a, b: a != b, (inside([tuple(map(float, p)) for p in r]) for r in rings))
    else:
        edges = edges_of(rings)

        @F.pandas_udf("boolean")
        def member(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            strips = Strips(edges)
            for x, y in parts:
                yield pd.Series(strips.inside(x, y))

        found = member(F.col("x").cast("double"), F.col("y").cast("double"))
    boxed = F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3])
    return Area(bounds, lambda p, wanted: p.where(boxed).where(found) if wanted else p.where(~(boxed & found)), rings)


def rounded(ring: np.ndarray, wide: float) -> np.ndarray:
    """A convex ring widened all around: the hull of a circle (as a polygon around it) at each corner."""
    turn = np.arange(ROUND) * 2 * math.pi / ROUND
    circle = np.stack((np.cos(turn), np.sin(turn)), 1) * wide / math.cos(math.pi / ROUND)
    return oriented(convex_hull((ring[:, None] + circle).reshape(-1, 2)))


def study_area(pts: DataFrame, r: float, spec="cells,min_pts=1,buffer=0", cell_size: float | None = None) -> Area:
    """spec: a method with options, corners or a GeoJSON geometry, an Area, False (the bounding box) or None (the grid).

    cells: output cells with min_pts points at least, widened by buffer; buff_pts: places within buffer of a point (r by
    default); convex: hull widened by buffer, its round corners as polygons; concave: see concave_hull; bounding_box: widened by buffer; grid: the whole
    output grid.
    """
    if isinstance(spec, Area):
        return spec
    if isinstance(spec, (list, np.ndarray, dict)):
        return polygon_area(spec)
    method, options = parse_area(spec) if spec else ("bbox" if spec is False else "grid", {})
    wide = options.get("buffer", float(r) if method == "points" else 0.0)
    a, b, c, d = pts.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if a is None:
        return Area((0, 0, 0, 0), lambda p, wanted: p.where(F.lit(not wanted)))
    if method == "bbox":
        return _box(a - wide, b - wide, c + wide, d + wide)
    bounds = (a - wide, b - wide, c + wide, d + wide)
    if method == "points":
        return Area(bounds, lambda p, wanted: within(p, pts, wide, anti=not wanted))
    if method == "concave":
        spots = pts.select("x", "y").where("x is not null and y is not null").distinct().limit(MOST_HULL_POINTS + 1).collect()
        if len(spots) > MOST_HULL_POINTS:
            raise ValueError(f"a concave hull takes at most {MOST_HULL_POINTS} distinct points; use cells, or thin the points")
        ring = concave_hull(np.array([(p["x"], p["y"]) for p in spots], float), options.get("concavity", 2.0))
        if wide:
            raise ValueError("a concave hull has no buffer; use buff_pts")
        return polygon_area(ring) if len(ring) > 2 else Area(bounds, lambda p, wanted: within(p, pts, 0.0, anti=not wanted))
    if method == "convex":
        ring = hull_of(pts)
        if len(ring) < 3:
            return Area(bounds, lambda p, wanted: within(p, pts, wide, anti=not wanted))
        return polygon_area(rounded(ring, wide) if wide else ring)
    size = cell_size or r / 3
    grid = build_grid(pts, size)
    if method == "grid":
        return _box(grid.xmin, grid.ymin, grid.xmin + grid.n_x * size, grid.ymin + grid.n_y * size)
    cells = grid.assign(pts).groupBy("row", "col").agg(F.count("*").alias("n")).where(F.col("n") >= options.get("min_pts", 1)).select("row", "col")
    reach = int(-(-wide // size))
    steps = lambda: F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    moved = cells.withColumn("_i", steps()).withColumn("_j", steps())
    moved = moved.select((F.col("row") + F.col("_i")).alias("_r"), (F.col("col") + F.col("_j")).alias("_c"), F.col("row").alias("_r0"), F.col("col").alias("_c0"))

    def in_cells(p: DataFrame, wanted: bool) -> DataFrame:
        x0, y0 = F.lit(grid.xmin) + F.col("_c0") * size, F.lit(grid.ymin) + F.col("_r0") * size
        gx = F.greatest(F.lit(0.0), x0 - F.col("x"), F.col("x") - x0 - size)
        gy = F.greatest(F.lit(0.0), y0 - F.col("y"), F.col("y") - y0 - size)
        met = (grid.row() == F.col("_r")) & (grid.col() == F.col("_c"))
        return p.join(moved, met & (gx * gx + gy * gy <= wide * wide) if wide else met, "left_semi" if wanted else "left_anti")

    return Area((bounds[0] - size, bounds[1] - size, bounds[2] + size, bounds[3] + size), in_cells, (), None if wide else (grid, cells))


def parse_weight(spec: str | None) -> tuple[str | None, float | None, bool]:
    """Variant, fraction and keep_raw of ``variant[=fraction][,keep_raw]``; an unknown variant is ignored with a warning."""
    if not spec:
        return None, None, False
    name, *options = [s.strip() for s in spec.split(",")]
    name, _, fraction = name.partition("=")
    name = OTHER.get(name, name)
    if name not in WEIGHTS:
        warnings.warn(f"area_weight {spec!r} is unknown and ignored; known: {', '.join(WEIGHTS)}", stacklevel=3)
        return None, None, False
    return name, float(fraction) if fraction else None, "keep_raw" in options


def _border(rings, size: float, x0: float, y0: float) -> set[tuple[int, int]]:
    """(row, col) of the squares that an edge passes, and their neighbours."""
    found = set()
    for x1, y1, x2, y2 in edges_of(rings):
        n = int(math.hypot(x2 - x1, y2 - y1) / size * 2) + 1
        if n > MOST_CELLS // 10:
            raise ValueError("the outline is too long for cells of this size")
        t = np.linspace(0, 1, n + 1)
        cells = {*zip(((y1 + t * (y2 - y1) - y0) // size).astype(int).tolist(), ((x1 + t * (x2 - x1) - x0) // size).astype(int).tolist(), strict=True)}
        found |= cells
    return {(i + p, j + q) for i, j in found for p in (-1, 0, 1) for q in (-1, 0, 1)}


def _exact_rings(pts: DataFrame, r: float, rings, pid: str) -> DataFrame:
    """Points away from the outline by more than r are wholly inside or outside; the others get a term for each edge."""
    every = np.concatenate(rings)
    x0, y0 = map(float, every.min(0))
    border, edges = _border(rings, r, x0, y0), edges_of(rings)
    kind = pts.schema[pid].dataType.simpleString()

    def run(frames):
        strips = Strips(edges)
        for f in frames:
            x, y = f["x"].to_numpy(float), f["y"].to_numpy(float)
            share = strips.inside(x, y).astype(float)
            near = np.array([k in border for k in zip(((y - y0) // r).tolist(), ((x - x0) // r).tolist(), strict=True)], bool)
            share[near] = rings_share(x[near], y[near], r, rings)
            yield pd.DataFrame({"pid": f["pid"], "share": share})

    some = pts.select(F.col(pid).alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    return some.mapInPandas(run, f"pid {kind}, share double").withColumnRenamed("pid", pid)


def _exact_cells(pts: DataFrame, r: float, grid: Grid, cells: DataFrame, pid: str) -> DataFrame:
    """Points whose cell has all cells within reach have share 1; for the others the parts of the disk in each cell add up."""
    s, reach = float(grid.size), int(r // grid.size) + 1
    gap = lambda i: max(abs(i) - 1, 0) * s
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if gap(i) ** 2 + gap(j) ** 2 <= r * r]
    told = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    moved = lambda df: df.withColumn("_o", told).withColumns({"row": F.col("_r") + F.col("_o.i"), "col": F.col("_c") + F.col("_o.j")}).drop("_o").join(cells, ["row", "col"])
    own = pts.select(F.col(pid), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), grid.row().alias("_r"), grid.col().alias("_c"))
    around = moved(own.select("_r", "_c").distinct()).groupBy("_r", "_c").agg(F.count("*").alias("_n"))
    placed = own.join(around, ["_r", "_c"], "left")

    @F.pandas_udf("double")
    def part(x: pd.Series, y: pd.Series, x0: pd.Series, y0: pd.Series) -> pd.Series:
        return pd.Series(box_share(x, y, r, x0, y0, s))

    edge = placed.where(F.coalesce("_n", F.lit(0)) < len(steps))
    met = moved(edge.where("_n > 0").drop("_n"))
    x0, y0 = F.lit(float(grid.xmin)) + F.col("col") * s, F.lit(float(grid.ymin)) + F.col("row") * s
    sums = met.groupBy(pid).agg(F.sum(part("x", "y", x0, y0)).alias("share"))
    rest = edge.select(pid).join(sums, pid, "left").select(pid, F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0))).alias("share"))
    return placed.where(F.col("_n") >= len(steps)).select(pid, F.lit(1.0).alias("share")).union(rest)


def area_share(pts: DataFrame, r: float, area: Area, pid: str = "pid") -> DataFrame:
    """pid, share: exact share of each point's disk inside an area with an outline or cells."""
    if area.rings:
        return _exact_rings(pts, float(r), area.rings, pid)
    if area.cells is None:
        raise ValueError("exact weights need a study area with an outline or of whole cells")
    return _exact_cells(pts, float(r), *area.cells, pid)


def frame_cells(spark: SparkSession, area: Area, grid: Grid, r: float) -> DataFrame:
    """row, col, valid (share inside the area) of the cells that a disk around a point of the grid can touch and that aren't wholly inside."""
    s, reach = float(grid.size), int(-(-r // grid.size)) + 1
    n_x, n_y = grid.n_x + 2 * reach, grid.n_y + 2 * reach
    if n_x * n_y > MOST_CELLS:
        raise ValueError(f"{n_x * n_y} cells; at most {MOST_CELLS}")
    every = spark.range(n_x * n_y).select((F.floor(F.col("id") / n_x) - reach).alias("row"), (F.col("id") % n_x - reach).alias("col"))
    if area.rings:
        rings, gx, gy = area.rings, float(grid.xmin), float(grid.ymin)
        border, edges = _border(rings, s, gx, gy), edges_of(rings)

        def run(frames):
            strips = Strips(edges)
            for f in frames:
                row, col = f["row"].to_numpy(), f["col"].to_numpy()
                x0, y0 = gx + col * s, gy + row * s
                valid = strips.inside(x0 + s / 2, y0 + s / 2).astype(float)
                for k in np.flatnonzero(np.array([c in border for c in zip(row.tolist(), col.tolist(), strict=True)], bool)):
                    part = sum(clipped_area(ring, x0[k], y0[k], x0[k] + s, y0[k] + s) for ring in rings) / (s * s)
                    valid[k] = part if 1e-12 < part < 1 - 1e-12 else round(part)
                some = valid < 1
                yield pd.DataFrame({"row": row[some], "col": col[some], "valid": valid[some]})

        return every.mapInPandas(run, "row bigint, col bigint, valid double")
    if area.cells is None:
        raise ValueError("area weights need a study area with an outline or of whole cells")
    own, cells = area.cells
    side = float(own.size)
    low = lambda v, at, at0: F.floor((F.lit(float(at0)) + F.col(v) * side - F.lit(float(at))) / s).cast("long")
    high = lambda v, at, at0: F.ceil((F.lit(float(at0)) + (F.col(v) + 1) * side - F.lit(float(at))) / s).cast("long") - 1
    parts = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"))
    parts = parts.withColumn("row", F.explode(F.sequence(low("_r", grid.ymin, own.ymin), high("_r", grid.ymin, own.ymin))))
    parts = parts.withColumn("col", F.explode(F.sequence(low("_c", grid.xmin, own.xmin), high("_c", grid.xmin, own.xmin))))

    def shared(v, own_v, at, at0):
        a, b = F.lit(float(at)) + F.col(v) * s, F.lit(float(at0)) + F.col(own_v) * side
        return F.greatest(F.lit(0.0), F.least(a + s, b + side) - F.greatest(a, b))

    area_of = shared("row", "_r", grid.ymin, own.ymin) * shared("col", "_c", grid.xmin, own.xmin)
    valid = parts.groupBy("row", "col").agg((F.sum(area_of) / (s * s)).alias("valid"))
    return every.join(valid, ["row", "col"], "left").withColumn("valid", F.coalesce("valid", F.lit(0.0))).where(F.col("valid") < 1 - 1e-9)


def logit_terms(s: float, r: float) -> tuple[float, float]:
    """Q and B of the logistic share 1 - 1 / (1 + Q exp(-B (d / r - 1))) for cells of size s."""
    return tuple(1 / (a + math.exp(b * (s / r - 2))) for a, b in LOGIT)


def cell_share(pts: DataFrame, r: float, cells: DataFrame, grid: Grid, variant: str = "logit", fraction: float | None = None, pid: str = "pid") -> DataFrame:
    """pid, share by approximation. cells: row, col, valid (share of the cell inside the area) of the cells that aren't wholly inside.

    A cell loses 1 - valid of its area (``logit``), on the border 1 - fraction and outside all (``flat``), or 1 - fraction wherever
    it isn't wholly inside (``binary``).  fraction: by default the mean valid share of the cells it stands for.  Cells wholly
    within a disk count fully, those that the disk only touches by a logistic share of the distance to their centre.
    """
    s = float(grid.size)
    if fraction is None and variant != "logit":
        some = cells.where("valid > 0") if variant == "flat" else cells
        fraction = some.agg(F.avg("valid")).first()[0] or 0.0
    q, b = logit_terms(s, float(r))
    lost = {
        "logit": 1 - F.col("valid"),
        "flat": F.when(F.col("valid") > 0, F.lit(1.0 - (fraction or 0.0))).otherwise(F.lit(1.0)),
        "binary": F.lit(1.0 - (fraction or 0.0)),
    }[variant]
    reach = int(-(-r // s)) + 1
    gap = lambda i: max(abs(i) - 1, 0) * s
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if gap(i) ** 2 + gap(j) ** 2 <= r * r]
    told = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    # the cells, fewer than the points, are told to the cells from which a disk can touch them
    around = cells.withColumn("_o", told).select((F.col("row") - F.col("_o.i")).alias("_r"), (F.col("col") - F.col("_o.j")).alias("_c"), "row", "col", lost.alias("_lost"))
    own = pts.select(F.col(pid), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), grid.row().alias("_r"), grid.col().alias("_c"))
    cx, cy = grid.centroid()
    dx, dy = F.abs(F.col("x") - cx), F.abs(F.col("y") - cy)
    nx, ny = F.greatest(dx - s / 2, F.lit(0.0)), F.greatest(dy - s / 2, F.lit(0.0))
    touched, held = nx * nx + ny * ny <= r * r, (dx + s / 2) ** 2 + (dy + s / 2) ** 2 <= r * r
    soft = 1 - 1 / (1 + q * F.exp(-b * (F.sqrt(dx * dx + dy * dy) / r - 1)))
    bad = own.join(around, ["_r", "_c"]).where(touched).groupBy(pid).agg(F.sum(F.col("_lost") * F.when(held, 1.0).otherwise(soft) * s * s).alias("_bad"))
    share = F.greatest(F.lit(0.0), 1 - F.coalesce(F.col("_bad"), F.lit(0.0)) / (math.pi * r * r))
    return pts.select(pid).join(bad, pid, "left").select(pid, share.alias("share"))


def shares(pts: DataFrame, radii: list[float], area: Area, variant: str, fraction: float | None = None, pid: str = "pid", frame: DataFrame | None = None) -> DataFrame:
    """pid and _share_k for the k-th radius. frame: the points that span the cells of the approximations (the points themselves)."""
    found = None
    for k, r in enumerate(radii):
        if variant == "exact":
            one = area_share(pts, r, area, pid)
        else:
            grid = build_grid(pts if frame is None else frame, r / 2)
            one = cell_share(pts, r, frame_cells(pts.sparkSession, area, grid, r), grid, variant, fraction, pid)
        one = one.withColumnRenamed("share", f"_share_{k}")
        found = one if found is None else found.join(one, pid)
    return found


def diagnostics(share: DataFrame, column: str = "share") -> DataFrame:
    """n_points, n_boundary_points (share under 0.999), least and mean share."""
    return share.agg(
        F.count(column).alias("n_points"), F.count(F.when(F.col(column) < 0.999, 1)).alias("n_boundary_points"),
        F.round(F.min(column), 4).alias("valid_area_share_min"), F.round(F.avg(column), 4).alias("valid_area_share_mean"),
    )


def area_size(area: Area) -> float | None:
    """Area of an outline; None where there is none."""
    return sum(ring_area(r) for r in area.rings) if area.rings else None
