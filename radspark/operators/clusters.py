"""Clusters of output cells: contiguity, drops, distance merges, convex fill, ranks, outlines.

Cells, totals and contiguity are distributed.  The greedy merge and the fill work on the clusters that are left after the
first drop; their cells are collected, at most ``MOST`` of them (more raise: use a larger cell size).
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radspark.functions.geometry import Strips, convex_hull, edges_of, ring_area
from radspark.plans.components import connected_components
from radspark.plans.grid import Grid
from radspark.plans.spec import parse_contingency, parse_merge_dist, parse_shares
from radspark.plans.storage import materialize

MOST = 200_000
#: Pairs of neighbouring cells up to which one task finds the components.
FEW_EDGES = 1_000_000
_WIDE = 1 << 31


def flagged_cells(pts: DataFrame, grid: Grid, flag: str, c: str) -> DataFrame:
    """row, col, total (raw sum over all points of the cell) and whether a flagged point lies in it, of the cells with points."""
    return grid.assign(pts).groupBy("row", "col").agg(F.sum(c).alias("total"), F.max(F.coalesce(F.col(flag).cast("boolean"), F.lit(False))).alias("flagged"))


def seed_cells(pts: DataFrame, grid: Grid, flag: str, c: str) -> DataFrame:
    """row, col, total of the cells with a flagged point."""
    return flagged_cells(pts, grid, flag, c).where("flagged").drop("flagged")


def contiguity(cells: DataFrame, queen: int = 1, rook: int = 0) -> DataFrame:
    """cells with ``component``: the smallest cell key among cells linked by steps of at most ``queen`` (Chebyshev) or, along an axis, ``rook``."""
    key = F.col("row") * _WIDE + F.col("col")
    steps = [(i, j) for i in range(-queen, queen + 1) for j in range(-queen, queen + 1) if (i, j) > (0, 0)]
    steps += [s for k in range(queen + 1, rook + 1) for s in ((0, k), (k, 0))]
    keyed = cells.withColumn("_k", key)
    if not steps:
        return keyed.withColumnRenamed("_k", "component")
    moved = keyed.select(F.col("_k").alias("a"), F.explode(F.array(*(F.col("_k") + (i * _WIDE + j) for i, j in steps))).alias("b"))
    edges = moved.join(keyed.select(F.col("_k").alias("b")), "b")
    labels = connected_components(edges, small=FEW_EDGES)
    return keyed.join(labels.withColumnRenamed("node", "_k"), "_k", "left").withColumn("component", F.coalesce("component", "_k")).drop("_k")


def cluster_table(cells: DataFrame, share: float = 0.05) -> DataFrame:
    """component, total, n_cells of the components with a total of at least share times the largest single cell's."""
    largest = cells.agg(F.max("total").alias("m"))
    grouped = cells.groupBy("component").agg(F.sum("total").alias("total"), F.count("*").alias("n_cells"))
    return grouped.where(F.col("total") >= largest.select(F.col("m") * F.lit(share)).scalar())


class _Cluster:
    def __init__(self, cells: dict, total: float):
        self.cells, self.total = dict(cells), total
        self.centre = tuple(sum(k[i] + 0.5 for k in cells) / len(cells) for i in (0, 1))
        self.first = min(cells)

    def key(self) -> tuple:
        return (-self.total, -len(self.cells), self.first)

    def annex(self, other: _Cluster) -> None:
        n, m = len(self.cells), len(other.cells)
        self.centre = tuple((p * n + q * m) / (n + m) for p, q in zip(self.centre, other.centre, strict=True))
        self.cells |= other.cells
        self.total += other.total
        self.first = min(self.first, other.first)


def border_distances(clusters: list[_Cluster], most: float) -> list[dict[int, float]]:
    """For each cluster the distance, in cells, of every other one whose border lies within ``most``."""
    found: list[dict[int, float]] = [{} for _ in clusters]
    edge = [(r, c, i) for i, k in enumerate(clusters) for r, c in k.cells if not {(r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)} <= k.cells.keys()]
    wide, buckets = int(most) + 2, defaultdict(list)
    for x in edge:
        buckets[x[0] // wide, x[1] // wide].append(x)
    buckets = {k: np.array(v) for k, v in buckets.items()}
    for (p, q), one in buckets.items():
        around = [buckets[k] for k in ((p, q), (p, q + 1), (p + 1, q - 1), (p + 1, q), (p + 1, q + 1)) if k in buckets]
        other = np.concatenate(around)
        for at in range(0, len(one), 512):
            part = one[at : at + 512, None]
            gap = np.maximum(np.abs(part[..., :2] - other[None, :, :2]) - 1, 0)
            d = np.sqrt((gap * gap).sum(-1))
            for k, m in zip(*np.nonzero((d <= most) & (part[..., 2] != other[:, 2])), strict=True):
                i, j = int(part[k, 0, 2]), int(other[m, 2])
                if d[k, m] < found[i].get(j, math.inf):
                    found[i][j] = found[j][i] = float(d[k, m])
    return found


def merge_by_distance(clusters: list[_Cluster], rules, size: float) -> list[_Cluster]:
    """Largest first; the first mergeable pair merges, until there is none.

    That pair is the first cluster in order with a partner, and the first of its partners; partners are kept up to date.
    """
    rules = [r for r in rules if r[0] is not None or r[1] is not None]
    alive = dict(enumerate(clusters))
    border = border_distances(clusters, max((b for _, b in rules if b is not None), default=-1) / size + 1e-9)
    wide = max((c for c, b in rules if b is None), default=0) / size
    buckets: dict[tuple, set[int]] = defaultdict(set)
    spot = lambda k: tuple(math.floor(x / wide) for x in k.centre) if wide else ()
    for i, k in alive.items():
        buckets[spot(k)].add(i)

    def close(i: int, j: int) -> bool:
        far, gap = math.dist(alive[i].centre, alive[j].centre) * size, border[i].get(j, math.inf) * size
        return any((c is None or far <= c) and (b is None or gap <= b) for c, b in rules)

    def partners_of(i: int) -> set[int]:
        some = set(border[i])
        if wide:
            p, q = spot(alive[i])
            some |= {j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in buckets.get((p + a, q + b), ())}
        return {j for j in some if j != i and close(i, j)}

    partners = {i: partners_of(i) for i in alive}
    queue = [(alive[i].key(), i) for i in alive if partners[i]]
    heapq.heapify(queue)
    while queue:
        key, i = heapq.heappop(queue)
        if i not in alive or key != alive[i].key() or not partners[i]:
            continue
        j = min(partners[i], key=lambda k: alive[k].key())
        for k in (i, j):
            buckets[spot(alive[k])].discard(k)
            for p in partners[k]:
                partners[p].discard(k)
        alive[i].annex(alive.pop(j))
        del partners[j]
        for k, d in border[j].items():
            border[k].pop(j, None)
            if k != i:
                border[i][k] = border[k][i] = min(d, border[i].get(k, math.inf))
        buckets[spot(alive[i])].add(i)
        partners[i] = partners_of(i)
        for p in partners[i]:
            partners[p].add(i)
            heapq.heappush(queue, (alive[p].key(), p))
        heapq.heappush(queue, (alive[i].key(), i))
    return sorted(alive.values(), key=_Cluster.key)


def fill_convex(clusters: list[_Cluster]) -> dict:
    """Adds, with total 0, free cells whose centre lies strictly inside the hull of the cluster's cell corners; larger clusters first.

    The cluster of each added cell.
    """
    filled = {}
    taken = {k for c in clusters for k in c.cells}
    for c in clusters:
        corners = np.array(list(c.cells))
        ring = convex_hull(np.concatenate([corners + step for step in ((0, 0), (0, 1), (1, 0), (1, 1))]))
        low, high = ring.min(0).astype(int), ring.max(0).astype(int)
        i, j = np.meshgrid(np.arange(low[0], high[0]), np.arange(low[1], high[1]), indexing="ij")
        within = np.ones(i.shape, bool)
        for p, q in zip(ring, np.roll(ring, -1, 0), strict=True):
            within &= (q[0] - p[0]) * (j + 0.5 - p[1]) - (q[1] - p[1]) * (i + 0.5 - p[0]) > 1e-9
        for k in zip(i[within].tolist(), j[within].tolist(), strict=True):
            if k not in taken:
                c.cells[k] = 0
                filled[k] = c
                taken.add(k)
    return filled


def rings_of(cells) -> list[list[list[tuple[int, int]]]]:
    """Polygons of the union of cells, each an outer ring (counter-clockwise) and its holes (clockwise), as corners (col, row)."""
    have, edges = set(cells), defaultdict(list)
    for r, c in have:
        for other, a, b in (((r - 1, c), (c, r), (c + 1, r)), ((r, c + 1), (c + 1, r), (c + 1, r + 1)), ((r + 1, c), (c + 1, r + 1), (c, r + 1)), ((r, c - 1), (c, r + 1), (c, r))):
            if other not in have:
                edges[a].append(b)
    simple = []
    while edges:
        path, at = [], min(edges)
        placed: dict[tuple, int] = {}
        while True:
            if at in placed:  # a loop is closed: it is a ring of its own
                simple.append(path[placed[at] :])
                for p in path[placed[at] + 1 :]:
                    del placed[p]
                del path[placed[at] + 1 :]
            else:
                placed[at] = len(path)
                path.append(at)
            if at not in edges:
                break
            nxt = edges[at].pop()
            if not edges[at]:
                del edges[at]
            at = nxt
    outer = [r for r in simple if ring_area(np.array(r)) > 0]
    found = [[r] for r in outer]
    for hole in (r for r in simple if ring_area(np.array(r)) < 0):
        (x1, y1), (x2, y2) = hole[:2]
        x, y = (x1 + x2) / 2 + (y2 - y1) / 2, (y1 + y2) / 2 - (x2 - x1) / 2  # the free cell beside the first edge
        around = [k for k, r in enumerate(outer) if Strips(edges_of([np.array(r, float)])).inside([x], [y])[0]]
        found[min(around, key=lambda k: ring_area(np.array(outer[k])))].append(hole)
    return found


def outline(cells, grid: Grid) -> str:
    """WKT of the union of cells, holes in the polygon that has them."""
    told = lambda ring: "(" + ", ".join(f"{grid.xmin + x * grid.size} {grid.ymin + y * grid.size}" for x, y in [*ring, ring[0]]) + ")"
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(map(told, polygon)) + ")" for polygon in rings_of(cells)) + ")"


def build_clusters(pts: DataFrame, grid: Grid, flag: str, c: str, *, contingency=1, merge_dist=None, min_cluster_share=(0.05, 0.0, 0.0), make_convex: bool = True) -> tuple[DataFrame, DataFrame]:
    """(clusters, cluster cells): ids from 1 by total, centroid, total, n_cells, area, geometry; and row, col, cluster_id."""
    grid.square()
    queen, rook = parse_contingency(contingency)
    rules, shares = parse_merge_dist(merge_dist), parse_shares(min_cluster_share)
    spark = pts.sparkSession
    every = materialize(flagged_cells(pts, grid, flag, c), "cells")
    seeds = every.where("flagged").drop("flagged")
    parts = contiguity(seeds, queen, rook if rook > queen else 0)
    largest = seeds.agg(F.max("total")).first()[0] or 0
    kept = parts.join(cluster_table(parts, shares[0]).select("component"), "component", "left_semi")
    rows = kept.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} clustered cells; use a larger cell size")
    by = defaultdict(dict)
    for x in rows:
        by[x["component"]][x["row"], x["col"]] = x["total"]
    clusters = merge_by_distance([_Cluster(v, sum(v.values())) for v in by.values()], rules, grid.size)
    clusters = [k for k in clusters if k.total >= largest * shares[1]]
    filled = fill_convex(clusters) if make_convex else {}
    if filled:
        cells = spark.createDataFrame([(int(r), int(q)) for r, q in filled], "row bigint, col bigint")
        for x in every.join(cells, ["row", "col"]).collect():  # at most one row for each filled cell
            k = filled[x["row"], x["col"]]
            k.cells[x["row"], x["col"]] = x["total"] or 0
            k.total += x["total"] or 0
    clusters = sorted((k for k in clusters if k.total >= largest * shares[2]), key=lambda k: (-k.total, min(k.cells)))
    at = lambda v, low: float(low + v * grid.size)
    table = [(i, at(k.centre[1], grid.xmin), at(k.centre[0], grid.ymin), float(k.total), len(k.cells), float(len(k.cells) * grid.size**2), outline(k.cells, grid)) for i, k in enumerate(clusters, 1)]
    cells = [(int(r), int(q), i) for i, k in enumerate(clusters, 1) for r, q in sorted(k.cells)]
    return (
        spark.createDataFrame(table, "cluster_id int, centroid_x double, centroid_y double, total double, n_cells int, area double, geometry string"),
        spark.createDataFrame(cells, "row bigint, col bigint, cluster_id int"),
    )


def with_cluster_id(pts: DataFrame, grid: Grid, cells: DataFrame, name: str = "cluster_id") -> DataFrame:
    """``pts`` with the id of the cluster of their cell, 0 for none."""
    ids = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("cluster_id").alias("_id"))
    return pts.join(ids, (grid.row() == F.col("_r")) & (grid.col() == F.col("_c")), "left").withColumn(name, F.coalesce("_id", F.lit(0))).drop("_r", "_c", "_id")


def geojson(wkt: Column) -> Column:
    """A GeoJSON geometry of a WKT polygon or multipolygon."""
    kind = F.when(wkt.startswith("MULTI"), F.lit("MultiPolygon")).otherwise(F.lit("Polygon"))
    points = F.regexp_replace(wkt, r"([-+0-9.eE]+) ([-+0-9.eE]+)", "[$1, $2]")
    body = F.translate(F.regexp_replace(points, r"^[A-Z]+ *", ""), "()", "[]")
    return F.concat(F.lit('{"type": "'), kind, F.lit('", "coordinates": '), body, F.lit("}"))


def save(df: DataFrame, path: str, fmt: str = "csv", geometry: str = "geometry") -> None:
    """csv (with header), parquet or geojson (a feature a line; ``geometry`` names the column with WKT)."""
    if fmt == "geojson":
        props = F.to_json(F.struct(*(n for n in df.columns if n != geometry)), {"ignoreNullFields": "false"})
        shape = F.coalesce(geojson(F.col(geometry)), F.lit("null")) if geometry in df.columns else F.lit("null")
        df.select(F.concat(F.lit('{"type": "Feature", "properties": '), props, F.lit(', "geometry": '), shape, F.lit("}")).alias("value")).write.text(path)
    elif fmt == "parquet":
        df.write.parquet(path)
    elif fmt == "csv":
        df.write.option("header", True).csv(path)
    else:
        raise ValueError("formats: csv, parquet, geojson")
