"""Public functions."""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radspark.functions.geometry import degrees_arrays, local_bounds, local_polygon, utm, utm_inverse, utm_zone, wkt_in_degrees
from radspark.operators import detect as detection
from radspark.operators import radius
from radspark.operators import study_area as areas
from radspark.operators.clusters import build_clusters, with_cluster_id
from radspark.operators.detect import Detection
from radspark.operators.radius import same_place
from radspark.operators.study_area import area_share, diagnostics, parse_weight, shares
from radspark.plans.grid import build_grid, described, spatial_summary
from radspark.plans.spec import cluster_id, parse_r, present_names
from radspark.sources.points import random_points

# Fixed value: the coordinate system of degrees.
DEGREES = "EPSG:4326"


class Zone(NamedTuple):
    """UTM zone of a WGS84 table; ``epsg`` is its code."""

    number: int
    north: bool

    @property
    def epsg(self) -> int:
        return (32600 if self.north else 32700) + self.number


def local_zone(*tables: DataFrame, lon: str = "lon", lat: str = "lat", proj_crs: str = "auto") -> Zone:
    """UTM zone of the centre of the tables' joint bounds, or the one that ``proj_crs`` (EPSG:326xx or EPSG:327xx) names."""
    if proj_crs != "auto":
        code = int(proj_crs.upper().removeprefix("EPSG:"))
        if code // 100 not in (326, 327) or not 1 <= code % 100 <= 60:
            raise ValueError(f"proj_crs {proj_crs!r} isn't a UTM zone")
        return Zone(code % 100, code // 100 == 326)
    found = [t.agg(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first() for t in tables]
    found = [f for f in found if f[0] is not None] or [(0.0,) * 4]
    low, high = [min(f[i] for f in found) for i in (0, 1)], [max(f[i] for f in found) for i in (2, 3)]
    return Zone(*utm_zone((low[0] + high[0]) / 2, (low[1] + high[1]) / 2))


def project(pts: DataFrame, crs: str, lon: str = "lon", lat: str = "lat", proj_crs: str = "auto", zone: Zone | None = None) -> DataFrame:
    """proj_x, proj_y: '' and UTM zones (EPSG:326xx, EPSG:327xx) take the columns as they are, EPSG:4326 the UTM zone of the bounds'
    centre; other systems raise."""
    if crs == "" or crs and crs.upper()[:8] in ("EPSG:326", "EPSG:327"):
        return pts.withColumns({"proj_x": F.col(lon), "proj_y": F.col(lat)})
    if crs is None or crs.upper() != DEGREES:
        raise ValueError(f"crs {crs!r} isn't supported: '', {DEGREES} or a UTM zone")
    x, y = utm(lon, lat, *(zone or local_zone(pts, lon=lon, lat=lat, proj_crs=proj_crs)))
    return pts.withColumns({"proj_x": x, "proj_y": y})


def unproject(df: DataFrame, zone: Zone, x: str = "centroid_x", y: str = "centroid_y", geometry: str = "geometry") -> DataFrame:
    """``df`` with x, y and the WKT column ``geometry`` (metres of the zone) as degrees: for exports in the initial system."""
    lon, lat = utm_inverse(x, y, *zone)
    shape = {geometry: wkt_in_degrees(F.col(geometry), *zone)} if geometry in df.columns else {}
    return df.withColumns({x: lon, y: lat} | shape)


def _flat(pts: DataFrame, target: DataFrame | None, crs: str, x: str, y: str, proj_crs: str, area):
    """Both tables with coordinates x, y of a plane, and the study area's polygon in it, if it is one.

    The columns that had these names are kept as _own_x, _own_y.
    """
    zone = local_zone(*(t for t in (pts, target) if t is not None), lon=x, lat=y, proj_crs=proj_crs) if crs.upper() == DEGREES else None
    out = []
    for t in (pts, target):
        if t is None:
            out.append(None)
            continue
        p = project(t, crs, x, y, zone=zone)
        for c in ("x", "y"):
            if c in t.columns:
                p = p.withColumnRenamed(c, f"_own_{c}")
        out.append(p.withColumnsRenamed({"proj_x": "x", "proj_y": "y"}))
    return *out, local_polygon(area, *zone) if zone and isinstance(area, (list, dict)) else area


def _named(found: DataFrame, pts: DataFrame) -> DataFrame:
    """The table's own columns first, then the new ones; helper coordinates go."""
    own = {c: f"_own_{c}" if f"_own_{c}" in found.columns else c for c in pts.columns}
    new = [c for c in found.columns if c not in own.values() and c not in ("x", "y")]
    return found.select(*(F.col(v).alias(c) for c, v in own.items()), *new)


@present_names
def radius_search(
    pts: DataFrame, r, c=(), stat="sum", *, crs: str = "", x: str = "x", y: str = "y", x_tgt: str | None = None, y_tgt: str | None = None, proj_crs: str = "auto", pid: str = "pid",
    pts_target: DataFrame | None = None, study_area="cells,min_pts=1,buffer=0", area_weight: str | None = None, cell_size: float | None = None, **options,
) -> DataFrame:
    """Aggregates of the points within r of each point; see radspark.operators.radius. crs: '' for a plane, EPSG:4326 for degrees.

    area_weight: ``exact``, ``logit``, ``flat`` or ``binary`` (also ``variant=fraction,keep_raw``) divides every aggregate
    by the share of its disk inside the study area.
    """
    variant, fraction, keep_raw = parse_weight(area_weight)
    if not crs and not variant:
        return radius.radius_search(pts, r, c, stat, x=x, y=y, x_tgt=x_tgt, y_tgt=y_tgt, pid=pid, pts_target=pts_target, **options)
    if pts_target is not None and (x_tgt or y_tgt):
        pts_target = pts_target.withColumnsRenamed({x_tgt or x: x, y_tgt or y: y})
    flat, target, study_area = _flat(pts, pts_target, crs, x, y, proj_crs, study_area)
    share = None
    if variant:
        radii = parse_r(r).distinct
        frame = flat if target is None else target
        area = areas.study_area(frame, radii[-1], study_area, cell_size)
        share = shares(flat, [d for d in radii if d > 0], area, variant, fraction, pid, frame)
    return _named(radius.radius_search(flat, r, c, stat, pid=pid, pts_target=target, share=share, keep_raw=keep_raw, **options), pts)


radius_sum = partial(radius_search, stat="sum")
radius_count = partial(radius_search, stat="count")
radius_mean = partial(radius_search, stat="mean")
radius_variance = partial(radius_search, stat="variance")
radius_std = partial(radius_search, stat="std")
radius_cv = partial(radius_search, stat="cv")
radius_skewness = partial(radius_search, stat="skewness")
radius_kurtosis = partial(radius_search, stat="kurtosis")
build_study_area = infer_study_area_from_pts = areas.study_area


def draw_random_coords(spark, n: int, area, *, crs: str = "", zone: Zone | None = None, random_seed: int = 0, generator=None, x: str = "x", y: str = "y") -> DataFrame:
    """nid and n random points x, y inside an area, or a polygon. crs EPSG:4326: the polygon and the points are in degrees.

    zone: the UTM zone in which degrees are drawn evenly; by default that of the polygon's centre.
    """
    if not crs:
        spot = area if isinstance(area, areas.Area) else areas.polygon_area(area)
        return random_points(spark, n, spot, random_seed, generator).withColumnsRenamed({"x": x, "y": y})
    if crs.upper() != DEGREES:
        raise ValueError(f"crs {crs!r} isn't supported: '' or {DEGREES}")
    if isinstance(area, areas.Area):
        spot = area
        if zone is None:
            raise ValueError("an area in metres needs its zone")
    else:
        a, b, c, d = areas.polygon_area(area).bounds
        zone = zone or Zone(*utm_zone((a + c) / 2, (b + d) / 2))
        spot = areas.polygon_area(local_polygon(area, *zone))
    return unproject(random_points(spark, n, spot, random_seed, generator), zone, "x", "y").withColumnsRenamed({"x": x, "y": y})


def weighted_search(pts: DataFrame, r, c, stat="sum", area="bbox", **options) -> DataFrame:
    """radius_search divided by the exact share of each disk inside the study area."""
    return radius_search(pts, r, c, stat, study_area=area, area_weight="exact", **options)


@present_names
def detect_cluster_pts(
    pts: DataFrame, r, c=(), stat="sum", *, crs: str = "", x: str = "x", y: str = "y", proj_crs: str = "auto", pts_target: DataFrame | None = None, study_area=detection.AREA, keep_cols: bool | None = True, **options,
) -> DataFrame:
    """Points flagged where their aggregate exceeds the k-th percentile of the same at random points of the study area.

    See radspark.operators.detect for the options: null_distribution (100,000 points by default), k, random_seed, area_weight,
    cell_size, exclude_self.  Null points given as a table are in the plane's coordinates.
    """
    flat, target, study_area = _flat(pts, pts_target, crs, x, y, proj_crs, study_area)
    return _named(detection.detect_cluster_pts(flat, r, c, stat, pts_target=target, area=study_area, keep_cols=keep_cols, **options), pts)


class Clusters(NamedTuple):
    """Points with flags and cluster ids; for each flag its clusters and their cells; the thresholds."""

    points: DataFrame
    clusters: dict[str, DataFrame]
    cells: dict[str, DataFrame]
    thresholds: DataFrame


@present_names
def detect_cluster_cells(
    pts: DataFrame, r, c=(), stat="sum", *, crs: str = "", x: str = "x", y: str = "y", proj_crs: str = "auto", pts_target: DataFrame | None = None, study_area=detection.AREA, cell_size: float | None = None,
    contingency=1, merge_dist=None, min_cluster_share=(0.05, 0.0, 0.0), make_convex: bool = True, **options,
) -> Clusters:
    """Flagged points and, for every flag (column and radius or band), the clusters of output cells."""
    flat, target, study_area = _flat(pts, pts_target, crs, x, y, proj_crs, study_area)
    found: Detection = detection.detect(flat, r, c, stat, pts_target=target, area=study_area, cell_size=cell_size, **options)
    values = [c] if isinstance(c, str) else list(c)
    flags = [n for n in found.points.columns if n not in flat.columns and "cluster" in n]
    per = max(1, len(flags) // max(1, len(values)))
    grid = build_grid(flat, cell_size or parse_r(r).items[0][1] / 3)
    points, clusters, cells = found.points, {}, {}
    for i, flag in enumerate(flags):
        value = values[min(i // per, len(values) - 1)] if values else None
        some = found.points if value else found.points.withColumn("_one", F.lit(1))
        clusters[flag], cells[flag] = build_clusters(some, grid, flag, value or "_one", contingency=contingency, merge_dist=merge_dist, min_cluster_share=min_cluster_share, make_convex=make_convex)
        points = with_cluster_id(points, grid, cells[flag], cluster_id(flag))
    return Clusters(_named(points, pts), clusters, cells, found.thresholds)


@present_names
def build_cluster_cells_from_labels(pts: DataFrame, c: str, is_cluster_column: str = "cluster", *, cell_size: float, min_cluster_share=(0.0, 0.0, 0.0), **options):
    grid = build_grid(pts, cell_size)
    clusters, cells = build_clusters(pts, grid, is_cluster_column, c, min_cluster_share=min_cluster_share, **options)
    return with_cluster_id(pts, grid, cells, f"{is_cluster_column}_id"), clusters, cells


__all__ = [
    "area_share", "degrees_arrays", "described", "local_bounds", "local_polygon", "spatial_summary", "build_cluster_cells_from_labels", "build_study_area", "detect_cluster_cells", "detect_cluster_pts", "diagnostics", "draw_random_coords",
    "infer_study_area_from_pts", "local_zone", "project", "radius_search", "same_place", "unproject", "weighted_search",
]
