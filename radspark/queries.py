"""Registered queries over the point views and the same in SQL (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radspark import api
from radspark.functions.geometry import hull_of, inside, utm
from radspark.operators import clusters, detect
from radspark.operators.study_area import area_share, shares, study_area
from radspark.plans import grid as grids
from radspark.plans.spec import STATS
from radspark.sources.points import points

R, CELL = 500, 166
#: Null points of the detection queries, and draws among which SQL looks for as many inside the default study area.
NULL_N, DRAWS = detect.NULL_POINTS, 3_000_000
RING = [(2000.0, 1000.0), (30000.0, 3000.0), (38000.0, 20000.0), (20000.0, 12000.0), (5000.0, 30000.0)]

# The point views in DuckDB's SQL.
EVENTS = "events_pts as (select event_id as pid, cast(trunc(epoch_us(ts) / 60e6 - 28401120) as bigint) as x, cast(round(value * 100) as bigint) as y, user_id as v from events)"
ORDERS = "orders_pts as (select o_orderkey as pid, cast(floor(o_totalprice / 10) as bigint) as x, cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) * 20 as bigint) as y, o_custkey as v from orders)"
PART = "part_pts as (select p_partkey as pid, cast(round(p_retailprice * 10) as bigint) as x, cast(p_size * 20 as bigint) as y, cast(p_size as bigint) as v from part)"


def _draws(n: int) -> str:
    digits = lambda axis: f"('0x' || substr(md5('0{axis}' || i), 1, 13))::bigint::double / 4503599627370496::double"
    return (
        "box as (select min(x)::double as a, max(x)::double as c, min(y)::double as b, max(y)::double as d from events_pts), "
        f"draws as (select i as pid, a + {digits('x')} * (c - a) as x, b + {digits('y')} * (d - b) as y from range({n}) t(i), box)"
    )


NULLS = _draws(NULL_N) + ", nulls as (select * from draws)"
#: Draws in the cells of events, widened by a cell on each side as the sampler's box is.
NULLS_IN_CELLS = _draws(DRAWS).replace("min(x)::double as a, max(x)::double as c, min(y)::double as b, max(y)::double as d", "min(x)::double - {s} as a, max(x)::double + {s} as c, min(y)::double - {s} as b, max(y)::double + {s} as d").format(s="166::double") + (
    ", o as (select min(x) as x0, min(y) as y0 from events_pts), full_cells as (select distinct floor((x - x0) / 166::double) as c, floor((y - y0) / 166::double) as r from events_pts, o), "
    "nulls as (select pid, x, y from draws, o where exists (select 1 from full_cells where c = floor((x - x0) / 166::double) and r = floor((y - y0) / 166::double)) order by pid limit " + str(NULL_N) + ")"
)


def pairs(source: str = "events_pts", target: str = "events_pts", r: int = R, name: str = "near") -> str:
    return (
        f"{name} as (select s.pid, t.v, t.v * t.v as v2, t.v * t.v * t.v as v3, t.v * t.v * t.v * t.v as v4, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) as d2 "
        f"from {source} s join {target} t on t.x between s.x - {r} and s.x + {r} and (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) <= {r * r})"
    )


SUMS = "sums as (select pid, count(*) as n, cast(sum(v) as bigint) as s1, cast(sum(v2) as bigint) as s2, cast(sum(v3) as bigint) as s3, cast(sum(v4) as bigint) as s4 from near group by pid)"
MOMENTS = (
    "moments as (select pid, n, s1, cast(s1 as double) / n as m1, cast(s2 as double) / n as e2, cast(s3 as double) / n as e3, cast(s4 as double) / n as e4 from sums), "
    "central as (select *, e2 - m1 * m1 as m2 from moments)"
)
NAN = "cast('nan' as double)"
FORMULAS = {
    "sum": "s1", "count": "n", "mean": "m1", "variance": "m2", "std": "sqrt(greatest(m2, 0.0))", "cv": f"coalesce(sqrt(greatest(m2, 0.0)) / nullif(m1, 0), {NAN})",
    "skewness": f"case when m2 > 0 then (e3 - 3.0::double * m1 * e2 + 2.0::double * m1 * m1 * m1) / (m2 * sqrt(m2)) else {NAN} end",
    "kurtosis": f"case when m2 > 0 then (e4 - 4.0::double * m1 * e3 + 6.0::double * m1 * m1 * e2 - 3.0::double * m1 * m1 * m1 * m1) / (m2 * m2) - 3.0::double else {NAN} end",
}


def _stat(stat: str):
    return lambda spark, d: api.radius_search(points(spark, d, "events"), R, "v", stat).select("pid", f"v_{STATS[stat]}_{R}")


def multi_stat(spark, d) -> DataFrame:
    return api.radius_search(points(spark, d, "events"), R, "v", ["sum", "mean", "variance"]).select("pid", f"v_sum_{R}", f"v_avg_{R}", f"v_var_{R}")


def two_columns(spark, d) -> DataFrame:
    pts = points(spark, d, "events").withColumn("w", F.col("x") % 10)
    return api.radius_search(pts, R, ["v", "w"], "sum").select("pid", f"v_sum_{R}", f"w_sum_{R}")


def exclude_self(spark, d) -> DataFrame:
    return api.radius_search(points(spark, d, "events"), R, "v", ["sum", "count"], exclude_self=True).select("pid", f"v_sum_{R}", f"v_cnt_{R}")


def source_target(spark, d) -> DataFrame:
    return api.radius_search(points(spark, d, "events"), R, "v", "sum", pts_target=points(spark, d, "orders")).select("pid", f"v_sum_{R}")


def radius_list(spark, d) -> DataFrame:
    return api.radius_search(points(spark, d, "events"), [250, 500], "v", "sum").select("pid", "v_sum_250", "v_sum_500")


def radius_bands(spark, d) -> DataFrame:
    return api.radius_search(points(spark, d, "events"), [(0, 250), (250, 500)], "v", "sum").select("pid", "v_sum_0_250", "v_sum_250_500")


def radius_wbands(spark, d) -> DataFrame:
    return api.radius_search(points(spark, d, "events"), [(0, 250, 3.0), (250, 500, 1.0)], "v", "sum").select("pid", "v_sum_wgt")


def radius_r0(spark, d) -> DataFrame:
    return api.same_place(points(spark, d, "part"), "v").select("pid", "v_sum_0")


def _grid(spark, d):
    pts = points(spark, d, "events")
    return pts, grids.build_grid(pts, CELL)


def _cells(agg: str):
    def query(spark, d):
        pts, g = _grid(spark, d)
        return grids.cell_aggregate(pts, g, "v", agg).select("row", "col", "v")

    return query


def grid_median(spark, d) -> DataFrame:
    return grids.aggregate_to_grid(points(spark, d, "events"), "v", CELL, "median").select("cell_col", "cell_row", "v")


def _labelled(spark, d):
    pts, g = _grid(spark, d)
    return pts.withColumn("cluster", F.col("v") % 50 == 0), g


def full_grid(spark, d) -> DataFrame:
    pts = points(spark, d, "events")
    g = grids.build_grid(pts, 1000)
    return grids.full_grid(grids.cell_aggregate(pts, g, "v"), g).select("row", "col", "v")


def seed_cells(spark, d) -> DataFrame:
    pts, g = _labelled(spark, d)
    return clusters.seed_cells(pts, g, "cluster", "v")


def contiguity_components(spark, d) -> DataFrame:
    return clusters.contiguity(seed_cells(spark, d)).select("row", "col", "component")


def cluster_table(spark, d) -> DataFrame:
    return clusters.cluster_table(clusters.contiguity(seed_cells(spark, d)), 0.5)


def sparse_grid(spark, d) -> DataFrame:
    pts, g = _labelled(spark, d)
    labelled = seed_cells(spark, d).select("row", "col", F.lit(1).alias("cluster_id"))
    return grids.sparse_grid(grids.cell_aggregate(pts, g, "v"), labelled).select("row", "col", "v", "cluster_id")


def null_thresholds(spark, d) -> DataFrame:
    found = detect.detect(points(spark, d, "events"), R, "v", area="bbox").thresholds
    return found.select("threshold")


def detect_pts(spark, d) -> DataFrame:
    return api.detect_cluster_pts(points(spark, d, "events"), R, "v", study_area="bbox").select("pid", f"v_sum_{R}", f"v_cluster_sum_{R}")


def detect_default(spark, d) -> DataFrame:
    return api.detect_cluster_pts(points(spark, d, "events"), R, "v", cell_size=CELL).select("pid", f"v_sum_{R}", f"v_cluster_sum_{R}")


def detect_pts_bands(spark, d) -> DataFrame:
    found = api.detect_cluster_pts(points(spark, d, "events"), [(0, 250), (250, 500)], "v", study_area="bbox", exclude_self=False)
    return found.select("pid", "v_sum_0_250_cluster", "v_sum_250_500_cluster")


def detect_weighted(spark, d) -> DataFrame:
    found = api.detect_cluster_pts(points(spark, d, "events"), R, [], study_area="bbox", area_weight="exact")
    return found.select("pid", F.round(f"count_cnt_{R}", 6).alias("weighted"))


def radius_weighted(spark, d) -> DataFrame:
    found = api.radius_search(points(spark, d, "events"), [250, 500], "v", ["sum", "mean"], study_area="bbox", area_weight="exact")
    return found.select("pid", *(F.round(c, 5).alias(c) for c in ("v_sum_250", "v_sum_500", "v_avg_250", "v_avg_500")))


def radius_target_exclude_self(spark, d) -> DataFrame:
    pts = points(spark, d, "events")
    return api.radius_search(pts.where("pid % 3 = 0"), R, "v", "sum", pts_target=pts, exclude_self=True).select("pid", f"v_sum_{R}")


def study_bbox(spark, d) -> DataFrame:
    area = study_area(points(spark, d, "orders"), R, "bbox,buffer=100")
    return area.inside(points(spark, d, "events")).select("pid")


def study_cells_members(spark, d) -> DataFrame:
    area = study_area(points(spark, d, "orders"), R, "cells,min_pts=2", CELL)
    return area.inside(points(spark, d, "events")).select("pid")


def study_buffer_points(spark, d) -> DataFrame:
    return study_area(points(spark, d, "orders"), R, "buff_pts,buffer=60").inside(points(spark, d, "events")).select("pid")


def polygon_filter(spark, d) -> DataFrame:
    return points(spark, d, "events").where(inside(RING)).select("pid")


def spatial_stats(spark, d) -> DataFrame:
    return grids.spatial_stats(points(spark, d, "events"), 1000)


def spatial_summary(spark, d) -> DataFrame:
    found = grids.spatial_summary(points(spark, d, "events"), [250, 500])
    return found.select("n_points", "width", "height", "aspect_ratio", "density_max_to_mean", "most_points", F.round(F.get("density_skewness", F.lit(0)), 9).alias("spread_250"), F.round(F.get("density_skewness", F.lit(1)), 9).alias("spread_500"))


def described_grid(spark, d) -> DataFrame:
    pts, g = _grid(spark, d)
    labelled = seed_cells(spark, d).select("row", "col", F.lit(1).alias("cluster_id"))
    return grids.described(grids.cell_aggregate(pts, g, "v"), g, labelled).select("row", "col", "centroid_x", "centroid_y", "v", "cluster_id")


def utm_forward(spark, d) -> DataFrame:
    pts = points(spark, d, "events").select("pid", (F.col("x") / 10000.0 + 3.0).alias("lon"), (F.col("y") / 1000.0).alias("lat"))
    east, north = utm("lon", "lat", 31)
    return pts.select("pid", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


def weight_exact(spark, d) -> DataFrame:
    pts = points(spark, d, "events")
    return area_share(pts, R, study_area(pts, R, "bbox")).select("pid", F.round("share", 9).alias("share"))


def weight_cells(spark, d) -> DataFrame:
    pts = points(spark, d, "events")
    area = study_area(points(spark, d, "orders"), R, "cells,min_pts=1", 1000)
    return area_share(pts, R, area).select("pid", F.round("share", 9).alias("share"))


def _weight(variant: str):
    def query(spark, d):
        pts = points(spark, d, "events")
        return shares(pts, [R], study_area(pts, R, "bbox"), variant).select("pid", F.round("_share_0", 9).alias("share"))

    return query


def convex_hull(spark, d) -> DataFrame:
    ring = hull_of(points(spark, d, "events"))
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(ring)], "seq int, x double, y double")


def cluster_cells(spark, d) -> DataFrame:
    found = api.detect_cluster_cells(points(spark, d, "events"), R, "v", study_area="bbox", cell_size=CELL, merge_dist=(None, 2.0 * CELL))
    table = found.clusters[f"v_cluster_sum_{R}"]
    return table.select("cluster_id", F.round("centroid_x", 6).alias("centroid_x"), F.round("centroid_y", 6).alias("centroid_y"), "total", "n_cells", "area")


def _with(*parts: str) -> str:
    return "with recursive " + ", ".join(parts) + " "


def _sql_cells(pts: str = "events_pts", size: int = CELL) -> str:
    return f"cells as (select cast(floor((y - (select min(y) from {pts})) / {float(size)}) as bigint) as row, cast(floor((x - (select min(x) from {pts})) / {float(size)}) as bigint) as col, v from {pts})"


SEEDS = "seeds as (select row, col, cast(sum(v) as bigint) as total from cells group by row, col having bool_or(v % 50 = 0))"
REACH = (
    "reach as (select row, col, row as r0, col as c0 from seeds union select s.row, s.col, a.r0, a.c0 from reach a join seeds s on s.row between a.row - 1 and a.row + 1 and s.col between a.col - 1 and a.col + 1), "
    "parts as (select row, col, min(r0 * 2147483648 + c0) as component from reach group by row, col)"
)


def _cross(x1, y1, x2, y2) -> str:
    return f"cast(((cast({y1} as double) > y) <> (cast({y2} as double) > y)) and x < cast({x2 - x1} as double) * (y - cast({y1} as double)) / cast({y2 - y1} as double) + cast({x1} as double) as int)"


def _utm_sql() -> str:
    from radspark.functions.geometry import EASTING, FLATTENING, K0, _series

    a, alpha, _ = _series()
    e = (FLATTENING * (2 - FLATTENING)) ** 0.5
    east = " + ".join(["eta", *(f"{c!r}::double * cos({2.0 * j}::double * xi) * sinh({2.0 * j}::double * eta)" for j, c in enumerate(alpha, 1))])
    up = " + ".join(["xi", *(f"{c!r}::double * sin({2.0 * j}::double * xi) * cosh({2.0 * j}::double * eta)" for j, c in enumerate(alpha, 1))])
    return _with(
        EVENTS,
        "deg as (select pid, radians(cast(y as double) / 1000.0) as phi, radians(cast(x as double) / 10000.0 + 3.0 - 3.0) as lam from events_pts)",
        f"conf as (select pid, lam, sinh(atanh(sin(phi)) - {e!r}::double * atanh({e!r}::double * sin(phi))) as t from deg)",
        "ab as (select pid, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1.0 + t * t)) as eta from conf)",
    ) + f"select pid, round({EASTING}::double + {K0 * a!r}::double * ({east}), 3) as east, round({K0 * a!r}::double * ({up}), 3) as north from ab"


#: Share of a disk inside a box around its centre: segments beyond each side, less the corners beyond two of them.
BOX_SHARE = (
    "box as (select min(x) as a, max(x) as c, min(y) as b, max(y) as d from events_pts), "
    "sides as (select pid, r, least(r, x - a)::double as h1, least(r, y - b)::double as h2, least(r, c - x)::double as h3, least(r, d - y)::double as h4 from events_pts, box, (values (250), (500)) t(r)), "
    "cut as (select pid, r, "
    + " + ".join(f"r * r * acos({h} / r) - {h} * sqrt(r * r - {h} * {h})" for h in ("h1", "h2", "h3", "h4"))
    + " as segments, "
    + " + ".join(
        f"case when {p} * {p} + {q} * {q} < r * r then (sqrt(r * r - {q} * {q}) * {q} + r * r * asin(sqrt(r * r - {q} * {q}) / r) - {p} * sqrt(r * r - {p} * {p}) - r * r * asin({p} / r)) / 2 - {q} * (sqrt(r * r - {q} * {q}) - {p}) else 0 end"
        for p, q in (("h1", "h2"), ("h2", "h3"), ("h3", "h4"), ("h4", "h1"))
    )
    + " as corners from sides), "
    "shares as (select pid, r, 1 - (segments - corners) / (pi() * r * r) as share from cut)"
)


def _weight_sql(lost: str) -> str:
    """The valid share of each cell of size r / 2 around the box; q and b by spacing over radius, 0.5."""
    s, n = R // 2, "(select min(x) as a, max(x) as c, min(y) as b, max(y) as d from events_pts)"
    span = f"greatest(0.0::double, least({{1}}::double, {{0}} + k * {s} + {s}) - greatest({{0}}::double, {{0}} + k * {s})) as part, {{0}} + (k + 0.5::double) * {s} as mid, k"
    line = lambda lo, hi: f"select {span.format(lo, hi)} from box, unnest(range(-3, cast(floor(({hi} - {lo}) / {s}.0) as bigint) + 4)) t(k)"
    return _with(
        EVENTS,
        f"box as {n}",
        f"cells as (select w.mid as mx, h.mid as my, w.part * h.part / {s * s}.0::double as valid from ({line('a', 'c')}) w, ({line('b', 'd')}) h where w.part * h.part / {s * s}.0::double < 1)",
        "k as (select 1 / (0.70628102::double + exp(0.57266908::double * -1.5)) as q, 1 / (-0.21443453::double + exp(0.76899004::double * -1.5)) as b, (select avg(valid) from cells where valid > 0) as border, (select avg(valid) from cells) as every)",
        f"met as (select pid, abs(x - mx) as dx, abs(y - my) as dy, {lost} as lost, q, b from events_pts, cells, k)",
        f"touched as (select *, power(dx + {s / 2}, 2) + power(dy + {s / 2}, 2) <= {R * R} as held, 1 - 1 / (1 + q * exp(-b * (sqrt(dx * dx + dy * dy) / {R} - 1))) as soft from met where power(greatest(dx - {s / 2}, 0), 2) + power(greatest(dy - {s / 2}, 0), 2) <= {R * R})",
        f"bad as (select pid, sum(lost * case when held then 1 else soft end * {s * s}) as bad from touched group by pid)",
    ) + f"select pid, round(greatest(0.0::double, 1 - coalesce(bad, 0) / (pi() * {R * R})), 9) as share from events_pts left join bad using (pid)"


#: Part of a disk left of u and below v of its centre, both between -r and r. A cell's part comes from its four corners.
_QUADRANT = (
    "case when u <= -r or v <= -r then 0 when u * u + v * v < r * r then u * v + (u * sqrt(r * r - u * u) + r * r * asin(u / r) + v * sqrt(r * r - v * v) + r * r * asin(v / r)) / 2 + pi() * r * r / 4 "
    "when u <= 0 and v <= 0 then 0 when u > 0 and v > 0 then pi() * r * r - (case when u < r then r * r * acos(u / r) - u * sqrt(r * r - u * u) else 0 end) - (case when v < r then r * r * acos(v / r) - v * sqrt(r * r - v * v) else 0 end) "
    "when u <= 0 then r * r * acos(-u / r) + u * sqrt(r * r - u * u) else r * r * acos(-v / r) + v * sqrt(r * r - v * v) end"
)


def _weight_cells_sql() -> str:
    corner = f"corner as (select pid, row, col, sign, {_QUADRANT} as part from (select pid, row, col, sign, {R}::double as r, least({R}::double, greatest(-{R}::double, u)) as u, least({R}::double, greatest(-{R}::double, v)) as v from spots) t)"
    return _with(
        EVENTS, ORDERS,
        "o as (select min(x) as x0, min(y) as y0 from orders_pts)",
        "cells as (select distinct cast(floor((x - x0) / 1000.0::double) as bigint) as col, cast(floor((y - y0) / 1000.0::double) as bigint) as row from orders_pts, o)",
        "own as (select pid, x, y, x0, y0, cast(floor((x - x0) / 1000.0::double) as bigint) as c0, cast(floor((y - y0) / 1000.0::double) as bigint) as r0 from events_pts, o)",
        "met as (select pid, row, col, x0 + col * 1000 - x as u0, y0 + row * 1000 - y as v0 from own, (values (-1), (0), (1)) i(i), (values (-1), (0), (1)) j(j), cells where row = r0 + i and col = c0 + j)",
        "spots as (select pid, row, col, k.sign, (u0 + 1000 * k.a)::double as u, (v0 + 1000 * k.b)::double as v from met, (values (0, 0, 1), (1, 0, -1), (0, 1, -1), (1, 1, 1)) k(a, b, sign))",
        corner,
    ) + f"select e.pid, round(least(1.0::double, greatest(0.0::double, coalesce(sum(sign * part), 0) / (pi() * {R * R}))), 9) as share from events_pts e left join corner using (pid) group by e.pid"


#: A point is a corner of the upper hull if every slope from its left is over every slope to its right; the lower one mirrors it.
_HULL = (
    "sides as (select x, max(y) as y, 1 as s from events_pts group by x union all select x, min(y) as y, -1 as s from events_pts group by x), "
    "slopes as (select p.s, p.x, p.y, min(p.s * (p.y - q.y)::double / (p.x - q.x)) filter (q.x < p.x) as before, max(p.s * (q.y - p.y)::double / (q.x - p.x)) filter (q.x > p.x) as after from sides p join sides q on p.s = q.s group by p.s, p.x, p.y), "
    "corners as (select s, x, y from slopes where before is null or after is null or before > after), "
    "ordered as (select x, y, min(case when s < 0 then 0 else 1 end) as part from corners group by x, y)"
)

#: Clusters of flagged cells: queen components, those with a twentieth of the largest cell's total, joined where borders are within two
#: cells (a rule without centroids, so merges are components of components), and free cells with a centre strictly inside the hull.
_CLUSTERS = (
    "ev as (select pid, v, cast(floor((y - (select min(y) from events_pts)) / 166::double) as bigint) as row, cast(floor((x - (select min(x) from events_pts)) / 166::double) as bigint) as col from events_pts), "
    "cells as (select row, col, cast(sum(v) as bigint) as total, bool_or(flag) as flag from ev join flags using (pid) group by row, col), "
    "seeds as (select row, col, total from cells where flag), "
    "{reach}, "
    "sums as (select component from parts join seeds using (row, col) group by component having sum(total) >= 0.05 * (select max(total) from seeds)), "
    "held as (select row, col, component, total from parts join seeds using (row, col) where component in (select component from sums)), "
    "near as (select distinct p.component as a, q.component as b from held p join held q on abs(p.row - q.row) <= 3 and abs(p.col - q.col) <= 3 where power(greatest(abs(p.row - q.row) - 1, 0), 2) + power(greatest(abs(p.col - q.col) - 1, 0), 2) <= 4), "
    "linked as (select a, b from near union select l.a, n.b from linked l join near n on n.a = l.b), "
    "named as (select row, col, total, least as cluster from held join (select a, min(b) as least from linked group by a) t on t.a = component), "
    "ranked as (select cluster, sum(total) as total, count(*) as n, avg(row + 0.5::double) as cy, avg(col + 0.5::double) as cx, row_number() over (order by sum(total) desc, count(*) desc, min((row, col))) as rank from named group by cluster), "
    "corners as (select cluster, row + i as x, min(col) as low, max(col) + 1 as high from named, (values (0), (1)) t(i) group by cluster, row + i), "
    "spans as (select l.cluster, m.x + 0.5::double as x, max((l.high * (r.x - m.x - 0.5::double) + r.high * (m.x + 0.5::double - l.x)) / (r.x - l.x)) as top, min((l.low * (r.x - m.x - 0.5::double) + r.low * (m.x + 0.5::double - l.x)) / (r.x - l.x)) as bottom "
    "from corners l join corners r on r.cluster = l.cluster and l.x < r.x join (select cluster, unnest(range(min(x), max(x))) as x from corners group by cluster) m on m.cluster = l.cluster and l.x <= m.x and r.x > m.x group by l.cluster, m.x), "
    "inside as (select cluster, cast(floor(x) as bigint) as row, unnest(range(cast(floor(bottom) as bigint) - 1, cast(ceil(top) as bigint) + 1)) as col, top, bottom from spans), "
    "filled as (select row, col, arg_min(cluster, rank) as cluster from inside join ranked using (cluster) where col + 0.5::double > bottom + 1e-9 and col + 0.5::double < top - 1e-9 and not exists (select 1 from named n where n.row = inside.row and n.col = inside.col) group by row, col), "
    "every as (select row, col, cluster, total from named union all select f.row, f.col, f.cluster, coalesce(c.total, 0) from filled f left join cells c on c.row = f.row and c.col = f.col), "
    "final as (select cluster, sum(total) as total, count(*) as n, min((row, col)) as first from every group by cluster)"
)


def queries() -> dict:
    found = {f"radius_{s}": _stat(s) for s in STATS}
    found |= {
        "radius_multi_stat": multi_stat, "radius_two_columns": two_columns, "radius_exclude_self": exclude_self, "radius_source_target": source_target,
        "radius_list": radius_list, "radius_bands": radius_bands, "radius_wbands": radius_wbands, "radius_r0": radius_r0,
        "cells_sum": _cells("sum"), "cells_mean": _cells("mean"), "cells_count": _cells("count"), "aggregate_to_grid_median": grid_median,
        "sparse_grid": sparse_grid, "full_grid": full_grid, "null_thresholds": null_thresholds, "detect_pts": detect_pts, "detect_pts_bands": detect_pts_bands,
        "detect_default": detect_default, "detect_weighted": detect_weighted, "radius_weighted": radius_weighted, "radius_target_exclude_self": radius_target_exclude_self, "weight_cells": weight_cells,
        "study_bbox": study_bbox, "study_cells_members": study_cells_members, "study_buffer_points": study_buffer_points, "polygon_filter": polygon_filter,
        "seed_cells": seed_cells, "contiguity_components": contiguity_components, "cluster_table": cluster_table, "spatial_stats": spatial_stats, "spatial_summary": spatial_summary, "described_grid": described_grid,
        "utm_forward": utm_forward, "weight_exact": weight_exact, "weight_binary": _weight("binary"), "weight_flat": _weight("flat"), "weight_logit": _weight("logit"), "convex_hull": convex_hull, "cluster_cells": cluster_cells,
    }
    return found


def oracle_sql() -> dict[str, str]:
    near = _with(EVENTS, pairs(), SUMS, MOMENTS)
    found = {f"radius_{s}": near + f"select pid, {f} as v_{STATS[s]}_{R} from central" for s, f in FORMULAS.items()}
    left = "select e.pid, coalesce(cast(sum(n.v) as bigint), 0) as"
    at = lambda r: f"cast(coalesce(sum(v) filter (d2 <= {r * r}), 0) as bigint)"
    null = _with(EVENTS, NULLS, pairs("nulls"))
    null_sums = null + ", at_null as (select n.pid, {} from nulls n left join near using (pid) group by n.pid) "
    seen_sum = f", real_near as (select s.pid, sum(t.v) - s.v as a from events_pts s join events_pts t on t.x between s.x - {R} and s.x + {R} and (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) <= {R * R} group by s.pid, s.v) select pid, cast(a as bigint) as v_sum_{R}, a > (select quantile_cont(cast(v as double), 0.995) from at_null) as v_cluster_sum_{R} from real_near"
    found |= {
        "radius_multi_stat": near + f"select pid, s1 as v_sum_{R}, m1 as v_avg_{R}, m2 as v_var_{R} from central",
        "radius_two_columns": _with(EVENTS) + f"select s.pid, cast(sum(t.v) as bigint) as v_sum_{R}, cast(sum(t.x % 10) as bigint) as w_sum_{R} from events_pts s join events_pts t on t.x between s.x - {R} and s.x + {R} and (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) <= {R * R} group by s.pid",
        "radius_exclude_self": near + f"select c.pid, c.s1 - e.v as v_sum_{R}, c.n - 1 as v_cnt_{R} from central c join events_pts e using (pid)",
        "radius_source_target": _with(EVENTS, ORDERS, pairs("events_pts", "orders_pts")) + f"{left} v_sum_{R} from events_pts e left join near n using (pid) group by e.pid",
        "radius_list": _with(EVENTS, pairs()) + f"select pid, {at(250)} as v_sum_250, {at(500)} as v_sum_500 from near group by pid",
        "radius_bands": _with(EVENTS, pairs()) + f"select pid, {at(250)} as v_sum_0_250, {at(500)} - {at(250)} as v_sum_250_500 from near group by pid",
        "radius_wbands": _with(EVENTS, pairs()) + f"select pid, 0.75::double * {at(250)} + 0.25::double * ({at(500)} - {at(250)}) as v_sum_wgt from near group by pid",
        "radius_r0": _with(PART) + "select pid, cast(sum(v) over (partition by x, y) as bigint) as v_sum_0 from part_pts",
        "cells_sum": _with(EVENTS, _sql_cells()) + "select row, col, cast(sum(v) as bigint) as v from cells group by row, col",
        "cells_mean": _with(EVENTS, _sql_cells()) + "select row, col, cast(sum(v) as double) / count(*) as v from cells group by row, col",
        "cells_count": _with(EVENTS, _sql_cells()) + "select row, col, count(v) as v from cells group by row, col",
        "aggregate_to_grid_median": _with(EVENTS, _sql_cells()) + "select col as cell_col, row as cell_row, quantile_cont(cast(v as double), 0.5) as v from cells group by row, col",
        "full_grid": _with(EVENTS, _sql_cells(size=1000)) + "select r.i as row, c.i as col, coalesce((s.v), 0) as v from range((select max(row) + 1 from cells)) r(i) cross join range((select max(col) + 1 from cells)) c(i) left join (select row, col, cast(sum(v) as bigint) as v from cells group by row, col) s on s.row = r.i and s.col = c.i",
        "sparse_grid": _with(EVENTS, _sql_cells(), SEEDS) + "select c.row, c.col, cast(sum(c.v) as bigint) as v, cast(count(s.row) > 0 as int) as cluster_id from cells c left join seeds s on s.row = c.row and s.col = c.col group by c.row, c.col",
        "seed_cells": _with(EVENTS, _sql_cells(), SEEDS) + "select row, col, total from seeds",
        "contiguity_components": _with(EVENTS, _sql_cells(), SEEDS, REACH) + "select row, col, component from parts",
        "cluster_table": _with(EVENTS, _sql_cells(), SEEDS, REACH) + "select component, cast(sum(total) as bigint) as total, count(*) as n_cells from parts join seeds using (row, col) group by component having sum(total) >= 0.5 * (select max(total) from seeds)",
        "null_thresholds": null_sums.format(f"{at(500)} as v") + "select quantile_cont(cast(v as double), 0.995) as threshold from at_null",
        "detect_pts": null_sums.format(f"{at(500)} as v") + seen_sum,
        "detect_pts_bands": null_sums.format(f"{at(250)} as a, {at(500)} - {at(250)} as b") + f", {pairs(name='real_near')}, seen as (select pid, {at(250)} as a, {at(500)} - {at(250)} as b from real_near group by pid) select pid, a > (select quantile_cont(cast(a as double), 0.995) from at_null) as v_sum_0_250_cluster, b > (select quantile_cont(cast(b as double), 0.995) from at_null) as v_sum_250_500_cluster from seen",
        "study_bbox": _with(EVENTS, ORDERS) + "select pid from events_pts where x between (select min(x) - 100 from orders_pts) and (select max(x) + 100 from orders_pts) and y between (select min(y) - 100 from orders_pts) and (select max(y) + 100 from orders_pts)",
        "study_cells_members": _with(EVENTS, ORDERS, "o as (select min(x) as x0, min(y) as y0 from orders_pts)", f"full_cells as (select floor((x - x0) / {float(CELL)}) as c, floor((y - y0) / {float(CELL)}) as r from orders_pts, o group by 1, 2 having count(*) >= 2)") + f"select pid from events_pts, o where exists (select 1 from full_cells where c = floor((x - x0) / {float(CELL)}) and r = floor((y - y0) / {float(CELL)}))",
        "study_buffer_points": _with(EVENTS, ORDERS, pairs("events_pts", "orders_pts", 60)) + "select distinct pid from near",
        "polygon_filter": _with(EVENTS) + "select pid from events_pts where (" + " + ".join(_cross(*p, *q) for p, q in zip(RING, [*RING[1:], RING[0]], strict=True)) + ") % 2 = 1",
        "spatial_stats": _with(EVENTS, _sql_cells(size=1000), "n as (select count(*) as n from cells group by row, col)") + "select (select count(*) from events_pts) as n_points, (select min(x) from events_pts) as xmin, (select max(x) from events_pts) as xmax, (select min(y) from events_pts) as ymin, (select max(y) from events_pts) as ymax, count(*) as n_cells, quantile_cont(cast(n as double), 0.9) as p90, max(n) as most from n",
        "spatial_summary": _with(EVENTS, "b as (select min(x) as a, min(y) as b, max(x) - min(x) as w, max(y) - min(y) as h, count(*) as n from events_pts)")
        + "select n as n_points, w::double as width, h::double as height, w::double / h as aspect_ratio, most * 64.0::double / n as density_max_to_mean, most as most_points, round(p250, 9) as spread_250, round(p500, 9) as spread_500 from b, "
        + "(select max(c) as most from (select count(*) as c from events_pts, b group by least(7, floor((x - a)::double / w * 8)), least(7, floor((y - b)::double / h * 8)))), "
        + ", ".join(
            f"(select quantile_cont(c::double, 0.9) * any_value(k * l) / any_value(n) as p{r} from (select count(*) as c, any_value(k) as k, any_value(l) as l, any_value(n) as n from events_pts, (select *, greatest(floor(w / {2 * r}.0), 1) as k, greatest(floor(h / {2 * r}.0), 1) as l from b) t group by least(k - 1, floor((x - a)::double / w * k)), least(l - 1, floor((y - b)::double / h * l))))"
            for r in (250, 500)
        ),
        "described_grid": _with(EVENTS, _sql_cells(), SEEDS, "o as (select min(x) as x0, min(y) as y0 from events_pts)") + f"select c.row, c.col, any_value(x0) + (c.col + 0.5::double) * {CELL} as centroid_x, any_value(y0) + (c.row + 0.5::double) * {CELL} as centroid_y, cast(sum(c.v) as bigint) as v, cast(count(s.row) > 0 as int) as cluster_id from o, cells c left join seeds s on s.row = c.row and s.col = c.col group by c.row, c.col",
        "utm_forward": _utm_sql(),
        "weight_binary": _weight_sql("1 - every"),
        "weight_flat": _weight_sql("case when valid > 0 then 1 - border else 1 end"),
        "weight_logit": _weight_sql("1 - valid"),
        "weight_exact": _with(EVENTS, BOX_SHARE) + f"select pid, round(share, 9) as share from shares where r = {R}",
        "weight_cells": _weight_cells_sql(),
        "convex_hull": _with(EVENTS, _HULL) + "select cast(row_number() over (order by part, case when part = 0 then x else -x end, y) - 1 as int) as seq, x::double as x, y::double as y from ordered",
        "cluster_cells": null_sums.format(f"{at(500)} as v") + seen_sum.replace("select pid, cast(a as bigint) as v_sum_500, a >", "flags as (select pid, a >").replace("group by s.pid, s.v) flags", "group by s.pid, s.v), flags").replace("as v_cluster_sum_500 from real_near", "as flag from real_near), ")
        + _CLUSTERS.format(reach=REACH).replace(" near ", " close ").replace("near as", "close as") + " select cast(row_number() over (order by f.total desc, f.first) as int) as cluster_id, round((select min(x) from events_pts) + cx * 166, 6) as centroid_x, round((select min(y) from events_pts) + cy * 166, 6) as centroid_y, f.total::double as total, cast(f.n as int) as n_cells, f.n * 27556::double as area from final f join ranked using (cluster)",
        "detect_default": _with(EVENTS, NULLS_IN_CELLS, pairs("nulls")) + ", at_null as (select n.pid, " + at(500) + " as v from nulls n left join near using (pid) group by n.pid) " + seen_sum,
        "detect_weighted": _with(EVENTS, pairs(), BOX_SHARE) + f"select pid, round((count(*) - 1) / any_value(share), 6) as weighted from near join shares using (pid) where r = {R} group by pid",
        "radius_weighted": _with(EVENTS, pairs(), BOX_SHARE) + ", s as (select pid, any_value(share) filter (r = 250) as a, any_value(share) filter (r = 500) as b from shares group by pid), t as (select pid, " + f"{at(250)} as v1, {at(500)} as v2, count(*) filter (d2 <= 62500) as n1, count(*) as n2 from near group by pid) select pid, round(v1 / a, 5) as v_sum_250, round(v2 / b, 5) as v_sum_500, round(v1 / n1, 5) as v_avg_250, round(v2 / n2, 5) as v_avg_500 from t join s using (pid)",
        "radius_target_exclude_self": _with(EVENTS, pairs()) + f"select e.pid, cast(sum(n.v) - any_value(e.v) as bigint) as v_sum_{R} from events_pts e join near n using (pid) where e.pid % 3 = 0 group by e.pid",
    }
    return found
