"""Study areas, area weights, detection, coordinates and exports against brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from radspark import api
from radspark.functions.geometry import Strips, _cross, clipped_area, concave_hull, edges_of, polygons, ring_area, rings_share
from radspark.operators import clusters, detect, radius, raster, strips
from radspark.operators.study_area import cell_share, diagnostics, frame_cells, parse_weight, polygon_area, shares, study_area
from radspark.plans import grid as grids
from radspark.plans import storage
from radspark.plans.components import connected_components
from radspark.sources.points import random_points

rng = random.Random(8)
HOLED = {"type": "MultiPolygon", "coordinates": [[[(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)], [(40, 40), (60, 40), (60, 60), (40, 60)]], [[(150, 0), (200, 0), (200, 50)]]]}


def frame(spark, rows, kind="pid bigint, x double, y double, v bigint"):
    return spark.createDataFrame(rows, kind)


def in_holed(x, y):
    return 0 <= x < 100 and 0 <= y < 100 and not (40 < x < 60 and 40 < y < 60) or 150 < x < 200 and 0 < y < x - 150


@pytest.fixture(scope="module")
def pts(spark):
    rows = [(i, rng.uniform(-20, 220), rng.uniform(-20, 120), rng.randrange(1, 9)) for i in range(200)]
    return frame(spark, rows).repartition(3)


def lattice_share(x, y, r, inside, n=160):
    """Share of a disk by a fine lattice."""
    t = (np.arange(n) + 0.5) / n * 2 - 1
    p, q = np.meshgrid(t, t)
    ok = p * p + q * q <= 1
    return np.mean([inside(x + r * a, y + r * b) for a, b in zip(p[ok], q[ok], strict=True)])


def test_rings_with_holes_and_parts(spark, pts):
    rings = polygons(HOLED)
    assert [ring_area(r) > 0 for r in rings] == [True, False, True] and sum(map(ring_area, rings)) == 100 * 100 - 400 + 1250
    area = polygon_area(HOLED)
    rows = {r.pid: r for r in pts.collect()}
    want = {i for i, r in rows.items() if in_holed(r.x, r.y)}
    assert {r.pid for r in area.inside(pts).collect()} == want and {r.pid for r in area.keep(pts, False).collect()} == set(rows) - want
    many = {"type": "Polygon", "coordinates": [[(50 + 40 * math.cos(k / 300 * 2 * math.pi), 50 + 40 * math.sin(k / 300 * 2 * math.pi)) for k in range(300)]]}
    assert {r.pid for r in polygon_area(many).inside(pts).collect()} == {i for i, r in rows.items() if math.dist((r.x, r.y), (50, 50)) < 39.99}
    g = np.random.default_rng(0)
    x, y = g.uniform(-20, 220, 500), g.uniform(-20, 120, 500)
    assert Strips(edges_of(rings)).inside(x, y).tolist() == [in_holed(a, b) for a, b in zip(x, y, strict=True)]
    got = {r.pid: r.share for r in api.area_share(pts, 15, area).collect()}
    for i, r in list(rows.items())[:60]:
        assert got[i] == pytest.approx(lattice_share(r.x, r.y, 15, in_holed), abs=0.01)
    less = area.minus(polygon_area([(0, 0), (50, 0), (50, 100), (0, 100)]))
    assert {r.pid for r in less.inside(pts).collect()} == {i for i in want if rows[i].x > 50}
    assert clipped_area(rings[0], 50, 50, 150, 150) == 2500


def test_shares_of_cells_and_approximations(spark, pts):
    area = study_area(pts, 30, "cells,min_pts=2", 20)
    grid, cells = area.cells
    have = {(r.row, r.col) for r in cells.collect()}
    inside = lambda x, y: (math.floor((y - grid.ymin) / 20), math.floor((x - grid.xmin) / 20)) in have
    rows = {r.pid: r for r in pts.collect()}
    got = {r.pid: r for r in shares(pts, [10, 30], area, "exact").collect()}
    assert set(got) == set(rows)
    for i, r in list(rows.items())[:40]:
        assert got[i]["_share_0"] == pytest.approx(lattice_share(r.x, r.y, 10, inside), abs=0.01)
        assert got[i]["_share_1"] == pytest.approx(lattice_share(r.x, r.y, 30, inside), abs=0.01)
    for spot in (area, polygon_area(HOLED)):
        own = grids.build_grid(pts, 15)
        valid = frame_cells(spark, spot, own, 30)
        f = inside if spot is area else in_holed
        for c in valid.orderBy(F.xxhash64("row", "col")).limit(40).collect():
            x, y = own.xmin + c.col * 15, own.ymin + c.row * 15
            t = (np.arange(60) + 0.5) / 60 * 15
            assert c.valid == pytest.approx(np.mean([f(x + a, y + b) for a in t for b in t]), abs=0.03)
        exact = {r.pid: r["_share_0"] for r in shares(pts, [30], spot, "exact").collect()}
        for variant, most in (("logit", 0.2), ("flat", 0.4), ("binary", 0.6)):
            near = {r.pid: r.share for r in cell_share(pts, 30, valid, own, variant).collect()}
            assert max(abs(near[i] - exact[i]) for i in exact) < most, variant
    told = diagnostics(shares(pts, [30], area, "exact"), "_share_0").first()
    assert told.n_points == 200 and 0 <= told.valid_area_share_min <= told.valid_area_share_mean <= 1


def test_weights_of_the_search(spark, pts):
    assert parse_weight("precise,keep_raw") == ("exact", None, True) and parse_weight("logit=0.5") == ("logit", 0.5, False) and parse_weight(None)[0] is None
    with pytest.warns(UserWarning):
        assert parse_weight("wrong")[0] is None
    got = api.radius_search(pts, [1, 15], "v", ["count", "mean"], area_weight="exact,keep_raw", study_area=HOLED).collect()
    plain = {r.pid: r for r in api.radius_search(pts, [1, 15], "v", ["count", "mean"]).collect()}
    for r in got:
        for d in (1, 15):
            share = r[f"valid_area_share_{d}"]
            assert r[f"v_cnt_{d}_raw"] == plain[r.pid][f"v_cnt_{d}"]
            if share > 0:
                assert r[f"v_cnt_{d}"] == pytest.approx(plain[r.pid][f"v_cnt_{d}"] / share) and r[f"v_avg_{d}"] == pytest.approx(plain[r.pid][f"v_avg_{d}"])
    for spec in ("cells,min_pts=1", "convex", "convex,buffer=5", "bounding_box", "grid", None, False):
        assert api.radius_search(pts, 15, "v", area_weight="logit", study_area=spec).count() == 200
    with pytest.raises(ValueError):
        api.radius_search(pts, 15, "v", area_weight="exact", study_area="buffer")


def test_buffers(spark, pts):
    probe = frame(spark, [(1, 0.0, 0.0, 1), (1, 500.0, 0.0, 1), (2, 3.0, 4.0, 1)])  # the first column is no key
    place = frame(spark, [(9, 0.0, 0.0, 1)])
    assert sorted((r.x, r.y) for r in study_area(place, 5, "buff_pts,buffer=5").inside(probe).collect()) == [(0, 0), (3, 4)]
    assert [(r.x, r.y) for r in study_area(place, 5, "buff_pts,buffer=0").inside(probe).collect()] == [(0, 0)]
    assert sorted((r.x, r.y) for r in study_area(place, 5, "buff_pts,buffer=5").keep(probe, False).collect()) == [(500, 0)]
    inside = study_area(pts, 30, "cells,min_pts=2,buffer=7", 20)
    rows = pts.collect()
    grid = grids.build_grid(pts, 20)
    count = {}
    for r in rows:
        k = math.floor((r.y - grid.ymin) / 20), math.floor((r.x - grid.xmin) / 20)
        count[k] = count.get(k, 0) + 1
    gap = lambda at, low: max(0, low - at, at - low - 20)
    want = {r.pid for r in rows if any(n > 1 and math.hypot(gap(r.x, grid.xmin + c * 20), gap(r.y, grid.ymin + q * 20)) <= 7 for (q, c), n in count.items())}
    assert {r.pid for r in inside.inside(pts).collect()} == want
    hull = study_area(pts, 30, "convex,buffer=4")
    assert hull.inside(pts).count() == 200


def test_draws_do_not_depend_on_partitions(spark, pts):
    area = polygon_area(HOLED)
    a = [tuple(r) for r in random_points(spark, 300, area, 5).collect()]
    assert len(a) == 300 and all(in_holed(x, y) for _, x, y in a)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(a) == sorted(tuple(r) for r in random_points(spark, 300, area, 5).repartition(5).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a != [tuple(r) for r in random_points(spark, 300, area, 6).collect()]
    line = random_points(spark, 50, area, 1, lambda n, g: np.stack((g.uniform(0, 100, n), np.full(n, 10.0)), 1)).collect()
    assert len(line) == 50 and all(r.y == 10 for r in line)


def test_detection_in_one_call(spark, pts):
    found = detect.detect(pts, 20, "v", null_distribution=500, random_seed=3)
    null = [r.v_sum_20 for r in found.null.collect()]
    threshold = found.thresholds.first()
    assert len(null) == 500 and threshold.threshold == pytest.approx(np.percentile(null, 99.5)) and threshold.k == 99.5
    rows = {r.pid: r for r in pts.collect()}
    for r in found.points.collect():
        want = sum(q.v for q in rows.values() if math.dist((r.x, r.y), (q.x, q.y)) <= 20 and q.pid != r.pid)
        assert r.v_sum_20 == want and r.v_cluster_sum_20 == (want > threshold.threshold)
    assert detect.distribution(found, "v_sum_20").groupBy("kind").agg(F.max("share").alias("m")).select(F.min("m")).first()[0] == 1.0
    some = api.detect_cluster_pts(pts, [(0, 10), (10, 20)], ["v"], null_distribution=200, area_weight="exact", study_area=HOLED, keep_cols=False)
    assert [c for c in some.columns if c not in pts.columns] == ["v_sum_0_10_cluster", "v_sum_10_20_cluster"]
    table = frame(spark, [(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    assert api.detect_cluster_pts(pts, 20, [], null_distribution=table, k=50).count() == 200
    got = api.detect_cluster_cells(pts, [20, 40], ["v"], null_distribution=200, k=[50, 60], cell_size=10)
    assert set(got.clusters) == {"v_sum_20_cluster", "v_sum_40_cluster"} and {"v_sum_20_cluster_id", "v_sum_40_cluster_id"} <= set(got.points.columns)
    assert {r.k for r in got.thresholds.collect()} == {50.0, 60.0}
    for bad in (0, 100):
        with pytest.raises(ValueError):
            api.detect_cluster_pts(pts, 20, "v", null_distribution=20, k=bad)


def test_degrees(spark):
    df = spark.createDataFrame([(1, 3.0, 50.0, 1), (2, 3.001, 50.0, 2), (3, 3.2, 50.1, 4)], "pid bigint, lon double, lat double, v bigint")
    got = {r.pid: r.v_sum_100 for r in api.radius_search(df, 100, "v", crs="EPSG:4326", x="lon", y="lat").collect()}
    assert got == {1: 3, 2: 3, 3: 4}  # a thousandth of a degree is 71.7 m here
    zone = api.local_zone(df)
    assert (zone.number, zone.epsg) == (31, 32631) and api.local_zone(df, proj_crs="EPSG:32732").north is False
    back = api.unproject(api.project(df, "EPSG:4326", zone=zone), zone, "proj_x", "proj_y").collect()
    assert all(r.proj_x == pytest.approx(r.lon) and r.proj_y == pytest.approx(r.lat) for r in back)
    found = api.detect_cluster_pts(df, 100, "v", crs="EPSG:4326", x="lon", y="lat", null_distribution=50, study_area="bbox")
    assert found.columns == ["pid", "lon", "lat", "v", "v_sum_100", "v_cluster_sum_100"]
    metres = api.project(df, "EPSG:4326").select("pid", "v", F.col("proj_x").alias("e"), F.col("proj_y").alias("n"))
    assert {r.pid: r.v_sum_100 for r in api.radius_search(metres, 100, "v", crs="EPSG:32631", x="e", y="n").collect()} == got
    with pytest.raises(ValueError):
        api.radius_search(df, 5, "v", crs="EPSG:25832", x="lon", y="lat")
    with pytest.raises(ValueError, match="no numbers"):
        api.radius_search(df.withColumn("s", F.lit("x")), 5, "s", x="lon", y="lat")


def test_large_values_nulls_and_own_values(spark):
    big = frame(spark, [(i, float(i % 3), 0.0, 1_000_000 + i) for i in range(9)])
    v = np.array([1_000_000 + i for i in range(9)], float)
    z = (v - v.mean()) / v.std()
    got = api.radius_search(big, 50, "v", ["kurtosis", "variance", "sum"]).first()
    assert got.v_krt_50 == pytest.approx((z**4).mean() - 3, abs=1e-2) and got.v_sum_50 == int(v.sum()) and got.v_var_50 == pytest.approx(v.var(), abs=1e-2)
    huge = frame(spark, [(1, 0.0, 0.0, 1 << 40), (2, 0.0, 0.0, 1 << 41)])
    assert math.isfinite(api.radius_search(huge, 5, "v", "skewness").first().v_skw_5)
    holes = frame(spark, [(1, 0.0, 0.0, None), (2, 1.0, 0.0, 5), (3, 99.0, 0.0, 7), (4, None, 0.0, 7)])
    with pytest.warns(UserWarning, match="nulls"):
        got = {r.pid: r for r in api.radius_search(holes, 5, "v", ["sum", "count"]).collect()}
    assert math.isnan(got[1].v_sum_5) and math.isnan(got[2].v_sum_5) and got[3].v_sum_5 == 7 and got[2].v_cnt_5 == 2 and got[4].v_cnt_5 == 0
    nowhere = frame(spark, [(i, 0.5, 0.5, 1) for i in range(400)] + [(900, float("nan"), 0.5, 50), (901, 0.5, float("nan"), 50)])
    got = {r.pid: r.v_sum_5 for r in api.radius_search(nowhere, 5, "v").collect()}
    assert got[0] == 400 and got[900] == got[901] == 0
    assert radius.columns_with_nan(holes, ["pid", "x", "v"]) == ["x", "v"]
    target = frame(spark, [(1, 0.0, 0.0, 1), (2, 1.0, 0.0, 4), (3, 2.0, 0.0, 5)])
    some = target.where("pid < 3")
    assert {r.pid: r.v_sum_5 for r in api.radius_search(some, 5, "v", pts_target=target, exclude_self=True).collect()} == {1: 9, 2: 6}
    with pytest.warns(UserWarning, match="own values stay"):
        assert api.radius_search(some.withColumn("v", F.lit(3)), 5, "v", pts_target=target, exclude_self=True).first().v_sum_5 == 10
    assert radius.relation(some, target) == "subset" and radius.relation(target, some) == "superset" and radius.relation(target, target) == "equal"
    assert radius.relation(some, some.withColumn("v", F.lit(77))) == "disjoint" and radius.relation(target, some.union(frame(spark, [(8, 0.0, 0.0, 0)]))) == "overlap"


@pytest.mark.parametrize("hot", [200_000, 50])
def test_dense_cells_and_salted_tiles(spark, monkeypatch, hot):
    """Hundreds of points in one spot, far ones, borders, several radii; with tiles of over 50 points dealt out."""
    monkeypatch.setattr(radius, "HOT", hot)
    g = random.Random(2)
    rows = [(i, g.randrange(0, 40), g.randrange(0, 40), g.randrange(9)) for i in range(600)]
    rows += [(1000 + i, g.randrange(-900, 900), g.randrange(-900, 900), 3) for i in range(60)] + [(2000, 500, 500, 1), (2001, 503, 504, 2), (2002, 500, 510, 4)]
    df = spark.createDataFrame(rows, "pid bigint, x bigint, y bigint, v bigint")
    xy, v = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    for r in ([5, 10], [10], [(0, 3), (3, 10)], [0, 10]):
        got = {x.pid: x for x in api.radius_search(df, r, "v", "sum").collect()}
        for i, p in enumerate(rows):
            for item in r:
                a, b = item if isinstance(item, tuple) else (0, item)
                name = f"v_sum_{a}_{b}" if isinstance(item, tuple) else f"v_sum_{b}"
                want = v[d2[i] <= b * b].sum() - (v[d2[i] <= a * a].sum() if a else 0)
                assert got[p[0]][name] == want, (r, p, item)


def test_joins_stay_inside_tiles(spark):
    df = spark.range(2000).select(F.col("id").alias("pid"), (F.col("id") * 37 % 1000).alias("x"), (F.col("id") * 91 % 1000).alias("y"), F.lit(1).cast("long").alias("v"))
    found = api.radius_search(df, 100, "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL") and "ShuffledHashJoin" in plan


def greedy(groups, rules, size):
    """The definition in plain Python: the first mergeable pair in order merges, again and again."""
    parts = [[dict(g), sum(g.values()), [sum(k[i] + 0.5 for k in g) / len(g) for i in (0, 1)]] for g in groups]
    while True:
        parts.sort(key=lambda c: (-c[1], -len(c[0]), min(c[0])))
        for i, j in ((i, j) for i in range(len(parts)) for j in range(i + 1, len(parts))):
            a, b = parts[i], parts[j]
            gap = min(math.hypot(*(max(abs(p - q) - 1, 0) for p, q in zip(x, y, strict=True))) for x in a[0] for y in b[0]) * size
            if any((c is None or math.dist(a[2], b[2]) * size <= c) and (e is None or gap <= e) for c, e in rules if (c, e) != (None, None)):
                n, m = len(a[0]), len(b[0])
                a[2] = [(p * n + q * m) / (n + m) for p, q in zip(a[2], b[2], strict=True)]
                a[0].update(b[0])
                a[1] += b[1]
                del parts[j]
                break
        else:
            return [sorted(p[0]) for p in parts]


@pytest.mark.parametrize("rules", [[(None, 20.0)], [(45.0, None)], [(30.0, 10.0), (None, 0.0)], [(60.0, 20.0)], [(25.0, None), (80.0, 30.0)], [(None, None)]])
def test_merges_match_the_definition(rules):
    g = random.Random(str(rules))
    for _ in range(8):
        cells = g.sample([(r, c) for r in range(30) for c in range(30)], 70)
        groups, left = [], set(cells)
        while left:  # queen components
            part, queue = set(), [left.pop()]
            while queue:
                r, c = queue.pop()
                part.add((r, c))
                near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                queue += near
            groups.append({k: g.randrange(1, 6) for k in part})
        found = clusters.merge_by_distance([clusters._Cluster(x, sum(x.values())) for x in groups], rules, 10.0)
        assert [sorted(k.cells) for k in found] == greedy(groups, rules, 10.0)


def test_outlines_and_exports(spark, tmp_path):
    ring = {(r, c) for r in range(3) for c in range(3)} - {(1, 1)}
    polygons_of = clusters.rings_of(ring | {(3, 3), (10, 10)})
    assert sorted(len(p) for p in polygons_of) == [1, 1, 2]
    pinched = clusters.rings_of({(0, 0), (0, 1), (1, 0), (2, 1), (1, 2), (2, 2), (0, 2), (2, 0)})
    assert sum(ring_area(np.array(r)) for p in pinched for r in p) == 8
    for _ in range(20):
        cells = set(rng.sample([(r, c) for r in range(7) for c in range(7)], 25))
        found = clusters.rings_of(cells)
        rings = [np.array(r, float) for p in found for r in p]
        assert sum(map(ring_area, rings)) == 25 and all(len(set(r)) == len(r) for p in found for r in p)
        middle = [(r, c) for r in range(7) for c in range(7)]
        assert set(map(tuple, np.array(middle)[Strips(edges_of(rings)).inside([c + 0.5 for _, c in middle], [r + 0.5 for r, _ in middle])].tolist())) == cells
        for p in found:  # a hole lies in its own polygon
            assert all(ring_area(np.array(h)) < 0 for h in p[1:]) and rings_share([0], [0], 1, [np.array(p[0], float) * 100])[0] >= 0
    grid = grids.Grid(0, 0, 10, 20, 20)
    df = spark.createDataFrame([(1, clusters.outline(ring, grid), None), (2, "POLYGON ((0 0, 1e2 0, 5 -5.5, 0 0))", "x")], "cluster_id int, geometry string, note string")
    clusters.save(df, f"{tmp_path}/g", "geojson")
    got = {x["properties"]["cluster_id"]: x for x in (json.loads(r.value) for r in spark.read.text(f"{tmp_path}/g").collect())}
    shape = got[1]["geometry"]
    assert got[1]["type"] == "Feature" and shape["type"] == "MultiPolygon" and [len(r) for r in shape["coordinates"][0]] == [13, 5] or [len(r) for r in shape["coordinates"][0]] == [5, 5]
    assert sum(ring_area(r) for r in polygons(shape)) == 800
    assert got[2]["geometry"] == {"type": "Polygon", "coordinates": [[[0, 0], [100, 0], [5, -5.5], [0, 0]]]} and got[1]["properties"]["note"] is None


def test_few_edges_in_one_task(spark):
    edges = [(i, i + 1) for i in range(0, 400) if i % 40] + [(7, 7), (1 << 60, -5)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert sorted(map(tuple, connected_components(df, small=1000).collect())) == sorted(map(tuple, connected_components(df).collect()))
    assert connected_components(df.limit(0), small=10).count() == 0


def test_clusters_need_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session())


def test_concave_hulls(spark):
    g = np.random.default_rng(4)
    bow = np.array([p for p in g.uniform(0, 10, (900, 2)) if not (3 < p[0] < 7 and p[1] > 3)])  # a U
    ring = concave_hull(bow, 1.5)
    assert ring_area(ring) < 0.85 * ring_area(concave_hull(bow, 1e9)) and len({tuple(p) for p in ring.tolist()}) == len(ring)
    inside = Strips(edges_of([ring])).inside(*bow.T)
    on_ring = np.array([tuple(p) in {tuple(q) for q in ring.tolist()} for p in bow.tolist()])
    assert (inside | on_ring).all() and not Strips(edges_of([ring])).inside([5.0], [8.0])[0]
    e = edges_of([ring])
    for k in range(len(e)):  # no edge crosses another
        assert not _cross(e[k, :2], e[k, 2:], e[:, :2], e[:, 2:]).any()
    df = frame(spark, [(i, float(a), float(b), 1) for i, (a, b) in enumerate(bow)])
    area = study_area(df, 1, "concave,concavity=1.5")
    assert area.bounds == pytest.approx((*bow.min(0), *bow.max(0))) and shares(df, [1], area, "exact").count() == len(bow)
    assert study_area(df.limit(2), 1, "concave").inside(df.limit(2)).count() == 2


def test_degrees_of_areas_and_exports(spark):
    box = [(3.0, 50.0), (3.01, 50.0), (3.01, 50.01), (3.0, 50.01)]
    zone = api.Zone(31, True)
    spot = api.draw_random_coords(spark, 40, box, crs="EPSG:4326", random_seed=2, x="lon", y="lat").collect()
    assert len(spot) == 40 and all(2.9999 < r.lon < 3.0101 and 49.9999 < r.lat < 50.0101 for r in spot)
    assert len(api.draw_random_coords(spark, 30, HOLED, random_seed=1).where("x > 150").collect()) > 0
    a, b, c, d = api.local_bounds((3.0, 50.0, 3.01, 50.01), *zone)
    assert a == pytest.approx(500000) and c - a == pytest.approx(717, abs=1) and d - b == pytest.approx(1112, abs=1)
    holed = {"type": "Polygon", "coordinates": [box, [(3.002, 50.002), (3.004, 50.002), (3.004, 50.004)]]}
    local = api.local_polygon(holed, *zone)
    assert [len(p) for p in local["coordinates"]] == [2]
    df = spark.createDataFrame([(1, 3.005, 50.005, 1), (2, 3.02, 50.005, 2)], "pid bigint, lon double, lat double, v bigint")
    got = {r.pid: r["valid_area_share_50"] for r in api.radius_search(df, 50, "v", crs="EPSG:4326", x="lon", y="lat", study_area=holed, area_weight="exact").collect()}
    assert got == {1: pytest.approx(1), 2: 0}
    wkt = spark.createDataFrame([(500000.0, 5538630.0, "POLYGON ((500000.0 5538630.0, 500717.0 5538630.0, 500000.0 5539742.0))")], "centroid_x double, centroid_y double, geometry string")
    back = api.unproject(wkt, zone).first()
    corner = [float(x) for x in back.geometry.removeprefix("POLYGON ((").split(",")[1].split()]
    assert back.centroid_x == pytest.approx(3) and corner[0] == pytest.approx(3.01, abs=1e-4) and corner[1] == pytest.approx(back.centroid_y, abs=1e-5)
    x, y = api.degrees_arrays([500717.0], [5538630.0], *zone)
    assert (x[0], y[0]) == pytest.approx(tuple(corner))


def test_earlier_names_of_options(spark, pts):
    with pytest.warns(DeprecationWarning, match="exclude_pt_itself"):
        a = api.radius_search(pts, 20, "v", exclude_pt_itself=True, silent=True).collect()
    assert a == api.radius_search(pts, 20, "v", exclude_self=True).collect()
    with pytest.warns(DeprecationWarning):
        found = api.detect_cluster_cells(pts, 20, "v", n_random_points=100, spacing=10, queen_contingency=2, border_dist_threshold=5, min_cluster_share_after_convex=0.1, k_th_percentile=90)
    want = api.detect_cluster_cells(pts, 20, "v", null_distribution=100, cell_size=10, contingency=(2, 1), merge_dist=(None, 5), min_cluster_share=(0.05, 0.0, 0.1), k=90)
    assert found.clusters["v_cluster_sum_20"].collect() == want.clusters["v_cluster_sum_20"].collect()
    with pytest.raises(TypeError):
        api.radius_search(pts, 20, "v", nonsense=1)


def test_described_cells(spark, pts):
    grid = grids.build_grid(pts, 20)
    cells = grids.cell_aggregate(pts, grid, "v")
    one = cells.limit(1).select("row", "col", F.lit(3).alias("cluster_id"))
    got = grids.described(grids.full_grid(cells, grid), grid, {"a": one, "b": one}).collect()
    assert len(got) == grid.n_x * grid.n_y and sum(r.cluster_id_a == 3 == r.cluster_id_b for r in got) == 1
    assert all(r.centroid_x == pytest.approx(grid.xmin + (r.col + 0.5) * 20) and r.geometry.startswith("POLYGON ((") for r in got)
    assert "20" in grid.info(cells) and str(cells.count()) in grid.info(cells)
    flat = grids.build_grid(pts, 20, size_y=5)
    count = {(r.row, r.col): r.v for r in grids.cell_aggregate(pts, flat, "v", "count").collect()}
    assert sum(count.values()) == 200 and max(r for r, _ in count) < flat.n_y and flat.n_y > 3 * grid.n_y
    assert all((math.floor((r.y - flat.ymin) / 5), math.floor((r.x - flat.xmin) / 20)) in count for r in pts.collect())
    with pytest.raises(ValueError):
        clusters.build_clusters(pts.withColumn("cluster", F.lit(True)), flat, "cluster", "v")
    some = grids.aggregate_to_grid(pts, "v", 20, {"v": lambda c: F.max(F.col(c) * 2)}).collect()
    assert {(r.cell_row, r.cell_col): r.v for r in some} == {(r.row, r.col): 2 * r.m for r in grid.assign(pts).groupBy("row", "col").agg(F.max("v").alias("m")).collect()}


def test_repeated_places_cost_no_pairs(spark):
    """Copies of each point count in full, but the cells don't get finer nor the joins longer by them."""
    g = random.Random(8)
    rows = [(i, float(g.randrange(0, 60)), float(g.randrange(0, 60)), g.randrange(1, 9)) for i in range(80)]
    once = frame(spark, rows)
    copies = once.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(24)))).select((F.col("pid") + F.col("k") * 1000).alias("pid"), "x", "y", (F.col("v") + F.col("k")).alias("v"))
    assert radius.look_at(copies, 10, "x", "y", ["v"]).crowd == radius.look_at(once, 10, "x", "y", ["v"]).crowd
    got = {r.pid: r for r in api.radius_search(copies, 10, "v", ["sum", "count"], exclude_self=True).collect()}
    for i, a, b, own in rows:
        near = [q[3] for q in rows if (q[1] - a) ** 2 + (q[2] - b) ** 2 <= 100]
        want = 25 * sum(near) + 300 * len(near)
        for k in (0, 24):
            assert (got[i + k * 1000].v_sum_10, got[i + k * 1000].v_cnt_10) == (want - own - k, 25 * len(near) - 1)
    assert len(got) == 2000


@pytest.mark.parametrize("whole", [True, False])
def test_strips_match_brute_force(whole):
    """Borders on lattice points, several radii (0 too), negative values and sums of over 64 bits."""
    g = np.random.default_rng(1)
    place = (lambda n: g.integers(-20, 40, n).astype(float)) if whole else (lambda n: g.random(n) * 60 - 7.3)
    for n, m, radii in ((300, 3000, [5.0]), (100, 40_000, [0.0, 2.5, 10.0]), (5, 1, [10.0])):
        x, y, ux, uy = place(n), place(n), place(m), place(m)
        v = g.integers(-1000, 1000, m)
        wide = v.astype(float) ** 2 * 1e15
        got = strips.disk_sums(x, y, ux, uy, [np.ones(m, np.int64), v, wide], radii)
        d2 = (x[:, None] - ux) ** 2 + (y[:, None] - uy) ** 2
        for (count, total, far), r in zip(got, radii, strict=True):
            near = d2 <= r * r
            assert (count == near.sum(1)).all() and (total == near @ v).all() and far == pytest.approx(near @ wide, rel=1e-12)


def test_dense_tiles_are_summed_by_strips(spark, monkeypatch):
    """The same results as by joins, from tiles that are dealt out too."""
    g = random.Random(9)
    df = frame(spark, [(i, float(g.randrange(0, 90)), float(g.randrange(0, 90)), g.randrange(-9, 900)) for i in range(500)] + [(900, None, 1.0, 5), (901, 400.0, float("nan"), 5)])
    searches = [([5, 20], ["sum", "count", "kurtosis"]), ([(0, 5), (5, 20)], "sum")]
    run = lambda r, stat: sorted(map(tuple, api.radius_search(df, r, "v", stat, exclude_self=True).collect()), key=lambda q: q[0])
    joined = [run(*s) for s in searches]
    monkeypatch.setattr(radius, "DENSE", 1.0)
    plan = api.radius_search(df, 20, "v")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_COL")
    monkeypatch.setattr(radius, "HOT", 100)
    for s, want in zip(searches, joined, strict=True):
        for a, b in zip(run(*s), want, strict=True):
            assert a[:1] + a[3:] == pytest.approx(b[:1] + b[3:], rel=1e-9, nan_ok=True)


@pytest.mark.parametrize("rows", [1, 400, 9000])
def test_transforms_match_brute_force(rows):
    """Exact sums on the lattice: border points, several radii (0 too), negative values and sums of over 64 bits."""
    g = np.random.default_rng(2)
    place = lambda n: np.unique(g.integers(-30, 90, (n, 2)), axis=0).astype(float).T
    (x, y), (ux, uy) = place(200), place(rows)
    v = g.integers(-(1 << 40), 1 << 40, len(ux))
    wide = np.rint(v.astype(float) ** 2 / 7)
    radii = [0.0, 2.5, 10.0]
    got = raster.disk_sums(x, y, ux, uy, [np.ones(len(ux), np.int64), v, wide], radii)
    d2 = (x[:, None] - ux) ** 2 + (y[:, None] - uy) ** 2
    for (count, total, far), r in zip(got, radii, strict=True):
        near = d2 <= r * r
        assert (count == near.sum(1)).all() and (total == near @ v).all()
        assert far == pytest.approx([float(sum(map(int, wide[k]))) for k in near], rel=1e-15)


def test_transforms_only_where_they_pay():
    """Work by transforms is that of the lattice; fractions, far coordinates and few places are left to strips."""
    u = np.stack(np.meshgrid(np.arange(60.0), np.arange(60.0))).reshape(2, -1)
    pays = lambda x, y, r=10.0: raster.pays(x, y, *u, 2, [r], strips.count(len(u[0])))
    assert pays(*u) and not pays(u[0] + 0.5, u[1]) and not pays(u[0], u[1] + 2.0**60)
    assert not pays(u[0][:1], u[1][:1]) and not pays(*u, 1e6) and not pays(u[0] + math.inf, u[1])


def test_dense_lattices_are_summed_whole(spark, monkeypatch):
    """Whole coordinates, with a dense tile: the same results as by joins, and parts only where there are many more points."""
    g = random.Random(4)
    rows = [(i, g.randrange(0, 80), g.randrange(0, 80), g.randrange(-9, 900)) for i in range(3000)]
    df = spark.createDataFrame(rows, "pid bigint, x bigint, y bigint, v bigint")
    x, y = (np.array(c, float) for c in zip(*{q[1:3] for q in rows}, strict=True))
    assert raster.pays(x, y, x, y, 5, [5.0, 20.0], strips.count(len(x)))
    run = lambda: sorted(map(tuple, api.radius_search(df, [5, 20], "v", ["sum", "count", "kurtosis"], exclude_self=True).collect()))
    monkeypatch.setattr(radius, "DENSE", 1e9)
    joined = run()
    monkeypatch.setattr(radius, "DENSE", 1.0)
    for hot in (1000, 100):
        monkeypatch.setattr(radius, "HOT", hot)
        plan = api.radius_search(df, [5, 20], "v")._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInPandas" in plan and ("_salt" in plan) == (hot == 100)
        for a, b in zip(run(), joined, strict=True):
            assert a[:8] == b[:8] and a == pytest.approx(b, rel=1e-9, nan_ok=True)


def test_fourth_powers_of_wide_ranges_are_whole():
    """Kurtosis of millions of points with values in the hundred thousands is left to strips or transforms, not to joins."""
    assert radius.Look(1000.0, 1, 36_000_000, {"v": (False, 0.0, 540_000.0, 270_000.0)}).whole("v", 270_000.0, 4)
    g = np.random.default_rng(5)
    u = np.unique(g.integers(0, 40, (900, 2)), axis=0).astype(float).T
    wide = np.rint(g.standard_normal(len(u[0])) * 2.0**110)
    near = ((u[0][:, None] - u[0]) ** 2 + (u[1][:, None] - u[1]) ** 2) <= 49
    want = [float(sum(int(q) for q in wide[k])) for k in near]
    for found in (strips, raster):
        assert found.disk_sums(*u, *u, [wide], [7.0])[0][0] == pytest.approx(want, rel=1e-12, abs=2.0**70)
