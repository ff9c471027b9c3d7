import importlib
import math
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from radspark import api
from radspark.functions.geometry import convex_hull, disk_share, inside, utm, utm_inverse
from radspark.operators import clusters
from radspark.operators.radius import same_place
from radspark.plans import grid as grids
from radspark.plans.components import connected_components
from radspark.plans.spec import cluster_id, column_name, parse_merge_dist, parse_r
from radspark.queries import oracle_sql, queries

rng = random.Random(3)
POINTS = [(i, rng.randrange(-1000, 1000), rng.randrange(-1000, 1000), rng.randrange(1, 50)) for i in range(300)]
POINTS += [(900, 3000, 3000, 7), (901, 3003, 3004, 5), (902, 3003, 3004, 2)]


@pytest.fixture(scope="module")
def pts(spark):
    return spark.createDataFrame(POINTS, "pid bigint, x bigint, y bigint, v bigint").repartition(3)


def around(p, r, own=True):
    return [q[3] for q in POINTS if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= r * r and (own or q[0] != p[0])]


def test_statistics_match_brute_force(pts):
    stats = ["sum", "count", "mean", "variance", "std", "cv", "skewness", "kurtosis"]
    got = {r.pid: r for r in api.radius_search(pts, 150, "v", stats).collect()}
    for p in POINTS:
        v = np.array(around(p, 150), float)
        m, s = v.mean(), v.std()
        z = (v - m) / s if s > 1e-9 else v * math.nan
        want = [v.sum(), len(v), m, s * s, s, s / m, (z**3).mean(), (z**4).mean() - 3]
        for name, w in zip(("sum", "cnt", "avg", "var", "std", "cv", "skw", "krt"), want, strict=True):
            assert got[p[0]][f"v_{name}_150"] == pytest.approx(w, rel=1e-6, abs=1e-6, nan_ok=True)


def test_border_bands_and_exclude_self(pts):
    assert {r.pid: r.v_sum_5 for r in api.radius_search(pts, 5, "v").where("pid >= 900").collect()} == {900: 14, 901: 14, 902: 14}
    got = api.radius_search(pts, [(0, 100), (100, 200)], "v", exclude_self=True).collect()
    for r in got:
        p = next(q for q in POINTS if q[0] == r.pid)
        a, b = sum(around(p, 100, False)), sum(around(p, 200, False))
        assert (r.v_sum_0_100, r.v_sum_100_200) == (a, b - a)
    w = api.radius_search(pts, [(0, 100, 3), (100, 200, 1)], "v").where("pid = 900").first()
    assert w.v_sum_wgt == pytest.approx(0.75 * 14)
    assert {r.pid: r.v_sum_0 for r in same_place(pts, "v").where("pid >= 900").collect()} == {900: 7, 901: 7, 902: 7}
    assert api.radius_search(pts.limit(0), 5, "v").count() == 0


def test_errors_and_names(pts):
    with pytest.raises(ValueError):
        api.radius_search(pts, 0, "v")
    with pytest.raises(ValueError):
        api.radius_search(pts, 5, "missing")
    with pytest.raises(ValueError):
        api.radius_search(pts.withColumn("v_sum_5", F.lit(1)), 5, "v")
    with pytest.raises(ValueError):
        api.radius_search(pts, [(0, 5)], "v", ["sum", "count"])
    assert column_name("v", "sum", parse_r(2.5), 0) == "v_sum_2p5"
    assert cluster_id("v_cluster_sum_5") == "v_cluster_id_sum_5" and cluster_id("a_cluster") == "a_cluster_id"
    assert parse_merge_dist((1, None)) == [(1, None)]


def test_nan_spreads_to_neighbours_only(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, float("nan")), (2, 1.0, 0.0, 1.0), (3, 99.0, 0.0, 2.0)], "pid bigint, x double, y double, v double")
    got = {r.pid: r.v_sum_5 for r in api.radius_search(df, 5, "v").collect()}
    assert math.isnan(got[1]) and math.isnan(got[2]) and got[3] == 2.0


def test_contiguity_and_clusters(spark):
    flagged = [(0, 0), (1, 1), (1, 2), (5, 5), (9, 0), (9, 2)]
    rows = [(i, c * 10 + 5, r * 10 + 5, 10 + i, True) for i, (r, c) in enumerate(flagged)] + [(99, 15, 95, 3, False)]
    df = spark.createDataFrame(rows, "pid bigint, x bigint, y bigint, v bigint, cluster boolean")
    g = grids.build_grid(df, 10, bounds=(0, 0, 100, 100))
    parts = clusters.contiguity(clusters.seed_cells(df, g, "cluster", "v")).collect()
    assert len({r.component for r in parts}) == 4
    table, cells = clusters.build_clusters(df, g, "cluster", "v", merge_dist=(None, 10), min_cluster_share=0)
    got = table.orderBy("cluster_id").collect()
    assert [r.n_cells for r in got] == [4, 3, 1] and got[0].total == 33.0 and got[0].area == 400.0
    assert {(r.row, r.col) for r in cells.collect()} == {*flagged, (0, 1), (9, 1)}
    assert all(r.geometry.startswith("MULTIPOLYGON") for r in got)


def test_filled_cells_have_their_totals_whatever_the_bound(spark, monkeypatch):
    """A ring of 20 flagged cells around 16 others with a value each, under a bound that the ring just meets."""
    monkeypatch.setattr(clusters, "MOST", 20)
    flagged = {(r, c) for r in range(6) for c in range(6) if r in (0, 5) or c in (0, 5)}
    rows = [(r * 6 + c, c * 10 + 5, r * 10 + 5, 1 + r * 6 + c, (r, c) in flagged) for r in range(6) for c in range(6)]
    df = spark.createDataFrame(rows, "pid bigint, x bigint, y bigint, v bigint, cluster boolean")
    table, cells = clusters.build_clusters(df, grids.build_grid(df, 10, bounds=(0, 0, 60, 60)), "cluster", "v")
    assert [(r.n_cells, r.total) for r in table.collect()] == [(36, sum(r[3] for r in rows))] and cells.count() == 36


def test_geometry(spark):
    ring = convex_hull(np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)]))
    assert len(ring) == 4
    assert disk_share([2, 0, 0, 50], [2, 2, 0, 0], 1, ring) == pytest.approx([1, 0.5, 0.25, 0])
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 1.0)], "pid bigint, x double, y double")
    assert [r.pid for r in df.where(inside([tuple(map(float, p)) for p in ring])).collect()] == [1]
    e, n = utm("x", "y", 31)
    far = df.select("pid", "x", "y", e.alias("e"), n.alias("n"))
    lon, lat = utm_inverse("e", "n", 31)
    for r in far.select("x", "y", lon.alias("lon"), lat.alias("lat")).collect():
        assert (r.lon, r.lat) == pytest.approx((r.x, r.y), abs=1e-9)
    mid = spark.createDataFrame([(3.0, 0.0)], "x double, y double").select(e.alias("e"), n.alias("n")).first()
    assert tuple(mid) == pytest.approx((500000, 0))


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "radspark.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "radius_sum" in entry.queries() and "pipeline" not in entry.queries() and entry.oracle_sql()
    sys.modules.pop("__spark_entry__")


def test_components_of_a_long_path(spark):
    """A shuffled path of 1,000 nodes, a path in order, a star, a loop and repeated edges."""
    path = random.Random(5).sample(range(1 << 40), 1000)
    star = [(1 << 50, (1 << 50) + i) for i in range(1, 50)]
    edges = [*zip(path, path[1:]), *((-i, -i - 1) for i in range(1, 300)), *star, star[0][::-1], (7 << 50, 7 << 50), (None, 5)]
    random.Random(6).shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = dict.fromkeys(path, min(path)) | dict.fromkeys(range(-300, 0), -300) | {1 << 50 | i: 1 << 50 for i in range(50)} | {7 << 50: 7 << 50}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
