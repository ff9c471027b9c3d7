"""The registered radius and detection queries where places are dense: no joins of point pairs, and the results of their SQL."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from radspark.operators import radius
from radspark.queries import oracle_sql, queries

NAMES = [
    "radius_skewness", "radius_list", "radius_two_columns", "radius_multi_stat", "detect_pts_bands", "radius_mean", "radius_bands", "radius_std",
    "radius_sum", "radius_variance", "detect_weighted", "radius_count", "radius_exclude_self", "detect_default", "cluster_cells",
]


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """1,500 events in a square of 1,600: over 100 places in each cell of the radius."""
    rng, n = np.random.default_rng(8), 1500
    ts = np.datetime64("2024-01-01", "us") + rng.integers(0, 1600, n) * np.timedelta64(60, "s")
    events = pd.DataFrame({"event_id": np.arange(n), "ts": ts, "user_id": rng.integers(0, 1500, n), "event_type": "view", "value": rng.integers(0, 1600, n) / 100, "props": "{}"})
    folder = tmp_path_factory.mktemp("dense")
    events.to_parquet(folder / "events.parquet", coerce_timestamps="us", index=False)
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_dense_places_take_no_pairs(spark, dense, name, monkeypatch):
    seen = []
    plain = radius._by_strips
    monkeypatch.setattr(radius, "_by_strips", lambda *a: seen.append(1) or plain(*a))
    found = queries()[name](spark, dense)
    # a detection sums around its points and around its null points
    assert len(seen) == (2 if name[:6] in ("detect", "cluste") else 1)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{dense}/events.parquet'")
    want = con.execute(oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert len(got) == len(want) > 0
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert all(a == pytest.approx(b, rel=1e-9, abs=1e-9, nan_ok=True) if isinstance(b, float) and not math.isnan(b) else a == b for a, b in zip(g, w, strict=True))
