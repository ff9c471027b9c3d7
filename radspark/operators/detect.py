"""Null distribution, thresholds and cluster labels of points."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radspark.operators.radius import POWERS, look_at, radius_search
from radspark.operators.study_area import Area, parse_weight, shares, study_area
from radspark.plans.spec import cluster_flag, parse_r, stat_name
from radspark.plans.storage import materialize
from radspark.sources.points import random_points

AREA, NULL_POINTS, PERCENTILE = "buff_cells,min_pts=1", 100_000, 99.5


class Detection(NamedTuple):
    """Points with aggregates and flags; flag, column, k and threshold (a row each); the null points with their aggregates."""

    points: DataFrame
    thresholds: DataFrame
    null: DataFrame


def percentiles(columns: list[str], k) -> list[float]:
    """k for each column: one number for all, or a list, repeated."""
    ks = [k] * len(columns) if isinstance(k, (int, float)) else [k[i % len(k)] for i in range(len(columns))]
    if any(not 0 < x < 100 for x in ks):
        raise ValueError("k must lie between 0 and 100")
    return ks


def thresholds(null: DataFrame, columns: list[str], k) -> DataFrame:
    """One row: the k-th percentile (linear interpolation) of each column. k: a number or one for each column."""
    return null.agg(*(F.percentile(F.col(c).cast("double"), F.lit(x / 100)).alias(c) for c, x in zip(columns, percentiles(columns, k), strict=True)))


def null_points(pts: DataFrame, null, area: Area, seed: int) -> DataFrame:
    """nid, x, y of a number of points drawn in the area, or of a table: its nid, x and y, or its first two columns."""
    if isinstance(null, int):
        return materialize(random_points(pts.sparkSession, null, area, seed), "null")  # three joins read them
    if {"nid", "x", "y"} <= set(null.columns):
        return null.select("nid", "x", "y")
    x, y = null.columns[:2]
    return null.select(F.monotonically_increasing_id().alias("nid"), F.col(x).alias("x"), F.col(y).alias("y"))


def detect(
    pts: DataFrame, r, c=(), stat="sum", *, pid: str = "pid", null_distribution=NULL_POINTS, area=AREA, area_weight: str | None = None, cell_size: float | None = None,
    k=PERCENTILE, random_seed: int = 0, exclude_self: bool = True, pts_target: DataFrame | None = None, suffix: str | None = None, overwrite: bool = False,
) -> Detection:
    """Aggregates of ``pts`` (pid, x, y, ...) and of null points, and a flag for each aggregate above the null's k-th percentile.

    The first statistic is tested, others are only added.  null_distribution: how many points to draw in the study area, or a
    table of them.  area_weight divides the aggregates of both by the share of each disk inside the area.  The null points
    aren't among the target's, so nothing of their own is taken from them.  Thresholds are a one-row plan; flags compare with
    scalar subqueries, so nothing is collected.
    """
    radii, stats = parse_r(r), [stat_name(s) for s in ([stat] if isinstance(stat, str) else stat)]
    values = [c] if isinstance(c, str) else list(c)
    target = pts if pts_target is None else pts_target
    variant, fraction, keep_raw = parse_weight(area_weight)
    spot = None
    if variant or isinstance(null_distribution, int):
        spot = study_area(target, radii.distinct[-1], area, cell_size)
    null = null_points(pts, null_distribution, spot, random_seed).withColumnRenamed("nid", pid)
    share = (lambda p: shares(p, [d for d in radii.distinct if d > 0], spot, variant, fraction, pid, target)) if variant else (lambda p: None)
    summed = [v for v in values if v in target.columns] if any(POWERS[s] for s in stats) else []
    look = look_at(target, radii.distinct[-1] or 1.0, "x", "y", summed)
    observed = radius_search(pts, r, values, stats, pid=pid, exclude_self=exclude_self, pts_target=pts_target, suffix=suffix, overwrite=overwrite, share=share(pts), keep_raw=keep_raw, look=look)
    at_null = radius_search(null, r, values, stats[0], pid=pid, pts_target=target, suffix=suffix, share=share(null), look=look)
    columns = [n for n in at_null.columns if n not in (pid, "x", "y") and not n.startswith("valid_area_share_")]
    found = thresholds(at_null, columns, k)
    tested = values or ["count"]
    per = max(1, len(columns) // len(tested))
    flags = {cluster_flag(n, tested[min(i // per, len(tested) - 1)], stats[0] if values else "count", radii): n for i, n in enumerate(columns)}
    told = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.lit(n).alias("column"), F.lit(float(q)).alias("k"), F.col(n).alias("threshold")) for (f, n), q in zip(flags.items(), percentiles(columns, k), strict=True))))
    flagged = observed.withColumns({flag: F.coalesce(F.col(n) > found.select(F.col(n)).scalar(), F.lit(False)) for flag, n in flags.items()})
    return Detection(flagged, found.select(told.alias("t")).select("t.*"), at_null)


def detect_cluster_pts(pts: DataFrame, r, c=(), stat="sum", *, keep_cols: bool | None = True, **options) -> DataFrame:
    """The points of ``detect``. keep_cols: False leaves out the aggregates, None only the shares of disks."""
    found = detect(pts, r, c, stat, **options)
    flags = {row for row in found.points.columns if row not in pts.columns and "cluster" in row}
    added = [n for n in found.points.columns if n not in pts.columns and n not in flags]
    if keep_cols is None:
        added = [n for n in added if n.startswith("valid_area_share_")]
    return found.points if keep_cols else found.points.drop(*added)


def distribution(found: Detection, column: str) -> DataFrame:
    """kind (observed or null), value and share of points at or below it: the data behind a plot of the two distributions."""
    out = None
    for kind, df in (("observed", found.points), ("null", found.null)):
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("_n"))
        # sums over ranges of values, so that no task needs all of them
        ranged = counts.repartitionByRange("value").withColumn("_part", F.spark_partition_id())
        inside = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sums = ranged.groupBy("_part").agg(F.sum("_n").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        total = counts.agg(F.sum("_n").alias("_n"))
        one = ranged.withColumn("_sum", F.sum("_n").over(inside)).join(F.broadcast(sums.drop("_m")), "_part")
        one = one.select(F.lit(kind).alias("kind"), "value", ((F.col("_sum") + F.col("_before")) / total.select("_n").scalar()).alias("share"))
        out = one if out is None else out.union(one)
    return out

