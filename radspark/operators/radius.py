"""Radius aggregation: tiles with a margin, sums of whole cells inside the disk, point pairs only in the cells that its border cuts.

The plane is cut into cells of a ``K``-th of the largest radius and tiles of ``TILE`` radii.  Source points are shuffled once by
tile, target points to every tile within reach (2.6 copies at most on average); all else happens inside a tile without another
shuffle.  A target cell that lies inside the disk of every point of a source cell gives its power sums as a whole, once for
each source cell; cells cut by the border of a disk are joined point by point.  All statistics, columns and radii come from
the same joins.  Points at the same place are one in all joins: target points are counted and summed by place first, and source
points get the sums of their place, so repeated places cost no pairs.  K follows from the mean number of places near a
place, so pairs grow with the border of a disk rather than its area.  Where places are ``DENSE`` and sums are exact in whole numbers, a tile's
places are summed by strips instead (see strips.py), with still less work for each place, or, where that is faster and all places have
whole coordinates, by transforms of the tile's lattice (see raster.py), whose work doesn't grow with the places.  Tiles with more than ``HOT`` source points are
salted: their places are dealt out, and their target points copied to each part.  As each part is a transform of its own, tables of whole
coordinates are salted from ``PARTS`` times as many.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from radspark.operators import raster, strips
from radspark.plans.spec import STATS, column_name, parse_r, stat_name

INTEGERS = ("byte", "short", "integer", "long")
POWERS = {"sum": 1, "count": 0, "mean": 1, "variance": 2, "std": 2, "cv": 2, "skewness": 3, "kurtosis": 4}
TILE, MOST_K, HOT = 4, 12, 200_000
#: Places per cell at which a finer grid stops to pay.
CROWD = 6.0
#: Places per cell of size r from which tiles are summed by strips.
DENSE = 100.0
#: Times ``HOT`` from which tiles are salted where a part costs a transform; points for each shuffle partition of a larger table.
PARTS, DEALT = 10, 50_000
_WIDER = 1 + 1e-9


def statistic(stat: str, n: Column, s: list[Column], shift: float = 0) -> Column:
    """From the count, the sum and the sums of higher powers of value - shift; NaN where it isn't defined."""
    nan = F.lit(float("nan"))
    if stat == "count":
        return n
    if stat == "sum":
        return s[0]
    e = [x.cast("double") / F.when(n != 0, n).cast("double") for x in s]
    m1 = e[0]
    if stat == "mean":
        return F.coalesce(m1, nan)
    mean, m1 = m1, m1 - F.lit(float(shift)) if shift else m1
    m2 = e[1] - m1 * m1
    if stat == "variance":
        return F.coalesce(m2, nan)
    std = F.sqrt(F.greatest(m2, F.lit(0.0)))
    if stat == "std":
        return F.coalesce(std, nan)
    if stat == "cv":
        return F.coalesce(std / F.when(mean != 0, mean), nan)
    good = F.when(m2 > 0, m2)
    if stat == "skewness":
        return F.coalesce((e[2] - F.lit(3.0) * m1 * e[1] + F.lit(2.0) * m1 * m1 * m1) / (good * F.sqrt(good)), nan)
    top = e[3] - F.lit(4.0) * m1 * e[2] + F.lit(6.0) * m1 * m1 * e[1] - F.lit(3.0) * m1 * m1 * m1 * m1
    return F.coalesce(top / (good * good) - F.lit(3.0), nan)


def _powers(v: Column, top: int, shift: float = 0) -> list[Column]:
    """v as it is, then the higher powers of v - shift in double, which can't overflow as integers do."""
    d = v.cast("double") - F.lit(float(shift)) if shift else v.cast("double")
    return [v, *(reduce(lambda a, _: a * d, range(p - 1), d) for p in range(2, top + 1))][:top]


def within(source: DataFrame, target: DataFrame, r: float, x: str = "x", y: str = "y", anti: bool = False) -> DataFrame:
    """The rows of ``source`` with (anti: without) a target point within r, the border included; nothing else about them changes."""
    s = float(r) * _WIDER if r else 1.0
    cell = lambda c: F.floor(F.col(c) / F.lit(s)).cast("long")
    step = F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))
    far = target.select(F.col(x).alias("_tx"), F.col(y).alias("_ty"), cell(x).alias("_cx"), cell(y).alias("_cy")).distinct()
    far = far.withColumn("_i", step).withColumn("_j", step).select("_tx", "_ty", (F.col("_cx") + F.col("_i")).alias("_cx"), (F.col("_cy") + F.col("_j")).alias("_cy"))
    dx, dy = (F.col(x) - F.col("_tx")).cast("double"), (F.col(y) - F.col("_ty")).cast("double")
    met = (cell(x) == F.col("_cx")) & (cell(y) == F.col("_cy")) & (dx * dx + dy * dy <= F.lit(float(r)) * F.lit(float(r)))
    return source.join(far, met, "left_anti" if anti else "left_semi")


def _number(c: str) -> Column:
    """A coordinate; NaN is none, so that the point is in no cell."""
    d = F.col(c).cast("double")
    return F.when(~F.isnan(d), d)


def offsets(k: int, radii: list[float]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Offsets of cells that some border cuts, and (i, j, mask of the radii that hold the cell) of those that none does."""
    cut, whole, most = [], [], radii[-1]
    units = [(d / most * k / _WIDER) ** 2 if most else 0.0 for d in radii]
    for i in range(-k - 1, k + 2):
        for j in range(-k - 1, k + 2):
            low = max(abs(i) - 1, 0) ** 2 + max(abs(j) - 1, 0) ** 2
            high = (abs(i) + 1) ** 2 + (abs(j) + 1) ** 2
            if any(u < high and (low < u or low == 0) for u in units):
                cut.append((i, j))
            elif mask := sum(1 << n for n, u in enumerate(units) if high <= u):
                whole.append((i, j, mask))
    return cut, whole


class Look(NamedTuple):
    """Mean number of places in a place's cell of size r, most points of a tile, points, and missing, least, largest and mean of each value column."""

    crowd: float
    largest: int
    n: int
    values: dict[str, tuple[bool, float, float, float]]

    def shift(self, v: str, whole: bool, top: int) -> float:
        """What to take from values before their powers are summed: nothing where sums of whole numbers are exact in double."""
        _, low, high, mean = self.values[v]
        if top < 2 or not math.isfinite(mean) or whole and self.n * max(abs(low), abs(high)) ** top < 1 << 53:
            return 0
        return float(math.floor(mean))


    def whole(self, v: str, shift: float, top: int) -> bool:
        """Whether sums of a column of whole numbers are exact in the parts of strips.py, and few parts do."""
        _, low, high, _ = self.values[v]
        return self.n * max(abs(low), abs(high)) < 1 << 62 and self.n * max(abs(low - shift), abs(high - shift)) ** top < 1 << 256


def look_at(target: DataFrame, r: float, x: str, y: str, values: list[str]) -> Look:
    """One pass over the target by places, cells and tiles."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(r) * _WIDER)).cast("long")
    tile = lambda c: F.floor(F.col(c) / F.lit(TILE)).cast("long")
    each = range(len(values))
    first = [q for i, v in enumerate(values) for q in (F.max(_missing(target, v)).alias(f"_b{i}"), F.min(v).alias(f"_l{i}"), F.max(v).alias(f"_h{i}"), F.sum(F.col(v).cast("double")).alias(f"_s{i}"))]
    again = [q for i in each for q in (F.max(f"_b{i}").alias(f"_b{i}"), F.min(f"_l{i}").alias(f"_l{i}"), F.max(f"_h{i}").alias(f"_h{i}"), F.sum(f"_s{i}").alias(f"_s{i}"))]
    places = target.groupBy(_number(x).alias("_x"), _number(y).alias("_y")).agg(F.count("*").alias("n"), *first)
    cells = places.groupBy(cell("_x").alias("cx"), cell("_y").alias("cy")).agg(F.sum("n").alias("n"), F.count("*").alias("m"), *again)
    tiles = cells.groupBy(tile("cx").alias("tx"), tile("cy").alias("ty")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(F.col("m").cast("double") * F.col("m")).alias("mm"), *again)
    got = tiles.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("mm").alias("mm"), F.max("n").alias("most"), *again).first()
    n = got["n"] or 0
    told = {v: (bool(got[f"_b{i}"]), float(got[f"_l{i}"] or 0), float(got[f"_h{i}"] or 0), float(got[f"_s{i}"] or 0) / max(n, 1)) for i, v in enumerate(values)}
    return Look(got["mm"] / got["m"] if n else 0.0, got["most"] or 0, n, told)


def _missing(df: DataFrame, v: str) -> Column:
    missing = F.col(v).isNull()
    return missing | F.isnan(v) if df.schema[v].dataType.typeName() in ("float", "double") else missing


def columns_with_nan(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that hold a null or NaN."""
    got = df.agg(*(F.coalesce(F.max(_missing(df, v)), F.lit(False)).alias(f"_{i}") for i, v in enumerate(columns))).first() if columns else ()
    return [v for v, b in zip(columns, got, strict=True) if b]


def _together(spark: SparkSession) -> None:
    """Joins on tile and cell of sides that are dealt out by tile need no further shuffle."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def disk_sums(source: DataFrame, target: DataFrame, radii: list[float], values: list[str], top: int, *, x: str, y: str, x_tgt: str, y_tgt: str, look: Look | None = None, shifts: tuple[float, ...] = (), whole_numbers: bool = False) -> DataFrame:
    """``source`` with _n_k and _s_k_p_i: count and sums of power p + 1 of values[i] within radii[k]; radii in order, the last over 0.

    ``values`` are columns of ``target``, numbers without nulls; powers over 1 are those of value - shifts[i].
    whole_numbers: all values are, and ``Look.whole`` holds for each.
    """
    _together(source.sparkSession)
    most = radii[-1]
    look = look or look_at(target, most, x_tgt, y_tgt, [])
    k = max(1, min(MOST_K, round(math.sqrt(look.crowd / CROWD))))
    side, wide = float(most) * _WIDER / k, TILE * k
    cut, whole = offsets(k, radii)
    cell = lambda c: F.floor(_number(c) / F.lit(side)).cast("long")
    tile = lambda c: F.floor(c / F.lit(wide)).cast("long")
    by = ["_tx", "_ty"]
    spot = {"_x": _number(x), "_y": _number(y)}
    src = source.withColumns(spot).withColumns({"_cx": cell("_x"), "_cy": cell("_y")}).withColumns({"_tx": tile(F.col("_cx")), "_ty": tile(F.col("_cy"))})
    power = [p for i, v in enumerate(values) for p in (q.alias(f"_p{n}_{i}") for n, q in enumerate(_powers(F.col(v), top, shifts[i] if shifts else 0)))]
    sums = [(n, i, f"_p{n}_{i}") for i in range(len(values)) for n in range(top)]
    tgt = target.select(_number(x_tgt).alias("_ux"), _number(y_tgt).alias("_uy"), *power).where("_ux is not null and _uy is not null").repartition("_ux", "_uy")
    tgt = tgt.groupBy("_ux", "_uy").agg(F.count("*").alias("_c"), *(F.sum(p).alias(p) for *_, p in sums)).withColumns({"_cx": cell("_ux"), "_cy": cell("_uy")})
    for c, t in (("_cx", "_tx"), ("_cy", "_ty")):
        tgt = tgt.withColumn(t, F.explode(F.sequence(tile(F.col(c) - F.lit(k + 1)), tile(F.col(c) + F.lit(k + 1)))))
    dense = whole_numbers and look.crowd > DENSE
    integers = all(df.schema[c].dataType.typeName() in INTEGERS for df, c in ((source, x), (source, y), (target, x_tgt), (target, y_tgt)))
    hot = HOT * PARTS if dense and integers else HOT
    if look.largest > hot:
        parts = src.groupBy("_tx", "_ty").agg(F.count("*").alias("_m")).where(F.col("_m") > hot).select("_tx", "_ty", F.ceil(F.col("_m") / hot).cast("int").alias("_m"))
        src = src.join(parts, ["_tx", "_ty"], "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_x", "_y"), F.col("_m")), F.lit(0)).cast("int")).drop("_m")
        tgt = tgt.join(parts, ["_tx", "_ty"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_m"), F.lit(1)) - 1))).drop("_m")
        by.append("_salt")
    # a count of their own for dense tiles: partitions joined by their bytes would put many of them into one task
    dealt = [max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), look.n // DEALT)] if dense and look.n > HOT else []
    src, tgt = src.repartition(*dealt, *by), tgt.repartition(*dealt, *by)
    at = [*by, "_cx", "_cy"]

    def moved(df: DataFrame, steps) -> DataFrame:
        """Rows for each offset, at the offset's cell; the own cell stays in _ox, _oy."""
        told = F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(s, "ijm"))) for s in steps)))  # noqa: B905
        return df.withColumnsRenamed({"_cx": "_ox", "_cy": "_oy"}).withColumn("_o", told).withColumns({"_cx": F.col("_ox") + F.col("_o.i"), "_cy": F.col("_oy") + F.col("_o.j")})

    names = [f"_n_{n}" for n in range(len(radii))] + [f"_s_{n}_{q}_{i}" for n in range(len(radii)) for q, i, _ in sums]
    if dense:
        one = src.select(*by, *spot).where("_x is not null and _y is not null").distinct()
        found = src.join(_by_strips(one, tgt, by, radii, sums).repartition(*dealt, *by).hint("shuffle_hash"), [*by, *spot], "left")
        return found.select(*source.columns, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names))

    near = moved(src.select(*spot, *at).where("_x is not null and _y is not null").distinct(), cut).join(tgt.hint("shuffle_hash"), at)
    dx, dy = F.col("_x") - F.col("_ux"), F.col("_y") - F.col("_uy")
    near = near.withColumn("_d2", dx * dx + dy * dy).where(F.col("_d2") <= F.lit(float(most)) * F.lit(float(most)))
    of, last = [], len(radii) - 1
    for n, d in enumerate(radii):
        inside = (lambda q: q) if n == last else (lambda q, d=d: F.when(F.col("_d2") <= F.lit(float(d)) * F.lit(float(d)), q))
        of.append(F.sum(inside(F.col("_c"))).alias(f"_n_{n}"))
        of += [F.sum(inside(F.col(p))).alias(f"_s_{n}_{q}_{i}") for q, i, p in sums]
    found = src.join(near.groupBy(*by, *spot).agg(*of).hint("shuffle_hash"), [*by, *spot], "left")
    if whole:
        cells = tgt.groupBy(*at).agg(F.sum("_c").alias("_n"), *(F.sum(p).alias(p) for *_, p in sums))
        inner = moved(src.select(*at).distinct(), whole).join(cells.hint("shuffle_hash"), at)
        of = []
        for n in range(len(radii)):
            inside = lambda q, n=n: F.when(F.col("_o.m").bitwiseAND(F.lit(1 << n)) != 0, q)
            of.append(F.sum(inside(F.col("_n"))).alias(f"_w_n_{n}"))
            of += [F.sum(inside(F.col(p))).alias(f"_w_s_{n}_{q}_{i}") for q, i, p in sums]
        inner = inner.groupBy(*by, "_ox", "_oy").agg(*of).withColumnsRenamed({"_ox": "_cx", "_oy": "_cy"})
        found = found.join(inner.hint("shuffle_hash"), at, "left")
    total = {c: (F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_w{c}"), F.lit(0))) if whole else F.coalesce(F.col(c), F.lit(0)) for c in names}
    return found.select(*source.columns, *(q.alias(c) for c, q in total.items()))


def _by_strips(spots: DataFrame, tgt: DataFrame, by: list[str], radii: list[float], sums: list[tuple[int, int, str]]) -> DataFrame:
    """Sums for each place of ``spots``; a group holds the places of one tile and the target's around it."""
    kinds = {c: spots.schema[c].dataType.simpleString() for c in by} | {"_x": "double", "_y": "double"}
    for n in range(len(radii)):
        kinds |= {f"_n_{n}": "bigint"} | {f"_s_{n}_{q}_{i}": "double" if q else "bigint" for q, i, _ in sums}

    def run(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if one.empty or other.empty:
            return pd.DataFrame({c: [] for c in kinds})
        values = [other[c].to_numpy() for c in ("_c", *(p for *_, p in sums))]
        places = [f[c].to_numpy() for f, c in ((one, "_x"), (one, "_y"), (other, "_ux"), (other, "_uy"))]
        told = raster.disk_sums(*places, values, radii) if raster.pays(*places, len(values), radii, strips.count(len(other))) else None
        told = told or strips.disk_sums(*places, values, radii)
        flat = {f"_n_{n}": told[n][0] for n in range(len(radii))} | {f"_s_{n}_{q}_{i}": told[n][k] for n in range(len(radii)) for k, (q, i, _) in enumerate(sums, 1)}
        return pd.DataFrame({c: np.asarray(one[c]) if c in one else flat[c] for c in kinds})

    return spots.groupBy(*by).cogroup(tgt.groupBy(*by)).applyInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def _needed(columns: list[str], have: list[str], what: str) -> None:
    if missing := [c for c in columns if c not in have]:
        raise ValueError(f"{what} has no column {', '.join(missing)}")


def contained(source: DataFrame, target: DataFrame, columns: list[str]) -> bool:
    """Whether every source row is one of the target's rows, judged by the columns (nulls are equal)."""
    some = target.select(*(F.col(c).alias(f"_t_{i}") for i, c in enumerate(columns))).distinct()
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_t_{i}")) for i, c in enumerate(columns)))
    return source.select(*columns).join(some, same, "left_anti").isEmpty()


def relation(a: DataFrame, b: DataFrame) -> str:
    """equal, subset, superset, overlap or disjoint: the distinct rows of ``a`` against those of ``b`` on their common columns."""
    columns = [c for c in a.columns if c in b.columns]
    if not columns:
        return "disjoint"
    one = a.select(*columns).distinct().withColumn("_a", F.lit(1))
    two = b.select(*(F.col(c).alias(f"_t_{i}") for i, c in enumerate(columns))).distinct().withColumn("_b", F.lit(1))
    same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"_t_{i}")) for i, c in enumerate(columns)))
    got = one.join(two, same, "full").agg(F.count("_a").alias("a"), F.count("_b").alias("b"), F.count(F.when(F.col("_a") == F.col("_b"), 1)).alias("both")).first()
    if not got["both"]:
        return "disjoint"
    return {(True, True): "equal", (True, False): "subset", (False, True): "superset"}.get((got["both"] == got["a"], got["both"] == got["b"]), "overlap")


def radius_search(
    pts: DataFrame, r, c=(), stat="sum", *, x: str = "x", y: str = "y", pid: str = "pid", exclude_self: bool = False,
    pts_target: DataFrame | None = None, x_tgt: str | None = None, y_tgt: str | None = None, suffix: str | None = None,
    overwrite: bool = False, share: DataFrame | None = None, keep_raw: bool = False, look: Look | None = None,
) -> DataFrame:
    """``pts`` with a column for each value column, statistic and radius, band or weighted band sum.

    pid: unique id of the points.  exclude_self: a point's own values don't count; with a target only if every point is one of
    the target's rows (coordinates and values), else a warning.  share: pid and _share_k for the k-th distinct radius over 0,
    the part of each disk inside the study area; counts and sums are divided by it (NaN if 0).  NaN values spread to the sums they belong
    to; a column with nulls is taken as double, and its nulls as NaN.  Points without coordinates have no neighbours.  look: what
    look_at says of the same target, largest radius and columns, if another search has asked already.
    """
    radii, stats = parse_r(r), [stat_name(s) for s in ([stat] if isinstance(stat, str) else stat)]
    c = [c] if isinstance(c, str) else list(c)
    if not c:
        c, stats = ["count"], ["count"]
    if len(stats) > 1 and "band" in radii.kind:
        raise ValueError("several statistics and bands can't be combined")
    target = pts if pts_target is None else pts_target
    x_tgt, y_tgt = x_tgt or x, y_tgt or y
    values = [v for v in c if v != "count" or v in target.columns]
    _needed([pid, x, y], pts.columns, "pts")
    _needed([x_tgt, y_tgt, *values], target.columns, "target")
    if words := [v for v in values if not isinstance(target.schema[v].dataType, NumericType)]:
        raise ValueError(f"no numbers: {', '.join(words)}")
    own = exclude_self
    if own and pts_target is not None:
        shared = [v for v in values if v in pts.columns]
        named = target.select(F.col(x_tgt).alias(x), F.col(y_tgt).alias(y), *(v for v in shared if v not in (x, y)))
        own = len(shared) == len(values) and contained(pts, named, list(dict.fromkeys([x, y, *shared])))
        if not own:
            warnings.warn("exclude_self: not every point is one of the target's; own values stay", stacklevel=2)
    names = [column_name(v, s, radii, k, suffix) for v in c for s in stats for k in range(len(radii.items))]
    if radii.kind == "wbands":
        names = [f"{v}{suffix}" if suffix else f"{v}_{STATS[stats[0]]}_wgt" for v in c]
    if clash := [n for n in names if n in pts.columns]:
        if not overwrite:
            raise ValueError(f"columns exist: {', '.join(clash)}; pass overwrite=True")
        pts = pts.drop(*clash)
    top = max(POWERS[s] for s in stats)
    distinct = radii.distinct
    most = distinct[-1] or 1.0
    summed = values if top else []
    look = look or look_at(target, most, x_tgt, y_tgt, summed)
    if missing := [v for v in summed if look.values[v][0]]:
        warnings.warn(f"nulls or NaN in {', '.join(missing)}", stacklevel=2)
    whole = {v: v not in missing and target.schema[v].dataType.typeName() in INTEGERS for v in summed}
    shift = {v: look.shift(v, whole[v], top) for v in summed}
    number = lambda v: F.col(v).cast("long") if whole[v] else F.coalesce(F.col(v).cast("double"), F.lit(float("nan")))
    clean = target.select(F.col(x_tgt).alias("_qx"), F.col(y_tgt).alias("_qy"), *(number(v).alias(f"_v{i}") for i, v in enumerate(summed)))
    reach = distinct if distinct[-1] else [*distinct, most]  # only coincident points: a search radius all the same
    found = disk_sums(pts, clean, reach, [f"_v{i}" for i in range(len(summed))], top, x=x, y=y, x_tgt="_qx", y_tgt="_qy", look=look, shifts=tuple(shift.values()), whole_numbers=all(whole[v] and look.whole(v, shift[v], top) for v in summed))
    if share is not None:
        found = found.join(share, pid, "left")
    weighted = {d: f"_share_{k}" for k, d in enumerate([d for d in distinct if d > 0])} if share is not None else {}

    def sums_at(k: int, d: float, v: str, raw: bool = False) -> tuple[Column, list[Column]]:
        weigh = (lambda q: q / F.when(F.col(weighted[d]) > 0, F.col(weighted[d]))) if d in weighted and not raw else (lambda q: q)
        n = F.col(f"_n_{k}") - (1 if own else 0)
        if v not in summed:
            return weigh(n), []
        i, mine = summed.index(v), _powers(number(v), top, shift[v]) if own else []
        return weigh(n), [weigh(F.col(f"_s_{k}_{p}_{i}") - mine[p] if own else F.col(f"_s_{k}_{p}_{i}")) for p in range(top)]

    out: dict[str, Column] = {}
    for v in c:
        for s in stats:
            at = {d: statistic(s, *sums_at(k, d, v), shift.get(v, 0)) for k, d in enumerate(distinct)}
            raw = {d: statistic(s, *sums_at(k, d, v, True), shift.get(v, 0)) for k, d in enumerate(distinct)}
            if "band" in radii.kind:
                parts = [at[b] - (at[a] if a > 0 else F.lit(0)) for a, b, _ in radii.items]
                if radii.kind == "bands":
                    out |= {column_name(v, s, radii, k, suffix): q for k, q in enumerate(parts)}
                else:
                    name = f"{v}{suffix}" if suffix else f"{v}_{STATS[s]}_wgt"
                    out[name] = reduce(lambda p, q: p + q, (F.lit(w) * q for q, (_, _, w) in zip(parts, radii.items, strict=True)))
            else:
                out |= {column_name(v, s, radii, k, suffix): at[b] for k, (_, b, _) in enumerate(radii.items)}
                if keep_raw and share is not None:
                    out |= {f"{column_name(v, s, radii, k, suffix)}_raw": raw[b] for k, (_, b, _) in enumerate(radii.items)}
    out |= {f"valid_area_share_{d:g}": F.col(q) for d, q in weighted.items()}
    return found.select(*(F.col(n) for n in pts.columns), *(q.alias(n) for n, q in out.items()))


def same_place(pts: DataFrame, c: str, stat: str = "sum", *, x: str = "x", y: str = "y", exclude_self: bool = False) -> DataFrame:
    """Radius 0: sum, count or mean over the points at exactly the same place; moment statistics are 0."""
    stat, here = stat_name(stat), Window.partitionBy(x, y)
    own = (F.lit(1), F.col(c)) if exclude_self else (F.lit(0), F.lit(0))
    n, s = F.count("*").over(here) - own[0], F.sum(c).over(here) - own[1]
    value = {"sum": s, "count": n, "mean": F.coalesce(s / F.when(n > 0, n), F.lit(0.0))}.get(stat, F.lit(0.0))
    return pts.withColumn(f"{c}_{STATS[stat]}_0", value)
