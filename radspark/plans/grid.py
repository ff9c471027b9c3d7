"""Output grid: scalars on the driver, cells as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: guard against grids of too many cells.
MOST_CELLS = 50_000_000


@dataclass(frozen=True)
class Grid:
    xmin: float
    ymin: float
    size: float
    n_x: int
    n_y: int
    size_y: float | None = None  #: height of a cell, where it isn't as high as wide

    @property
    def high(self) -> float:
        return self.size_y or self.size

    def row(self, y: str = "y") -> Column:
        return F.floor((F.col(y) - F.lit(self.ymin)) / F.lit(self.high)).cast("long")

    def col(self, x: str = "x") -> Column:
        return F.floor((F.col(x) - F.lit(self.xmin)) / F.lit(self.size)).cast("long")

    def assign(self, pts: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        return pts.withColumns({"row": self.row(y), "col": self.col(x)})

    def centroid(self) -> tuple[Column, Column]:
        return F.lit(self.xmin) + (F.col("col") + 0.5) * self.size, F.lit(self.ymin) + (F.col("row") + 0.5) * self.high

    def wkt(self) -> Column:
        x0, y0 = F.lit(self.xmin) + F.col("col") * self.size, F.lit(self.ymin) + F.col("row") * self.high
        x1, y1 = x0 + self.size, y0 + self.high
        point = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
        return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0)), F.lit("))"))

    def square(self) -> Grid:
        """The grid itself; clusters and study areas need cells as high as wide."""
        if self.high != self.size:
            raise ValueError("cells must be as high as wide here")
        return self

    def info(self, cells: DataFrame | None = None) -> str:
        """Extent, cells and, for a table of cells with points, how many these are and what they hold."""
        lines = [f"{self.n_y} rows x {self.n_x} columns of cells of {self.size:g} x {self.high:g}", f"x from {self.xmin:g} to {self.xmin + self.n_x * self.size:g}, y from {self.ymin:g} to {self.ymin + self.n_y * self.high:g}"]
        if cells is not None:
            lines += [f"{cells.count()} cells with points", f"columns: {', '.join(c for c in cells.columns if c not in ('row', 'col'))}"]
        return "\n".join(lines)


def build_grid(pts: DataFrame, size: float, x: str = "x", y: str = "y", bounds: tuple | None = None, size_y: float | None = None) -> Grid:
    """bounds: (xmin, ymin, xmax, ymax); the first two bind, the others only widen."""
    if size <= 0 or size_y is not None and size_y <= 0:
        raise ValueError("cell size must be positive")
    a, b, c, d = pts.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    if a is None:
        a = b = c = d = 0
    if bounds:
        a, b, c, d = bounds[0], bounds[1], max(bounds[2], c), max(bounds[3], d)
    n_x, n_y = math.floor((c - a) / size) + 1, math.floor((d - b) / (size_y or size)) + 1
    if n_x * n_y > MOST_CELLS:
        raise ValueError(f"{n_x * n_y} cells; at most {MOST_CELLS}")
    return Grid(a, b, size, n_x, n_y, size_y)


def cell_aggregate(pts: DataFrame, grid: Grid, c, agg: str = "sum", x: str = "x", y: str = "y") -> DataFrame:
    """row, col and one aggregate of each value column for cells with points."""
    if agg not in ("sum", "mean", "count"):
        raise ValueError("agg: sum, mean or count")
    c = [c] if isinstance(c, str) else list(c)
    f = {"sum": F.sum, "mean": F.avg, "count": F.count}[agg]
    return grid.assign(pts, x, y).groupBy("row", "col").agg(*(f(v).alias(v) for v in c))


def aggregate_to_grid(pts: DataFrame, c, size: float, agg="sum", x: str = "x", y: str = "y", bounds: tuple | None = None) -> DataFrame:
    """cell_x, cell_y (centres), cell_col, cell_row and the aggregates.

    agg: a name, a function from a column's name to an aggregate, or one of these for each column.
    """
    grid = build_grid(pts, size, x, y, bounds)
    c = [c] if isinstance(c, str) else list(c)
    how = agg if isinstance(agg, dict) else dict.fromkeys(c, agg)
    most = {"nunique": F.count_distinct, "first": F.first, "last": F.last, "var": F.var_samp, "skew": F.skewness}
    known = most | {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp, "median": lambda v: F.percentile(F.col(v).cast("double"), F.lit(0.5))}
    found = grid.assign(pts, x, y).groupBy("row", "col").agg(*((how[v] if callable(how[v]) else known[how[v]])(v).alias(v) for v in c))
    cx, cy = grid.centroid()
    return found.select(cx.alias("cell_x"), cy.alias("cell_y"), F.col("col").alias("cell_col"), F.col("row").alias("cell_row"), *c)


def full_grid(cells: DataFrame, grid: Grid) -> DataFrame:
    """Every cell of the grid, values 0 where there are none."""
    spark = cells.sparkSession
    every = spark.range(grid.n_y).select(F.col("id").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.n_x - 1).cast("long"))))
    return every.join(cells, ["row", "col"], "left").fillna(0)


def described(cells: DataFrame, grid: Grid, clusters: dict[str, DataFrame] | DataFrame | None = None) -> DataFrame:
    """``cells`` (row, col, values) with centroid_x, centroid_y, a cluster id for each table of cluster cells (0 for none) and geometry.

    clusters: one table (column cluster_id), or one for each name (columns cluster_id_name).
    """
    told = clusters if isinstance(clusters, dict) else {"": clusters} if clusters is not None else {}
    out = cells
    for name, table in told.items():
        c = f"cluster_id_{name}" if name else "cluster_id"
        out = out.join(table.select("row", "col", F.col("cluster_id").alias(c)), ["row", "col"], "left").fillna(0, [c])
    if not told:
        out = out.withColumn("cluster_id", F.lit(0))
    x, y = grid.centroid()
    values = [c for c in out.columns if c not in ("row", "col")]
    return out.select("row", "col", x.alias("centroid_x"), y.alias("centroid_y"), *values, grid.wkt().alias("geometry"))


def sparse_grid(cells: DataFrame, cluster_cells: DataFrame) -> DataFrame:
    """Cells with points or in a cluster; cluster_id 0 for none."""
    return cells.join(cluster_cells.select("row", "col", "cluster_id"), ["row", "col"], "full").fillna(0)


def spatial_stats(pts: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Number of points, bounding box and skewness of density (90th percentile of points in non-empty cells over their mean)."""
    grid = build_grid(pts, size, x, y)
    cells = grid.assign(pts, x, y).groupBy("row", "col").agg(F.count("*").alias("n"), F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d"))
    return cells.agg(
        F.sum("n").alias("n_points"), F.min("a").alias("xmin"), F.max("b").alias("xmax"), F.min("c").alias("ymin"), F.max("d").alias("ymax"),
        F.count("*").alias("n_cells"), F.percentile(F.col("n").cast("double"), F.lit(0.9)).alias("p90"), F.max("n").alias("most"),
    )


def spatial_summary(pts: DataFrame, radii: list[float], x: str = "x", y: str = "y", side: int = 8) -> DataFrame:
    """One row: extent, aspect, densest of side x side cells over the mean density, and for each radius its share of the extent,
    its diameter in such cells, and the 90th percentile of points in non-empty cells of its diameter over the mean density."""
    a, b, c, d, n = pts.agg(F.min(x), F.min(y), F.max(x), F.max(y), F.count("*")).first()
    wide, high = (float(c - a), float(d - b)) if n else (0.0, 0.0)
    size = wide * high

    def cells(n_x: int, n_y: int) -> DataFrame:
        place = lambda v, low, all_, k: F.least(F.lit(k - 1), F.floor((F.col(v) - F.lit(low)).cast("double") / F.lit(all_ or 1.0) * k))
        return pts.groupBy(place(x, a, wide, n_x).alias("i"), place(y, b, high, n_y).alias("j")).agg(F.count("*").alias("n"))

    def dense(counts: DataFrame, value, parts: int) -> float:
        return (counts.agg(value).first()[0] or 0) * parts / n if n and size else 1.0

    spans = [(max(int(wide / (2 * r)), 1), max(int(high / (2 * r)), 1)) for r in radii]
    spread = [dense(cells(*k), F.percentile(F.col("n").cast("double"), F.lit(0.9)), k[0] * k[1]) for k in spans]
    most = cells(side, side).agg(F.max("n")).first()[0] or 0
    far = max(wide, high) or 1.0
    row = (n, wide, high, size, wide / high if high else 1.0, float(most) * side * side / n if n and size else 1.0, int(most), [2.0 * r / far for r in radii], [2.0 * r / (wide / side or 1.0) for r in radii], spread)
    kinds = "n_points long, width double, height double, area double, aspect_ratio double, density_max_to_mean double, most_points long, radius_to_world array<double>, diameter_in_cells array<double>, density_skewness array<double>"
    return pts.sparkSession.createDataFrame([row], kinds)
