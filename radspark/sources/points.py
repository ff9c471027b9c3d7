"""Point views of tables and null points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of one call of a generator of coordinates.
CHUNK = 10_000

# SQL of the integer point views.
VIEWS = {
    "events": "select event_id as pid, cast(timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts) as bigint) as x, cast(round(value * 100) as bigint) as y, user_id as v from {t}",
    "orders": "select o_orderkey as pid, cast(floor(o_totalprice / 10) as bigint) as x, cast(datediff(o_orderdate, date'1995-01-01') * 20 as bigint) as y, o_custkey as v from {t}",
    "part": "select p_partkey as pid, cast(round(p_retailprice * 10) as bigint) as x, cast(p_size * 20 as bigint) as y, cast(p_size as bigint) as v from {t}",
    "customer": "select c_custkey as pid, cast(round(c_acctbal * 100) as bigint) as x, (c_custkey * 7919) % 100003 * 10 as y, cast(c_nationkey as bigint) as v from {t}",
}


def points(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.sql(VIEWS[table].replace("{t}", "{df}"), df=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def uniform(seed: int, what: str, salt: str = "") -> Column:
    """A number in [0, 1) from md5(seed, salt, what): the same for the same id, whatever the partitions or the engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}{salt}"), F.col(what).cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def random_points(spark: SparkSession, n: int, area, seed: int = 0, generator=None) -> DataFrame:
    """nid, x, y: the first n of the draws with ids 0, 1, ... that lie in the study area; n rows.

    Draws are uniform in the area's bounding box, by ``uniform``.  generator: (m, rng) gives m rows of x, y instead; it is
    called for each ``CHUNK`` ids with a generator seeded by (seed, chunk), so that draws don't depend on partitions.
    """
    a, b, c, d = map(float, area.bounds)
    many = n
    for _ in range(12):
        if generator is None:
            drawn = spark.range(many).select(
                F.col("id").alias("nid"), (F.lit(a) + uniform(seed, "id", "x") * F.lit(c - a)).alias("x"), (F.lit(b) + uniform(seed, "id", "y") * F.lit(d - b)).alias("y")
            )
        else:
            drawn = _generated(spark, -(-many // CHUNK), seed, generator)
        inside = area.inside(drawn)
        last, found = _nth(inside, n, max(CHUNK, many // CHUNK))
        if last is not None:
            return inside.where(F.col("nid") <= last)
        many = int(min(many * 64, many * n / found * 1.1 + 1000)) if found else many * 16
    raise ValueError("the study area is too small a part of its bounding box")


def _nth(rows: DataFrame, n: int, block: int) -> tuple[int | None, int]:
    """The n-th smallest nid, if there are as many, and the number of rows: counts of blocks of ids, then the ids of one block."""
    which = F.floor(F.col("nid") / block).cast("long")
    before = 0
    for b, c in sorted(rows.groupBy(which.alias("b")).agg(F.count("*").alias("c")).collect()):
        if before + c >= n:
            ids = sorted(r[0] for r in rows.where(which == b).select("nid").collect())
            return (ids[n - before - 1] if n else -1), before + c
        before += c
    return (None if n else -1), before


def _generated(spark: SparkSession, chunks: int, seed: int, generator) -> DataFrame:
    def run(frames):
        for f in frames:
            for k in f["id"]:
                xy = np.asarray(generator(CHUNK, np.random.default_rng((seed, int(k)))), float)
                yield pd.DataFrame({"nid": np.arange(CHUNK) + int(k) * CHUNK, "x": xy[:, 0], "y": xy[:, 1]})

    return spark.range(chunks).mapInPandas(run, "nid bigint, x double, y double")
