"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radspark.plans.storage import drop, materialize


def smallest_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, in order, and the smallest node of the component of each."""
    node, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    i, j = place[: len(u)], place[len(u) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for k in (i, j):
            np.minimum.at(new, label[k], low)
            np.minimum.at(new, k, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return node, node[label]
        label = new


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = 0) -> DataFrame:
    """Columns ``node, component`` (smallest node of the component) for every node of an edge.

    Each round every node joins its first neighbour (or itself) in the order of a hash that changes every two rounds, and
    edges are carried over to the nodes that were joined.  The last node of a component is never joined, so rounds end;
    rounds are expected (not proved) to grow with the logarithm of the number of nodes.  Round tables go to the shared folder.
    Loops and repeated edges are allowed; an empty edge table gives an empty result.  Tables of at most ``small`` edges (two long
    integers each) go through one task instead of many rounds.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    left = materialize(one.union(one.select("v", "u")).where("u is not null and v is not null").distinct(), "edges")
    if small and left.limit(2 * small + 1).count() <= 2 * small:

        def solve(frames):
            every = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype="int64"), *frames])
            node, label = smallest_labels(every["u"].to_numpy(np.int64), every["v"].to_numpy(np.int64))
            yield pd.DataFrame({"node": node, "component": label})

        labels = materialize(left.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInPandas(solve, "node bigint, component bigint"), "labels")
        drop(left)
        return labels
    joins = []
    while not joins or not left.isEmpty():
        key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(joins) // 2)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        first = left.groupBy("u").agg(F.min(key("v")).alias("_v")).withColumn("_u", key("u"))
        to = materialize(first.select(F.col("u").alias("node"), F.least("_u", "_v")["n"].alias("to")), "joins")
        joins.append(to)
        ends = left.where("u <> v").join(to.select(F.col("node").alias("u"), F.col("to").alias("_u")), "u")
        ends = ends.join(to.select(F.col("node").alias("v"), F.col("to").alias("_v")), "v").where("_u <> _v")
        old, left = left, materialize(ends.select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct(), "edges")
        drop(old)
    done = [left, *joins]
    labels = joins.pop()
    while joins:
        tops = labels.select(F.col("node").alias("to"), F.col("to").alias("_top"))
        labels = joins.pop().join(tops, "to", "left").select("node", F.coalesce("_top", "to").alias("to"))
    labels = materialize(labels, "labels")
    least = materialize(labels.groupBy("to").agg(F.min("node").alias("component")), "least")  # a table: the join can be split
    found = materialize(labels.join(least, "to").select("node", "component"), "labels")
    drop(*done, labels, least)
    return found
