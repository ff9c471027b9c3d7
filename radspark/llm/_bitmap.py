"""A bitmap of fixed size over hashed keys: it lets Python scans drop most rows that a later exact join would drop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**BITS bits, 4 MB: what reaches the driver and the executors doesn't grow with the keys. A full bitmap only passes more.
BITS = 25


def bitmap(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = (
        keys.where(F.col(column).isNotNull())
        .select(F.shiftright(place, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int")).alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .collect()
    )
    out = np.zeros(1 << max(0, bits - 6), np.int64)
    for w, b in words:
        out[w] = b
    return out.view(np.uint64)


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit keys may be among the bitmap's."""
    bits = int(len(table)).bit_length() - 1 + 6
    place = keys >> np.uint64(64 - bits)
    return ((table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
