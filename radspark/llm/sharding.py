"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring is cut into ``2**ring_bits`` cells.  A row's cell comes from the hash of its doc_id (of its text where doc_id is
null), and it belongs to the first virtual node at or after its cell.  Shards hold ``floor`` or ``ceil`` of rows / shards;
rows beyond a full shard continue clockwise to the next virtual node whose shard has room.  Only the number of rows of each
cell (at most ``2**ring_bits`` rows whatever the input) reaches the driver, which walks the ring once and returns, for each
cell, the rank intervals that go to each shard.  Ranks and slots come from a window within a cell; in a crowded cell, as many
texts of one repeated doc_id make it, from one within each of ``PARTS`` parts by text.

Null texts count 0 bytes and have checksum 0; texts of any length are measured whole; rows of equal hash are ranked by doc_id,
checksum and size, and repeated rows, which are alike in all of these, are placed one by one; an empty table gives an empty result.  A
kept column with the name of a result (in any case) gets underscores before its name.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radspark.llm._columns import fresh

#: Cells of more rows than HOT and than CROWD times the mean are ranked in PARTS parts.
HOT, CROWD, PARTS = 1_000_000, 8, 64
RESULT = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "home_shard"]


def ring(n_shards: int, vnodes: int, ring_bits: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    at = []
    for s in range(n_shards):
        for v in range(vnodes):
            x = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
            at.append((x, s))
    return [(x >> (64 - ring_bits), s) for x, s in sorted(at)]


def walk(counts: dict[tuple[int, int], int], n_shards: int, vnodes: int, ring_bits: int) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, part, first rank, end rank, shard, slot of the first) intervals so that no shard exceeds its capacity.

    counts: rows of each cell and part.
    """
    nodes = ring(n_shards, vnodes, ring_bits)
    cells = [c for c, _ in nodes]
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    filled, out = [0] * n_shards, []
    for (cell, part), n in sorted(counts.items()):
        done, v = 0, bisect_left(cells, cell)
        while done < n:
            shard = nodes[v % len(nodes)][1]
            take = min(n - done, room[shard] - filled[shard])
            if take > 0:
                out.append((cell, part, done, done + take, shard, filled[shard]))
                filled[shard] += take
                done += take
            v += 1
    return out


def shard(docs: DataFrame, n_shards: int = 8, vnodes: int = 128, ring_bits: int = 14, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard of every row. Law ``rows``: counts at most one apart.

    keep: further columns of ``docs`` to carry, after doc_id.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        *(F.col(c).alias(f"_keep_{c}") for c in keep),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), text)).alias("_h"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS)).cast("int").alias("_part"),
    ).withColumn("_cell", F.shiftrightunsigned("_h", 64 - ring_bits).cast("int"))
    counts = {(r["_cell"], 0): r["n"] for r in rows.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    hot = [c for (c, _), n in counts.items() if n > max(HOT, CROWD * sum(counts.values()) >> ring_bits)]
    # a row's part counts in crowded cells only: texts of one repeated id are ranked in several tasks
    rows = rows.withColumn("_part", F.when(F.col("_cell").isin(hot), F.col("_part")).otherwise(0)) if hot else rows.withColumn("_part", F.lit(0))
    if hot:
        parts = rows.where(F.col("_cell").isin(hot)).groupBy("_cell", "_part").agg(F.count("*").alias("n")).collect()
        counts = {k: n for k, n in counts.items() if k[0] not in hot} | {(r["_cell"], r["_part"]): r["n"] for r in parts}
    plan = walk(counts, n_shards, vnodes, ring_bits)
    nodes = ring(n_shards, vnodes, ring_bits)
    cells = [c for c, _ in nodes]
    told = json.dumps([[*x, nodes[bisect_left(cells, x[0]) % len(nodes)][1]] for x in plan])
    intervals = (
        spark.range(1)
        .select(F.explode(F.from_json(F.lit(told), "array<array<bigint>>")).alias("x"))
        .select(*(F.col("x")[k].alias(n) for k, n in enumerate(("_c", "_p", "_from", "_to", "shard", "_slot", "home_shard"))))
    )
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell", "_part").orderBy("_h", "doc_id", "text_crc32", "size")) - 1)
    return ranked.join(
        F.broadcast(intervals), (F.col("_cell") == F.col("_c")) & (F.col("_part") == F.col("_p")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    ).select(
        "doc_id",
        *(F.col(f"_keep_{c}").alias(fresh(RESULT, c)[0]) for c in keep),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int"),
        (F.col("_slot") + F.col("_rank") - F.col("_from")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("home_shard").cast("int"),
    )
