"""Mix sources to target weights: hash-random order in each source, distributed prefix sums, cut at the exact budget.

Every row gets a random key: the leading bits of md5(seed, doc_id), those of md5(text), then both in full.  The leading bits make
``BUCKETS`` buckets of one source and ``PARTS`` parts of each, so the texts of one repeated id, or without an id, lie in many parts.
Running sums over buckets and over a bucket's parts give each part its offset, a window inside the part gives each row its own, so
the largest task holds one part, not one source.  A source takes whole epochs while its budget allows and then rows in key order; the
row at the cut gives exactly the words that are left.

Null texts and texts without words have size 0 and give nothing; a null source is a source of its own and sorts last; repeated
rows count one by one, in one part.  Texts of any length count whole; an empty table gives an empty result.  Columns beside
doc_id, text and source aren't read; ``mixed_documents`` keeps them all, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radspark.llm._text import WORD
from radspark.plans.storage import materialize

WEIGHTS = (5, 2, 1)
BUCKETS, PARTS = 1 << 9, 1 << 5


def _key(value, seed: str = ""):
    """60 bits of an md5 as a long; DuckDB computes the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), value)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0) -> DataFrame:
    """Budget of each source. ``sizes``: one row per source with _source, _none, source_size.

    Sources in order of size / weight: the first k stop at ``most`` times their size, the others share the rest by weight,
    for the smallest k at which none is above.  The windows run over one row per source.
    """
    by_name, by_ratio = Window.orderBy("_none", "_source"), Window.orderBy("_ratio", "_rank")
    up, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    sized = (
        sizes.withColumn("_rank", F.row_number().over(by_name))
        .withColumn("_w", w.cast("double"))
        .withColumn("_cap", most * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_pot", share * F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_pot") - F.coalesce(F.sum("_cap").over(up), F.lit(0.0))) / F.sum("_w").over(rest))
    )
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(everything)["_level"]
    return sized.withColumn("_lambda", level).select(
        "_source", "_none", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_lambda") * F.col("_w"), F.col("_cap"))).alias("target")
    )


def _placed(docs: DataFrame, columns: tuple[str, ...], share: float, weights: tuple[int, ...], most: float, seed: str) -> DataFrame:
    """``columns`` as _keep_..., size, source_size, target and taken of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [f"_keep_{c}" for c in columns]
    rows = docs.select(
        *(F.col(c).alias(k) for c, k in zip(columns, kept, strict=True)),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.coalesce(F.col("source"), F.lit("")).alias("_source"),
        F.col("source").isNull().alias("_none"),
        _key(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed).alias("_key"),
        _key(text).alias("_tie"),
    )
    # the keys have 60 bits
    leading = lambda c, n: F.shiftright(c, 60 - (n.bit_length() - 1)).cast("int")
    rows = rows.withColumns({"_bucket": leading("_key", BUCKETS), "_part": leading("_tie", PARTS)})
    source, bucket = ["_source", "_none"], ["_source", "_none", "_bucket"]
    # a small table, read three times: at most BUCKETS * PARTS rows for each source
    parts = materialize(rows.groupBy(*bucket, "_part").agg(F.sum("size").alias("_sum")), "ranges")
    sums = parts.groupBy(*bucket).agg(F.sum("_sum").alias("_sum"))
    budget = targets(sums.groupBy(*source).agg(F.sum("_sum").alias("source_size")), share, weights, most)

    def earlier(by: list[str], order: list[str], value: str):
        """Sum of what comes before: over buckets of a source, parts of a bucket, rows of a part, so that no window holds more."""
        return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    buckets = sums.withColumn("_before", earlier(source, ["_bucket"], "_sum")).drop("_sum").join(budget, source)
    offsets = parts.withColumn("_offset", earlier(bucket, ["_part"], "_sum")).drop("_sum").join(buckets, bucket)
    placed = rows.withColumn("_inside", earlier([*bucket, "_part"], ["_key", "_tie"], "size")).join(offsets, [*bucket, "_part"])
    budget = F.floor(F.col("target") + 1e-6)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - whole * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_before") - F.col("_offset") - F.col("_inside")))
    return placed.select(*kept, "size", "source_size", F.col("target").cast("double"), (whole * F.col("size") + cut).cast("long").alias("taken"))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, taken of every row."""
    some = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))
    found = _placed(some, ("doc_id", "source", "text_hash"), share, weights, most, seed)
    return found.withColumnsRenamed({f"_keep_{c}": c for c in ("doc_id", "source", "text_hash")})


def mixed_documents(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mixture itself with the columns of ``docs``: a row for each epoch, the last one cut after its last taken word."""
    found = _placed(docs, tuple(docs.columns), share, weights, most, seed)
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    copies = found.where("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    words = F.col("taken") - (F.col("_copy") - 1) * F.col("size")
    text = F.col("_keep_text")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), words.cast("int")), "")
    copies = copies.withColumn("_keep_text", F.when(words < F.col("size"), head).otherwise(text))
    out = {c: F.col(f"_keep_{c}") for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.length("_keep_text").cast(docs.schema["n_chars"].dataType)
    return copies.select(*(v.alias(c) for c, v in out.items()))
