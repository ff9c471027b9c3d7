"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus, in DataFrame operations only.

Word unigrams and bigrams of every document are hashed to ``2 * BUCKETS`` buckets and counted, once for all documents (raw)
and once for the trusted ones: all rows labelled ``quality = 1``.  A document's score is the mean log-ratio of its buckets, so
it doesn't depend on length; it passes if the score is at least ``threshold``.  The smoothed ratio of every bucket counts: a
bucket with few expected trusted hits has a ratio near 0.  Nothing is drawn at random.

A shuffled join by id flags the trusted texts, alike at every size; else each scan keeps a document in its row: counts meet in
one aggregate over buckets, and the finished ratios, an array of fixed length, come back as a scalar subquery.  Null texts have
no words; a document without words scores 0 and fails the base rule.  Texts of any length are measured whole, repeated rows one
by one; an empty table gives an empty result, and without trusted rows every ratio is at most 0.  A score equal to the threshold
passes.  Columns beside doc_id, text and the quality label aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
SPACES = r"[\x20\x09-\x0D]+"
#: Mean log-ratio in nats from which a document is kept.
THRESHOLD = -0.1
#: Pseudo-counts.
SMOOTH = 20.0


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, _text, _w (words), _h (their 64-bit hashes) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    some = docs.select(*keep, text.alias("_text")).withColumn("_w", F.filter(F.split("_text", SPACES), lambda w: w != ""))
    return some.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))


def buckets() -> Column:
    h = F.col("_h")
    one = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)))
    two = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(BUCKETS)) + BUCKETS)
    return F.concat(one, two)


def log_ratios(docs: DataFrame, labels: DataFrame, smooth: float = SMOOTH) -> DataFrame:
    """One row: an array with the log-ratio of each bucket."""
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id", F.lit(0).cast("bigint").alias("_salt"), F.lit(1).alias("_t")).distinct()
    # rows without an id are dealt out by their text; the ids, not the texts, are what a task holds in memory
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)
    flagged = docs.select("doc_id", "text", salt.alias("_salt")).join(trusted.hint("shuffle_hash"), ["doc_id", "_salt"], "left")
    counts = (
        words(flagged, "_t")
        .select("_t", F.explode(buckets()).alias("_b"))
        .groupBy("_b")
        .agg(F.count("*").alias("_raw"), F.count("_t").alias("_good"))
    )
    spark = docs.sparkSession
    full = spark.range(2 * BUCKETS).withColumnRenamed("id", "_b").join(counts, "_b", "left").fillna(0, ["_raw", "_good"])
    return full.agg(
        F.sort_array(F.collect_list(F.struct("_b", "_raw", "_good"))).alias("_all"), F.sum("_raw").alias("_nr"), F.sum("_good").alias("_ng")
    ).select(F.transform("_all", lambda x: _ratio(x["_good"], x["_raw"] * F.col("_ng") / F.greatest(F.col("_nr"), F.lit(1)), smooth)).alias("_llr"))


def _ratio(good: Column, expected: Column, smooth: float) -> Column:
    """Log-ratio of trusted to expected count, both smoothed."""
    return F.log((good + smooth) / (expected + smooth))


def repeated_words() -> Column:
    """Words inside 3-word windows that occur twice or more in the row. ``_g``: the windows' hashes."""
    order = F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    marked = _let(
        order,
        lambda s: F.transform(
            s,
            lambda x, j: F.when(
                F.coalesce((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"]), F.lit(False))
                | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
                x["i"],
            ),
        ),
    )
    at = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"]
    return F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0)).otherwise(covered).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _buckets of every row."""
    h = F.col("_h")
    windows = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    some = words(docs, "doc_id").select("doc_id", "_text", "_w", "_h", windows.alias("_g"), lines.alias("_l"))
    return some.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words().alias("n_repeat_words"),
        buckets().alias("_buckets"),
    )


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, smooth: float = SMOOTH) -> DataFrame:
    """doc_id, the base figures, base_failed, log_ratio and kept of every row."""
    ratios = log_ratios(docs, labels, smooth).scalar()
    # One use of the subquery's alias, so that the optimizer puts it in its place and rows don't carry the array.
    scored = measure(docs).withColumn("_llr", ratios)
    scored = scored.select("*", F.aggregate("_buckets", F.lit(0.0), lambda a, b: a + F.get("_llr", b.cast("int"))).alias("_sum")).drop("_llr")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ratio = F.when(F.size("_buckets") > 0, F.col("_sum") / F.size("_buckets")).otherwise(F.lit(0.0))
    return (
        scored.withColumn("log_ratio", ratio)
        .withColumn("base_failed", failed)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & (F.col("log_ratio") >= threshold)).alias("kept"), "log_ratio",
        )
    )
